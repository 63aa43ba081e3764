"""Legacy ARC archives to WARC: parse version-specific header lines and declared lengths, synthesise
identifiers, timestamps, types and digests, write WARC archives and read them back.

An ARC record is a header line and as many bytes as the line's last field declares. Version 1 lines
have five fields, version 2 lines ten; the archive's own first record tells which. Archives are
gzip, a member for each record, so that a record can be fetched by its offset. Spark's text sink
writes them: rows are whole members, and the sink's line end is an empty member.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from calendar import monthrange
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_path, table

LEAST = 100  # shorter payloads are stored again, not revisited
STRETCH = 8 << 20  # bytes after which a stretch of records ends
PER_FILE = 4  # stretches of an archive
END = b"\r\n\r\n"
NOTHING = gzip.compress(b"", mtime=0)
# The fields of the header lines of either version, and their names in a WARC record.
V1 = ("url", "ip", "date", "mime", "length")
V2 = ("url", "ip", "date", "mime", "status", "checksum", "location", "offset", "filename", "length")
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
RECORD = "page_id long, uri string, ip string, date string, mime string, status string, head binary, payload binary, payload_bytes long, digest string, record_id string"


def _field(value: str | None) -> str:
    """A header line's field: no blanks or control characters, never empty."""
    return quote(value or "-", safe="!#$%&'()*+,/:;=?@[]-._~") or "-"


def arc_record(uri: str | None, stamp: str, body: bytes, version: int, ip: str = "0.0.0.0", mime: str = "text/html", status: int = 200) -> bytes:
    head = [_field(uri), ip, stamp, mime]
    if version == 2:
        head += [str(status), hashlib.md5(body).hexdigest(), "-", "0", "pages.arc"]
    return " ".join([*head, str(len(body))]).encode() + b"\n" + body + b"\n"


def arc_head(version: int, stamp: str) -> bytes:
    fields = "URL IP-address Archive-date Content-type Archive-length" if version == 1 else "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
    body = f"{version} 0 strandlake\n{fields}\n".encode()
    return arc_record("filedesc://pages.arc", stamp, body, version, mime="text/plain")


def arc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, body) of each record of an archive, its own description left out.

    Only an archive's first record may be its description; the version is the one it declares. An
    archive without it is read by the number of fields of each line. Bodies are taken by declared length, so line breaks and
    header-like lines inside them do no harm. A declared length beyond the data is an error."""
    at, version, first = 0, 0, True
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        stop = data.find(b"\n", at)
        if stop < 0:
            raise ValueError("ARC header line without an end")
        line = data[at:stop].decode("utf-8", "replace").rstrip("\r").split(" ")
        names = {1: V1, 2: V2}.get(version) or (V2 if len(line) >= len(V2) else V1)
        if len(line) < len(names):
            raise ValueError(f"ARC header line of {len(line)} fields")
        extra = len(line) - len(names)  # blanks in a URL of an old archive
        fields = dict(zip(names, [" ".join(line[: extra + 1]), *line[extra + 1 :]], strict=True))
        if not re.fullmatch(r"[0-9]+", fields["length"]) or (end := stop + 1 + int(fields["length"])) > len(data):
            raise ValueError("ARC record whose declared length does not fit")
        body, at = data[stop + 1 : end], end
        if first and fields["url"].startswith("filedesc:") and (m := re.match(rb"([0-9]{1,4}) ", body)):
            version, first = int(m[1]), False
            continue
        first = False
        yield fields, body


def iso(stamp: str) -> str:
    """YYYYMMDD[hhmm[ss]] as a WARC date; fields that are missing or out of range, and days that the month lacks, fall to their least value."""
    digits = (re.sub(r"[^0-9]", "", stamp) + "0" * 14)[:14]
    y, *rest = int(digits[:4]), *(int(digits[i : i + 2]) for i in range(4, 14, 2))
    low, high = (1, 1, 0, 0, 0), (12, 31, 23, 59, 59)
    rest = [v if a <= v <= b else a for v, a, b in zip(rest, low, high, strict=True)]
    if rest[1] > monthrange(max(y, 1), rest[0])[1]:
        rest[1] = 1
    return f"{y:04}-{rest[0]:02}-{rest[1]:02}T{rest[2]:02}:{rest[3]:02}:{rest[4]:02}Z"


def split_http(body: bytes) -> tuple[bytes, bytes]:
    """(HTTP head with its blank line, payload); a body without an HTTP status line is all payload."""
    if body[:5] == b"HTTP/":
        m = re.search(rb"\r?\n\r?\n", body)
        if m:
            return body[: m.end()], body[m.end() :]
    return b"", body


def http_head(status: str, mime: str, length: int) -> bytes:
    return f"HTTP/1.1 {status} OK\r\nContent-Type: {mime}\r\nContent-Length: {length}\r\n\r\n".encode()


def convert(fields: dict[str, str], body: bytes, page_id: int | None) -> tuple:
    head, payload = split_http(body)
    date, digest = iso(fields["date"]), hashlib.sha256(payload).hexdigest()
    if not head:
        head = http_head(fields.get("status", "200"), fields["mime"], len(payload))
    record = uuid.uuid5(uuid.NAMESPACE_URL, f"{fields['url']} {date} {digest} {page_id}").urn
    return page_id, fields["url"], fields["ip"], date, fields["mime"], fields.get("status", "200"), head, payload, len(payload), digest, f"<{record}>"


def convert_arc(archives: DataFrame, id_col: str = "page_id", arc_col: str = "arc") -> DataFrame:
    """archives(id, binary ARC data) -> one row for each record, with what its WARC record needs."""
    names = [x.split()[0] for x in RECORD.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in RECORD.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, size = [], 0
            for page_id, arc in zip(b.column(0), b.column(1), strict=True):
                for fields, body in arc_records(arc.as_py() or b""):
                    held.append(convert(fields, body, page_id.as_py()))
                    size += len(body)
                    if size > STRETCH:
                        yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in held], schema=schema)
                        held, size = [], 0
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in held], schema=schema)

    return archives.select(F.col(id_col).cast("long").alias("page_id"), F.col(arc_col).alias("arc")).mapInArrow(run, RECORD)


def arc_of_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One small ARC archive a page, version 1 for even ids and 2 for odd ones: (page_id, arc). Null html is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, held, size = [], [], 0
            for page_id, url, html in zip(*b.columns, strict=True):
                i, page = page_id.as_py(), (html.as_py() or "").encode("utf-8", "surrogatepass")
                body = http_head("200", "text/html; charset=UTF-8", len(page)) + page
                stamp = (datetime(2001, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=(i or 0) % 600_000_000)).strftime("%Y%m%d%H%M%S")
                version = 2 if (i or 0) % 2 else 1
                ids.append(i)
                held.append(arc_head(version, stamp) + arc_record(url.as_py(), stamp, body, version))
                size += len(body)
                if size > STRETCH:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(held, pa.binary())], names=["page_id", "arc"])
                    ids, held, size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(held, pa.binary())], names=["page_id", "arc"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).mapInArrow(run, "page_id long, arc binary")


def with_type(records: DataFrame, least: int = LEAST) -> DataFrame:
    """Adds record_type and refers_to: of equal payloads of `least` bytes or more, the smallest page_id is the response.

    Only digests and ids are grouped, pre-aggregated; rows meet their digest's first id by a join
    whose large keys Spark can split."""
    first = records.where(F.col("payload_bytes") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    revisit = F.col("page_id") != F.col("first")
    return records.join(first, "digest", "left").withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisit, F.col("first")))


def warc_record(r: dict) -> bytes:
    """A record without the two line breaks that close it; a revisit keeps the HTTP head and leaves the payload out."""
    revisit = r["record_type"] == "revisit"
    block = r["head"] if revisit else r["head"] + r["payload"]
    head = [
        "WARC/1.0",
        f"WARC-Type: {r['record_type']}",
        f"WARC-Record-ID: {r['record_id']}",
        f"WARC-Date: {r['date']}",
        f"WARC-Target-URI: {r['uri']}",
        f"WARC-IP-Address: {r['ip']}",
        f"WARC-Payload-Digest: sha256:{r['digest']}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        *([f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page-ID: {r['refers_to']}"] if revisit else []),
        *([f"X-Page-ID: {r['page_id']}"] if r["page_id"] is not None else []),
        f"X-Payload-Length: {r['payload_bytes']}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + END + block


def info_record() -> bytes:
    block = b"software: strandlake\r\nformat: WARC File Format 1.0\r\n"
    return f"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <{uuid.uuid5(uuid.NAMESPACE_URL, 'strandlake').urn}>\r\nWARC-Date: 2001-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(block)}".encode() + END + block


def member(record: bytes) -> bytes:
    d = zlib.compressobj(5, zlib.DEFLATED, 31)
    return d.compress(record) + d.compress(END) + d.flush()


def write_warc(records: DataFrame, path: str) -> None:
    """Writes records (with type) as gzip WARC archives under path, a member for each record."""
    names = ["page_id", "uri", "ip", "date", "head", "payload", "payload_bytes", "digest", "record_id", "record_type", "refers_to"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [member(info_record())], 0
        some = False
        for b in batches:
            for i in range(b.num_rows):
                record = warc_record({n: b[n][i].as_py() for n in names})
                held.append(member(record))
                size, some = size + len(record), True
                if size > STRETCH:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["stretch"])
                    held, size, some = [member(info_record())], 0, False
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["stretch"])

    stretches = records.select(*names).mapInArrow(run, "stretch binary")
    stretches.select(F.col("stretch").cast("string").alias("value")).write.options(lineSep=NOTHING.decode("latin-1"), encoding="ISO-8859-1", maxRecordsPerFile=PER_FILE).text(path)


def members(data: bytes, step: int = 1 << 14) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of each gzip member; a plain archive is one."""
    if data[:2] != b"\x1f\x8b":
        if data:
            yield 0, len(data), data
        return
    at = 0
    while at < len(data):
        d, out, to = zlib.decompressobj(31), [], at
        while not d.eof:
            if to >= len(data):
                raise ValueError("gzip member without an end")
            out.append(d.decompress(data[to : to + step]))
            to += step
        end = min(to, len(data)) - len(d.unused_data)
        yield at, end - at, b"".join(out)
        at = end


def warc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record of an archive, gzip (any number of members) or plain.

    The headers hold the offset and length of the record's member too, under ' offset' and ' length'."""
    for start, length, part in members(data):
        at = 0
        while at < len(part):
            stop = part.find(END, at)
            if not part.startswith(b"WARC/", at) or stop < 0:
                raise ValueError("not a WARC record")
            headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in part[at:stop].decode("utf-8", "surrogateescape").split("\r\n")[1:])}
            end = stop + 4 + int(headers["content-length"])
            if part[end : end + 4] != END:
                raise ValueError("WARC record whose declared length does not fit")
            yield headers | {" offset": str(start), " length": str(length)}, part[stop + 4 : end]
            at = end + 4


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the archives under path: page_id, uri, date, record_id, record_type, payload_bytes, payload_digest, refers_to, archive (file name), offset and length of the record's member.

    Blocks' digests, and the payloads' of responses, are computed again; one that differs from its header is an error."""
    spec = "page_id long, uri string, date string, record_id string, record_type string, payload_bytes long, payload_digest string, refers_to long, archive string, offset long, length long"
    schema = pa.schema([(x.split()[0], pa.int64() if x.endswith("long") else pa.string()) for x in spec.split(", ")])

    def row(h: dict[str, str], block: bytes) -> dict:
        digest = h["warc-payload-digest"].partition(":")[2]
        size, revisit = int(h["x-payload-length"]), h["warc-type"] == "revisit"
        if hashlib.sha256(block).hexdigest() != h["warc-block-digest"].partition(":")[2]:
            raise ValueError("block digest differs")
        if not revisit:
            payload = split_http(block)[1]
            size = len(payload)
            if hashlib.sha256(payload).hexdigest() != digest:
                raise ValueError("payload digest differs")
        return {"page_id": int(h["x-page-id"]) if "x-page-id" in h else None, "uri": h["warc-target-uri"], "date": h["warc-date"], "record_id": h["warc-record-id"], "record_type": h["warc-type"], "payload_bytes": size, "payload_digest": digest, "refers_to": int(h["x-refers-to-page-id"]) if revisit else None, "offset": int(h[" offset"]), "length": int(h[" length"])}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                yield pa.RecordBatch.from_pylist([row(h, block) | {"archive": name} for h, block in warc_records(content.as_py()) if h["warc-type"] != "warcinfo"], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("archive"), "content").mapInArrow(run, spec)


def archived(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", path: str | None = None) -> DataFrame:
    """Pages as ARC, converted to WARC, written under path and read back: a row for each input row.

    Null html is an empty payload, a null url is '-', any other url (one that begins with filedesc:
    too) is a page's. Rows that repeat a page_id get records of their own; those of the smallest id
    are all responses. Null ids come back null and are never referred to. A record may be as large
    as Arrow lets a value be (2 GB). Other columns are not read. An empty table gives none."""
    path = path or shared_path(pages.sparkSession, "warc")
    records = convert_arc(arc_of_pages(pages, id_col, url_col, html_col))
    write_warc(with_type(records), path)
    return read_warc(pages.sparkSession, path)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH p AS (
  SELECT page_id, url, encode(coalesce(html, '')) AS body, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first FROM p WHERE octet_length(body) >= 100 GROUP BY ALL HAVING count(*) > 1
)
SELECT page_id, CAST(octet_length(body) AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
