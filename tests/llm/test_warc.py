import gzip
import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from strandlake.llm import warc

SF = "/root/testdata/sf0.001"


def test_arc_lines_of_both_versions_and_declared_lengths():
    body = b"x\n2 http://fake 0.0.0.0 20010101000000 text/html 5\nmore\r\n\r\nWARC/1.0\r\n"
    for version in (1, 2):
        data = warc.arc_head(version, "20010203040506") + warc.arc_record("http://a b/é", "20010203040506", body, version) + warc.arc_record(None, "1999", b"", version)
        got = list(warc.arc_records(data))
        assert [b for _, b in got] == [body, b""]
        assert got[0][0]["url"] == "http://a%20b/%C3%A9" and got[1][0]["url"] == "-"
    page = warc.arc_head(1, "1997") + warc.arc_record("filedesc://a page", "1997", b"7 no description", 1)
    assert [(f["url"], b) for f, b in warc.arc_records(page)] == [("filedesc://a%20page", b"7 no description")]
    assert len(list(warc.arc_records(warc.arc_record("filedesc:x", "1997", b"text", 1)))) == 1
    old = b"http://a/with blank 1.2.3.4 19970101 text/html 3\nabc\n"
    assert next(warc.arc_records(old))[0]["url"] == "http://a/with blank"
    for bad in (b"http://a 1.2.3.4 1997 text/html 9\nabc\n", b"one two 3\nabc\n", b"no end"):
        with pytest.raises(ValueError):
            list(warc.arc_records(bad))


def test_dates():
    assert warc.iso("20010203040506") == "2001-02-03T04:05:06Z"
    assert warc.iso("1997") == "1997-01-01T00:00:00Z" and warc.iso("19971399") == "1997-01-01T00:00:00Z"
    assert warc.iso("20010231120000") == "2001-02-01T12:00:00Z" and warc.iso("20000229") == "2000-02-29T00:00:00Z" and warc.iso("00000000") == "0000-01-01T00:00:00Z"


def test_http_head_is_no_payload():
    r = warc.convert({"url": "u", "ip": "i", "date": "1997", "mime": "m"}, b"HTTP/1.0 200 OK\r\nA: b\r\n\r\nbody", 3)
    assert r[7] == b"body" and r[9] == hashlib.sha256(b"body").hexdigest()


def test_round_trip_of_odd_rows(spark):
    long = "<p>é😀\r\n\r\nWARC/1.0\r\n" * 20
    rows = [(5, "http://x", long, 1), (3, None, long, 1), (3, "http://y", long, 1), (9, "http://z", "short", 1), (8, "a b", "short", 1), (1, "u", None, 1), (2, "u", "", 1), (None, "u", long, 1), (7, "u", "z" * 3_000_000, 1), (10, "u", "HTTP/1.1 200 OK\r\n\r\n" + "q" * 200, 1), (11, "filedesc:p", "1 0 x", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest int").withColumns({c: F.lit(1) for c in ("arc", "uri", "first", "payload", "offset")})
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archived(df).collect()), key=str)
    n, h = len(long.encode()), hashlib.sha256(long.encode()).hexdigest()
    assert [x for x in got if x[2] == h] == sorted([(3, n, h, "response", None)] * 2 + [(5, n, h, "revisit", 3), (None, n, h, "response", None)], key=str)
    assert len(got) == len(rows) and sum(x[3] == "revisit" for x in got) == 1
    assert {x[0]: x[1] for x in got}[7] == 3_000_000 and {x[0]: x[1] for x in got}[10] == 219
    assert warc.archived(df.limit(0)).count() == 0


def test_record_is_fetched_by_its_offset(spark, tmp_path):
    df = spark.createDataFrame([(i, f"http://{i}", f"<p>{i}</p>" * 40) for i in range(50)], "page_id long, url string, html string")
    rows = warc.archived(df, path=str(tmp_path / "w")).collect()
    for r in rows[:5]:
        with open(tmp_path / "w" / r.archive, "rb") as f:
            f.seek(r.offset)
            found = list(warc.warc_records(f.read(r.length)))
        assert len(found) == 1 and found[0][0]["warc-record-id"] == r.record_id and f"<p>{r.page_id}</p>".encode() in found[0][1]
    whole = gzip.decompress((tmp_path / "w" / rows[0].archive).read_bytes())  # any gzip reader takes the archive
    assert len(list(warc.warc_records(whole))) == len(list(warc.warc_records((tmp_path / "w" / rows[0].archive).read_bytes())))


def test_query_matches_sql(spark):
    c = duckdb.connect()
    c.execute(f"create view pages as select * from '{SF}/pages.parquet'")
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    want = sorted(c.sql(warc.OP5_SQL).select(*cols).fetchall())
    assert sorted(tuple(r[k] for k in cols) for r in warc.op5_warc(spark, SF).collect()) == want
