"""Substring dedup by hashing units of text: lines, and runs of words between content-defined borders.

Units are normalised (lower case, blanks as one) and their digests grouped over the corpus; of equal
units the earliest (smallest doc_id, then place) stays. A stretch of repeated units that lie end to
end goes if it has at least `least` words; offsets into the original text are retained.

A border is the least value among WINDOW places; places where a sentence or line begins come before
all others. A run goes from each border to the first border or sentence end RUN or more words on. A
place's value is set by the two words after it, so whatever PASSAGE words two texts share, both
have a whole run of them in common: 2 * WINDOW + RUN + 2 <= PASSAGE.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

PASSAGE, WINDOW, RUN = 50, 16, 16
LEAST = RUN  # words of the shortest stretch that goes
HELD = 4 << 20  # bytes of text whose units are compared in a task before anything is shuffled
LAST = np.iinfo(np.int64).max  # the rank of a null doc_id
SURE = np.int64(np.iinfo(np.int64).min)
SPANS = "array<struct<s:int,e:int>>"
BLANK = np.zeros(256, dtype=bool)
BLANK[list(b" \t\n\r\x0b\x0c")] = True
STOP = np.zeros(256, dtype=bool)
STOP[list(b".!?")] = True
WORD = re.compile(r"[^ \t\n\r\x0b\x0c]+")
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def lowered(text: str) -> bytes:
    """In lower case, code point for code point."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(y if len(y := x.lower()) == 1 else x for x in text)
    return low.encode("utf-8", "surrogatepass")


class Powers:
    """Powers of an odd number and of its inverse modulo 2 ** 64."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            self.up, self.down = (np.cumprod(np.r_[np.uint64(1), np.full(n + 1, x, dtype=np.uint64)], dtype=np.uint64) for x in (self.base, self.inverse))
        return self.up[: n + 1], self.down[: n + 1]


POWERS = (Powers(0x2545F4914F6CDD1D), Powers(0x5851F42D4C957F2D))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * M2
    return x ^ (x >> np.uint64(29))


def range_digests(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit digests of the word sequences [a, b), from the words' own hashes h[word, 2]."""
    out = []
    for c, powers in enumerate(POWERS):
        up, down = powers.upto(len(h))
        sums = np.r_[np.uint64(0), np.cumsum(h[:, c] * down[:-1], dtype=np.uint64)]
        out.append(mixed((sums[b] - sums[a]) * up[a] + (b - a).astype(np.uint64) * M1))
    return out[0], out[1]


class Units:
    """Units of some texts: of unit i the text `doc`, its words [a, b) counted within that text, and its digest (d0, d1).

    They come by text and place; equal ones of one place are one."""

    def __init__(self, texts: list[str | None]):
        parts = [lowered(t or "") for t in texts]
        data = b"\n".join(parts) + b"\n"
        raw = np.frombuffer(data, dtype=np.uint8)
        blank = BLANK[raw]
        starts = np.flatnonzero(~blank & np.r_[True, blank[:-1]])
        ends = np.flatnonzero(blank & np.r_[False, ~blank[:-1]])
        n = len(starts)
        h = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, data.split())), dtype=np.uint64).reshape(-1, 2)
        begin = np.cumsum([0, *(len(p) + 1 for p in parts)])
        of = np.searchsorted(begin, starts, side="right") - 1
        first = np.searchsorted(of, np.arange(len(texts) + 1))  # the first word of each text, and the end
        line = np.searchsorted(np.flatnonzero(raw == 10), starts)
        line_start = np.r_[True, line[1:] != line[:-1]] if n else np.zeros(0, bool)
        line_end = np.r_[line_start[1:], True] if n else line_start
        stop = STOP[raw[ends - 1]] | line_end if n else line_start
        a, b = np.flatnonzero(line_start), np.flatnonzero(line_end) + 1
        run_a, run_b = self._runs(h, of, first, np.r_[True, stop[:-1]] if n else stop, stop)
        a, b = np.r_[a, run_a], np.r_[b, run_b]
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.zeros(0, bool)
        a, b = a[new], b[new]
        self.d0, self.d1 = range_digests(h, a, b)
        self.doc = of[a]
        self.a, self.b = a - first[self.doc], b - first[self.doc]

    @staticmethod
    def _runs(h: np.ndarray, of: np.ndarray, first: np.ndarray, begins: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(h)
        if n < PASSAGE:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        after = np.r_[h[1:, 0], np.uint64(0)]
        after[first[1:-1][first[1:-1] > 0] - 1] = 0  # a text's last word has none after it
        value = (mixed(h[:, 0] * M1 + after) >> np.uint64(1)) | (~begins).astype(np.uint64) << np.uint64(63)
        whole = of[: n - WINDOW + 1] == of[WINDOW - 1 :]
        size = np.diff(first)
        whole &= size[of[: n - WINDOW + 1]] >= PASSAGE
        at = np.lib.stride_tricks.sliding_window_view(value, WINDOW).argmin(axis=1) + np.arange(n - WINDOW + 1)
        border = np.zeros(n, dtype=bool)
        border[at[whole]] = True
        same = np.r_[False, (value[1:] == value[:-1]) & (of[1:] == of[:-1])]
        border &= ~same  # of a word said over and over the first place only
        end = border.copy()
        end[1:] |= stop[:-1]
        end = np.r_[np.flatnonzero(end), n]
        a = np.flatnonzero(border)
        b = end[np.minimum(np.searchsorted(end, a + RUN), len(end) - 1)]
        ok = (b >= a + RUN) & (b <= first[of[a] + 1])
        return a[ok], b[ok]


def compared(ids: list[int | None], ths: list[int], texts: list[str | None]) -> tuple[np.ndarray, ...]:
    """(row, key, d1, span) of the units of some rows: span holds a unit's words as a << 31 | b.

    Of equal units only those of the least doc_id are open: key and d1 are their digest. All others
    are surely repeated: their span is marked with SURE and their key only spreads them. A unit that
    the same text holds before is sure too; one that overlaps it there is left out."""
    rank = np.array([LAST if i is None else i for i in ids], dtype=np.int64)
    by_rank = np.argsort(rank, kind="stable")
    u = Units([texts[i] for i in by_rank])
    row, span = by_rank[u.doc], u.a.astype(np.int64) << 31 | u.b
    o = np.argsort(u.d0, kind="stable")
    d0, d1, row, span, a, b, r = u.d0[o], u.d1[o], row[o], span[o], u.a[o], u.b[o], rank[row[o]]
    n = len(o)
    if not n:
        return row, d0.view(np.int64), d1.view(np.int64), span
    new = np.r_[True, (d0[1:] != d0[:-1]) | (d1[1:] != d1[:-1])]
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    sure, out = r > r[start], np.zeros(n, dtype=bool)
    again = np.r_[False, ~new[1:] & (row[1:] == row[:-1])]
    held = 0
    for i in np.flatnonzero(again).tolist():
        if not again[i - 1]:
            held = b[i - 1]
        if a[i] < held:
            out[i] = True
        else:
            sure[i], held = True, b[i]
    key = np.where(sure, mixed(np.array(ths, dtype=np.int64).view(np.uint64)[row] + span.view(np.uint64)), d0)
    span = np.where(sure, span | SURE, span)
    keep = ~out
    return row[keep], key[keep].view(np.int64), np.where(sure, np.uint64(0), d1)[keep].view(np.int64), span[keep]


def unit_table(docs: DataFrame, held: int = HELD) -> DataFrame:
    """docs(doc_id, text, th) -> (key, d1, doc_id, th, span), see compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        texts: list[str | None] = []
        ths: list[int] = []
        size = 0

        def rows() -> Iterator[pa.RecordBatch]:
            row, key, d1, span = compared(ids, ths, texts)
            id_, th = pa.array(ids, pa.int64()), pa.array(ths, pa.int64())
            for at in range(0, len(row), 100_000):
                s = slice(at, at + 100_000)
                w = pa.array(row[s])
                yield pa.RecordBatch.from_arrays([pa.array(key[s]), pa.array(d1[s]), id_.take(w), th.take(w), pa.array(span[s])], names=["key", "d1", "doc_id", "th", "span"])

        for batch in batches:
            for i, text, th in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                ids.append(i)
                texts.append(text.as_py())
                ths.append(th)
                size += len(texts[-1] or "")
                if size >= held or len(ids) >= held >> 8:
                    yield from rows()
                    ids, texts, ths, size = [], [], [], 0
        if ids:
            yield from rows()

    return docs.select("doc_id", "text", "th").mapInArrow(run, "key long, d1 long, doc_id long, th long, span long")


def repeated(found: DataFrame) -> DataFrame:
    """(doc_id, th, span) of units that a row of a smaller doc_id holds, or the same text before.

    Equal units meet in one task, sorted by rank and streamed; a task sends one row of a unit at
    most for each doc_id of the least rank it has seen, however many hold it."""
    rank = F.coalesce("doc_id", F.lit(int(LAST)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, int, int] | None = None
        for b in batches:
            if not b.num_rows:
                continue
            key, d1, span = (b[c].to_numpy() for c in ("key", "d1", "span"))
            r = b["doc_id"].fill_null(int(LAST)).to_numpy()
            new = np.r_[True, (key[1:] != key[:-1]) | (d1[1:] != d1[:-1])]
            least = r[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
            if last and last[:2] == (key[0], d1[0]):
                least[: np.argmax(new[1:]) + 1 if new[1:].any() else len(key)] = last[2]
            last = (key[-1], d1[-1], least[-1])
            gone = np.flatnonzero((span < 0) | (r > least))
            w = pa.array(gone)
            yield pa.RecordBatch.from_arrays([b["doc_id"].take(w), b["th"].take(w), pa.array(span[gone] & ~SURE)], names=["doc_id", "th", "span"])

    return found.repartition("key").sortWithinPartitions("key", "d1", rank).mapInArrow(run, "doc_id long, th long, span long")


def stretches(spans: list[int], least: int) -> tuple[list[tuple[int, int]], int]:
    """([first word, end) of stretches of at least `least` words, number of units in them)."""
    out: list[list[int]] = []
    for x in sorted(set(spans)):
        a, b = x >> 31, x & (1 << 31) - 1
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
            out[-1][2] += 1
        else:
            out.append([a, b, 1])
    long = [x for x in out if x[1] - x[0] >= least]
    return [(a, b) for a, b, _ in long], sum(k for *_, k in long)


def stretch_table(gone: DataFrame, least: int) -> DataFrame:
    """(doc_id, th, cuts, units) of texts that have a stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [stretches(x.as_py(), least) for x in b["spans"]]
            at = pa.array([i for i, (cuts, _) in enumerate(found) if cuts], pa.int64())
            cuts = pa.array([[x for pair in c for x in pair] for c, _ in found if c], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b["doc_id"].take(at), b["th"].take(at), cuts, pa.array([k for c, k in found if c], pa.int64())], names=["doc_id", "th", "cuts", "units"])

    return gone.groupBy("doc_id", "th").agg(F.collect_set("span").alias("spans")).mapInArrow(run, "doc_id long, th long, cuts array<int>, units long")


def char_spans(text: str, cuts: list[int]) -> list[tuple[int, int]]:
    """Word stretches (a, b, a, b, ...) as spans of code points; a stretch of whole lines takes their line breaks along."""
    places = [m.span() for m in WORD.finditer(text)]
    out: list[tuple[int, int]] = []
    for a, b in zip(cuts[::2], cuts[1::2], strict=True):
        s, e = places[a][0], places[b - 1][1]
        head, tail = text.rfind("\n", 0, s) + 1, text.find("\n", e)
        tail = len(text) if tail < 0 else tail + 1
        if not text[head:s].strip(" \t\r\x0b\x0c") and not text[e:tail].strip(" \t\n\r\x0b\x0c"):
            s, e = head, tail
        out.append((s, e))
    return out


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, held: int = HELD) -> DataFrame:
    """One row per input row: doc_id, text (what stays), removed and kept (spans of the original text, in code points), units (number removed).

    A unit is repeated if the same text holds it before, or a row of a smaller doc_id holds it;
    stretches of `least` or more words of repeated units go. So a lone repeated line of fewer words
    stays, and goes beside other repeated ones. Rows that repeat a doc_id are one document: they are
    not held against each other. A null doc_id ranks last. Null text stays null, and an empty one
    empty. Of very long texts all units count; a word said over and over is left as it is. Other
    columns are not read, whatever their names. An empty table gives none."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    found = stretch_table(repeated(unit_table(base, held)), least)
    other = found.select(F.col("doc_id").alias("id_"), F.col("th").alias("th_"), "cuts", "units")
    joined = base.join(other, base["doc_id"].eqNullSafe(other["id_"]) & (base["th"] == other["th_"]), "left").select("doc_id", "text", "cuts", "units")
    kind = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, removed, kept = [], [], []
            for text, words in zip(batch.column(1), batch.column(2), strict=True):
                t, w = text.as_py(), words.as_py()
                cuts = char_spans(t, w) if w else []
                stay = [(a, b) for a, b in zip([0, *(e for _, e in cuts)], [*(s for s, _ in cuts), len(t or "")], strict=True) if b > a]
                texts.append(t if not cuts else "".join(t[a:b] for a, b in stay))
                removed.append([{"s": s, "e": e} for s, e in cuts])
                kept.append([{"s": s, "e": e} for s, e in stay])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(removed, kind), pa.array(kept, kind), batch.column(3).fill_null(0)], names=["doc_id", "text", "removed", "kept", "units"])

    return joined.mapInArrow(cut, f"doc_id long, text string, removed {SPANS}, kept {SPANS}, units long")


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(table(spark, sf_dir, "documents"))
    said = F.array_join(F.transform("removed", lambda x: F.concat_ws(":", x["s"], x["e"])), ",")
    return found.select("doc_id", "units", said.alias("removed"), F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("kept_chars"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
