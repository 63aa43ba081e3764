"""SimHash near-dedup: fingerprints of word shingles, compared as vertical bit planes.

Candidates share whole bands of bits: with `blocks` bands and a radius r, two fingerprints at r or
fewer differing bits agree on at least blocks - r bands, so one table for each choice of
blocks - r bands finds every pair. Inside a table's bucket, members lie in blocks of 64 lanes, one
machine word for each bit plane; a query's distances to the 64 lanes are counted together by a
carry-save counter, and a block is abandoned when all its lanes are beyond the radius.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import salt_of, table, whole_groups, written
from .components import components

SHINGLE, SEED, RADIUS = 3, 42, 3
CHUNK = 4096
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash of ASCII-lower-cased words; 0 where there is no word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams: Iterator[bytes] = iter([b" ".join(words)])
        n = 1
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
        n = len(words) - shingle + 1
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(seed)), dtype=np.uint64, count=n)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.fromiter((fingerprint(x.as_py(), shingle, seed) for x in b.column(1)), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def planes_of(values: np.ndarray, block: np.ndarray, lane: np.ndarray, blocks: int) -> np.ndarray:
    """Vertical planes: [bit, block] words whose bit `lane` is that bit of the value in that lane."""
    planes = np.zeros((64, blocks), dtype=np.uint64)
    for bit in range(64):
        word = ((values >> np.uint64(bit)) & np.uint64(1)) << lane
        np.bitwise_or.at(planes[bit], block, word)
    return planes


def within(planes: np.ndarray, valid: np.ndarray, query: np.ndarray, block: np.ndarray, radius: int) -> np.ndarray:
    """For each (query value, block): the word of lanes at `radius` or fewer differing bits.

    Counters are held bit-sliced too (ones, twos, ...), with a sticky overflow; every eight planes
    the pairs with no lane left are dropped."""
    width = max(1, int(radius).bit_length())
    hit = np.zeros(len(query), dtype=np.uint64)
    at = np.arange(len(query))
    counter = [np.zeros(len(query), dtype=np.uint64) for _ in range(width)]
    over = np.zeros(len(query), dtype=np.uint64)
    for bit in range(64):
        carry = planes[bit][block] ^ (np.uint64(0) - ((query >> np.uint64(bit)) & np.uint64(1)))
        for k in range(width):
            counter[k], carry = counter[k] ^ carry, counter[k] & carry
        over |= carry
        if bit % 8 == 7 and bit < 63:
            live = np.flatnonzero(~_beyond(counter, over, radius) & valid[block])
            if len(live) < len(query):
                query, block, at, over = query[live], block[live], at[live], over[live]
                counter = [c[live] for c in counter]
            if not len(query):
                return hit
    hit[at] = ~_beyond(counter, over, radius) & valid[block]
    return hit


def _beyond(counter: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose count is more than radius: the sticky overflow, or a bitwise comparison of the counter."""
    more, same = np.zeros_like(over), np.full_like(over, ALL)
    for k in reversed(range(len(counter))):
        if radius >> k & 1:
            same = same & counter[k]
        else:
            more |= same & counter[k]
            same = same & ~counter[k]
    return over | more


def join_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union of the pairs (a, b) into labels, each label the smallest index of its set."""
    while len(a):
        x, y = labels[a], labels[b]
        open_ = x != y
        if not open_.any():
            break
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels = up
    return labels


def linked(values: np.ndarray, group: np.ndarray, radius: int = RADIUS, step: int = 1 << 16) -> np.ndarray:
    """labels: for each member the smallest index it reaches by links within its group; groups lie together."""
    n = len(values)
    labels = np.arange(n)
    if n < 2:
        return labels
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[first, n])
    of = np.repeat(np.arange(len(first)), size)
    place = np.arange(n) - first[of]
    per = -(-size // 64)
    start = np.r_[0, np.cumsum(per)[:-1]]
    block = start[of] + place // 64
    lane = (place % 64).astype(np.uint64)
    total = int(per.sum())
    planes = planes_of(values, block, lane, total)
    valid = np.zeros(total, dtype=np.uint64)
    np.bitwise_or.at(valid, block, np.uint64(1) << lane)
    # each query meets its own block and those after it: every pair is seen once or twice
    ahead = per[of] - place // 64
    ends = np.cumsum(ahead)
    at = 0
    while at < n:
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + step)))
        who = np.repeat(np.arange(at, stop), ahead[at:stop])
        offset = np.arange(len(who)) - np.repeat(np.cumsum(ahead[at:stop]) - ahead[at:stop], ahead[at:stop])
        b = block[who] + offset
        hit = within(planes, valid, values[who], b, radius)
        some = np.flatnonzero(hit)
        if len(some):
            bits = np.unpackbits(hit[some].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            r, c = np.nonzero(bits)
            left = who[some][r]
            g = of[left]
            right = first[g] + (b[some][r] - start[g]) * 64 + c
            labels = join_labels(labels, left, right)
        at = stop
    return labels


def band_tables(radius: int, blocks: int) -> list[int]:
    """Masks of the bits that each table's bucket shares."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    bands = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    return [sum(c) for c in combinations(bands, blocks - radius)]


def links(fps: DataFrame, radius: int = RADIUS, chunk: int = CHUNK, blocks: int | None = None) -> DataFrame:
    """fps(fp long, distinct) -> edges (u, v) whose components are those of all links at `radius` or fewer bits.

    blocks: more bands give more tables with smaller buckets; any number is exact. By default it
    follows the number of fingerprints. Buckets over `chunk` members are cut into chunks, and every
    pair of chunks is a task of its own."""
    if blocks is None:
        n = fps.count()
        blocks = radius + (1 if n < 1 << 22 else 2 if n < 1 << 30 else 3)
    masks = [m - (1 << 64) if m >= 1 << 63 else m for m in band_tables(radius, blocks)]
    keyed = fps.select("fp", F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(masks)])).alias("key"))
    sizes = keyed.groupBy("key").count().where("count > 1").select("key", F.ceil(F.col("count") / chunk).cast("int").alias("parts"))
    placed = keyed.join(sizes, "key").withColumn("mine", salt_of(F.col("fp"), F.col("parts")))
    pairs = F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: F.least(x, F.col("mine")) * F.col("parts") + F.greatest(x, F.col("mine"))))
    tasks = placed.select("fp", F.explode(pairs).alias("pair"), "key").select("fp", F.xxhash64("key", "pair").alias("task"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["task"]):
            values = t["fp"].to_numpy().view(np.uint64)
            labels = linked(values, t["task"].to_numpy(), radius)
            child = np.flatnonzero(labels != np.arange(len(labels)))
            yield pa.RecordBatch.from_arrays([pa.array(values[child].view(np.int64)), pa.array(values[labels[child]].view(np.int64))], names=["u", "v"])

    return tasks.repartition("task").sortWithinPartitions("task").mapInArrow(run, "u long, v long")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED, chunk: int = CHUNK) -> DataFrame:
    """One row per input row: doc_id, fp (signed long), component_id (smallest doc_id reachable by links).

    Null or empty text has fingerprint 0 and links as any other; very long texts are counted whole, in
    stretches of 65,536 shingles. Rows that repeat a doc_id each give a row. A null doc_id is kept and
    takes its component's smallest id. Other columns are not read, whatever their names. An empty
    table gives none."""
    fps = written(fingerprints(docs, id_col, text_col, shingle, seed), "simhash")
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = components(links(distinct.select("fp"), radius, chunk))
    joined = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    lowest = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = joined.join(lowest, "root").select("fp", "component_id")
    return fps.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
