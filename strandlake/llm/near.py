"""Near copies by exact Jaccard similarity of five-word shingles, for the corpus pipeline.

SimHash links (few bits) come first and gather most copies cheaply; each is verified. No radius of
a fingerprint is sure to hold all pairs of a given similarity, so the rest are found by prefixes:
under one order of all shingles, two sets of similarity 4/5 or more share one of the first
n - ceil(4 n / 5) + 1 shingles of each. Only pairs that are not yet in one component are compared.

Prefixes are made anew from the texts each time they are needed. First only (key, component) is
counted; keys that lie in two components or more are few, and only their rows are dealt again, each
with a parity bitmap: two sets differ in as many elements at least as their bitmaps in bits. A task
holds the rows of a key and gives no pairs but which components its bitmaps can't tell apart: one row
for each component it merges, so what comes out is never more than what came in, however large a
group is. Components that may be one in this way are a cluster; every link lies within a cluster.
The texts of each cluster are dealt once and compared there, again without pairs already joined.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import Bits, salt_of, whole_groups, written
from .components import components

SHINGLE, SEED = 5, 42
SAMPLE, COMMON = 20_000, 100_000  # the order of shingles is made from so many documents, and holds so many common shingles
CHUNK = 1024
BITS = 1 << 16  # of a parity bitmap at most
ROW_BITS = 1 << 12  # of one that goes with every row of a prefix
HELD = 1 << 22  # shingles of a task's texts
Order = tuple[np.ndarray, np.ndarray]


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles; one of all words where there are fewer, none where there is no word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    grams = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False)) if len(words) >= SHINGLE else iter([b" ".join(words)])
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), dtype=np.uint64))


def node_of(hashes: np.ndarray) -> int:
    """Digest of a set of shingles, as a signed long."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).view(np.int64))


def simhash_of(hashes: np.ndarray) -> int:
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def parity_of(hashes: np.ndarray, places: int = 2, most: int = BITS) -> bytes:
    """Of each place of a bitmap whether an odd number of hashes fall on it; about `places` times as many places as hashes."""
    n = min(most, max(64, 1 << (places * len(hashes)).bit_length()))
    odd = np.bincount((hashes & np.uint64(n - 1)).astype(np.int64), minlength=n) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def differ(a: bytes, b: bytes) -> int:
    """How many elements two sets differ in at least; the longer bitmap is folded to the shorter's length."""
    x, y = sorted((np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)), key=len)
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def common_shingles(texts: DataFrame, sample: int = SAMPLE, most: int = COMMON) -> Order:
    """(sorted hashes, counts) of the shingles that stand in most texts of a bounded sample. They only set the order: any order is exact."""
    share = min(1.0, sample / max(1, texts.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(x.as_py()).view(np.int64))], names=["h"])

    part = texts.where(F.pmod(F.xxhash64(F.lit(3), "text"), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = part.select("text").mapInArrow(run, "h long").groupBy("h").count().where("count > 2").orderBy(F.desc("count"), "h").limit(most).toArrow()
    h, n = rows["h"].to_numpy().view(np.uint64), rows["count"].to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def prefix(hashes: np.ndarray, common: Order) -> np.ndarray:
    """The rarest n - ceil(4 n / 5) + 1 of n sorted hashes, in the order of (count in the sample, hash)."""
    known, count = common
    rank = np.zeros(len(hashes), dtype=np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        rank = np.where(known[at] == hashes, count[at], 0)
    return hashes[np.argsort(rank, kind="stable")][: len(hashes) - -(-4 * len(hashes) // 5) + 1]


def sketches(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, th) -> (doc_id, th, node, fp, n, parity): node is a digest of the set of shingles, n its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], []]
            for x in b.column(1):
                s = shingles(x.as_py())
                for c, f in zip(out, (node_of, simhash_of, len, parity_of), strict=True):
                    c.append(f(s))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=["doc_id", "th", "node", "fp", "n", "parity"])

    return docs.mapInArrow(run, "doc_id long, th long, node long, fp long, n long, parity binary")


def keyed(texts: DataFrame, common: Order, unless: Bits | None = None, only: Bits | None = None, never: Bits | None = None, bitmaps: bool = False) -> DataFrame:
    """texts(th, root, text) -> (key, node, root, n, pos): a row for each shingle of a text's prefix.

    root null: the node itself. unless: texts whose th may be in it are left out; only: keys that
    surely are not in it are; never: keys that may be in it. A task gives equal texts once. bitmaps:
    with a column parity."""
    names = ["key", "node", "root", "n", "pos"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[list[np.ndarray]] = [[] for _ in names]
        parity: list[bytes] = []
        size = 0

        def rows() -> pa.RecordBatch:
            columns = [pa.array(np.concatenate(x)) for x in held]
            return pa.RecordBatch.from_arrays([*columns, pa.array(parity, pa.binary())], names=[*names, "parity"]) if bitmaps else pa.RecordBatch.from_arrays(columns, names=names)

        for b in batches:
            th = b.column(0).to_numpy()
            skip = unless.has(th) if unless else np.zeros(len(th), dtype=bool)
            for i, h in enumerate(th.tolist()):
                if skip[i] or h in seen:
                    continue
                if len(seen) < 1 << 20:
                    seen.add(h)
                s = shingles(b.column(2)[i].as_py())
                key = prefix(s, common).view(np.int64)
                pos = np.arange(len(key))
                if only:
                    pos = np.flatnonzero(only.has(key) & ~never.has(key) if never else only.has(key))
                node = node_of(s)
                root = b.column(1)[i].as_py()
                for c, x in zip(held, (key[pos], np.full(len(pos), node), np.full(len(pos), node if root is None else root), np.full(len(pos), len(s)), pos), strict=True):
                    c.append(x.astype(np.int64))
                if bitmaps and len(pos):
                    parity += [parity_of(s, 1, ROW_BITS)] * len(pos)
                size += len(pos)
                if size > (10_000 if bitmaps else 50_000):
                    yield rows()
                    held, parity, size = [[] for _ in names], [], 0
        if size:
            yield rows()

    return texts.select("th", "root", "text").mapInArrow(run, "key long, node long, root long, n long, pos long" + (", parity binary" if bitmaps else ""))


class Bitmaps:
    """Parity bitmaps of many sets, compared by pairs of places."""

    def __init__(self, parity: list[bytes]):
        self.size = np.fromiter(map(len, parity), dtype=np.int64, count=len(parity)) // 8
        self.start = np.cumsum(self.size) - self.size
        self.words = np.frombuffer(b"".join(parity), dtype=np.uint64)

    def folded(self, at: np.ndarray, size: int) -> np.ndarray:
        """Each of `at` as `size` words; longer ones are folded."""
        times, word = self.size[at] // size, np.arange(size)
        out = self.words[self.start[at][:, None] + word]
        for k in range(1, int(times.max())):
            long = times > k
            out[long] ^= self.words[self.start[at[long]][:, None] + k * size + word]
        return out

    def differ(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many elements the sets i and j differ in at least."""
        least = np.minimum(self.size[i], self.size[j])
        out = np.zeros(len(i), dtype=np.int64)
        for size in np.unique(least).tolist():
            of = np.flatnonzero(least == size)
            for part in np.array_split(of, -(-len(of) * size // (1 << 18))):
                out[part] = np.bitwise_count(self.folded(i[part], size) ^ self.folded(j[part], size)).sum(axis=1, dtype=np.int64)
        return out


def merged(task: np.ndarray, root: np.ndarray, n: np.ndarray, bitmaps: Bitmaps, pos: np.ndarray | None = None, sets: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of roots, at most as many as rows, that join all roots of one task between which a pair of rows may be similar; rows of a task lie together.

    Without sets, by what the sizes, the places of their key and the bitmaps allow; with sets, exactly."""
    rows = len(task)
    first = np.flatnonzero(np.r_[True, task[1:] != task[:-1]])
    of = np.repeat(np.arange(len(first)), np.diff(np.r_[first, rows]))
    order = np.lexsort((np.arange(rows), root, of))
    new = np.r_[True, (of[order][1:] != of[order][:-1]) | (root[order][1:] != root[order][:-1])]
    labels = np.empty(rows, dtype=np.int64)
    labels[order] = order[new][np.cumsum(new) - 1]  # the first row of the same task and root
    begun, at, step = np.flatnonzero(labels == np.arange(rows)), np.arange(rows), 0
    done = np.minimum.reduceat(labels == first[of], first)
    while True:  # rows with those 1, 2, ... places on, as long as they are of the same task and it isn't one already
        step += 1
        at = at[at + step < rows]
        at = at[(of[at] == of[at + step]) & ~done[of[at]]]
        if not len(at):
            break
        i, j = at, at + step
        ok = (labels[i] != labels[j]) & (5 * np.minimum(n[i], n[j]) >= 4 * np.maximum(n[i], n[j]))
        if pos is not None:
            ok &= 9 * (np.minimum(n[i] - pos[i], n[j] - pos[j]) + np.minimum(pos[i], pos[j])) >= 4 * (n[i] + n[j])
        i, j = i[ok], j[ok]
        if not len(i):
            continue
        ok = 9 * bitmaps.differ(i, j) <= n[i] + n[j]
        i, j = i[ok], j[ok]
        if sets is not None:
            ok = np.fromiter((9 * len(np.intersect1d(sets[x], sets[y], assume_unique=True)) >= 4 * (len(sets[x]) + len(sets[y])) for x, y in zip(i.tolist(), j.tolist(), strict=True)), dtype=bool, count=len(i))
            i, j = i[ok], j[ok]
        if len(i):
            labels = simhash.join_labels(labels, i, j)
            done = np.minimum.reduceat(labels == first[of], first)
    child = begun[labels[begun] != begun]
    return root[child], root[labels[child]]


def maybe_one(rows: DataFrame) -> DataFrame:
    """rows(task, node, root, n, pos, parity) -> pairs of roots (u, v), which join all roots of one task that may have a similar pair. Tasks are of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["task"], 10_000):
            task, root, n, pos = (t[c].to_numpy().astype(np.int64) for c in ("task", "root", "n", "pos"))
            u, v = merged(task, root, n, Bitmaps(t["parity"].to_pylist()), pos)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return rows.select("task", "root", "n", "pos", "parity").repartition("task").sortWithinPartitions("task").mapInArrow(run, "u long, v long")


def surely_one(rows: DataFrame) -> DataFrame:
    """rows(task, root, text) -> pairs of roots (u, v), which join all roots of one task that have a pair of texts of similarity 4/5 or more. Tasks are of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups((b.slice(k, 250) for b in batches for k in range(0, b.num_rows, 250)), ["task"], 1000):
            sets = [shingles(x.as_py()) for x in t["text"]]
            n = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
            u, v = merged(t["task"].to_numpy(), t["root"].to_numpy(), n, Bitmaps([parity_of(s) for s in sets]), sets=sets)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return rows.select("task", "root", "text").repartition("task").sortWithinPartitions("task").mapInArrow(run, "u long, v long")


def dealt(rows: DataFrame, group: str, parts_of: Callable[[Column, Column], Column]) -> DataFrame:
    """rows(group, node, root, n, ...) with a task: any two rows of one group and different roots meet in one, groups of one root in none.

    A group's largest root is cut into parts_of(rows, sum of n) parts, its other rows too. Each part of
    the one meets each part of the others, and these each other: where all but a few rows are of one
    root already, that is about one task a row."""
    by_root = rows.groupBy(group, "root").agg(F.count("*").alias("c"), F.sum("n").alias("w"))
    by_group = by_root.groupBy(group).agg(F.max_by("root", F.struct("c", "root")).alias("large"), F.max(F.struct("c", "root", "w"))["w"].alias("wl"), F.max("c").alias("cl"), F.sum("c").alias("c"), F.sum("w").alias("w"))
    cut = by_group.where("c > cl").select(group, "large", parts_of(F.col("cl"), F.col("wl")).alias("pl"), parts_of(F.col("c") - F.col("cl"), F.col("w") - F.col("wl")).alias("po"))
    is_large = F.col("root") == F.col("large")
    placed = rows.join(cut, group).withColumn("mine", F.when(is_large, salt_of(F.col("node"), F.col("pl"))).otherwise(salt_of(F.col("node"), F.col("po"))))
    upto = lambda parts: F.sequence(F.lit(0), F.col(parts) - 1)
    large = F.transform(upto("po"), lambda x: F.xxhash64(F.lit(0), group, "mine", x))
    other = F.concat(
        F.transform(upto("pl"), lambda x: F.xxhash64(F.lit(0), group, x, "mine")),
        F.transform(upto("po"), lambda x: F.xxhash64(F.lit(1), group, F.least(x, F.col("mine")), F.greatest(x, F.col("mine")))),
    )
    return placed.withColumn("task", F.explode(F.when(is_large, large).otherwise(other))).drop("large", "pl", "po", "mine")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs (u, v) whose texts(node, text) have a similarity of 4/5 or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                s, t = shingles(x.as_py()), shingles(y.as_py())
                keep.append(9 * len(np.intersect1d(s, t, assume_unique=True)) >= 4 * (len(s) + len(t)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    left, right = texts.select(F.col("node").alias("u"), F.col("text").alias("s")), texts.select(F.col("node").alias("v"), F.col("text").alias("t"))
    return pairs.join(left, "u").join(right, "v").select("u", "v", "s", "t").mapInArrow(run, "u long, v long")


def not_ruled_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (u, v, nu, nv, pu, pv) whose bitmaps allow a similarity of 4/5: then they differ in a ninth of both sizes at most."""
    for b in batches:
        n = b["nu"].to_numpy() + b["nv"].to_numpy()
        keep = [9 * differ(x.as_py(), y.as_py()) <= k for x, y, k in zip(b["pu"], b["pv"], n.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b["u"], b["v"]], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))


def once(texts: DataFrame, bits: Bits) -> DataFrame:
    """(th, text) of each different text whose th may be in bits; a task sends equal texts once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            at = []
            for i in np.flatnonzero(bits.has(b.column(0).to_numpy())).tolist():
                h = b.column(0)[i].as_py()
                if h not in seen:
                    at.append(i)
                    if len(seen) < 1 << 20:
                        seen.add(h)
            if at:
                yield b.take(pa.array(at))

    return texts.select("th", "text").mapInArrow(run, "th long, text string").groupBy("th").agg(F.first("text").alias("text"))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, sample: int = SAMPLE) -> DataFrame:
    """One row per input row: doc_id and component_id, the smallest doc_id reached by links of similarity 4/5 or more.

    Texts without a word (null, empty or blank) are alike. Texts of fewer than five words are alike
    if all their words are. Rows that repeat a doc_id each give a row; a null doc_id takes its
    component's smallest id. Very long texts are read whole. An empty table gives none."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    base = base.withColumn("th", F.xxhash64(F.coalesce("text", F.lit(""))))
    rows = written(sketches(base), "near-sketches")
    nodes = written(rows.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("fp").alias("fp"), F.first("n").alias("n"), F.min("th").alias("th"), F.first("parity").alias("parity")), "near-nodes")

    def checked(pairs: DataFrame) -> tuple[DataFrame, DataFrame, Bits]:
        """(links, texts met (th, node or null, text), which th those are)."""
        found = pairs.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        side = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("parity").alias(f"p{c}"))
        found = found.join(side("u"), "u").join(side("v"), "v").where("5 * least(nu, nv) >= 4 * greatest(nu, nv)")
        found = written(found.select("u", "v", "nu", "nv", "pu", "pv").mapInArrow(not_ruled_out, "u long, v long"), "near-pairs")
        ends = nodes.join(found.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "node").select("node", "th")
        bits = Bits.of(ends, "th")
        texts = written(once(base, bits).join(ends, "th", "left").select("th", "node", "text"), "near-texts")
        return written(verified(found, texts.where("node is not null")), "near-links"), texts, bits

    rep = nodes.groupBy("fp").agg(F.min("node").alias("rep"))

    def near_bits() -> DataFrame:
        same = nodes.join(rep, "fp").select(F.col("node").alias("u"), F.col("rep").alias("v"))
        few = simhash.links(rep.select("fp")).join(rep.toDF("u", "ru"), "u").join(rep.toDF("v", "rv"), "v").select(F.col("ru").alias("u"), F.col("rv").alias("v"))
        return same.unionByName(few)

    first, met, bits = checked(near_bits())
    common = common_shingles(base, sample)
    met = written(met.join(components(first), "node", "left"), "near-met")

    def all_keys(only: Bits | None = None, never: Bits | None = None, bitmaps: bool = False) -> DataFrame:
        others = base.withColumn("root", F.lit(None).cast("long"))
        return keyed(others, common, bits, only, never, bitmaps).unionByName(keyed(met, common, None, only, never, bitmaps))

    counts = all_keys().groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count("*").alias("c"))
    met_again = written(counts.select("key", "c", (F.col("a") < F.col("b")).alias("shared")).where(f"shared or c > {chunk}"), "near-shared")

    def rooted(rows: DataFrame, *links: DataFrame) -> DataFrame:
        """rows(root, ...) with the roots that the links join as one."""
        found = components(reduce(DataFrame.unionByName, links)).toDF("root", "__root")
        return rows.join(found, "root", "left").withColumn("root", F.coalesce("__root", "root")).drop("__root")

    def maybe() -> DataFrame:
        """Pairs of roots whose components hold every link that is left."""
        shared, often = met_again.where("shared"), met_again.where(F.col("c") > chunk)
        if often.isEmpty():
            return written(maybe_one(all_keys(Bits.of(shared, "key"), None, True).withColumn("task", F.col("key"))), "near-maybe")
        hot = Bits.of(often, "key")  # of one component or of more: none of them may come to a task whole
        cold = all_keys(Bits.of(shared.where(F.col("c") <= chunk), "key"), hot, True).withColumn("task", F.col("key"))
        many = all_keys(hot, None, True).join(often.where("shared").select("key", F.ceil(F.col("c") / chunk).cast("int").alias("parts")), "key")
        many = written(many.dropDuplicates(["key", "node"]), "near-often")
        part = many.withColumn("task", F.xxhash64("key", salt_of(F.xxhash64("key", "node"), F.col("parts")))).drop("parts")
        found = written(maybe_one(cold.unionByName(part)), "near-maybe")
        rest = dealt(rooted(many.drop("parts"), found), "key", lambda c, w: F.ceil(c / chunk).cast("int"))
        return found.unionByName(written(maybe_one(rest), "near-maybe"))

    def surely() -> DataFrame:
        """Pairs of roots that join all roots with a link between them: all texts of a cluster are compared."""
        parts_of = lambda c, w: F.ceil(F.greatest(c / chunk, w / HELD)).cast("int")
        cluster = components(maybe()).toDF("root", "cluster")
        cluster = cluster.unionByName(cluster.select(F.col("cluster").alias("root"), "cluster").distinct())
        of_node = nodes.select("node", "th", "n").join(components(first), "node", "left").withColumn("root", F.coalesce("root", "node"))
        members = written(of_node.join(cluster, "root"), "near-members")
        parts = members.groupBy("cluster").agg(parts_of(F.count("*"), F.sum("n")).alias("parts"))
        texts = once(base, Bits.of(members, "th")).join(members.join(parts, "cluster"), "th").select("cluster", "node", "root", "n", "parts", "text")
        texts = written(texts, "near-texts")
        in_parts = lambda rows, seed: rows.withColumn("task", F.xxhash64("cluster", salt_of(F.col("node"), F.col("parts"), seed)))
        found = [written(surely_one(in_parts(texts, 7)), "near-links")]
        large = texts.where("parts > 1")
        if not large.isEmpty():  # what is alike throughout is joined by parts that are cut in two ways; then each row meets what it isn't joined with
            found.append(written(surely_one(in_parts(rooted(large, *found), 8)), "near-links"))
            found.append(written(surely_one(dealt(rooted(large, *found), "cluster", parts_of)), "near-links"))
        return reduce(DataFrame.unionByName, found)

    links = first.unionByName(surely())
    joined = nodes.select("node", "least").join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.select("doc_id", "node").join(joined.join(lowest, "root").select("node", "component_id"), "node").select("doc_id", "component_id")
