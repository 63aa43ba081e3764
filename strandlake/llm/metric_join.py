"""Exact metric range join of vectors by cosine, and the groups its links form.

Unit vectors at cosine >= t lie within r = sqrt(2 - 2t). Pivots are the centres of a bounded sample;
every vector belongs to the cell of its nearest pivot. A vector meets another cell only if the
triangle inequality lets a member of that cell be within r, and cells join independently, pair by
pair. Cells with many vectors are cut into parts of bounded size, so no task holds more than two.

More pivots make fewer pairs but more replicas. Their number is the one that costs least on the
sample, by its own replication and cell sizes: many where vectors are clustered, few where they are
not and the triangle inequality rules out little.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .clusters import centres
from .common import salt_of, table, whole_groups, written
from .components import components
from .simhash import join_labels

PART_BYTES = 4 << 20  # of a part's vectors, as floats
SAMPLE = 8192
PIVOTS = (8, 32, 128, 512)  # numbers of pivots that are weighed
SHIP, PAIR = 3e-6, 1e-10  # seconds to send a replica, and to compare a pair for each dimension: they only weigh one number of pivots against another
MARGIN = 1e-4  # single precision decides pairs further from the threshold than this, double the rest


def vector_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values end to end, and each row's length and whether it is non-null with finite components only."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if flat.dtype not in (np.float32, np.float64):
        flat = flat.astype(np.float64)
    bad = np.r_[0, np.cumsum(~np.isfinite(flat))]
    ends = np.cumsum(lengths)
    ok = (bad[ends] == bad[ends - lengths]) & column.is_valid().to_numpy(zero_copy_only=False)
    return flat, lengths, ok


def prepared(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, vec binary): vec is null where the vector takes no part."""
    wide = dict(df.dtypes)[vec_col] != "array<float>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, lengths, ok = vector_rows(b.column(1))
            flat = flat.astype(np.float64 if wide else np.float32) + 0  # -0 becomes 0
            ends = np.cumsum(lengths)
            some = np.r_[0, np.cumsum(flat != 0)]
            ok &= some[ends] > some[ends - lengths]
            vec = [flat[e - n : e].tobytes() if k else None for e, n, k in zip(ends, lengths, ok, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(vec, pa.binary())], names=["vec_id", "vec"])

    return df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vec")).mapInArrow(run, "vec_id long, vec binary")


def units(rows: list[bytes], wide: bool) -> np.ndarray:
    m = np.frombuffer(b"".join(rows), dtype=np.float64 if wide else np.float32).astype(np.float64).reshape(len(rows), -1)
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]


def by_length(rows: list[bytes]) -> dict[int, np.ndarray]:
    n = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
    return {int(k): np.flatnonzero(n == k) for k in np.unique(n)}


class Cells:
    """Pivots of each vector length, and from the second pass on each cell's radius and parts.

    The last cell takes vectors of lengths without a pivot; it meets no other cell."""

    def __init__(self, pivots: dict[int, np.ndarray], wide: bool, radius: float):
        """pivots: unit vectors by the number of bytes of a vector."""
        self.wide, self.r, self.pivots = wide, radius + 1e-9, {}
        self.n = 0
        for k, p in sorted(pivots.items()):
            self.pivots[k] = (np.arange(self.n, self.n + len(p)), p)
            self.n += len(p)
        self.reach = np.zeros(self.n + 1)
        self.parts = np.ones(self.n + 1, dtype=np.int64)

    def home(self, rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        cell, far = np.full(len(rows), self.n), np.zeros(len(rows))
        for k, at in by_length(rows).items():
            if k in self.pivots:
                ids, p = self.pivots[k]
                cos = units([rows[i] for i in at], self.wide) @ p.T
                best = cos.argmax(axis=1)
                cell[at], far[at] = ids[best], np.sqrt(np.maximum(0, 2 - 2 * cos[np.arange(len(at)), best]))
        return cell, far

    def meets(self, rows: list[bytes], cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, other cell) pairs that the triangle inequality can't rule out, the own cell left out."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for k, at in by_length(rows).items():
            if k not in self.pivots:
                continue
            ids, p = self.pivots[k]
            cos = units([rows[i] for i in at], self.wide) @ p.T
            far = np.sqrt(np.maximum(0, 2 - 2 * cos))
            own = np.searchsorted(ids, cell[at])
            line = np.arange(len(at))
            near = far[line, own]
            apart = np.sqrt(np.maximum(0, 2 - 2 * (p @ p.T)))[own]
            ok = (far <= self.reach[ids][None, :] + self.r) & (far - near[:, None] <= 2 * self.r)
            # in Euclidean space the distance to the plane between two pivots is a sharper bound
            ok &= (far**2 - near[:, None] ** 2 <= 2 * (self.r * apart + 1e-9))
            ok[line, own] = False
            r, c = np.nonzero(ok)
            found.append((at[r], ids[c]))
        return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def chosen(sample: list[bytes], n: int, wide: bool, radius: float, part_bytes: int, counts: tuple[int, ...]) -> Cells:
    """The cells whose join of n vectors costs least, weighed on a sample of them."""
    pivots: dict[int, np.ndarray] = {}
    for size, at in by_length(sample).items():
        rows = [sample[i] for i in at]
        unit, scale = units(rows, wide), n / len(sample)
        dim, best = unit.shape[1], np.inf
        for k in counts:
            if k > counts[0] and k > len(rows) / 8:
                break
            cells = Cells({size: centres(unit, k)}, wide, radius)
            home, far = cells.home(rows)
            np.maximum.at(cells.reach, home, far)
            held = np.bincount(home, minlength=cells.n + 1) * scale
            parts = np.ceil(held / part_of(dim, part_bytes))
            _, other = cells.meets(rows, home)
            met = np.r_[home, other]
            cost = scale * (SHIP * parts[met].sum() + PAIR * dim * held[met].sum())
            if cost < best:
                best, pivots[size] = cost, cells.pivots[size][1]
    return Cells(pivots, wide, radius)


def part_of(dim: int, part_bytes: int) -> int:
    """Vectors of a part."""
    return max(1, part_bytes // (4 * max(1, dim)))


def pair_links(a: np.ndarray, b: np.ndarray, same: bool, threshold: float, step: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of unit vectors at cosine >= threshold; with same, each unordered pair once."""
    a32, b32 = a.astype(np.float32), b.astype(np.float32)
    for at in range(0, len(a), step):
        low = at if same else 0
        near = a32[at : at + step] @ b32[low:].T
        r, c = np.nonzero(near >= threshold - MARGIN)
        score = near[r, c]
        r, c = r + at, c + low
        if same:
            keep = c > r
            r, c, score = r[keep], c[keep], score[keep]
        unsure = np.flatnonzero(score < threshold + MARGIN)
        keep = np.ones(len(r), dtype=bool)
        keep[unsure] = np.einsum("ij,ij->i", a[r[unsure]], b[c[unsure]]) >= threshold
        yield r[keep], c[keep]


def link_groups(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.95, part_bytes: int = PART_BYTES, pivots: tuple[int, ...] = PIVOTS) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero or hold null or non-finite components have no links, are
    their own component and kept. Vectors of different lengths don't link. Rows with equal vectors
    are joined as one and counted with their number. Rows that repeat a vec_id are rows of their
    own, count as links of each other, and share that id's component. A row with a null vec_id has
    no links and is kept. Other columns are not read, whatever their names. An empty table
    gives none. Needs 0 < threshold <= 1."""
    wide = dict(df.dtypes)[vec_col] != "array<float>"
    rows = written(prepared(df, id_col, vec_col).withColumn("key", F.when(F.col("vec_id").isNotNull(), F.sha2("vec", 256))), "vectors")
    some = rows.where("key is not null")
    reps = written(some.groupBy("key").agg(F.min("vec_id").alias("rid"), F.any_value("vec").alias("vec"), F.count("*").alias("copies")), "vector-texts")
    n = reps.count()
    sample = [bytes(r.vec) for r in reps.orderBy(F.xxhash64("key"), "key").select("vec").limit(SAMPLE).collect()]
    cells = chosen(sample, n, wide, math.sqrt(max(0.0, 2 - 2 * threshold)), part_bytes, pivots)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, far = cells.home(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(far)], names=["rid", "vec", "copies", "cell", "far"])

    placed = written(reps.select("rid", "vec", "copies").mapInArrow(place, "rid long, vec binary, copies long, cell long, far double"), "vector-cells")
    for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far"), F.max(F.octet_length("vec")).alias("size")).collect():  # a row for each pivot
        cells.parts[r.cell], cells.reach[r.cell] = -(-r.n // part_of(r.size // (8 if wide else 4), part_bytes)), r.far
    offset = np.r_[0, np.cumsum(cells.parts)]
    total = int(offset[-1])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                yield from _deal(b.slice(at, 1000))

    def _deal(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        cell = b["cell"].to_numpy()
        row, other = cells.meets(b["vec"].to_pylist(), cell)
        row, other = np.r_[np.arange(b.num_rows), row], np.r_[cell, other]
        many = cells.parts[other]
        who = np.repeat(row, many)
        target = np.repeat(offset[other], many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        mine = offset[cell[who]] + b["salt"].to_numpy()[who] % cells.parts[cell[who]]
        task = np.minimum(mine, target) * total + np.maximum(mine, target)
        for at in range(0, len(who), 20_000):
            w = pa.array(who[at : at + 20_000])
            yield pa.RecordBatch.from_arrays([pa.array(task[at : at + 20_000]), pa.array(mine[at : at + 20_000]), b["rid"].take(w), b["vec"].take(w), b["copies"].take(w)], names=["task", "mine", "rid", "vec", "copies"])

    dealt = placed.withColumn("salt", salt_of(F.col("rid"), 1 << 30)).mapInArrow(deal, "task long, mine long, rid long, vec binary, copies long")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["task"], 1):
            task = t["task"].to_numpy()
            for at in np.split(np.arange(len(task)), np.flatnonzero(task[1:] != task[:-1]) + 1):
                yield cell_pair(t.take(pa.array(at)), int(task[at[0]]))

    def cell_pair(t: pa.Table, task: int) -> pa.RecordBatch:
        rid, mine, copies, vec = t["rid"].to_numpy(), t["mine"].to_numpy(), t["copies"].to_numpy(), t["vec"].to_pylist()
        count, labels = np.zeros(len(rid), dtype=np.int64), np.arange(len(rid))
        low, high = task // total, task % total
        for at in by_length(vec).values():
            left, right = at[mine[at] == low], at[mine[at] == high]
            if len(left) and len(right):
                a = units([vec[i] for i in left], wide)
                b = a if low == high else units([vec[i] for i in right], wide)
                for r, c in pair_links(a, b, low == high, threshold):
                    i, j = left[r], right[c]
                    count += np.bincount(i, copies[j], len(rid)).astype(np.int64) + np.bincount(j, copies[i], len(rid)).astype(np.int64)
                    labels = join_labels(labels, i, j)
        some = np.flatnonzero(count)
        return pa.RecordBatch.from_arrays([pa.array(rid[some]), pa.array(count[some]), pa.array(rid[labels[some]])], names=["rid", "n", "root"])

    joined = written(dealt.repartition("task").sortWithinPartitions("task").mapInArrow(join, "rid long, n long, root long"), "vector-links")
    links = joined.groupBy("rid").agg(F.sum("n").alias("n"))
    roots = components(joined.select(F.col("rid").alias("u"), F.col("root").alias("v"))).withColumnRenamed("node", "rid")
    of_key = reps.select("key", "rid", "copies").join(links, "rid", "left").join(roots, "rid", "left").select("key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rid").alias("component_id"))
    out = rows.select("vec_id", "key").join(of_key, "key", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op6_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_groups(table(spark, sf_dir, "embeddings"))


OP6_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95::DOUBLE
), r AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id) AS n_links, (SELECT min(b) FROM r WHERE r.a = e.vec_id) AS component_id,
       e.vec_id = (SELECT min(b) FROM r WHERE r.a = e.vec_id) AS kept
FROM embeddings e
"""
