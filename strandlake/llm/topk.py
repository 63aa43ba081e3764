"""Exact top-k search by inner product over document-range blocks.

Rows are put in the order of their nearest centre (of a bounded sample), so that ranges of them hold
alike vectors. A block holds such a range as a forward index (a small integer matrix) with the
largest and least value of every term (component); a shard is some blocks of near centres. A query's
bound for a block is the sum of its terms' best values there.

A query's first k-th score comes from the shard that holds it. Queries of near centres form bundles;
from the small table of block maxima alone it follows which blocks can matter to which bundle, and
only those are dealt out. There each query takes blocks in the order of their bounds until a bound
falls below its k-th score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .clusters import centres, normalised
from .common import salt_of, table, written
from .metric_join import vector_rows

BLOCK, SHARD, QUERIES = 256, 16, 256  # rows of a block, blocks of a shard on average, queries of a bundle on average
SAMPLE, CENTRES = 8192, 512  # vectors that centres are made from, and centres at most
TABLE = 4096  # blocks, and bundles times 64, whose bounds are taken in one task
LOW = np.iinfo(np.int64).min


def quantised(flat: np.ndarray, scale: float) -> np.ndarray:
    return np.clip(np.floor(scale * flat.astype(np.float64)), -(2.0**62), 2.0**62).astype(np.int64)


def packed(m: np.ndarray) -> tuple[bytes, str]:
    for kind in ("i1", "i2", "i4"):
        if not m.size or np.iinfo(kind).min <= m.min() and m.max() <= np.iinfo(kind).max:
            return m.astype(kind).tobytes(), kind
    return m.tobytes(), "i8"


def unpacked(data: bytes, kind: str, n: int) -> np.ndarray:
    return np.frombuffer(data, dtype=kind).astype(np.int64).reshape(n, -1)


def products(m: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact integer products m @ q.T, as floats' matrix product where that is exact, held to a long."""
    if not m.size or not q.size:
        return np.zeros((len(m), len(q)), dtype=np.int64)
    if float(np.abs(m).max()) * float(np.abs(q).max()) * m.shape[1] < 2**53:
        return (m.astype(np.float64) @ q.T.astype(np.float64)).astype(np.int64)
    return np.clip(m.astype(object) @ q.T.astype(object), LOW, -(LOW + 1)).astype(np.int64)


def bounds(top: np.ndarray, low: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Of each block and query: the sum of the terms' best values."""
    return products(np.hstack([top, low]), np.hstack([np.maximum(q, 0), np.minimum(q, 0)]))


def best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Indices of each query's k best entries: higher score first, ties to the smaller id."""
    order = np.lexsort((ids, -score.astype(np.float64) if np.abs(score).max(initial=0) < 2**53 else ~score, query))
    q = query[order]
    first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
    return order[rank < k]


def rows_of(batches: Iterator[pa.RecordBatch], scale: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, matrix, is_query) of rows of one length; rows that take no part are left out."""
    for b in batches:
        flat, lengths, ok = vector_rows(b.column(1))
        ends = np.cumsum(lengths)
        ids, asks = b.column(0).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False).astype(bool)
        values = quantised(np.where(np.isfinite(flat), flat, 0), scale)
        for dim in np.unique(lengths[ok]):
            w = np.flatnonzero(ok & (lengths == dim))
            yield ids[w], values[(ends[w] - dim)[:, None] + np.arange(dim)[None, :]], asks[w]


class Places:
    """Centres of each length, and how many rows and queries each has."""

    def __init__(self, sample: dict[int, np.ndarray], n: int, rows: int):
        total = max(1, sum(map(len, sample.values())))
        self.at: dict[int, np.ndarray] = {}
        for dim, m in sample.items():
            unit = normalised(m.astype(np.float64))
            c = centres(unit, max(1, min(CENTRES, int(n * len(m) / total) // rows))) if dim else unit[:1]
            if len(c) > 1:  # near centres come next to each other
                c = c[np.argsort((c - c.mean(axis=0)) @ np.linalg.svd(c - c.mean(axis=0), full_matrices=False)[2][0])]
            self.at[dim] = c

    def of(self, m: np.ndarray) -> np.ndarray:
        c = self.at.get(m.shape[1])
        return np.zeros(len(m), np.int64) if c is None or not m.shape[1] else (normalised(m.astype(np.float64)) @ c.T).argmax(axis=1)


BLOCKS = "dim int, cell int, shard long, block long, ids binary, kind string, data binary, asks binary, floors binary"


def index_of(rows: DataFrame, k: int, scale: float, block: int, shard: int) -> DataFrame:
    """rows(id, vec, asks) -> blocks; asks are a block's places that hold queries, floors their first k-th scores."""

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, m, _ in rows_of(batches, scale):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), m.shape[1], np.int32)), pa.array([x.tobytes() for x in m], pa.binary())], names=["dim", "vec"])

    n = rows.count()
    share = min(1.0, SAMPLE / max(1, n))
    got = rows.where(F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(1 << 20)) < F.lit(max(1, int(share * (1 << 20))))).mapInArrow(some, "dim int, vec binary").limit(2 * SAMPLE).collect()
    by: dict[int, list[bytes]] = {}
    for r in got:
        by.setdefault(r.dim, []).append(bytes(r.vec))
    places = Places({d: np.frombuffer(b"".join(v), dtype=np.int64).reshape(len(v), d) for d, v in by.items()}, n, max(1, block // 4))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, m, asks in rows_of(batches, scale):
            data = [packed(x) for x in m]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), m.shape[1], np.int32)), pa.array(places.of(m).astype(np.int32)), pa.array(ids), pa.array([d for d, _ in data], pa.binary()), pa.array([x for _, x in data]), pa.array(asks)], names=["dim", "cell", "id", "vec", "kind", "asks"])

    placed = rows.mapInArrow(place, "dim int, cell int, id long, vec binary, kind string, asks boolean")
    over = Window.partitionBy("dim").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("dim", "cell").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(over), F.lit(0)))  # a row for each centre
    sizes = sizes.select("dim", "cell", F.floor(F.col("before") / (block * shard)).alias("at"), F.ceil(F.col("n") / (block * shard)).alias("parts"))
    # a centre of many rows has as many shards; rows of one id are spread by their vector
    dealt = placed.join(sizes, ["dim", "cell"]).withColumn("shard", F.xxhash64("dim", "at", F.pmod(F.xxhash64(F.lit(7), "id", "vec"), F.col("parts"))))

    def cut(key: tuple, t: pa.Table) -> pa.Table:
        dim, of = key[0].as_py(), key[1].as_py()
        ids = t["id"].to_numpy()
        m = np.stack([np.frombuffer(v.as_py(), dtype=x.as_py()).astype(np.int64) for v, x in zip(t["vec"], t["kind"], strict=True)])
        ask = np.flatnonzero(t["asks"].to_numpy(zero_copy_only=False))
        score, floor = products(m, m[ask]), np.full(len(ids), LOW)
        for j, q in enumerate(ask):
            s = np.sort(score[ids != ids[q], j])[::-1]
            if len(s) >= k:
                floor[q] = s[k - 1]
        asks = np.zeros(len(ids), dtype=bool)
        asks[ask] = True
        out, cells = [], t["cell"].to_numpy()
        for cell in np.unique(cells):
            mine = np.flatnonzero(cells == cell)
            if dim and len(mine) > block:  # rows that lean the same way share a block
                lean = normalised(m[mine].astype(np.float64))
                lean -= lean.mean(axis=0)
                mine = mine[np.argsort(lean @ np.linalg.svd(lean, full_matrices=False)[2][0], kind="stable")]
            for at in range(0, len(mine), block):
                w = mine[at : at + block]
                w = w[np.argsort(ids[w], kind="stable")]
                data, kind = packed(m[w])
                q = np.flatnonzero(asks[w])
                out.append({"dim": dim, "cell": int(cell), "shard": of, "block": len(out), "ids": ids[w].tobytes(), "kind": kind, "data": data, "asks": q.tobytes(), "floors": floor[w[q]].tobytes()})
        return pa.Table.from_pylist(out, schema=schema)

    schema = pa.schema([("dim", pa.int32()), ("cell", pa.int32()), ("shard", pa.int64()), ("block", pa.int64()), ("ids", pa.binary()), ("kind", pa.string()), ("data", pa.binary()), ("asks", pa.binary()), ("floors", pa.binary())])
    return written(dealt.groupBy("dim", "shard").applyInArrow(cut, BLOCKS), "blocks")


def queries_of(index: DataFrame) -> DataFrame:
    """(id, dim, cell, vec, floor) of each query once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                at, ids = np.frombuffer(r["asks"], dtype=np.int64), np.frombuffer(r["ids"], dtype=np.int64)
                if len(at):
                    m = unpacked(r["data"], r["kind"], len(ids))[at]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(np.full(len(at), r["dim"], np.int32)), pa.array(np.full(len(at), r["cell"], np.int32)), pa.array([x.tobytes() for x in m], pa.binary()), pa.array(np.frombuffer(r["floors"], dtype=np.int64))], names=["id", "dim", "cell", "vec", "floor"])

    found = index.mapInArrow(run, "id long, dim int, cell int, vec binary, floor long")
    return written(found.groupBy("id").agg(F.min(F.struct("dim", "vec", "floor", "cell")).alias("q")).select("id", "q.*"), "queries")


def bundles_of(queries: DataFrame, size: int) -> DataFrame:
    """(dim, bundle, asked): about `size` queries each, of one centre or of some next to each other."""
    over = Window.partitionBy("dim").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = queries.groupBy("dim", "cell").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(over), F.lit(0)))  # a row for each centre
    joined = queries.join(cells, ["dim", "cell"])
    salt = F.pmod(F.xxhash64(F.lit(9), "id"), F.ceil(F.col("n") / size))
    return written(joined.withColumn("bundle", F.xxhash64("dim", F.floor(F.col("before") / size), salt)).groupBy("dim", "bundle").agg(F.collect_list(F.struct("id", "vec", "floor")).alias("asked")), "bundles")


def asked_of(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, matrix, floors) of lists of queries."""
    asked = [x for r in rows for x in r]
    return np.array([x["id"] for x in asked]), np.frombuffer(b"".join(x["vec"] for x in asked), dtype=np.int64).reshape(len(asked), -1), np.array([x["floor"] for x in asked], dtype=np.int64)


def extremes(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (m.max(axis=0), m.min(axis=0)) if m.shape[1] else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def surviving(index: DataFrame, bundles: DataFrame, size: int = TABLE) -> DataFrame:
    """(dim, shard, block, bundle) of blocks for which some query of the bundle has a bound that reaches its first k-th score."""

    def maxima(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                top, low = extremes(unpacked(r["data"], r["kind"], len(r["ids"]) // 8))
                yield pa.RecordBatch.from_pylist([{"dim": r["dim"], "shard": r["shard"], "block": r["block"], "top": top.tolist(), "low": low.tolist()}], schema=schema_in)

    schema_in = pa.schema([("dim", pa.int32()), ("shard", pa.int64()), ("block", pa.int64()), ("top", pa.list_(pa.int64())), ("low", pa.list_(pa.int64()))])
    schema = pa.schema([("dim", pa.int32()), ("shard", pa.int64()), ("block", pa.int64()), ("bundle", pa.int64())])
    tops = written(index.mapInArrow(maxima, "dim int, shard long, block long, top array<long>, low array<long>"), "maxima")
    left, right = max(1, -(-tops.count() // size)), max(1, -(-64 * bundles.count() // size))
    a = tops.withColumn("g", F.pmod(F.xxhash64("shard", "block"), F.lit(left)).cast("int")).withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(right - 1))))
    b = bundles.withColumn("h", salt_of(F.col("bundle"), right)).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(left - 1))))

    def meet(key: tuple, x: pa.Table, y: pa.Table) -> pa.Table:
        if not x.num_rows or not y.num_rows:
            return schema.empty_table()
        top, low = (np.array(x[c].to_pylist(), dtype=np.int64).reshape(x.num_rows, -1) for c in ("top", "low"))
        out = []
        for bundle, asked in zip(y["bundle"].to_pylist(), y["asked"].to_pylist(), strict=True):
            _, q, floor = asked_of([asked])
            hit = np.flatnonzero((bounds(top, low, q) >= floor[None, :]).any(axis=1))
            out.append(pa.table([x[c].take(pa.array(hit)) for c in ("dim", "shard", "block")] + [pa.array(np.full(len(hit), bundle))], schema=schema))
        return pa.concat_tables(out)

    return a.groupBy("dim", "g", "h").cogroup(b.groupBy("dim", "g", "h")).applyInArrow(meet, "dim int, shard long, block long, bundle long")


def search(df: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 256.0, block: int = BLOCK, shard: int = SHARD, bundle: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row where is_query holds, the k rows of other ids with the highest integer inner product of floor(scale * x).

    Ties go to the smaller vec_id. Fewer than k candidates: all of them. Vectors that are null or
    hold null or non-finite components, and rows with a null id, take no part; vectors of other
    lengths are no candidates. Rows that repeat an id are candidates each; as queries they count
    once (the least vector). Components beyond 2^62 and scores beyond a long are held to that. Other
    columns are read only by is_query, whatever their names. An empty table gives none."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"), F.coalesce(is_query, F.lit(False)).alias("asks")).where("id is not null and vec is not null")
    index = index_of(rows, k, scale, block, shard)
    bundles = bundles_of(queries_of(index), bundle)
    pairs = written(surviving(index, bundles), "pairs")

    def score(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return schema_out.empty_table()
        qid, q, kth = asked_of(b["asked"].to_pylist())
        held = [(np.frombuffer(r["ids"], dtype=np.int64), unpacked(r["data"], r["kind"], len(r["ids"]) // 8)) for r in a.to_pylist()]
        ends = [extremes(m) for _, m in held]
        bound = bounds(np.stack([x for x, _ in ends]), np.stack([y for _, y in ends]), q)
        order = np.argsort(-bound, axis=0, kind="stable")
        tq, ti, ts = (np.zeros(0, np.int64) for _ in range(3))
        for step in range(len(held)):
            at = order[step]
            live = np.flatnonzero(bound[at, np.arange(len(q))] >= kth)
            if not len(live):
                break  # bounds fall from step to step, k-th scores only rise
            new = []
            for blk in np.unique(at[live]):
                w = live[at[live] == blk]
                ids, m = held[blk]
                s = products(m, q[w])
                r, c = np.nonzero((s >= kth[w][None, :]) & (ids[:, None] != qid[w][None, :]))
                new.append((w[c], ids[r], s[r, c]))
            tq, ti, ts = (np.concatenate([x, *(n[i] for n in new)]) for i, x in enumerate((tq, ti, ts)))
            keep = best(tq, ti, ts, k)
            tq, ti, ts = tq[keep], ti[keep], ts[keep]
            full = np.bincount(tq, minlength=len(q)) == k
            last = np.full(len(q), LOW)
            last[tq] = ts  # the last entry of each query is its k-th
            kth = np.where(full, np.maximum(kth, last), kth)
        return pa.table({"query_id": qid[tq], "vec_id": ti, "score": ts}, schema=schema_out)

    schema_out = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
    at = ["dim", "shard", "bundle"]
    left = index.select("dim", "shard", "block", "ids", "kind", "data").join(pairs, ["dim", "shard", "block"]).drop("block")
    right = bundles.join(pairs.select(*at).distinct(), ["dim", "bundle"])
    found = left.groupBy(*at).cogroup(right.groupBy(*at)).applyInArrow(score, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
