import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.llm import metric_join, topk

SF = "/root/testdata/sf0.001"


def rows_of(df, columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    return c


def test_op1_matches_sql(spark, duck):
    cols = ["query_id", "rank", "vec_id", "score"]
    want = sorted(duck.sql(topk.OP1_SQL).select(*cols).fetchall())
    assert rows_of(topk.op1_topk(spark, SF), cols) == want


def test_op6_matches_sql(spark, duck):
    cols = ["vec_id", "n_links", "component_id", "kept"]
    want = sorted(duck.sql(metric_join.OP6_SQL).select(*cols).fetchall())
    assert rows_of(metric_join.op6_metric_join(spark, SF), cols) == want


def test_search_small_parts_ties_and_odd_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=6).round(1)]) for i in range(90)]
    rows += [(i, rows[3][1]) for i in range(90, 110)] + [(200, None), (201, [None, 1.0]), (202, [float("nan")] * 6), (203, []), (250, [1.0, 2.0]), (None, [1.0] * 6), (300, [1e300, -1e300, 0.0, 0.0, 0.0, 0.0])]
    rows += [rows[5]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    df = df.withColumn("block", F.lit(1)).withColumn("score", F.lit("x"))
    got = rows_of(topk.search(df, F.col("vec_id") % 5 == 0, 4, block=8, shard=2, bundle=5), ["query_id", "rank", "vec_id", "score"])
    live = [(i, [int(np.clip(np.floor(256 * x), -(2.0**62), 2.0**62)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q in sorted({i for i, _ in live if i % 5 == 0}):
        v = next(v for i, v in live if i == q)
        scored = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, w)))), i) for i, w in live if i != q and len(w) == len(v))
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:4])]
    assert got == sorted(want)
    assert topk.search(df.limit(0), F.col("vec_id") % 5 == 0, 4).count() == 0


@pytest.mark.parametrize("pivots", [(4,), (2, 16, 32), metric_join.PIVOTS])
def test_links_small_parts_ties_and_odd_rows(spark, pivots):
    rng = np.random.default_rng(6)
    rows = []
    for _ in range(30):
        c = rng.normal(size=5)
        for _ in range(rng.integers(1, 6)):
            rows.append((len(rows), [float(x) for x in c + rng.normal(size=5) * 0.25]))
    rows += [(1000 + i, rows[7][1]) for i in range(25)]
    rows += [(2000, None), (2001, [0.0] * 5), (2002, [float("inf")] * 5), (2003, [None] * 5), (2004, []), (2005, [1.0, 0.0]), (2006, [2.0, 0.0]), (2007, [x * 1e200 for x in rows[0][1]])]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("key", "vec", "cell", "copies", "rid", "task")})
    got = rows_of(metric_join.link_groups(df, part_bytes=320, pivots=pivots), ["vec_id", "n_links", "component_id", "kept"])
    unit = {i: np.array(v) / np.abs(v).max() for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    root = {i: i for i, _ in rows}
    n = dict.fromkeys(root, 0)

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in unit:
        for b in unit:
            if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] / np.sqrt((unit[a] @ unit[a]) * (unit[b] @ unit[b])) >= 0.95:
                n[a] += 1
                n[b] += 1
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    assert got == sorted((i, n[i], top(i), top(i) == i) for i in root)
    assert metric_join.link_groups(df.limit(0)).count() == 0
