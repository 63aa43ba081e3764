"""Connected components by alternating large-star and small-star rounds over a written edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("coalesce(bit_xor(xxhash64(u, v)), 0)"), F.expr("coalesce(sum(cast(v as decimal(38,0))), 0)")).first())


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges(u long, v long) -> (node, root): for each node of an edge the smallest node that it reaches.

    Hubs are safe: a node's neighbours are reduced by a pre-aggregated minimum and met again by a
    join, never gathered in a list. Every round ends in a written table."""
    edges = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = _mark(edges)
    if before[0] == 0:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        edges = written(small, "edges")
        now = _mark(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
