"""From weights at typed sites to ALT probabilities at every panel site."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import met


def row_sites(shared: DataFrame, n_variants: int) -> DataFrame:
    """(row, site) for weight rows: 0 at the first panel site, the typed sites, the last panel site.

    shared(n, site) of typed sites in order."""
    typed = shared.select((F.col("n") + 1).cast("int").alias("row"), F.col("site").cast("long").alias("site"))
    ends = shared.agg(F.count("*").alias("c")).select(F.explode(F.array(F.struct(F.lit(0).alias("row"), F.lit(0).cast("long").alias("site")), F.struct((F.col("c") + 1).cast("int").alias("row"), F.lit(n_variants - 1).cast("long").alias("site")))).alias("e")).select("e.row", "e.site")
    return typed.unionByName(ends)


def interval_table(rows: DataFrame) -> DataFrame:
    """(row, start, num): the interval from each row to the next and how many sites it holds; the last holds its end."""
    after = rows.select((F.col("row") - 1).alias("row"), F.col("site").alias("next"))
    last = rows.agg((F.max("row") - 1).alias("last"))  # one row
    out = rows.join(after, "row").join(F.broadcast(last), F.col("row") == F.col("last"), "left")
    return out.select("row", F.col("site").alias("start"), (F.col("next") - F.col("site") + F.col("last").isNotNull().cast("int")).alias("num"))


def interval_chunks(intervals: DataFrame, n_chunks: int) -> DataFrame:
    """intervals with part: even runs of intervals, one for every ten panel chunks (one at least), as a partition key."""
    parts = max(n_chunks // 10, 1)
    n = intervals.agg(F.count("*").alias("n")).first().n
    return intervals.withColumn("part", F.floor(F.col("row") / max(1, -(-n // parts))))


def site_intervals(intervals: DataFrame) -> DataFrame:
    """(site, row, k, num): each panel site in exactly one interval, k sites after its start."""
    some = intervals.where("num > 0")
    return some.select("row", "num", "start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("num") - 1)).alias("k")).select((F.col("start") + F.col("k")).alias("site"), "row", "k", "num")


def interval_weights(weights: DataFrame, intervals: DataFrame) -> DataFrame:
    """(target_hap, row, ref_hap, w0, w1, num): weights at both ends of each interval, over haplotypes that have one at either."""
    w = weights.select("target_hap", "row", "ref_hap", "w")
    zero = F.lit(0.0)
    ends = F.explode(F.array(F.struct(F.col("row").alias("row"), F.col("w").alias("w0"), zero.alias("w1")), F.struct((F.col("row") - 1).alias("row"), zero.alias("w0"), F.col("w").alias("w1"))))
    both = w.select("target_hap", "ref_hap", ends.alias("e")).select("target_hap", "ref_hap", "e.row", "e.w0", "e.w1")
    both = both.groupBy("target_hap", "row", "ref_hap").agg(F.sum("w0").alias("w0"), F.sum("w1").alias("w1"))
    return both.join(intervals.select("row", "num"), "row")


def site_weights(ends: DataFrame, sites: DataFrame) -> DataFrame:
    """(target_hap, site, ref_hap, w): weights interpolated linearly in the number of sites."""
    w = F.col("w0") + (F.col("w1") - F.col("w0")) * F.col("k") / F.col("num")
    return ends.drop("num").join(sites, "row").select("target_hap", "site", "ref_hap", w.alias("w"))


def alt_probabilities(ends: DataFrame, sites: DataFrame, alt: DataFrame, digits: int = 10) -> DataFrame:
    """(site, target_hap, p): the weighted share of ALT alleles at each panel site.

    alt(site, hap) holds ALT alleles only. What all haplotypes weigh together is interpolated from the
    sums at the interval's ends; only haplotypes with the ALT allele are met one by one."""
    at = lambda a, b: F.col(a) + (F.col(b) - F.col(a)) * F.col("k") / F.col("num")
    whole = ends.groupBy("target_hap", "row").agg(F.sum("w0").alias("s0"), F.sum("w1").alias("s1"))
    whole = whole.join(sites, "row").select("target_hap", "site", at("s0", "s1").alias("whole"))
    held = alt.select("site", F.col("hap").alias("ref_hap")).join(sites, "site").join(met(ends.drop("num")), ["row", "ref_hap"])
    held = held.groupBy("target_hap", "site").agg(F.sum(at("w0", "w1")).alias("part"))
    p = F.coalesce(F.col("part"), F.lit(0.0)) / F.col("whole")
    return whole.join(met(held), ["target_hap", "site"], "left").select("site", "target_hap", F.round(p, digits).alias("p"))
