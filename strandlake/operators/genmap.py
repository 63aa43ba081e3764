"""Genetic distance: interpolation of a map to the typed sites, and recombination probabilities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEAST_CM, NE = 1e-7, 1_000_000


def interpolated(genetic_map: DataFrame, sites: DataFrame, by: str = "chrom") -> DataFrame:
    """sites with cm: linear in position between map points, held flat before the first and after the last.

    genetic_map(chrom, pos, cm); a position that the map holds takes its value. Both sides are laid
    over each other and filled from neighbours in one ordered pass for each chromosome."""
    points = genetic_map.groupBy(by, "pos").agg(F.min("cm").alias("cm"))
    laid = points.join(sites.select(by, "pos").distinct(), [by, "pos"], "full")
    order = Window.partitionBy(by).orderBy("pos")
    back, on = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col("cm").isNotNull(), F.struct("pos", "cm"))
    laid = laid.withColumn("a", F.last(known, True).over(back)).withColumn("b", F.first(known, True).over(on))
    line = F.col("a.cm") + (F.col("b.cm") - F.col("a.cm")) * (F.col("pos") - F.col("a.pos")) / (F.col("b.pos") - F.col("a.pos"))
    value = F.when(F.col("cm").isNotNull(), F.col("cm")).when(F.col("a").isNull(), F.col("b.cm")).when(F.col("b").isNull(), F.col("a.cm")).otherwise(line)
    return sites.join(laid.select(by, "pos", value.alias("cm")), [by, "pos"])


def recombination(cm: DataFrame, n_panel: int, ne: float = NE, by: str = "chrom") -> DataFrame:
    """cm(chrom, n, cm) with before and after: the probability of a switch from the previous site and to the next.

    No distance counts as 1e-7 cM, and so do the ends."""
    order = Window.partitionBy(by).orderBy("n")
    rho = lambda d: 1 - F.exp(F.when(d.isNull() | (d == 0), F.lit(LEAST_CM)).otherwise(d) * -0.04 * ne / n_panel)
    return cm.withColumn("before", rho(F.col("cm") - F.lag("cm").over(order))).withColumn("after", rho(F.lead("cm").over(order) - F.col("cm")))
