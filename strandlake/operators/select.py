"""Coverage, scores and the informative haplotypes of each target and site."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import deviations_kept, min_max
from ..functions.tables import met

BEST, DIGITS = 50, 12


def coverage(matches: DataFrame, n_sites: int) -> DataFrame:
    """matches with stop and the stretch (low, high) each covers once gaps are filled, and added, the sites gained.

    Before a target's first covered site its runs that begin there reach back to 0; before any other
    gap the runs that end there reach forward to it end. Lengths stay as they are."""
    t = Window.partitionBy("target_hap")
    by_start = t.orderBy("start")
    m = matches.withColumn("stop", F.col("start") + F.col("len") - 1)
    m = m.withColumn("first", F.min("start").over(t))
    starts = m.groupBy("target_hap", "start").agg(F.max("stop").alias("far"))
    reach = F.max("far").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    heads = starts.withColumn("before", reach).where(F.col("before").isNull() | (F.col("start") > F.col("before") + 1))
    # an island of covered sites ends before the next head; what ends with it stretches to that head
    ends = heads.select("target_hap", F.coalesce("before", F.lit(-2)).alias("stop"), F.col("start").alias("next"))
    tail = m.groupBy("target_hap").agg(F.max("stop").alias("stop")).withColumn("next", F.lit(n_sites))
    ends = ends.where("stop >= 0").unionByName(tail)
    m = m.join(met(ends), ["target_hap", "stop"], "left")
    low = F.when(F.col("start") == F.col("first"), F.lit(0)).otherwise(F.col("start"))
    high = F.coalesce(F.col("next") - 1, F.col("stop"))
    m = m.withColumn("low", low).withColumn("high", high).withColumn("added", F.col("start") - F.col("low") + F.col("high") - F.col("stop"))
    return m.select("target_hap", "ref_hap", "start", "len", "stop", "low", "high", "added")


def missing_sites(cover: DataFrame, n_sites: int) -> DataFrame:
    """(target_hap, n) of sites that no run covers before gaps are filled."""
    all_ = cover.select("target_hap").distinct().select("target_hap", F.explode(F.sequence(F.lit(0), F.lit(n_sites - 1))).alias("n"))
    held = cover.select("target_hap", F.explode(F.sequence("start", "stop")).alias("n"))
    return all_.join(met(held), ["target_hap", "n"], "left_anti")


def stabbed(cover: DataFrame, low: str = "low", high: str = "high") -> DataFrame:
    """A row for each run and site it covers: the interval join by expansion, bounded by the runs kept at each start."""
    return cover.withColumn("n", F.explode(F.sequence(low, high)))


def totals(cover: DataFrame, n_panel: int) -> DataFrame:
    """(target_hap, ref_hap, tot, norm) of panel haplotypes with a run.

    tot is the matched length with gaps filled; norm scales it over all n_panel haplotypes, those
    without a run counting as 0."""
    sums = cover.groupBy("target_hap", "ref_hap").agg(F.sum(F.col("len") + F.col("added")).alias("tot"))
    t = Window.partitionBy("target_hap")
    low = F.when(F.count("*").over(t) < n_panel, F.lit(0)).otherwise(F.min("tot").over(t))
    return sums.withColumn("low", low).withColumn("high", F.max("tot").over(t)).select("target_hap", "ref_hap", "tot", min_max(F.col("tot").cast("double"), F.col("low"), F.col("high")).alias("norm"))


def scored(cover: DataFrame, total: DataFrame, digits: int = DIGITS) -> DataFrame:
    """cover with score = len * norm, rounded so that equal scores stay equal."""
    return cover.join(met(total.select("target_hap", "ref_hap", "norm")), ["target_hap", "ref_hap"]).withColumn("score", F.round(F.col("len") * F.col("norm"), digits))


def thresholds(score: DataFrame, n_sites: int, digits: int = DIGITS) -> DataFrame:
    """(target_hap, n, avg_len, sd, best, threshold) of each site."""
    least = score.groupBy("target_hap").agg(F.min("len").alias("min_len"))
    at = stabbed(score).groupBy("target_hap", "n").agg(F.avg("len").alias("avg_len"), F.stddev_pop("score").alias("sd"), F.max("score").alias("best"))
    at = at.join(met(least), "target_hap")
    k = deviations_kept(F.col("avg_len"), F.col("min_len"), n_sites)
    return at.select("target_hap", "n", "avg_len", "sd", "best", F.round(F.col("best") - F.col("sd") * k, digits).alias("threshold"))


def best_at_sites(score: DataFrame, limits: DataFrame, cap: int = BEST) -> DataFrame:
    """(target_hap, n, ref_hap, score, k): runs at or over the site's threshold, the best `cap`; ties to the larger haplotype."""
    at = stabbed(score).join(met(limits.select("target_hap", "n", "threshold")), ["target_hap", "n"]).where(F.col("score") >= F.col("threshold"))
    order = Window.partitionBy("target_hap", "n").orderBy(F.desc("score"), F.desc("ref_hap"))
    return at.withColumn("k", F.row_number().over(order)).where(F.col("k") <= cap).select("target_hap", "n", "ref_hap", "score", "k")


def seen_again(best: DataFrame) -> DataFrame:
    """(target_hap, ref_hap, sites) of haplotypes at more than one site."""
    return best.groupBy("target_hap", "ref_hap").agg(F.count("*").alias("sites")).where("sites > 1")


def restricted(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """rows(target_hap, n, ref_hap) of kept haplotypes; a site that would lose all keeps all."""
    marked = rows.join(met(kept.select("target_hap", "ref_hap").withColumn("ok", F.lit(1))), ["target_hap", "ref_hap"], "left")
    any_ = F.max("ok").over(Window.partitionBy("target_hap", "n"))
    return marked.withColumn("any", any_).where("ok = 1 or any is null").select("target_hap", "n", "ref_hap")


def expanded(cover: DataFrame, chosen: DataFrame) -> DataFrame:
    """(target_hap, n, ref_hap): all sites of each run that holds a site where its haplotype was chosen."""
    at = stabbed(cover.select("target_hap", "ref_hap", "start", "low", "high"))
    holds = at.join(met(chosen), ["target_hap", "ref_hap", "n"], "left_semi").select("target_hap", "ref_hap", "start").distinct()
    return at.join(met(holds), ["target_hap", "ref_hap", "start"], "left_semi").select("target_hap", "n", "ref_hap")


def frequent(rows: DataFrame, n_sites: int) -> tuple[DataFrame, DataFrame]:
    """(haplotypes over the cutoff with their counts, cutoff and error rate of each target)."""
    counts = rows.groupBy("target_hap", "ref_hap").agg(F.count("*").alias("cnt"))
    cut = counts.groupBy("target_hap").agg(F.least(F.percentile("cnt", F.lit(0.1)), F.max("cnt") - F.lit(1.0)).alias("cutoff"))
    cut = cut.withColumn("error", F.col("cutoff") / n_sites)
    return counts.join(met(cut), "target_hap").where("cnt > cutoff").select("target_hap", "ref_hap", "cnt"), cut


def selected(matches: DataFrame, n_sites: int, n_panel: int, cap: int = BEST) -> tuple[DataFrame, DataFrame]:
    """From kept runs to (target_hap, n, ref_hap) and each target's error rate."""
    cover = coverage(matches, n_sites)
    score = scored(cover, totals(cover, n_panel))
    best = best_at_sites(score, thresholds(score, n_sites), cap)
    chosen = restricted(best.select("target_hap", "n", "ref_hap"), seen_again(best))
    wide = expanded(cover, chosen)
    kept, cut = frequent(wide, n_sites)
    return restricted(wide, kept), cut
