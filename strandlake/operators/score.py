"""Scoring of imputed calls against truth, by variant and by sample.

Both sides are rows (chunk, variant, sample_idx, h, allele), joined on variant, sample and strand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tables import met

EPS, TINY = 1e-8, 1e-15


def paired(imputed: DataFrame, truth: DataFrame) -> DataFrame:
    """(chunk, variant, sample_idx, h, x, y)."""
    return imputed.withColumnRenamed("allele", "x").join(met(truth.select("variant", "sample_idx", "h", F.col("allele").alias("y"))), ["variant", "sample_idx", "h"]).select("chunk", "variant", "sample_idx", "h", "x", "y")


def doses(pairs: DataFrame) -> DataFrame:
    """(chunk, variant, sample_idx, x, y): alleles of both strands summed."""
    return pairs.groupBy("chunk", "variant", "sample_idx").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))


def unphased(pairs: DataFrame) -> DataFrame:
    """Alleles put in one order within each genotype, so that phase does not count."""
    of = doses(pairs)
    both = of.withColumn("h", F.explode(F.array(F.lit(0), F.lit(1))))
    side = lambda c: (F.col(c) > 1 - F.col("h")).cast("int")  # noqa: E731  dose 1 is (0, 1)
    return both.select("chunk", "variant", "sample_idx", "h", side("x").alias("x"), side("y").alias("y"))


def _confusion() -> list[Column]:
    one = lambda a, b: F.sum(((F.col("x") == a) & (F.col("y") == b)).cast("long"))
    return [one(1, 1).alias("tp"), one(0, 0).alias("tn"), one(1, 0).alias("fp"), one(0, 1).alias("fn")]


def confusion_by_variant(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("variant").agg(*_confusion()).withColumn("te", F.col("fp") + F.col("fn"))


def confusion_by_sample(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("sample_idx").agg(*_confusion()).withColumn("te", F.col("fp") + F.col("fn"))


def fscore_by_variant(pairs: DataFrame) -> DataFrame:
    c = confusion_by_variant(pairs)
    p = (F.col("tp") + EPS) / (F.col("tp") + F.col("fp") + EPS)
    r = (F.col("tp") + EPS) / (F.col("tp") + F.col("fn") + EPS)
    return c.select("variant", "tp", "tn", "fp", "fn", "te", F.round(p, 6).alias("prec"), F.round(r, 6).alias("recall"), F.round(2 * p * r / (p + r), 6).alias("fscore"))


def accuracy_by_variant(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("variant").agg(F.round(F.avg((F.col("x") == F.col("y")).cast("double")), 6).alias("accuracy"))


def _moments(n: Column) -> tuple[Column, Column]:
    sx, sy = F.sum("x"), F.sum("y")
    num = n * F.sum(F.col("x") * F.col("y")) - sx * sy
    den = F.sqrt(((n * F.sum(F.col("x") * F.col("x")) - sx * sx) * (n * F.sum(F.col("y") * F.col("y")) - sy * sy)).cast("double"))
    return num, den


def r2_by_variant(pairs: DataFrame) -> DataFrame:
    num, den = _moments(F.count("*"))
    return doses(pairs).groupBy("variant").agg(F.round(F.pow(num / (den + TINY), F.lit(2.0)), 6).alias("r2"))


def rmse_by_variant(pairs: DataFrame) -> DataFrame:
    d = F.col("x") - F.col("y")
    return pairs.groupBy("variant").agg(F.round(F.sqrt(F.avg((d * d).cast("double"))), 6).alias("rmse"))


def iqs_by_variant(pairs: DataFrame) -> DataFrame:
    """Imputation quality: observed concordance of genotype classes against its expectation; null where that is 1."""
    same = F.sum((F.col("x") == F.col("y")).cast("long"))
    n = F.count("*")
    # of three class indicators, all agree where the genotype does, else one
    p0 = (same * 3 + (n - same)) / (n * 3)
    pc = (same / n) * (same / n)
    return doses(pairs).groupBy("variant").agg(F.round(F.when(pc < 1, (p0 - pc) / (1 - pc)), 6).alias("iqs"), F.round(p0, 6).alias("p0"))


def by_sample(pairs: DataFrame, phased: bool = True) -> DataFrame:
    """The sample report: sums by chunk and sample, then by sample. r2 depends on the chunks, as its parts are summed."""
    c = (pairs if phased else unphased(pairs)).groupBy("chunk", "sample_idx").agg(*_confusion())
    a = pairs.groupBy("chunk", "sample_idx").agg((F.sum((F.col("x") == F.col("y")).cast("double")) / 2).alias("right"), F.countDistinct("variant").alias("n_var"))
    num, den = _moments(F.count("*"))
    d = doses(pairs).groupBy("chunk", "sample_idx").agg((num + TINY).alias("num"), (den + TINY).alias("den"))
    all_ = c.join(met(a), ["chunk", "sample_idx"]).join(met(d), ["chunk", "sample_idx"])
    s = all_.groupBy("sample_idx").agg(*[F.sum(x).alias(x) for x in ("right", "n_var", "num", "den", "tp", "tn", "fp", "fn")])
    prec = F.round(F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), 6)
    rec = F.round(F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0)), 6)
    s = s.withColumn("prec", prec).withColumn("recall", rec)
    f1 = F.round(2 * F.col("prec") * F.col("recall") / F.nullif(F.col("prec") + F.col("recall"), F.lit(0.0)), 6)
    return s.select("sample_idx", F.round(F.col("right") / F.col("n_var"), 6).alias("accuracy"), F.round(F.pow(F.col("num") / F.col("den"), F.lit(2.0)), 6).alias("r2"), "tp", "tn", "fp", "fn", (F.col("fp") + F.col("fn")).alias("te"), "prec", "recall", f1.alias("f1"))


def variant_report(pairs: DataFrame, phased: bool = True) -> DataFrame:
    """One row for each variant: confusion, F-score, accuracy, r2, RMSE, IQS."""
    out = fscore_by_variant(pairs if phased else unphased(pairs))
    for other in (accuracy_by_variant(pairs), r2_by_variant(pairs), rmse_by_variant(pairs), iqs_by_variant(pairs)):
        out = out.join(other, "variant")
    return out
