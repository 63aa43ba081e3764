"""Genotype calls, allele counts and VCF records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import short_number
from ..functions.tables import met


def calls(probs: DataFrame) -> DataFrame:
    """probs(site, target_hap, p) -> (site, sample_idx, ap1, ap2, ds, gt1, gt2): a call is ALT where p is over one half."""
    pair = probs.groupBy("site", F.floor(F.col("target_hap") / 2).alias("sample_idx")).agg(*[F.max(F.when(F.col("target_hap") % 2 == h, F.col("p"))).alias(f"ap{h + 1}") for h in (0, 1)])
    gt = lambda c: (F.col(c) > 0.5).cast("int")
    return pair.select("site", "sample_idx", "ap1", "ap2", (F.col("ap1") + F.col("ap2")).alias("ds"), gt("ap1").alias("gt1"), gt("ap2").alias("gt2"))


def allele_counts(called: DataFrame) -> DataFrame:
    """(site, ac, an, af): ALT alleles, all alleles, and their ratio to four places."""
    ac, an = F.sum(F.col("gt1") + F.col("gt2")), F.count("*") * 2
    return called.groupBy("site").agg(ac.alias("ac"), an.alias("an")).withColumn("af", F.round(F.col("ac") / F.col("an"), 4))


def records(called: DataFrame, sites: DataFrame, typed: DataFrame, own: DataFrame) -> DataFrame:
    """(site, chrom, pos, record): one VCF line for each panel site.

    typed(site) sites show the target's own genotypes, own(site, sample_idx, gt); the others the call,
    dose and probabilities, flagged IMP. AC and AF are those of the imputed calls at every site. An
    empty original id falls back to the variant id."""
    text = F.concat_ws(":", F.concat_ws("|", "gt1", "gt2"), short_number(F.col("ds")), short_number(F.col("ap1")), short_number(F.col("ap2")))
    rows = called.select("site", "sample_idx", text.alias("text")).join(met(own), ["site", "sample_idx"], "left").join(typed.select("site", F.lit(True).alias("typed")).distinct(), "site", "left")
    shown = F.when(F.col("typed"), F.coalesce("gt", F.lit("./."))).otherwise(F.col("text"))
    lines = rows.groupBy("site").agg(F.max(F.coalesce("typed", F.lit(False))).alias("typed"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("sample_idx", shown.alias("x")))), lambda x: x["x"]), "\t").alias("samples"))
    af = F.when(F.col("ac") % F.col("an") == 0, F.format_string("%d", (F.col("ac") / F.col("an")).cast("long"))).otherwise(F.col("af").cast("string"))
    out = lines.join(allele_counts(called), "site").join(sites, "site")
    info = F.concat(F.lit("AF="), af, F.lit(";AC="), F.col("ac"), F.lit(";AN="), F.col("an"), F.when(F.col("typed"), "").otherwise(";IMP"))
    name = F.coalesce(F.nullif(F.col("original_id"), F.lit("")), F.col("id"))
    record = F.concat_ws("\t", "chrom", "pos", name, "ref", "alt", F.lit("."), F.lit("PASS"), info, F.when(F.col("typed"), "GT").otherwise("GT:DS:AP1:AP2"), "samples")
    return out.select("site", "chrom", "pos", record.alias("record"))
