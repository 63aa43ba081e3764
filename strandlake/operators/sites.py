"""Site and haplotype tables: intersection, masks, selection, slices, frequencies, zone maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["chrom", "pos", "ref", "alt"]


def first_rows(sites: DataFrame, row: str) -> DataFrame:
    """One row for each site key, with the smallest row number; a pre-aggregated minimum."""
    return sites.groupBy(*KEY).agg(F.min(row).alias(row))


def intersect(panel: DataFrame, target: DataFrame, panel_row: str = "site", target_row: str = "target_row") -> DataFrame:
    """Sites in both tables with the first row number on either side."""
    return first_rows(panel, panel_row).join(first_rows(target, target_row), KEY)


def mask(sites: DataFrame, shared: DataFrame, row: str = "site") -> DataFrame:
    """0/1 for each row: whether it is shared. The join is on the row number, unique on both sides."""
    return sites.select(row).join(shared.select(row).withColumn("one", F.lit(1)), row, "left").select(row, F.coalesce("one", F.lit(0)).alias("keep"))


def dense(sites: DataFrame, *by: str, within: tuple[str, ...] = ("chrom",), width: int = 1 << 16) -> DataFrame:
    """Adds n, the rank from 0 in the order of `by` (the site number) within each chromosome.

    The first of `by` is a number; ranges of `width` of it are ranked in one piece each, and ranges
    are summed up, so that no task holds a whole chromosome."""
    by = by or ("site",)
    at = sites.withColumn("__range", F.floor(F.col(by[0]) / width))
    before = Window.partitionBy(*within).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    ahead = at.groupBy(*within, "__range").agg(F.count("*").alias("__n")).withColumn("__ahead", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    local = at.withColumn("__local", F.row_number().over(Window.partitionBy(*within, "__range").orderBy(*by)) - 1)
    return local.join(ahead, [*within, "__range"]).select(*sites.columns, (F.col("__ahead") + F.col("__local")).cast("int").alias("n"))


def mismatched(panel_shared: DataFrame, target_shared: DataFrame) -> DataFrame:
    """Rows (n, key) that differ between the filtered site lists; empty when both agree in keys and order."""
    a, b = panel_shared.select("n", *KEY), target_shared.select("n", *KEY)
    return a.exceptAll(b).withColumn("side", F.lit("panel")).unionByName(b.exceptAll(a).withColumn("side", F.lit("target")))


def merge(panel: DataFrame, target: DataFrame, first: int) -> DataFrame:
    """Panel and target alleles as one table; target haplotypes follow the panel's, from number `first` on."""
    return panel.select("site", "hap", "allele").unionByName(target.select("site", (F.col("hap") + first).alias("hap"), "allele"))


def select_samples(alleles: DataFrame, samples: DataFrame, names: list[str]) -> DataFrame:
    """Alleles of the named samples, haplotypes renumbered in the order of the names.

    A name listed twice gives the sample twice; the numbers of a name that no sample bears stay unused."""
    listed = F.explode(F.filter(F.transform(F.array(*[F.lit(n) for n in names]), lambda x, i: F.struct(x.alias("name"), i.alias("k"))), lambda x: x["name"] == F.col("sample_id")))
    ranked = samples.where(F.col("sample_id").isin(names)).withColumn("at", listed)
    out = alleles.withColumn("sample_idx", F.floor(F.col("hap") / 2)).join(ranked.select("sample_idx", "sample_id", F.col("at.k").alias("k")), "sample_idx")
    return out.select("sample_id", (F.col("k") * 2 + F.col("hap") % 2).cast("int").alias("hap"), "site", "allele")


def rows_at(alleles: DataFrame, i: int, chunk_size: int | None = None) -> DataFrame:
    """chunk_size: of a store whose partition column is chunk; only site i's chunk is read then."""
    out = alleles.where(F.col("site") == i)
    return out if chunk_size is None else out.where(F.col("chunk") == i // chunk_size)


def rows_between(alleles: DataFrame, start: int | None = None, stop: int | None = None, step: int = 1, chunk_size: int | None = None) -> DataFrame:
    """Global slice semantics over non-negative sites; a negative step only reverses the order, which rows don't have.

    chunk_size: of a store whose partition column is chunk; only the chunks of the range are read then."""
    span = abs(step)
    low, high = (start or 0, stop) if step > 0 else ((stop + 1) if stop is not None else 0, None if start is None else start + 1)
    anchor = low if step > 0 else (start if start is not None else low)
    out = alleles.where(F.col("site") >= low)
    out = out if high is None else out.where(F.col("site") < high)
    if chunk_size is not None:
        out = out.where(F.col("chunk") >= low // chunk_size)
        out = out if high is None else out.where(F.col("chunk") <= max(0, high - 1) // chunk_size)
    return out if span == 1 else out.where(F.pmod(F.col("site") - anchor, F.lit(span)) == 0)


def take(alleles: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(ordinal, site): the rows of each listed site with its ordinal."""
    return wanted.join(alleles, "site")


def position_range(sites: DataFrame, low: int, high: int, inclusive: bool = True) -> DataFrame:
    return sites.where((F.col("pos") >= low) & ((F.col("pos") <= high) if inclusive else (F.col("pos") < high)))


def minor_frequency(alleles: DataFrame) -> DataFrame:
    f = F.avg(F.col("allele").cast("double"))
    return alleles.groupBy("site").agg(F.least(f, 1 - f).alias("maf"))


def dosage(alleles: DataFrame) -> DataFrame:
    return alleles.groupBy("site", F.floor(F.col("hap") / 2).alias("sample_idx")).agg(F.sum("allele").alias("dose"))


def chunked(sites: DataFrame, size: int) -> DataFrame:
    return sites.withColumn("chunk", F.floor(F.col("site") / size))


def zone_map(sites: DataFrame) -> DataFrame:
    return sites.groupBy("chunk").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.count("*").alias("n_sites"))


def panel_facts(sites: DataFrame, alleles: DataFrame) -> DataFrame:
    """One row for each chromosome: sites, chunks, position range; and the number of haplotypes."""
    n = alleles.agg(F.countDistinct("hap")).first()[0]
    facts = sites.groupBy("chrom").agg(F.count("*").alias("n_variants"), F.min("pos").alias("min_position"), F.max("pos").alias("max_position"), F.countDistinct("chunk").alias("n_chunks"))
    return facts.withColumn("n_haps", F.lit(n).cast("long")).withColumn("n_samples", F.lit(n // 2).cast("long"))


def position_chunks(sites: DataFrame, per_chunk: int) -> DataFrame:
    """(chrom, k, start, stop): even position ranges that hold about per_chunk sites; the last has no stop."""
    facts = sites.groupBy("chrom").agg(F.count("*").alias("n"), F.max("pos").alias("last"))
    facts = facts.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("n") / per_chunk))).withColumn("width", F.ceil(F.col("last") / F.col("parts")))
    out = facts.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    return out.select("chrom", "k", (F.col("k") * F.col("width") + 1).alias("start"), F.when(F.col("k") < F.col("parts") - 1, (F.col("k") + 1) * F.col("width")).alias("stop"))

