"""A panel, targets and a genetic map derived from the driver's tables.

Every vector of `embeddings` is a haplotype and every component a site; the allele is 1 where the
component is positive. Two vectors make a sample; every twentieth sample is a target, typed at every
second site, and all others are the panel. `nation` gives the genetic map.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import variant_id
from ..functions.tables import written
from ..operators import match
from ..operators import sites as site_ops
from .stages import Stages

EVERY = 20  # one in so many samples is a target
CHUNK = 16
CHROM = "20"


def is_target(hap: Column) -> Column:
    return F.floor(hap / 2) % EVERY == 0


def position(site: Column) -> Column:
    return (F.lit(60000) + site * 1000 + site * site % 997).cast("long")


def letter(letters: str, site: Column) -> Column:
    return F.substring(F.lit(letters), (site % 4 + 1).cast("int"), F.lit(1))


class Virtual(Stages):
    width: int | None = None  # sites; by default one for each component

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def alleles(self) -> DataFrame:
        if self.width:  # a site's allele is the sign of a product of two components
            at = F.explode(F.sequence(F.lit(0), F.lit(self.width - 1)))
            e = self.table("embeddings").select(F.col("vec_id").cast("int").alias("hap"), "embedding", at.alias("site"))
            one, other = F.get("embedding", F.col("site") % 64), F.get("embedding", (F.floor(F.col("site") / 64).cast("int") * 11 + F.col("site") + 1) % 64)
            return e.select("hap", F.col("site").cast("long").alias("site"), (one * other > 0).cast("int").alias("allele"))
        e = self.table("embeddings").select(F.col("vec_id").cast("int").alias("hap"), F.posexplode("embedding").alias("site", "x"))
        return e.select("hap", F.col("site").cast("long").alias("site"), (F.col("x") > 0).cast("int").alias("allele"))

    @cached_property
    def sites(self) -> DataFrame:
        s = self.table("embeddings").select((F.lit(self.width) if self.width else F.max(F.size("embedding"))).alias("n")).limit(1).select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1)).alias("site"))
        s = s.select("site", F.lit(CHROM).alias("chrom"), position(F.col("site")).alias("pos"), letter("ACGT", F.col("site")).alias("ref"), letter("CGTA", F.col("site")).alias("alt"))
        s = s.withColumn("id", variant_id(F.col("chrom"), F.col("pos"), F.col("ref"), F.col("alt"))).withColumn("original_id", F.when(F.col("site") % 3 == 0, F.concat(F.lit("rs"), "site")).otherwise(""))
        return written(site_ops.chunked(s, CHUNK), "sites")

    @cached_property
    def typed_sites(self) -> DataFrame:
        """Sites of the targets' own file, with row numbers of their own."""
        return site_ops.dense(self.sites.where(F.col("site") % 2 == 0)).select(F.col("n").cast("long").alias("target_row"), *site_ops.KEY)

    @cached_property
    def shared(self) -> DataFrame:
        return written(site_ops.dense(site_ops.intersect(self.sites, self.typed_sites)).select("n", "site", "target_row", *site_ops.KEY), "shared")

    @cached_property
    def panel(self) -> DataFrame:
        return self.alleles.where(~is_target(F.col("hap")))

    @cached_property
    def n_panel(self) -> int:
        return self.table("embeddings").where(~is_target(F.col("vec_id"))).count()

    @cached_property
    def targets(self) -> DataFrame:
        return self.alleles.where(is_target(F.col("hap")))

    @cached_property
    def panel_bits(self) -> DataFrame:
        return written(match.packed(self.panel.join(self.shared.select("site", "n"), "site")), "panel-bits")

    @cached_property
    def target_bits(self) -> DataFrame:
        return written(match.packed(self.targets.join(self.shared.select("site", "n"), "site")), "target-bits")

    @cached_property
    def panel_alt(self) -> DataFrame:
        return self.panel.where("allele = 1").select("site", "hap")

    @cached_property
    def genetic_map(self) -> DataFrame:
        k = F.col("n_nationkey")
        return self.table("nation").select(F.lit(CHROM).alias("chrom"), (F.lit(55000) + k * 3000).cast("long").alias("pos"), (F.lit(0.01) * k * (k + 1) / 2).alias("cm"))


class Capped(Virtual):
    """With caps that trim: few runs are kept at each start and few haplotypes at each site."""

    forward, backward, most = 4, 2, 3


class Sparse(Virtual):
    """With long runs only, so that sites before, between and after them are not covered."""

    match_length = 9


class Wide(Virtual):
    """Thirty-two times as many sites, for runs of ten or more of 1,024 typed ones."""

    width, match_length = 2048, 10


STORES: dict[tuple, Virtual] = {}


def store(spark: SparkSession, sf_dir: str, kind: type[Virtual] = Virtual) -> Virtual:
    """The stages of a session and input; queries of one session share the tables that are there already, forget() ends that."""
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in STORES:
        STORES[key] = kind(spark, sf_dir)
    return STORES[key]


def forget() -> None:
    STORES.clear()
