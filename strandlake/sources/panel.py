"""The panel store: sites, alleles and samples as Parquet, alleles in partitions by chromosome and chunk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sites as site_ops

CHUNK = 10_000


def prepare(sites: DataFrame, genotypes: DataFrame, size: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(sites with site number, chunk and variant id; ALT alleles (chrom, chunk, site, hap)) of split, phased genotypes."""
    uneven(genotypes)
    numbered = site_ops.dense(sites, "pos", "ref", "alt").withColumnRenamed("n", "site")
    numbered = site_ops.chunked(numbered, size)
    alt = genotypes.where("allele = 1").join(numbered.select("chrom", "pos", "ref", "alt", "site", "chunk"), ["chrom", "pos", "ref", "alt"])
    return numbered, alt.select("chrom", "chunk", "site", (F.col("sample_idx") * 2 + F.col("h")).cast("int").alias("hap"))


def uneven(genotypes: DataFrame) -> None:
    """Every site must have the same number of haplotypes; anything else is an error."""
    n = genotypes.groupBy("chrom", "pos", "ref", "alt").agg(F.count("*").alias("n")).agg(F.min("n").alias("a"), F.max("n").alias("b")).first()
    if n.a != n.b:
        raise ValueError(f"sites hold from {n.a} to {n.b} haplotypes")


def write(sites: DataFrame, alleles: DataFrame, samples: DataFrame, path: str, replace: bool = False) -> None:
    """Writes the store; an existing one stays unless replace is set (then it is written anew)."""
    spark = sites.sparkSession
    if not replace and exists(spark, path):
        return
    mode = "overwrite" if replace else "errorifexists"
    sites.write.mode(mode).option("compression", "zstd").parquet(f"{path}/sites")
    alleles.repartition("chrom", "chunk").sortWithinPartitions("site", "hap").write.mode(mode).option("compression", "zstd").partitionBy("chrom", "chunk").parquet(f"{path}/alleles")
    samples.write.mode(mode).parquet(f"{path}/samples")


def exists(spark: SparkSession, path: str) -> bool:
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(f"{path}/samples/_SUCCESS")
    return p.getFileSystem(hadoop).exists(p)


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sites, ALT alleles, samples); a filter on chunk prunes partitions."""
    return spark.read.parquet(f"{path}/sites"), spark.read.parquet(f"{path}/alleles"), spark.read.parquet(f"{path}/samples")


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """The store's facts by chromosome, as JSON text: sites, chunks, position range, haplotypes, samples."""
    sites, _, samples = read(spark, path)
    n = samples.count()
    facts = sites.groupBy("chrom").agg(F.count("*").alias("n_variants"), F.min("pos").alias("min_position"), F.max("pos").alias("max_position"), F.countDistinct("chunk").alias("n_chunks"))
    facts = facts.withColumns({"n_samples": F.lit(n), "n_haps": F.lit(2 * n)})
    return facts.select("chrom", F.to_json(F.struct(*facts.columns)).alias("metadata"))


def decoded(facts: DataFrame) -> DataFrame:
    """The JSON text of metadata as columns."""
    return facts.select(F.from_json("metadata", "chrom string, n_variants long, min_position long, max_position long, n_chunks long, n_samples long, n_haps long").alias("m")).select("m.*")
