"""Side files: site lists, sample lists, site filters, genetic maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def genetic_map(spark: SparkSession, path: str) -> DataFrame:
    """Four columns with single blanks, '#' comments: chromosome, name, cM, position."""
    rows = spark.read.csv(path, sep=" ", comment="#", schema="chrom string, name string, cm double, pos long")
    return rows.select("chrom", "pos", "cm").where("pos is not null")


def site_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="chrom string, pos long, ref string, alt string").withColumns({"ref": F.upper("ref"), "alt": F.upper("alt")})


def sample_list(spark: SparkSession, path: str) -> DataFrame:
    """First word of each line, in order; the two head lines of a list that begins with ID_1 are left out."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("line", "value"))
    names = rows.select("line", F.get(F.split(F.trim("value"), r"\s+"), F.lit(0)).alias("sample_id"))
    skip = 2 if names.where("line = 0 and sample_id = 'ID_1'").count() else 0
    names = names.where((F.col("line") >= skip) & (F.col("sample_id") != ""))
    return names.select((F.col("line") - skip).alias("sample_idx"), "sample_id")


def site_filter(spark: SparkSession, path: str, n: int) -> DataFrame:
    """(site, keep): a line for each site; anything but 1 leaves the site out. A wrong number of lines is an error."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n")).alias("site", "value"))
    got = rows.count()
    if got != n:
        raise ValueError(f"site filter has {got} lines, not {n}")
    return rows.select("site", (F.col("value") == "1").cast("int").alias("keep"))
