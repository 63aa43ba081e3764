"""The corpus pipeline: quality classifier, SimHash near-dedup, secret scans, mixing, packing.

Each stage takes all rows its predecessor kept; what lies between two stages is a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import mixing, near, packing, quality, secrets
from strandlake.llm.common import table, without_ids, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; null and empty texts are judged as such. Rows that repeat a doc_id stay if one of them is kept."""
    return quality.kept(docs, table(spark, sf_dir, "labels"))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, Jaccard 0.8 or more) the document of the smallest doc_id stays; rows that repeat one in every column become one.

    A null doc_id goes where its group has another; documents without a word are one group. Only rows
    whose id may go or may repeat are shuffled; all others stay where they are."""
    found = written(near.groups(docs), "near-groups")
    gone = found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct()
    again = found.groupBy("doc_id").count().where("count > 1").select("doc_id")
    return without_ids(docs, "doc_id", gone, again)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking credentials are masked; examples, null and clean texts stay as they are. n_chars follows the text."""
    out = secrets.redacted(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(out.schema["n_chars"].dataType)) if "n_chars" in out.columns else out


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mixture; a null source is a source."""
    return mixing.in_order(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences, which follow the mixture.

    A written table has no order, so the mixture's places are made again from the same rows (they
    depend on nothing else): documents of one range of places share sequences, and sequence_id goes
    on from range to range. Rows that repeat a doc_id take the first of its places."""
    places = mixing.mixed(docs).groupBy("doc_id").agg(F.min("mix_position").alias("place"))
    return packing.packed(docs, places=places)


STAGES = [
    ("quality classifier", quality_stage),
    ("simhash near-dedup", simhash_stage),
    ("secret scans", secrets_stage),
    ("mixing sources to target weights", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: Tokenising and SimHash are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "-"))
    return docs
