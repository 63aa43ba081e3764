"""Plans over files: prepare a panel store, impute a target VCF, score an imputed VCF."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import plain_number, variant_id
from ..functions.tables import written
from ..operators import calls, match, score
from ..operators import sites as site_ops
from ..sources import files, panel, vcf
from .stages import Stages

VERSION = "1.0"


def packed_sparse(alt: DataFrame, haps: DataFrame, n_sites: int) -> DataFrame:
    """(hap, bits) of all haps from ALT alleles (hap, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = []
            for x in b["at"]:
                line = np.full(n_sites, ord("0"), dtype=np.uint8)
                line[np.array(x.as_py() or [], dtype=np.int64)] = ord("1")
                bits.append(line.tobytes().decode())
            yield pa.RecordBatch.from_arrays([b["hap"], pa.array(bits, pa.string())], names=["hap", "bits"])

    lists = alt.groupBy("hap").agg(F.collect_list("n").alias("at"))
    return haps.select("hap").join(lists, "hap", "left").select("hap", "at").mapInArrow(run, "hap int, bits string")


def _haps(samples: DataFrame) -> DataFrame:
    return samples.select(F.explode(F.array(*[(F.col("sample_idx") * 2 + h).cast("int") for h in (0, 1)])).alias("hap"))


def prepare(spark: SparkSession, vcf_path: str, out: str, chunk_size: int = panel.CHUNK, replace: bool = False) -> None:
    """A phased VCF as a panel store; does nothing where one is and replace is not set."""
    text = vcf.lines(spark, vcf_path)
    rows = vcf.split_alleles(vcf.records(text))
    name = F.min("id").alias("original_id")  # one of the ids of a site that is listed twice
    sites = rows.groupBy("chrom", "pos", "ref", "alt").agg(name)
    genotypes = vcf.genotypes(rows).groupBy("chrom", "pos", "ref", "alt", "sample_idx", "h").agg(F.max("allele").alias("allele"))
    numbered, alt = panel.prepare(sites, genotypes, chunk_size)
    numbered = numbered.withColumn("id", variant_id(F.col("chrom"), F.col("pos"), F.col("ref"), F.col("alt")))
    panel.write(numbered, alt, vcf.samples(text), out, replace)


class Imputation(Stages):
    """A target VCF against a panel store, one chromosome."""

    def __init__(self, spark: SparkSession, store: str, target: str, genetic_map: str, match_length: int = match.MIN_LENGTH, est_ne: float = 1_000_000):
        self.match_length, self.est_ne = match_length, est_ne
        self.sites, self._alt, self.panel_samples = panel.read(spark, store)
        self.text = vcf.lines(spark, target)
        self.samples = vcf.samples(self.text)
        self.genetic_map = files.genetic_map(spark, genetic_map)
        if self.samples.count() == 0:
            raise ValueError("the target has no samples")
        self.chrom = vcf.one_chromosome(self.target_sites)
        if self.chrom != vcf.one_chromosome(self.sites):
            raise ValueError("panel and target are of different chromosomes")
        self.genetic_map = self.genetic_map.withColumn("chrom", F.lit(self.chrom))

    @cached_property
    def target_rows(self) -> DataFrame:
        return vcf.split_alleles(vcf.records(self.text))

    @cached_property
    def target_sites(self) -> DataFrame:
        return site_ops.dense(self.target_rows.select(*site_ops.KEY).distinct(), "pos", "ref", "alt").withColumnRenamed("n", "target_row")

    @cached_property
    def shared(self) -> DataFrame:
        found = written(site_ops.dense(site_ops.intersect(self.sites, self.target_sites)).select("n", "site", "target_row", *site_ops.KEY), "shared")
        if found.count() < 2:
            raise ValueError("panel and target share fewer than two sites")
        return found

    @cached_property
    def genotypes(self) -> DataFrame:
        """Target alleles at shared sites: n, site, hap, allele."""
        g = vcf.genotypes(self.target_rows).join(self.shared.select(*site_ops.KEY, "n", "site"), site_ops.KEY)
        return written(g.groupBy("n", "site", (F.col("sample_idx") * 2 + F.col("h")).cast("int").alias("hap")).agg(F.max("allele").alias("allele"), F.max("is_missing").alias("is_missing")), "target-genotypes")

    @cached_property
    def panel_alt(self) -> DataFrame:
        return self._alt.select("site", "hap")

    @cached_property
    def n_panel(self) -> int:
        return 2 * self.panel_samples.count()

    @cached_property
    def panel_bits(self) -> DataFrame:
        return written(packed_sparse(self.panel_alt.join(self.shared.select("site", "n"), "site"), _haps(self.panel_samples), self.n_sites), "panel-bits")

    @cached_property
    def target_bits(self) -> DataFrame:
        return written(packed_sparse(self.genotypes.where("allele = 1"), _haps(self.samples), self.n_sites), "target-bits")

    @cached_property
    def own(self) -> DataFrame:
        """The target's own genotype text at typed sites."""
        show = F.when(F.col("is_missing"), ".").otherwise(F.col("allele").cast("string"))
        one = lambda h: F.max(F.when(F.col("hap") % 2 == h, show))
        return self.genotypes.groupBy("site", F.floor(F.col("hap") / 2).alias("sample_idx")).agg(F.concat_ws("|", one(0), one(1)).alias("gt"))

    @cached_property
    def records(self) -> DataFrame:
        return calls.records(calls.calls(self.probabilities), self.sites, self.shared, self.own)

    def write(self, out: str) -> str:
        name = vcf.output_name(out)
        ids = [r.sample_id for r in self.samples.orderBy("sample_idx").collect()]  # the target file's columns
        vcf.write(self.records, vcf.header_lines(vcf.contig_line(self.text, self.chrom), ids, VERSION), name)
        return name


def impute(spark: SparkSession, store: str, target: str, genetic_map: str, out: str, match_length: int = match.MIN_LENGTH, est_ne: float = 1_000_000) -> str:
    """Writes the imputed VCF as gzip parts under the returned name."""
    return Imputation(spark, store, target, genetic_map, match_length, est_ne).write(out)


def filter_sites(spark: SparkSession, vcf_path: str, site_path: str, out: str) -> str:
    """A VCF's records whose site stands in a site list, as they are; returns the name of the file written."""
    text = vcf.lines(spark, vcf_path)
    body = text.where(~F.col("value").startswith("#") & (F.col("value") != ""))
    f = F.split("value", "\t", 6)
    keyed = body.select("value", F.get(f, F.lit(0)).alias("chrom"), F.get(f, F.lit(1)).cast("long").alias("pos"), F.upper(F.get(f, F.lit(3))).alias("ref"), F.upper(F.get(f, F.lit(4))).alias("alt"))
    kept = keyed.join(files.site_list(spark, site_path).distinct(), site_ops.KEY, "left_semi").select(F.col("pos").alias("site"), F.col("value").alias("record"))
    return _write_like(text, kept, out)


def select_samples(spark: SparkSession, vcf_path: str, names_path: str, out: str) -> str:
    """A VCF with the columns of the listed samples, in the list's order; a name that the file lacks is an error."""
    text = vcf.lines(spark, vcf_path)
    at = {r.sample_id: r.sample_idx for r in vcf.samples(text).collect()}  # the file's columns
    wanted = [r.sample_id for r in files.sample_list(spark, names_path).orderBy("sample_idx").collect()]
    if missing := [n for n in wanted if n not in at]:
        raise ValueError(f"no such samples: {missing[:10]}")
    f = F.split("value", "\t")
    body = text.where(~F.col("value").startswith("#") & (F.col("value") != ""))
    kept = body.select(F.get(f, F.lit(1)).cast("long").alias("site"), F.concat_ws("\t", *[F.get(f, F.lit(i)) for i in range(9)], *[F.get(f, F.lit(9 + at[n])) for n in wanted]).alias("record"))
    return _write_like(text, kept, out, wanted)


def _write_like(text: DataFrame, body: DataFrame, out: str, names: list[str] | None = None) -> str:
    head = [r.value for r in vcf.header(text).collect()]  # the header's lines
    if names is not None:
        head = [x for x in head if not x.startswith("#CHROM")] + ["\t".join([*"#CHROM POS ID REF ALT QUAL FILTER INFO FORMAT".split(), *names])]
    name = vcf.output_name(out)
    vcf.write(body, head, name)
    return name


def match_files(spark: SparkSession, store: str, target: str, genetic_map: str, out: str, match_length: int = match.MIN_LENGTH) -> DataFrame:
    """Writes the kept runs of a target VCF against a panel store as Parquet under out."""
    Imputation(spark, store, target, genetic_map, match_length).matches.write.parquet(out)
    return spark.read.parquet(out)


def score_files(spark: SparkSession, truth: str, imputed: str, out: str | None = None, names: list[str] | None = None, chunk_size: int = 10_000, phased: bool = False, region: tuple[str, int, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(variant report, sample report); written as CSV and TSV under out where given.

    Variants and samples are met by name. Chunks are even position ranges of the imputed file.
    region: chromosome, first and last position; other records are not scored."""
    x = vcf.scored_alleles(vcf.lines(spark, imputed), names, *(region or ()))
    facts = x.agg(F.max("pos").alias("last"), F.countDistinct("variant").alias("n")).first()
    width = max(1, -(-(facts.last or 1) // max(1, -(-(facts.n or 1) // chunk_size))))
    x = x.withColumn("chunk", F.floor((F.col("pos") - 1) / width)).drop("pos")
    pairs = written(score.paired(x, vcf.scored_alleles(vcf.lines(spark, truth), names, *(region or ())).drop("pos")), "pairs")
    variants, samples = score.variant_report(pairs, phased), score.by_sample(pairs, phased).withColumnRenamed("sample_idx", "sample")
    if out:
        text = lambda df: df.select(*[plain_number(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
        text(variants).write.csv(f"{out}_accuracy_variants.csv", header=True)
        text(samples).write.csv(f"{out}_accuracy_samples.tsv", header=True, sep="\t")
    return variants, samples
