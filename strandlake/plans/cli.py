"""Command line: python -m strandlake.plans.cli prepare | impute | score | match | filter-sites | select-samples | stats ..."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from ..operators.genmap import NE
from ..operators.match import MIN_LENGTH
from ..sources import vcf
from ..sources.panel import CHUNK
from . import files


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strandlake")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("prepare", help="a phased VCF as a panel store")
    a.add_argument("--vcf", required=True)
    a.add_argument("--panel", required=True)
    a.add_argument("--chunk-size", type=int, default=CHUNK)
    a.add_argument("--replace", action="store_true")
    b = sub.add_parser("impute", help="a target VCF against a panel store")
    for name in ("--panel", "--target", "--map", "--out"):
        b.add_argument(name, required=True)
    b.add_argument("--vcf", help="prepare the panel from this file first, where it is not there yet")
    b.add_argument("--match-length", type=int, default=MIN_LENGTH)
    b.add_argument("--est-ne", type=float, default=NE)
    b.add_argument("--chunk-size", type=int, default=CHUNK)
    c = sub.add_parser("score", help="an imputed VCF against the truth")
    for name in ("--truth", "--imputed", "--out"):
        c.add_argument(name, required=True)
    c.add_argument("--samples", help="comma-separated sample names")
    c.add_argument("--chunk-size", type=int, default=10_000)
    c.add_argument("--consider-phasing", action="store_true")
    c.add_argument("--region", help="chromosome:first-last")
    d = sub.add_parser("match", help="the kept runs of a target VCF against a panel store")
    for name in ("--panel", "--target", "--map", "--out"):
        d.add_argument(name, required=True)
    d.add_argument("--match-length", type=int, default=MIN_LENGTH)
    e = sub.add_parser("filter-sites", help="records of a VCF whose site is listed")
    f = sub.add_parser("select-samples", help="columns of a VCF whose sample is listed")
    for q, name in ((e, "--sites"), (f, "--samples")):
        for x in ("--vcf", name, "--out"):
            q.add_argument(x, required=True)
    g = sub.add_parser("stats", help="records, last position and length of each chromosome of a VCF")
    g.add_argument("--vcf", required=True)
    for q in sub.choices.values():
        q.add_argument("--checkpoint", help="folder that all executors share, for tables between stages")
        q.add_argument("--parallelism", type=int, help="shuffle partitions")
    return p


def _region(text: str | None) -> tuple[str, int, int] | None:
    if text is None:
        return None
    chrom, _, span = text.rpartition(":")
    low, high = span.split("-")
    return chrom, int(low), int(high)


def main(argv: list[str] | None = None) -> None:
    o = parser().parse_args(argv)
    spark = SparkSession.builder.appName("strandlake").getOrCreate()
    if o.checkpoint:
        spark.sparkContext.setCheckpointDir(o.checkpoint)
    if o.parallelism:
        spark.conf.set("spark.sql.shuffle.partitions", o.parallelism)
    if o.command == "prepare":
        files.prepare(spark, o.vcf, o.panel, o.chunk_size, o.replace)
    elif o.command == "impute":
        if o.vcf:
            files.prepare(spark, o.vcf, o.panel, o.chunk_size)
        print(files.impute(spark, o.panel, o.target, o.map, o.out, o.match_length, o.est_ne))
    elif o.command == "match":
        files.match_files(spark, o.panel, o.target, o.map, o.out, o.match_length)
    elif o.command == "filter-sites":
        print(files.filter_sites(spark, o.vcf, o.sites, o.out))
    elif o.command == "select-samples":
        print(files.select_samples(spark, o.vcf, o.samples, o.out))
    elif o.command == "stats":
        for r in vcf.file_stats(vcf.lines(spark, o.vcf)).orderBy("chrom").toJSON().toLocalIterator():
            print(r)
    else:
        files.score_files(spark, o.truth, o.imputed, o.out, o.samples.split(",") if o.samples else None, o.chunk_size, o.consider_phasing, region=_region(o.region))


if __name__ == "__main__":
    main()
