"""VCF text: records, sites, samples and genotypes, and the writer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.assembly import LENGTHS
from ..functions.numbers import variant_id

FIXED = ("chrom", "pos", "id", "ref", "alt", "qual", "filter", "info", "format")


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def header(text: DataFrame) -> DataFrame:
    return text.where(F.col("value").startswith("#"))


def contig_line(text: DataFrame, chrom: str) -> str:
    """The header's line of a contig, or a plain one where it has none."""
    found = header(text).where(F.col("value").startswith(f"##contig=<ID={chrom},") | (F.col("value") == f"##contig=<ID={chrom}>")).first()
    return found.value if found else f"##contig=<ID={chrom}>"


def samples(text: DataFrame) -> DataFrame:
    """(sample_idx, sample_id) from the column line."""
    names = F.split("value", "\t")
    return text.where(F.col("value").startswith("#CHROM")).select(F.posexplode(F.slice(names, F.lit(10), F.greatest(F.size(names) - 9, F.lit(0)))).alias("sample_idx", "sample_id"))


def records(text: DataFrame) -> DataFrame:
    """Fixed columns and the array of sample fields; alleles in upper case."""
    f = F.split("value", "\t")
    body = text.where(~F.col("value").startswith("#") & (F.col("value") != ""))
    fields = [F.get(f, F.lit(i)).alias(c) for i, c in enumerate(FIXED)]
    rest = F.slice(f, F.lit(10), F.greatest(F.size(f) - 9, F.lit(0))).alias("fields")
    return body.select(*fields, rest).withColumns({"pos": F.col("pos").cast("long"), "ref": F.upper("ref"), "alt": F.upper("alt")})


def split_alleles(rows: DataFrame) -> DataFrame:
    """One row for each ALT allele, numbered from 1 in allele_no; a record without ALT gives one row with ALT '.'."""
    return rows.select("*", F.posexplode(F.split("alt", ",")).alias("at", "one")).withColumn("alt", F.col("one")).withColumn("allele_no", F.col("at") + 1).drop("at", "one")


def sites(rows: DataFrame, chrom: str | None = None, low: int | None = None, high: int | None = None) -> DataFrame:
    """Distinct sites (chrom, pos, ref, alt, id) of a region; equal rows become one."""
    out = rows.select("chrom", "pos", "ref", "alt", "id")
    for keep in [F.col("chrom") == chrom if chrom is not None else None, F.col("pos") >= low if low is not None else None, F.col("pos") <= high if high is not None else None]:
        out = out if keep is None else out.where(keep)
    return out.dropDuplicates()


def ids(text: DataFrame) -> DataFrame:
    """The id column of the records alone."""
    return text.where(~F.col("value").startswith("#") & (F.col("value") != "")).select(F.get(F.split("value", "\t", 4), F.lit(2)).alias("id"))


def region(text: DataFrame, chrom: str | None = None, low: int | None = None, high: int | None = None) -> DataFrame:
    """Header lines, and the records of a region: only their first two fields are split to tell."""
    f = F.split("value", "\t", 3)
    pos, keep = F.get(f, F.lit(1)).try_cast("long"), F.lit(True)
    for c in (F.get(f, F.lit(0)) == chrom if chrom is not None else None, pos >= low if low is not None else None, pos <= high if high is not None else None):
        keep = keep if c is None else keep & c
    return text.where(F.col("value").startswith("#") | keep)


def scored_alleles(text: DataFrame, names: list[str] | None = None, chrom: str | None = None, low: int | None = None, high: int | None = None) -> DataFrame:
    """(pos, variant, sample_idx, h, allele) of a file's genotypes, samples and variants by name; of a region, and of some samples, where given."""
    found = samples(text)
    g = genotypes(split_alleles(records(region(text, chrom, low, high)))).join(found if names is None else found.where(F.col("sample_id").isin(names)), "sample_idx")
    return g.select("pos", variant_id(F.col("chrom"), F.col("pos"), F.col("ref"), F.col("alt")).alias("variant"), F.col("sample_id").alias("sample_idx"), "h", "allele")


def with_ids(found: DataFrame) -> DataFrame:
    return found.withColumn("variant_id", variant_id(F.col("chrom"), F.col("pos"), F.col("ref"), F.col("alt")))


def file_stats(text: DataFrame) -> DataFrame:
    """(chrom, n_records, last_pos) of a file's records, and the length its header or else the assembly gives."""
    declared = header(text).select(F.regexp_extract("value", r"^##contig=<ID=([^,>]+)", 1).alias("chrom"), F.regexp_extract("value", r"length=([0-9]+)", 1).try_cast("long").alias("declared")).where("chrom <> ''").groupBy("chrom").agg(F.max("declared").alias("declared"))
    known = F.create_map(*[F.lit(x) for pair in LENGTHS.items() for x in pair])
    got = records(text).groupBy("chrom").agg(F.count("*").alias("n_records"), F.max("pos").alias("last_pos"))
    length = F.coalesce("declared", known[F.regexp_replace("chrom", "^chr", "")].cast("long"))
    return got.join(declared, "chrom", "left").select("chrom", "n_records", "last_pos", length.alias("length"))


def called(fields: Column, fmt: Column) -> Column:
    """The GT part of each sample field as an array of allele codes, '/' read as '|'; nulls where the record has no GT.

    The place of GT is laid beside each field: a function of an array's elements that named a column of
    the record would have the record's line split again for every one of them."""
    at = F.array_position(F.split(fmt, ":"), "GT").cast("int")
    placed = F.arrays_zip(fields.alias("field"), F.array_repeat(at, F.size(fields)).alias("at"))
    gt = lambda x: F.when(x["at"] > 0, F.get(F.split(x["field"], ":"), x["at"] - 1))
    return F.transform(placed, lambda x: F.split(F.regexp_replace(gt(x), "/", "|"), r"\|"))


def genotypes(rows: DataFrame) -> DataFrame:
    """(chrom, pos, ref, alt, sample_idx, h, allele, is_missing) of split records that have GT.

    A missing code is allele 0 with the mask set. A haploid code counts for both strands where every
    sample of the record is haploid; mixed ploidy is an error."""
    g = rows.withColumn("codes", called(F.col("fields"), F.col("format"))).where(F.size("fields") > 0).where(F.get("codes", F.lit(0)).isNotNull())
    least, most = F.array_min(F.transform("codes", lambda x: F.size(x))), F.array_max(F.transform("codes", lambda x: F.size(x)))
    g = g.withColumn("codes", F.when((least != most) | (most > 2), F.raise_error(F.concat(F.lit("mixed ploidy at "), F.col("pos")))).otherwise(F.col("codes")))
    g = g.select("chrom", "pos", "ref", "alt", "allele_no", F.posexplode("codes").alias("sample_idx", "pair"))
    g = g.select("*", F.posexplode(F.when(F.size("pair") == 1, F.array_repeat(F.get("pair", F.lit(0)), 2)).otherwise(F.col("pair"))).alias("h", "code"))
    missing = F.col("code") == "."
    return g.select("chrom", "pos", "ref", "alt", "sample_idx", "h", F.when(missing, 0).otherwise((F.col("code").try_cast("int") == F.col("allele_no")).cast("int")).alias("allele"), missing.alias("is_missing"))


def one_chromosome(found: DataFrame) -> str:
    """The single chromosome of a table; none or several are errors."""
    names = [r.chrom for r in found.select("chrom").distinct().limit(2).collect()]
    if len(names) != 1:
        raise ValueError("no variants" if not names else f"several chromosomes: {names}")
    return names[0]


def header_lines(contig: str, sample_ids: list[str], version: str) -> list[str]:
    return [
        "##fileformat=VCFv4.2",
        f"##source=strandlake {version}",
        '##FILTER=<ID=PASS,Description="All filters passed">',
        contig,
        '##INFO=<ID=IMP,Number=0,Type=Flag,Description="Imputed site">',
        '##INFO=<ID=AF,Number=A,Type=Float,Description="ALT allele frequency of the calls">',
        '##INFO=<ID=AN,Number=1,Type=Integer,Description="Number of alleles">',
        '##INFO=<ID=AC,Number=A,Type=Integer,Description="ALT allele count of the calls">',
        '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">',
        '##FORMAT=<ID=DS,Number=A,Type=Float,Description="ALT dose, AP1 + AP2">',
        '##FORMAT=<ID=AP1,Number=A,Type=Float,Description="ALT probability of the first haplotype">',
        '##FORMAT=<ID=AP2,Number=A,Type=Float,Description="ALT probability of the second haplotype">',
        "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *sample_ids]),
    ]


def write(body: DataFrame, head: list[str], path: str) -> None:
    """Writes records(site, record) as gzip text, parts in site order; the header is in the first part."""
    spark = body.sparkSession
    top = spark.createDataFrame([(i - len(head), x) for i, x in enumerate(head)], "site long, record string")
    all_ = top.unionByName(body.select(F.col("site").cast("long").alias("site"), "record"))
    all_.repartitionByRange("site").sortWithinPartitions("site").select(F.col("record").alias("value")).write.option("compression", "gzip").text(path)


def output_name(path: str) -> str:
    """The name of an output: kept if it ends in .vcf.gz, else its suffix replaced by that."""
    if path.endswith(".vcf.gz"):
        return path
    folder, slash, name = path.rpartition("/")
    return f"{folder}{slash}{name.rsplit('.', 1)[0]}.vcf.gz"
