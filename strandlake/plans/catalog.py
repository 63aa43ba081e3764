"""Queries over the virtual panel, and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import plain_number, short_number
from ..functions.tables import met, shared_path
from ..operators import calls, impute, score, select
from ..operators import sites as site_ops
from ..operators import weights as weight_ops
from ..sources import files as side_files
from ..sources import panel as panel_store
from ..sources import vcf
from .virtual import CHUNK, Capped, Sparse, Virtual, Wide, store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _plain(df: DataFrame) -> DataFrame:
    """Integers as longs, so that results have one integer type."""
    return df.select(*[F.col(c).cast("long").alias(c) if t in ("int", "tinyint", "smallint") or t.startswith("decimal") else F.col(c) for c, t in df.dtypes])


def query(sql: str | None = None, kind: type[Virtual] = Virtual):
    def add(f: Callable[[Virtual], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: _plain(f(store(spark, sf_dir, kind)))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- common table expressions of the SQL side, each with those it reads

CTES: list[tuple[str, str]] = [
    ("alleles", "SELECT vec_id AS hap, CAST(unnest(range(len(embedding))) AS BIGINT) AS site, unnest(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END)) AS allele FROM embeddings"),
    ("sites", "SELECT site, '20' AS chrom, 60000 + 1000 * site + (site * site) % 997 AS pos, substr('ACGT', CAST(site % 4 + 1 AS BIGINT), 1) AS ref, substr('CGTA', CAST(site % 4 + 1 AS BIGINT), 1) AS alt, '20-' || (60000 + 1000 * site + (site * site) % 997) || '-' || substr('ACGT', CAST(site % 4 + 1 AS BIGINT), 1) || '-' || substr('CGTA', CAST(site % 4 + 1 AS BIGINT), 1) AS id, CASE WHEN site % 3 = 0 THEN 'rs' || site ELSE '' END AS original_id, site // 16 AS chunk FROM (SELECT DISTINCT site FROM alleles)"),
    ("typed", "SELECT hap, site // 2 AS n, allele FROM alleles WHERE site % 2 = 0"),
    ("tgt", "SELECT * FROM typed WHERE (hap // 2) % 20 = 0"),
    ("ref", "SELECT * FROM typed WHERE (hap // 2) % 20 <> 0"),
    ("np", "SELECT count(*) AS n_panel FROM embeddings WHERE (vec_id // 2) % 20 <> 0"),
    ("pairs", "SELECT t.hap AS target_hap, r.hap AS ref_hap, n, CAST(t.allele <> r.allele AS INT) AS mm FROM tgt t JOIN ref r USING (n) WHERE n < 31"),
    ("islands", "SELECT *, sum(mm) OVER (PARTITION BY target_hap, ref_hap ORDER BY n) AS grp FROM pairs"),
    ("runs", "SELECT target_hap, ref_hap, min(n) AS start, count(*) AS len FROM islands WHERE mm = 0 GROUP BY target_hap, ref_hap, grp HAVING count(*) >= 5"),
    ("bits", "SELECT hap, string_agg(CAST(allele AS VARCHAR), '' ORDER BY n) AS bits FROM typed GROUP BY hap"),
    ("tot", "SELECT *, CAST(sum(len) OVER (PARTITION BY target_hap, ref_hap ORDER BY start) AS BIGINT) AS tot FROM runs"),
    ("keyed", "SELECT w.*, (start = 0 OR substr(t.bits, start, 1) = '1') AS up, reverse(substr(r.bits, 1, start)) AS key FROM tot w JOIN bits r ON r.hap = ref_hap JOIN bits t ON t.hap = target_hap"),
    ("top450", "SELECT target_hap, ref_hap, start, len, tot, rank FROM (SELECT *, row_number() OVER (PARTITION BY target_hap, start ORDER BY len DESC, tot DESC, CASE WHEN up THEN key END, CASE WHEN up THEN ref_hap END, CASE WHEN NOT up THEN key END DESC, CASE WHEN NOT up THEN ref_hap END DESC) AS rank FROM keyed) WHERE rank <= 450"),
    ("rested", "SELECT *, CAST(sum(len) OVER (PARTITION BY target_hap, ref_hap ORDER BY start DESC) AS BIGINT) AS rest FROM top450"),
    ("top60", "SELECT target_hap, ref_hap, start, len, rest, k FROM (SELECT *, row_number() OVER (PARTITION BY target_hap, start ORDER BY len DESC, rest DESC, rank) AS k FROM rested) WHERE k <= 60"),
    ("covered", "SELECT DISTINCT target_hap, unnest(range(start, start + len)) AS n FROM top60"),
    ("stops", "SELECT s.target_hap, s.stop, CASE WHEN count(*) FILTER (c.n = s.stop + 1) > 0 THEN s.stop ELSE coalesce(min(c.n), 32) - 1 END AS high FROM (SELECT DISTINCT target_hap, start + len - 1 AS stop FROM top60) s LEFT JOIN covered c ON c.target_hap = s.target_hap AND c.n > s.stop GROUP BY s.target_hap, s.stop"),
    ("firsts", "SELECT target_hap, min(start) AS first FROM top60 GROUP BY target_hap"),
    ("cover", "SELECT m.target_hap, ref_hap, start, len, start + len - 1 AS stop, CASE WHEN start = first THEN 0 ELSE start END AS low, high, (CASE WHEN start = first THEN start ELSE 0 END) + high - (start + len - 1) AS added FROM top60 m JOIN stops s ON s.target_hap = m.target_hap AND s.stop = start + len - 1 JOIN firsts f ON f.target_hap = m.target_hap"),
    ("sums", "SELECT target_hap, ref_hap, CAST(sum(len + added) AS BIGINT) AS tot FROM cover GROUP BY ALL"),
    ("ranges", "SELECT target_hap, CASE WHEN count(*) < (SELECT n_panel FROM np) THEN 0 ELSE min(tot) END AS lo, max(tot) AS hi FROM sums GROUP BY target_hap"),
    ("totals", "SELECT s.target_hap, ref_hap, tot, CASE WHEN hi = lo THEN 1.0::DOUBLE ELSE (tot - lo)::DOUBLE / (hi - lo) * 0.9::DOUBLE + 0.1::DOUBLE END AS norm FROM sums s JOIN ranges r ON r.target_hap = s.target_hap"),
    ("scored", "SELECT c.*, round(len * norm, 12) AS score FROM cover c JOIN totals t ON t.target_hap = c.target_hap AND t.ref_hap = c.ref_hap"),
    ("stabbed", "SELECT *, unnest(range(low, high + 1)) AS n FROM scored"),
    ("shortest", "SELECT target_hap, min(len) AS min_len FROM scored GROUP BY ALL"),
    ("limits", "SELECT s.target_hap, n, avg(len) AS avg_len, stddev_pop(score) AS sd, max(score) AS best, round(max(score) - stddev_pop(score) * (pow((avg(len) - 32) / (any_value(min_len) - 32)::DOUBLE, 24) * 2.8::DOUBLE + 0.2::DOUBLE), 12) AS threshold FROM stabbed s JOIN shortest m ON m.target_hap = s.target_hap GROUP BY s.target_hap, n"),
    ("best50", "SELECT target_hap, n, ref_hap, score, k FROM (SELECT s.target_hap, s.n, ref_hap, score, row_number() OVER (PARTITION BY s.target_hap, s.n ORDER BY score DESC, ref_hap DESC) AS k FROM stabbed s JOIN limits l ON l.target_hap = s.target_hap AND l.n = s.n WHERE score >= threshold) WHERE k <= 50"),
    ("again", "SELECT target_hap, ref_hap, count(*) AS sites FROM best50 GROUP BY ALL HAVING count(*) > 1"),
    ("marked", "SELECT b.target_hap, b.n, b.ref_hap, a.sites IS NOT NULL AS ok FROM best50 b LEFT JOIN again a ON a.target_hap = b.target_hap AND a.ref_hap = b.ref_hap"),
    ("chosen", "SELECT target_hap, n, ref_hap FROM marked WHERE ok OR (target_hap, n) NOT IN (SELECT target_hap, n FROM marked WHERE ok)"),
    ("wide", "SELECT s.target_hap, s.n, s.ref_hap FROM stabbed s WHERE EXISTS (SELECT 1 FROM chosen c WHERE c.target_hap = s.target_hap AND c.ref_hap = s.ref_hap AND c.n BETWEEN s.low AND s.high)"),
    ("counts", "SELECT target_hap, ref_hap, count(*) AS cnt FROM wide GROUP BY ALL"),
    ("cuts", "SELECT target_hap, least(quantile_cont(cnt, 0.1::DOUBLE), max(cnt) - 1)::DOUBLE AS cutoff FROM counts GROUP BY ALL"),
    ("kept", "SELECT c.target_hap, ref_hap, cnt FROM counts c JOIN cuts u ON u.target_hap = c.target_hap WHERE cnt > cutoff"),
    ("marked2", "SELECT w.*, k.cnt IS NOT NULL AS ok FROM wide w LEFT JOIN kept k ON k.target_hap = w.target_hap AND k.ref_hap = w.ref_hap"),
    ("selected", "SELECT target_hap, n, ref_hap FROM marked2 WHERE ok OR (target_hap, n) NOT IN (SELECT target_hap, n FROM marked2 WHERE ok)"),
    ("gmap", "SELECT 55000 + 3000 * n_nationkey AS pos, 0.01::DOUBLE * n_nationkey * (n_nationkey + 1) / 2 AS cm FROM nation"),
    ("near", "SELECT site // 2 AS n, pos, (SELECT max(pos) FROM gmap g WHERE g.pos <= s.pos) AS a, (SELECT min(pos) FROM gmap g WHERE g.pos >= s.pos) AS b FROM sites s WHERE site % 2 = 0"),
    ("cms", "SELECT n, n.pos, CASE WHEN a IS NULL OR a = b THEN y.cm WHEN b IS NULL THEN x.cm ELSE x.cm + (y.cm - x.cm) * (n.pos - a) / (b - a) END AS cm FROM near n LEFT JOIN gmap x ON x.pos = a LEFT JOIN gmap y ON y.pos = b"),
    ("gaps", "SELECT n, cm, cm - lag(cm) OVER (ORDER BY n) AS back, lead(cm) OVER (ORDER BY n) - cm AS onward FROM cms"),
    ("rates", "SELECT n, 1 - exp((CASE WHEN back IS NULL OR back = 0 THEN 1e-7 ELSE back END) * -0.04::DOUBLE * 1000000 / (SELECT n_panel FROM np)) AS before, 1 - exp((CASE WHEN onward IS NULL OR onward = 0 THEN 1e-7 ELSE onward END) * -0.04::DOUBLE * 1000000 / (SELECT n_panel FROM np)) AS after FROM gaps"),
    ("nhaps", "SELECT target_hap, n, count(*) AS c FROM selected GROUP BY ALL"),
    ("active", "SELECT DISTINCT target_hap, ref_hap FROM selected"),
    ("grid", "SELECT a.target_hap, a.ref_hap, h.n, c, CASE WHEN s.n IS NULL THEN 0 ELSE 1 END AS m, CASE WHEN s.n IS NULL THEN cutoff / 32 ELSE 1 - cutoff / 32 END AS e, before / c AS pf, after / c AS pb FROM active a JOIN nhaps h ON h.target_hap = a.target_hap JOIN rates r ON r.n = h.n JOIN cuts u ON u.target_hap = a.target_hap LEFT JOIN selected s ON s.target_hap = a.target_hap AND s.ref_hap = a.ref_hap AND s.n = h.n"),
    ("fwd0", "SELECT target_hap, ref_hap, 0::BIGINT AS row, m / c::DOUBLE AS x FROM grid WHERE n = 0 UNION ALL SELECT f.target_hap, f.ref_hap, row + 1, e * (x + m * pf) FROM fwd0 f JOIN grid g ON g.target_hap = f.target_hap AND g.ref_hap = f.ref_hap AND g.n = f.row"),
    ("bwd0", "SELECT target_hap, ref_hap, 33::BIGINT AS row, 1 / c::DOUBLE AS x FROM grid WHERE n = 31 UNION ALL SELECT f.target_hap, f.ref_hap, row - 1, e * (x + m * pb) FROM bwd0 f JOIN grid g ON g.target_hap = f.target_hap AND g.ref_hap = f.ref_hap AND g.n = f.row - 2"),
    ("fwd", "SELECT * FROM fwd0 UNION ALL SELECT target_hap, ref_hap, 33, m / c::DOUBLE FROM grid WHERE n = 31"),
    ("bwd", "SELECT * FROM bwd0 UNION ALL SELECT target_hap, ref_hap, 0, 1 / c::DOUBLE FROM grid WHERE n = 0"),
    ("products", "SELECT f.target_hap, f.ref_hap, f.row, CASE WHEN f.row IN (0, 1) THEN a.m / a.c::DOUBLE WHEN f.row IN (32, 33) THEN z.m / z.c::DOUBLE ELSE f.x * b.x END AS w FROM fwd f JOIN bwd b ON b.target_hap = f.target_hap AND b.ref_hap = f.ref_hap AND b.row = f.row JOIN grid a ON a.target_hap = f.target_hap AND a.ref_hap = f.ref_hap AND a.n = 0 JOIN grid z ON z.target_hap = f.target_hap AND z.ref_hap = f.ref_hap AND z.n = 31"),
    ("normed", "SELECT target_hap, ref_hap, row, coalesce(w / nullif(sum(w) OVER (PARTITION BY target_hap, row), 0), 0) AS w, count(*) OVER (PARTITION BY target_hap, row) AS haps FROM products"),
    ("pruned", "SELECT target_hap, ref_hap, row, w FROM normed WHERE w > 0 AND w >= 1 / (haps + 1)::DOUBLE"),
    ("row_sites", "SELECT 0 AS row, 0 AS site UNION ALL SELECT site // 2 + 1, site FROM sites WHERE site % 2 = 0 UNION ALL SELECT 33, 63"),
    ("intervals", "SELECT row, site AS start, nxt - site + CASE WHEN row = 32 THEN 1 ELSE 0 END AS num FROM (SELECT *, lead(site) OVER (ORDER BY row) AS nxt FROM row_sites) WHERE nxt IS NOT NULL"),
    ("ends", "SELECT target_hap, row, ref_hap, sum(w0) AS w0, sum(w1) AS w1 FROM (SELECT target_hap, row, ref_hap, w AS w0, 0.0::DOUBLE AS w1 FROM pruned UNION ALL SELECT target_hap, row - 1, ref_hap, 0.0::DOUBLE, w FROM pruned) WHERE row BETWEEN 0 AND 32 GROUP BY ALL"),
    ("site_w", "SELECT target_hap, start + k AS site, ref_hap, w0 + (w1 - w0) * k / num AS w FROM ends JOIN (SELECT *, unnest(range(num)) AS k FROM intervals) USING (row)"),
    ("probs", "SELECT w.site, target_hap, round(sum(w * allele) / sum(w), 10) AS p FROM site_w w JOIN alleles a ON a.site = w.site AND a.hap = w.ref_hap GROUP BY ALL"),
    ("called", "SELECT site, target_hap // 2 AS sample_idx, max(CASE WHEN target_hap % 2 = 0 THEN p END) AS ap1, max(CASE WHEN target_hap % 2 = 1 THEN p END) AS ap2 FROM probs GROUP BY ALL"),
    ("gts", "SELECT *, ap1 + ap2 AS ds, CAST(ap1 > 0.5 AS BIGINT) AS gt1, CAST(ap2 > 0.5 AS BIGINT) AS gt2 FROM called"),
    ("acs", "SELECT site, CAST(sum(gt1 + gt2) AS BIGINT) AS ac, count(*) * 2 AS an, round(sum(gt1 + gt2) / (count(*) * 2)::DOUBLE, 4) AS af FROM gts GROUP BY ALL"),
    ("xy", "SELECT g.site // 16 AS chunk, g.site AS variant, sample_idx, h, CASE WHEN h = 0 THEN gt1 ELSE gt2 END AS x, a.allele AS y FROM gts g, (SELECT unnest([0, 1]) AS h) hh, alleles a WHERE a.site = g.site AND a.hap = sample_idx * 2 + h"),
    ("dose", "SELECT chunk, variant, sample_idx, CAST(sum(x) AS BIGINT) AS x, CAST(sum(y) AS BIGINT) AS y FROM xy GROUP BY ALL"),
    ("conf", "SELECT variant, count(*) FILTER (x = 1 AND y = 1) AS tp, count(*) FILTER (x = 0 AND y = 0) AS tn, count(*) FILTER (x = 1 AND y = 0) AS fp, count(*) FILTER (x = 0 AND y = 1) AS fn FROM xy GROUP BY ALL"),
]


def sql(select_: str) -> str:
    """select_ with the expressions it needs, in order."""
    import re

    bodies, needed = dict(CTES), set()
    words = lambda s: set(re.findall(r"\b[a-z_]+\d*\b", s))
    todo = [select_]
    while todo:
        for w in words(todo.pop()) & set(bodies) - needed:
            needed.add(w)
            todo.append(bodies[w])
    parts = [f"{n} AS {'' if n in ('fwd0', 'bwd0') else 'MATERIALIZED '}({b})" for n, b in CTES if n in needed]
    return f"WITH RECURSIVE {', '.join(parts)} {select_}"


# ---- sites, slices and panel facts


@query(sql("SELECT chrom, pos, ref, alt, site, site // 2 AS target_row FROM sites WHERE site % 2 = 0"))
def site_intersect(v: Virtual) -> DataFrame:
    return site_ops.intersect(v.sites, v.typed_sites).select(*site_ops.KEY, "site", "target_row")


@query(sql("SELECT site, CASE WHEN site % 2 = 0 THEN 1 ELSE 0 END::BIGINT AS keep FROM sites"))
def site_filter_mask(v: Virtual) -> DataFrame:
    return site_ops.mask(v.sites, v.shared)


@query(sql("SELECT hap, site // 2 AS n, allele::BIGINT AS allele FROM alleles WHERE site % 2 = 0"))
def site_filtered_alleles(v: Virtual) -> DataFrame:
    return v.alleles.join(v.shared.select("site", "n"), "site").select("hap", F.col("n").cast("long").alias("n"), "allele")


@query("SELECT 0::BIGINT AS differences")
def site_lists_agree(v: Virtual) -> DataFrame:
    other = site_ops.dense(v.typed_sites, "target_row").select("n", *site_ops.KEY)
    return site_ops.mismatched(v.shared, other).agg(F.count("*").alias("differences"))


@query(sql("SELECT site // 2 AS n, pos + CASE WHEN side = 'target' AND site % 14 = 6 THEN 1 ELSE 0 END AS pos, side FROM sites, (SELECT unnest(['panel', 'target']) AS side) WHERE site % 14 = 6"))
def site_lists_differ(v: Virtual) -> DataFrame:
    """One site in seven of the target's list is moved by a base."""
    other = site_ops.dense(v.typed_sites, "target_row").select("n", "chrom", F.when(F.col("n") % 7 == 3, F.col("pos") + 1).otherwise(F.col("pos")).alias("pos"), "ref", "alt")
    return site_ops.mismatched(v.shared, other).select("n", "pos", "side")


@query(sql("SELECT site, CASE WHEN (hap // 2) % 20 = 0 THEN hap + (SELECT max(vec_id) + 1 FROM embeddings) ELSE hap END AS hap, allele::BIGINT AS allele FROM alleles"))
def merge_panel_targets(v: Virtual) -> DataFrame:
    return site_ops.merge(v.panel, v.targets, v.table("embeddings").agg(F.max("vec_id") + 1).first()[0])


NAMES = ["S7", "S3", "S11", "S0", "S3"]


@query(sql("SELECT 'S' || (hap // 2) AS sample_id, k * 2 + hap % 2 AS hap, site, allele::BIGINT AS allele FROM alleles JOIN (SELECT unnest([7, 3, 11, 0, 3]) AS s, unnest(range(5)) AS k) ON s = hap // 2"))
def sample_select(v: Virtual) -> DataFrame:
    samples = v.table("embeddings").select(F.floor(F.col("vec_id") / 2).alias("sample_idx")).distinct().withColumn("sample_id", F.concat(F.lit("S"), "sample_idx"))
    return site_ops.select_samples(v.alleles, samples, NAMES)


@query(sql("SELECT hap, site, allele::BIGINT AS allele FROM alleles WHERE site >= 5 AND site < 41 AND (site - 5) % 3 = 0"))
def panel_slice(v: Virtual) -> DataFrame:
    return site_ops.rows_between(v.alleles, 5, 41, 3).select("hap", "site", "allele")


@query(sql("SELECT hap, site, allele::BIGINT AS allele FROM alleles WHERE site = 17"))
def panel_row(v: Virtual) -> DataFrame:
    return site_ops.rows_at(v.alleles, 17).select("hap", "site", "allele")


@query(sql("SELECT ordinal, hap, a.site, allele::BIGINT AS allele FROM alleles a JOIN (SELECT unnest([3, 60, 12, 3]) AS site, unnest(range(4)) AS ordinal) w ON w.site = a.site"))
def panel_take(v: Virtual) -> DataFrame:
    wanted = v.spark.createDataFrame([(i, s) for i, s in enumerate([3, 60, 12, 3])], "ordinal long, site long")
    return site_ops.take(v.alleles, wanted).select("ordinal", "hap", "site", "allele")


@query(sql("SELECT site, pos FROM sites WHERE pos BETWEEN 70000 AND 90121"))
def panel_range(v: Virtual) -> DataFrame:
    return site_ops.position_range(v.sites, 70000, 90121).select("site", "pos")


@query(sql("SELECT site, pos FROM sites WHERE pos >= 70121 AND pos < 90121"))
def panel_range_exclusive(v: Virtual) -> DataFrame:
    return site_ops.position_range(v.sites, 70121, 90121, inclusive=False).select("site", "pos")


@query(sql("SELECT hap, site, allele::BIGINT AS allele FROM alleles WHERE (hap // 2) % 20 <> 0"))
def panel_all(v: Virtual) -> DataFrame:
    return v.panel.select("hap", "site", "allele")


@query(sql("SELECT site, least(avg(allele), 1 - avg(allele)) AS maf FROM alleles GROUP BY site"))
def panel_maf(v: Virtual) -> DataFrame:
    return site_ops.minor_frequency(v.alleles)


@query(sql("SELECT site, hap // 2 AS sample_idx, CAST(sum(allele) AS BIGINT) AS dose FROM alleles GROUP BY ALL"))
def panel_dosage(v: Virtual) -> DataFrame:
    return site_ops.dosage(v.alleles)


@query(sql("SELECT chunk, min(pos) AS first_pos, max(pos) AS last_pos, count(*) AS n_sites FROM sites GROUP BY chunk"))
def chunk_zone_map(v: Virtual) -> DataFrame:
    return site_ops.zone_map(v.sites)


@query(sql("SELECT '20' AS chrom, count(*) AS n_variants, min(pos) AS min_position, max(pos) AS max_position, count(DISTINCT chunk) AS n_chunks, (SELECT count(DISTINCT hap) FROM alleles) AS n_haps, (SELECT count(DISTINCT hap) // 2 FROM alleles) AS n_samples FROM sites"))
def panel_metadata(v: Virtual) -> DataFrame:
    return site_ops.panel_facts(v.sites, v.alleles)


@query(sql("SELECT '20' AS chrom, k, k * w + 1 AS start, CASE WHEN k < parts - 1 THEN (k + 1) * w END AS stop FROM (SELECT unnest(range(parts)) AS k, parts, CAST(ceil(last / parts) AS BIGINT) AS w FROM (SELECT CAST(ceil(count(*) / 16) AS BIGINT) AS parts, max(pos) AS last FROM sites))"))
def position_chunks(v: Virtual) -> DataFrame:
    return site_ops.position_chunks(v.sites, CHUNK)


@query(sql("SELECT site, coalesce(nullif(original_id, ''), id) AS name FROM sites"))
def variant_names(v: Virtual) -> DataFrame:
    return v.sites.select("site", F.coalesce(F.nullif(F.col("original_id"), F.lit("")), F.col("id")).alias("name"))


# ---- VCF records, made of the rows of nation

VCF_ROWS = "'21' AS chrom, CAST(100 + n_nationkey // 2 AS BIGINT) AS pos, 'id' || n_nationkey AS id, 'a' AS ref"
VCF_SQL = f"SELECT {VCF_ROWS}, CASE n_nationkey % 3 WHEN 0 THEN '.' WHEN 1 THEN 'c' ELSE 'c,ta' END AS alt, (n_nationkey % 3)::VARCHAR AS g1, CASE WHEN n_nationkey % 5 = 0 THEN '.' ELSE (n_nationkey % 2)::VARCHAR END AS g2 FROM nation"


def vcf_text(v: Virtual) -> DataFrame:
    k = F.col("n_nationkey")
    alt = F.when(k % 3 == 0, ".").when(k % 3 == 1, "c").otherwise("c,ta")
    g1, g2 = (k % 3).cast("string"), F.when(k % 5 == 0, ".").otherwise((k % 2).cast("string"))
    fields = [F.lit("21"), (F.lit(100) + F.floor(k / 2)).cast("string"), F.concat(F.lit("id"), k), F.lit("a"), alt, F.lit("."), F.lit("PASS"), F.lit("."), F.lit("DP:GT"), F.concat(F.lit("7:"), g1, F.lit("/"), g2), F.concat(F.lit("7:"), g2)]
    haploid = [*fields[:9], F.concat(F.lit("7:"), g1), fields[10]]
    return v.table("nation").select(F.concat_ws("\t", *fields[:10]).alias("value"), F.concat_ws("\t", *haploid).alias("haploid"))


@query(f"SELECT chrom, pos, id, 'A' AS ref, upper(unnest(string_split(alt, ','))) AS alt, unnest(range(1, 1 + len(string_split(alt, ',')))) AS allele_no FROM ({VCF_SQL})")
def split_multiallelic(v: Virtual) -> DataFrame:
    return vcf.split_alleles(vcf.records(vcf_text(v).select("value"))).select("chrom", "pos", "id", "ref", "alt", "allele_no")


GT_SQL = f"SELECT *, upper(unnest(string_split(alt, ','))) AS one, unnest(range(1, 1 + len(string_split(alt, ',')))) AS no FROM ({VCF_SQL})"


@query(f"SELECT chrom, pos, 'A' AS ref, one AS alt, 0::BIGINT AS sample_idx, h::BIGINT AS h, CASE WHEN h = 0 THEN g1 = no::VARCHAR ELSE g2 = no::VARCHAR END::BIGINT AS allele, CASE WHEN h = 0 THEN false ELSE g2 = '.' END AS is_missing FROM ({GT_SQL}), (SELECT unnest([0, 1]) AS h) hh")
def vcf_genotypes(v: Virtual) -> DataFrame:
    return vcf.genotypes(vcf.split_alleles(vcf.records(vcf_text(v).select("value"))))


@query(f"SELECT chrom, pos, 'A' AS ref, one AS alt, s::BIGINT AS sample_idx, h::BIGINT AS h, CASE WHEN s = 0 THEN g1 = no::VARCHAR ELSE g2 = no::VARCHAR END::BIGINT AS allele, CASE WHEN s = 0 THEN false ELSE g2 = '.' END AS is_missing FROM ({GT_SQL}), (SELECT unnest([0, 1]) AS h) hh, (SELECT unnest([0, 1]) AS s) ss")
def vcf_haploid_genotypes(v: Virtual) -> DataFrame:
    return vcf.genotypes(vcf.split_alleles(vcf.records(vcf_text(v).select(F.col("haploid").alias("value")))))


@query(f"SELECT DISTINCT chrom, pos, 'A' AS ref, upper(alt) AS alt, id FROM ({VCF_SQL}) WHERE pos BETWEEN 103 AND 110")
def vcf_region_sites(v: Virtual) -> DataFrame:
    return vcf.sites(vcf.records(vcf_text(v).select("value")), "21", 103, 110)


# ---- matching


@query(sql("SELECT target_hap, ref_hap, start, len FROM runs"))
def match_runs(v: Virtual) -> DataFrame:
    return v.runs


@query(sql("SELECT * FROM top450"))
def match_top450(v: Virtual) -> DataFrame:
    return v.top_forward


@query(sql("SELECT * FROM top60"))
def match_top60(v: Virtual) -> DataFrame:
    return v.matches


# ---- the same with caps that trim, and with runs so long that gaps remain

CAPS = {"rank <= 450": "rank <= 4", "k <= 60": "k <= 2", "k <= 50": "k <= 3"}


def varied(text: str, changes: dict[str, str]) -> str:
    for old, new in changes.items():
        assert old in text
        text = text.replace(old, new)
    return text


@query(varied(sql("SELECT * FROM top450"), {"rank <= 450": "rank <= 4"}), Capped)
def capped_forward(v: Virtual) -> DataFrame:
    return v.top_forward


@query(varied(sql("SELECT * FROM top60"), {"rank <= 450": "rank <= 4", "k <= 60": "k <= 2"}), Capped)
def capped_backward(v: Virtual) -> DataFrame:
    return v.matches


@query(varied(sql("SELECT target_hap, n, ref_hap, round(score, 9) AS score, k FROM best50"), CAPS), Capped)
def capped_best_per_site(v: Virtual) -> DataFrame:
    return v.best.withColumn("score", F.round("score", 9))


LONG = {"count(*) >= 5": "count(*) >= 9"}


@query(varied(sql("SELECT * FROM cover"), LONG), Sparse)
def sparse_gap_fill(v: Virtual) -> DataFrame:
    return v.cover


@query(varied(sql("SELECT target_hap, n FROM (SELECT DISTINCT target_hap, unnest(range(32)) AS n FROM top60) EXCEPT SELECT target_hap, n FROM covered"), LONG), Sparse)
def sparse_missing_sites(v: Virtual) -> DataFrame:
    return select.missing_sites(v.cover, v.n_sites)


@query(varied(sql("SELECT target_hap, n, count(*) AS runs FROM stabbed GROUP BY ALL"), LONG), Sparse)
def sparse_coverage(v: Virtual) -> DataFrame:
    return select.stabbed(v.cover).groupBy("target_hap", "n").agg(F.count("*").alias("runs"))


# ---- the same over many more sites

BROAD = {
    dict(CTES)["alleles"]: "SELECT vec_id AS hap, site, CASE WHEN embedding[site % 64 + 1] * embedding[(site // 64 * 11 + site + 1) % 64 + 1] > 0 THEN 1 ELSE 0 END AS allele FROM embeddings, (SELECT unnest(range(2048)) AS site)",
    "n < 31": "n < 1023",
    "count(*) >= 5": "count(*) >= 10",
}


@query(varied(sql("SELECT target_hap, ref_hap, start, len FROM runs"), BROAD), Wide)
def wide_match_runs(v: Virtual) -> DataFrame:
    return v.runs


@query(varied(sql("SELECT * FROM top60"), BROAD), Wide)
def wide_match_top60(v: Virtual) -> DataFrame:
    return v.matches


# ---- coverage and selection


@query(sql("SELECT * FROM cover"))
def gap_fill(v: Virtual) -> DataFrame:
    return v.cover


@query(sql("SELECT target_hap, n FROM (SELECT DISTINCT target_hap, unnest(range(32)) AS n FROM top60) EXCEPT SELECT target_hap, n FROM covered"))
def missing_sites(v: Virtual) -> DataFrame:
    return select.missing_sites(v.cover, v.n_sites)


@query(sql("SELECT target_hap, n, ref_hap, start, len FROM stabbed"))
def stab_join(v: Virtual) -> DataFrame:
    return select.stabbed(v.cover).select("target_hap", "n", "ref_hap", "start", "len")


@query(sql("SELECT target_hap, ref_hap, tot, round(norm, 10) AS norm FROM totals"))
def hap_totals_normalized(v: Virtual) -> DataFrame:
    return v.totals.withColumn("norm", F.round("norm", 10))


@query(sql("SELECT target_hap, n, round(avg_len, 9) AS avg_len, round(sd, 9) AS sd, round(best, 9) AS best, round(threshold, 9) AS threshold FROM limits"))
def site_threshold(v: Virtual) -> DataFrame:
    return v.limits.select("target_hap", "n", *[F.round(c, 9).alias(c) for c in ("avg_len", "sd", "best", "threshold")])


@query(sql("SELECT target_hap, n, ref_hap, round(score, 9) AS score, k FROM best50"))
def best50_per_site(v: Virtual) -> DataFrame:
    return v.best.withColumn("score", F.round("score", 9))


@query(sql("SELECT * FROM again"))
def hap_having_gt1(v: Virtual) -> DataFrame:
    return select.seen_again(v.best)


@query(sql("SELECT * FROM chosen"))
def filter_with_fallback(v: Virtual) -> DataFrame:
    return v.chosen


@query(sql("SELECT * FROM wide"))
def expand_matches(v: Virtual) -> DataFrame:
    return v.wide


@query(sql("SELECT k.target_hap, ref_hap, cnt, round(cutoff, 9) AS cutoff, round(cutoff / 32, 9) AS error FROM kept k JOIN cuts u ON u.target_hap = k.target_hap"))
def hap_percentile_cut(v: Virtual) -> DataFrame:
    kept, cut = v.frequent
    return kept.join(met(cut), "target_hap").select("target_hap", "ref_hap", "cnt", F.round("cutoff", 9).alias("cutoff"), F.round("error", 9).alias("error"))


@query(sql("SELECT * FROM selected"))
def selected_haplotypes(v: Virtual) -> DataFrame:
    return v.selected


@query(sql("SELECT target_hap, n, c AS n_haps FROM nhaps"))
def site_hap_counts(v: Virtual) -> DataFrame:
    return weight_ops.site_counts(v.selected)


@query(sql("SELECT target_hap, n, string_agg(ref_hap::VARCHAR, ',' ORDER BY ref_hap) AS haps FROM selected GROUP BY ALL"))
def haplotype_id_lists(v: Virtual) -> DataFrame:
    return v.selected.groupBy("target_hap", "n").agg(F.array_join(F.sort_array(F.collect_list("ref_hap")), ",").alias("haps"))


# ---- map, recurrence and weights


@query(sql("SELECT n, pos, round(cm, 9) AS cm FROM cms"))
def genmap_interp(v: Virtual) -> DataFrame:
    return v.cm.select("n", "pos", F.round("cm", 9).alias("cm"))


@query(sql("SELECT n, round(before, 9) AS before, round(after, 9) AS after FROM rates"))
def recomb_prob(v: Virtual) -> DataFrame:
    return v.rates.select("n", F.round("before", 9).alias("before"), F.round("after", 9).alias("after"))


def _size(c: str):
    """Values of any size are compared by their logarithm."""
    return F.when(F.col(c) > 0, F.round(F.log10(c), 6))


@query(sql("SELECT target_hap, row, ref_hap, CASE WHEN x > 0 THEN round(log10(x), 6) END AS fwd FROM fwd"))
def forward_fold(v: Virtual) -> DataFrame:
    return v.folds.select("target_hap", "row", "ref_hap", _size("fwd").alias("fwd"))


@query(sql("SELECT target_hap, row, ref_hap, CASE WHEN x > 0 THEN round(log10(x), 6) END AS bwd FROM bwd"))
def backward_fold(v: Virtual) -> DataFrame:
    return v.folds.select("target_hap", "row", "ref_hap", _size("bwd").alias("bwd"))


@query(sql("SELECT target_hap, row, ref_hap, round(w, 7) AS w FROM normed"))
def weights_normalized(v: Virtual) -> DataFrame:
    return v.folds.select("target_hap", "row", "ref_hap", F.round("w", 7).alias("w"))


@query(sql("SELECT target_hap, row, ref_hap, round(w, 7) AS w FROM pruned"))
def weights_pruned(v: Virtual) -> DataFrame:
    return v.weights.select("target_hap", "row", "ref_hap", F.round("w", 7).alias("w"))


# ---- imputation and calls


@query(sql("SELECT row, start, num FROM intervals"))
def interval_rows(v: Virtual) -> DataFrame:
    return v.intervals


@query(sql("SELECT row, start, num, row // 9 AS part FROM intervals"))
def interval_chunks(v: Virtual) -> DataFrame:
    """As of a panel of 40 chunks: four parts of at most 9 of the 33 intervals."""
    return impute.interval_chunks(v.intervals, 40)


@query(sql("SELECT start + k AS site, row, k, num FROM (SELECT *, unnest(range(num)) AS k FROM intervals)"))
def site_interval(v: Virtual) -> DataFrame:
    return impute.site_intervals(v.intervals)


@query(sql("SELECT target_hap, site, ref_hap, round(w, 7) AS w FROM site_w"))
def interp_weights(v: Virtual) -> DataFrame:
    return impute.site_weights(v.ends, impute.site_intervals(v.intervals)).withColumn("w", F.round("w", 7))


@query(sql("SELECT site, target_hap, round(p, 7) AS p FROM probs"))
def alt_prob(v: Virtual) -> DataFrame:
    return v.probabilities.withColumn("p", F.round("p", 7))


@query(sql("SELECT site, sample_idx, round(ap1, 7) AS ap1, round(ap2, 7) AS ap2, round(ds, 7) AS ds, gt1, gt2 FROM gts"))
def genotype_call(v: Virtual) -> DataFrame:
    return calls.calls(v.probabilities).withColumns({c: F.round(c, 7) for c in ("ap1", "ap2", "ds")})


@query(sql("SELECT * FROM acs"))
def allele_count_freq(v: Virtual) -> DataFrame:
    return calls.allele_counts(calls.calls(v.probabilities))


@query(sql("SELECT site, '21' AS chrom, a.allele || '|' || b.allele AS gt, a.hap // 2 AS sample_idx FROM alleles a JOIN alleles b USING (site) WHERE (a.hap // 2) % 20 = 0 AND a.hap % 2 = 0 AND b.hap = a.hap + 1").replace("'21' AS chrom, ", ""))
def target_genotypes(v: Virtual) -> DataFrame:
    return own_genotypes(v)


def own_genotypes(v: Virtual) -> DataFrame:
    return v.targets.groupBy("site", F.floor(F.col("hap") / 2).alias("sample_idx")).agg(F.concat_ws("|", F.max(F.when(F.col("hap") % 2 == 0, F.col("allele"))), F.max(F.when(F.col("hap") % 2 == 1, F.col("allele")))).alias("gt"))


def _short(x: str) -> str:
    return f"CASE WHEN {x} % 1 = 0 THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) ELSE rtrim(rtrim(printf('%.2f', {x}), '0'), '.') END"


RECORD_SQL = sql(f"""SELECT s.site, concat_ws(chr(9), chrom, pos, coalesce(nullif(original_id, ''), id), ref, alt, '.', 'PASS',
  'AF=' || (SELECT CASE WHEN ac % an = 0 THEN (ac // an)::VARCHAR ELSE af::VARCHAR END || ';AC=' || ac || ';AN=' || an FROM acs WHERE acs.site = s.site) || CASE WHEN s.site % 2 = 0 THEN '' ELSE ';IMP' END,
  CASE WHEN s.site % 2 = 0 THEN 'GT' ELSE 'GT:DS:AP1:AP2' END,
  (SELECT string_agg(CASE WHEN s.site % 2 = 0 THEN a.allele || '|' || b.allele ELSE gt1 || '|' || gt2 || ':' || {_short("ds")} || ':' || {_short("ap1")} || ':' || {_short("ap2")} END, chr(9) ORDER BY sample_idx)
   FROM gts g JOIN alleles a ON a.site = g.site AND a.hap = sample_idx * 2 JOIN alleles b ON b.site = g.site AND b.hap = sample_idx * 2 + 1 WHERE g.site = s.site)) AS record FROM sites s""")


@query(RECORD_SQL)
def vcf_record_text(v: Virtual) -> DataFrame:
    return calls.records(calls.calls(v.probabilities), v.sites, v.shared, own_genotypes(v)).select("site", "record")


@query(f"SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, {_short('l_quantity / 3')} AS text FROM lineitem")
def number_text(v: Virtual) -> DataFrame:
    return v.table("lineitem").select("l_orderkey", "l_linenumber", short_number(F.col("l_quantity") / 3).alias("text"))


# ---- files: written from the virtual panel, read by the readers


def _lines(v: Virtual, df: DataFrame, label: str) -> str:
    """A single text file of df(i, value), in the order of i."""
    path = shared_path(v.spark, label)
    df.repartition(1).sortWithinPartitions("i").select("value").write.text(path)
    return path


@query(sql("SELECT '20' AS chrom, pos::BIGINT AS pos, round(cm, 9) AS cm FROM gmap"))
def file_genetic_map(v: Virtual) -> DataFrame:
    rows = v.genetic_map.select(F.col("pos").alias("i"), F.concat_ws(" ", "chrom", F.lit("."), F.col("cm").cast("string"), "pos").alias("value"))
    note = v.spark.createDataFrame([(0, "# chromosome name cM position")], "i long, value string")
    return side_files.genetic_map(v.spark, _lines(v, rows.unionByName(note), "map")).withColumn("cm", F.round("cm", 9))


@query(sql("SELECT chrom, pos, ref, alt FROM sites"))
def file_site_list(v: Virtual) -> DataFrame:
    rows = v.sites.select(F.col("site").alias("i"), F.concat_ws("\t", "chrom", "pos", F.lower("ref"), "alt").alias("value"))
    return side_files.site_list(v.spark, _lines(v, rows, "site-list"))


@query("SELECT sample_idx, 'S' || sample_idx AS sample_id FROM (SELECT DISTINCT vec_id // 2 AS sample_idx FROM embeddings)")
def file_sample_list(v: Virtual) -> DataFrame:
    names = v.table("embeddings").select(F.floor(F.col("vec_id") / 2).alias("i")).distinct().select("i", F.concat(F.lit("S"), F.col("i"), F.lit("\tPOP:x")).alias("value"))
    head = v.spark.createDataFrame([(-2, "ID_1 ID_2 missing"), (-1, "0 0 0")], "i long, value string")
    return side_files.sample_list(v.spark, _lines(v, names.unionByName(head), "samples"))


@query(sql("SELECT site, CASE WHEN site % 2 = 0 THEN 1 ELSE 0 END::BIGINT AS keep FROM sites"))
def file_site_filter(v: Virtual) -> DataFrame:
    rows = site_ops.mask(v.sites, v.shared).select(F.col("site").alias("i"), F.col("keep").cast("string").alias("value"))
    return side_files.site_filter(v.spark, _lines(v, rows, "filter"), v.n_variants)


def panel_files(v: Virtual) -> str:
    """The panel's store: sites, ALT alleles by chromosome and chunk, samples."""
    path = shared_path(v.spark, "store")
    alt = v.panel_alt.join(v.sites.select("site", "chrom", "chunk"), "site").select("chrom", "chunk", "site", "hap")
    samples = v.panel.select(F.floor(F.col("hap") / 2).alias("sample_idx")).distinct().withColumn("sample_id", F.concat(F.lit("S"), "sample_idx"))
    panel_store.write(v.sites, alt, samples, path)
    return path


@query(sql("SELECT site, hap FROM alleles WHERE (hap // 2) % 20 <> 0 AND allele = 1 AND site >= 21 AND site < 50 AND (site - 21) % 4 = 0"))
def store_slice(v: Virtual) -> DataFrame:
    _, alt, _ = panel_store.read(v.spark, panel_files(v))
    return site_ops.rows_between(alt, 21, 50, 4, CHUNK).select("site", "hap")


@query(sql("SELECT site, hap FROM alleles WHERE (hap // 2) % 20 <> 0 AND allele = 1 AND site = 17"))
def store_row(v: Virtual) -> DataFrame:
    _, alt, _ = panel_store.read(v.spark, panel_files(v))
    return site_ops.rows_at(alt, 17, CHUNK).select("site", "hap")


@query(sql("SELECT chrom, count(*) AS n_variants, min(pos) AS min_position, max(pos) AS max_position, count(DISTINCT chunk) AS n_chunks, (SELECT n_panel // 2 FROM np) AS n_samples, (SELECT n_panel FROM np) AS n_haps FROM sites GROUP BY chrom"))
def store_metadata(v: Virtual) -> DataFrame:
    return panel_store.decoded(panel_store.metadata(v.spark, panel_files(v)))


@query(sql("SELECT site, chunk, id, original_id FROM sites"))
def store_sites(v: Virtual) -> DataFrame:
    sites, _, _ = panel_store.read(v.spark, panel_files(v))
    return sites.select("site", "chunk", "id", "original_id")


def names(v: Virtual) -> list[str]:
    """Of the targets, in order: the columns of their file."""
    return [r.s for r in v.targets.select(F.floor(F.col("hap") / 2).alias("i")).distinct().orderBy("i").select(F.concat(F.lit("S"), "i").alias("s")).collect()]


def target_file(v: Virtual) -> str:
    """A VCF of the targets at typed sites."""
    path = shared_path(v.spark, "target") + ".vcf.gz"
    rows = own_genotypes(v).join(v.shared.select("site"), "site").groupBy("site").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("sample_idx", "gt"))), lambda x: x["gt"]), "\t").alias("gts"))
    body = rows.join(v.sites, "site").select("site", F.concat_ws("\t", "chrom", "pos", "id", "ref", "alt", F.lit("."), F.lit("PASS"), F.lit("."), F.lit("GT"), "gts").alias("record"))
    vcf.write(body, vcf.header_lines("##contig=<ID=20,length=64444167>", names(v), "1.0"), path)
    return path


@query(sql("SELECT s.pos, dense_rank() OVER (ORDER BY hap // 2) - 1 AS sample_idx, hap % 2 AS h, allele::BIGINT AS allele, false AS is_missing FROM alleles a JOIN sites s ON s.site = a.site WHERE (hap // 2) % 20 = 0 AND a.site % 2 = 0"))
def file_vcf_genotypes(v: Virtual) -> DataFrame:
    return vcf.genotypes(vcf.split_alleles(vcf.records(vcf.lines(v.spark, target_file(v))))).select("pos", "sample_idx", "h", "allele", "is_missing")


@query(sql("SELECT row_number() OVER (ORDER BY s) - 1 AS sample_idx, 'S' || s AS sample_id FROM (SELECT DISTINCT hap // 2 AS s FROM alleles WHERE (hap // 2) % 20 = 0)"))
def file_vcf_samples(v: Virtual) -> DataFrame:
    return vcf.samples(vcf.lines(v.spark, target_file(v)))


@query(sql("SELECT id FROM sites WHERE site % 2 = 0"))
def file_vcf_ids(v: Virtual) -> DataFrame:
    return vcf.ids(vcf.lines(v.spark, target_file(v)))


@query(sql("SELECT '20' AS chrom, count(*) AS n_records, max(pos) AS last_pos, 64444167::BIGINT AS length FROM sites WHERE site % 2 = 0"))
def file_vcf_stats(v: Virtual) -> DataFrame:
    return vcf.file_stats(vcf.lines(v.spark, target_file(v)))


@query("SELECT '##contig=<ID=20,length=64444167>' AS contig, '20' AS chrom, (SELECT count(*) FROM (SELECT DISTINCT vec_id // 2 AS s FROM embeddings) WHERE s % 20 = 0) AS n_columns")
def file_vcf_header(v: Virtual) -> DataFrame:
    text = vcf.lines(v.spark, target_file(v))
    found = v.spark.createDataFrame([(vcf.contig_line(text, "20"), vcf.one_chromosome(vcf.records(text)))], "contig string, chrom string")
    return found.withColumn("n_columns", F.lit(vcf.samples(text).count()).cast("long"))


def imputed_file(v: Virtual) -> str:
    path = shared_path(v.spark, "imputed") + ".vcf.gz"
    body = calls.records(calls.calls(v.probabilities), v.sites, v.shared, own_genotypes(v))
    vcf.write(body, vcf.header_lines("##contig=<ID=20,length=64444167>", names(v), "1.0"), path)
    return path


@query(RECORD_SQL.replace("SELECT s.site, concat_ws", "SELECT concat_ws"))
def file_imputed_records(v: Virtual) -> DataFrame:
    return vcf.lines(v.spark, imputed_file(v)).where(~F.col("value").startswith("#")).select(F.col("value").alias("record"))


@query(sql("SELECT s.id AS variant, 'S' || g.sample_idx AS sample_idx, h::BIGINT AS h, CASE WHEN s.site % 2 = 0 THEN a.allele WHEN h = 0 THEN gt1 ELSE gt2 END::BIGINT AS allele FROM gts g, (SELECT unnest([0, 1]) AS h) hh, sites s, alleles a WHERE s.site = g.site AND a.site = g.site AND a.hap = g.sample_idx * 2 + h AND s.pos BETWEEN 70000 AND 90121 AND g.sample_idx IN (0, 20)"))
def file_scored_region(v: Virtual) -> DataFrame:
    """The scorer's scan of an imputed file: a region, two samples by name."""
    return vcf.scored_alleles(vcf.lines(v.spark, imputed_file(v)), ["S0", "S20"], "20", 70000, 90121).select("variant", "sample_idx", "h", "allele")


@query(sql("SELECT variant, tp, tn, fp, fn, fp + fn AS te, round(2 * p * r / (p + r), 6) AS fscore FROM (SELECT *, (tp + 1e-8) / (tp + fp + 1e-8) AS p, (tp + 1e-8) / (tp + fn + 1e-8) AS r FROM conf)"))
def file_score_report(v: Virtual) -> DataFrame:
    """The variant report as it is written to CSV, read back."""
    path = shared_path(v.spark, "report")
    found = score.fscore_by_variant(pairs(v))
    found.select(*[plain_number(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in found.dtypes]).write.csv(path, header=True)
    return v.spark.read.csv(path, header=True, schema="variant long, tp long, tn long, fp long, fn long, te long, prec double, recall double, fscore double").drop("prec", "recall")


# ---- scoring


def pairs(v: Virtual) -> DataFrame:
    called = calls.calls(v.probabilities)
    strands = F.explode(F.array(*[F.struct(F.lit(h).alias("h"), F.col(f"gt{h + 1}").alias("allele")) for h in (0, 1)]))
    imputed = called.select(F.floor(F.col("site") / CHUNK).alias("chunk"), F.col("site").alias("variant"), "sample_idx", strands.alias("s")).select("chunk", "variant", "sample_idx", "s.h", "s.allele")
    truth = v.targets.select(F.col("site").alias("variant"), F.floor(F.col("hap") / 2).alias("sample_idx"), (F.col("hap") % 2).alias("h"), "allele")
    return score.paired(imputed, truth)


@query(sql("SELECT *, fp + fn AS te FROM conf"))
def confusion_variant(v: Virtual) -> DataFrame:
    return score.confusion_by_variant(pairs(v))


UNPHASED = "SELECT variant, sample_idx, CASE WHEN x > 1 - h THEN 1 ELSE 0 END AS x, CASE WHEN y > 1 - h THEN 1 ELSE 0 END AS y FROM dose, (SELECT unnest([0, 1]) AS h) hh"


@query(sql(f"SELECT variant, count(*) FILTER (x = 1 AND y = 1) AS tp, count(*) FILTER (x = 0 AND y = 0) AS tn, count(*) FILTER (x = 1 AND y = 0) AS fp, count(*) FILTER (x = 0 AND y = 1) AS fn, count(*) FILTER (x <> y) AS te FROM ({UNPHASED}) GROUP BY variant"))
def confusion_variant_unphased(v: Virtual) -> DataFrame:
    return score.confusion_by_variant(score.unphased(pairs(v)))


@query(sql("SELECT sample_idx, count(*) FILTER (x = 1 AND y = 1) AS tp, count(*) FILTER (x = 0 AND y = 0) AS tn, count(*) FILTER (x = 1 AND y = 0) AS fp, count(*) FILTER (x = 0 AND y = 1) AS fn, count(*) FILTER (x <> y) AS te FROM xy GROUP BY sample_idx"))
def confusion_sample(v: Virtual) -> DataFrame:
    return score.confusion_by_sample(pairs(v))


@query(sql("SELECT variant, tp, tn, fp, fn, fp + fn AS te, round(p, 6) AS prec, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS fscore FROM (SELECT *, (tp + 1e-8) / (tp + fp + 1e-8) AS p, (tp + 1e-8) / (tp + fn + 1e-8) AS r FROM conf)"))
def fscore_variant(v: Virtual) -> DataFrame:
    return score.fscore_by_variant(pairs(v))


@query(sql("SELECT variant, round(avg(CASE WHEN x = y THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy FROM xy GROUP BY variant"))
def accuracy_variant(v: Virtual) -> DataFrame:
    return score.accuracy_by_variant(pairs(v))


MOMENTS = "(count(*) * sum(x * y) - sum(x) * sum(y))::DOUBLE AS num, sqrt(((count(*) * sum(x * x) - sum(x) * sum(x)) * (count(*) * sum(y * y) - sum(y) * sum(y)))::DOUBLE) AS den"


@query(sql(f"SELECT variant, round(pow(num / (den + 1e-15), 2), 6) AS r2 FROM (SELECT variant, {MOMENTS} FROM dose GROUP BY variant)"))
def r2_variant(v: Virtual) -> DataFrame:
    return score.r2_by_variant(pairs(v))


@query(sql("SELECT variant, round(sqrt(avg((x - y) * (x - y))), 6) AS rmse FROM xy GROUP BY variant"))
def rmse_variant(v: Virtual) -> DataFrame:
    return score.rmse_by_variant(pairs(v))


@query(sql("SELECT variant, round(CASE WHEN pc < 1 THEN (p0 - pc) / (1 - pc) END, 6) AS iqs, round(p0, 6) AS p0 FROM (SELECT variant, (count(*) FILTER (x = y) * 3 + count(*) FILTER (x <> y)) / (count(*) * 3)::DOUBLE AS p0, pow(count(*) FILTER (x = y) / count(*)::DOUBLE, 2) AS pc FROM dose GROUP BY variant)"))
def iqs_variant(v: Virtual) -> DataFrame:
    return score.iqs_by_variant(pairs(v))


@query(
    sql(
        f"""SELECT sample_idx, round(r / n, 6) AS accuracy, round(pow(num / den, 2), 6) AS r2, tp, tn, fp, fn, fp + fn AS te, prec, recall, round(2 * prec * recall / nullif(prec + recall, 0), 6) AS f1
  FROM (SELECT *, round(tp / nullif(tp + fp, 0)::DOUBLE, 6) AS prec, round(tp / nullif(tp + fn, 0)::DOUBLE, 6) AS recall
    FROM (SELECT sample_idx, count(*) FILTER (x = 1 AND y = 1) AS tp, count(*) FILTER (x = 0 AND y = 0) AS tn, count(*) FILTER (x = 1 AND y = 0) AS fp, count(*) FILTER (x = 0 AND y = 1) AS fn, count(*) FILTER (x = y) / 2.0::DOUBLE AS r, count(DISTINCT variant) AS n FROM xy GROUP BY sample_idx) a
    JOIN (SELECT sample_idx, sum(num + 1e-15) AS num, sum(den + 1e-15) AS den FROM (SELECT chunk, sample_idx, {MOMENTS} FROM dose GROUP BY chunk, sample_idx) GROUP BY sample_idx) b USING (sample_idx))"""
    )
)
def r2_sample_rollup(v: Virtual) -> DataFrame:
    return score.by_sample(pairs(v))


FLAGSHIP = "alt_prob"


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES[FLAGSHIP](spark, sf_dir)
