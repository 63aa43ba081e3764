"""Secret scans with corpus-wide ownership: built-in functions only.

Candidates found in a text are hashed and their hashes counted over all repositories and owners. A
value in many repositories of many owners is a copied example; any other that looks random is a
live-looking credential. Where no repository is given, equal texts are one repository, so that
copies of one document do not make its key an example.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free_name, table, written

# The kinds in order, each with its pattern, the group that holds the value and the
# least length of that group. A run of [0-9a-f] under 24 long can't hold a match, nor can a run after
# AKIA under 16, so the least length stands in those two patterns.
KINDS = (
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
# The method's own kind: long mixed tokens, kept only where corpus counts call them live.
OWNED = ("owned", r"[A-Za-z0-9+/_-]{20,}", 0, 20)
OWNERS, REPOS = 3, 3  # a value of this many owners and repositories is an example
PIECE = 4096  # code points of the pieces that long texts are cut from
# A match of assign holds the last letter of its word, a mark and a character of its value; matches
# of the other kinds are runs that the owned kind's pattern finds too. So a text without both of
# these needs no closer look.
NEAR = r"""[DdTtNnYy]["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]"""
HIT = "struct<k:int,s:long,e:long,v:string>"


def may_hold(text: Column) -> Column:
    return (text.rlike(NEAR) & text.rlike(KINDS[0][1])) | text.rlike(OWNED[1])


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)


def _placed(k: int, g: str, b: str, c: str, v: str):
    def one(x: Column, i: Column) -> Column:
        n = F.floor(i / 256).cast("int")
        before = F.get(F.col(c), n) + _sum(F.slice(F.col(b), n * 256 + 1, i - n * 256))
        start = before + F.get(F.col(g), i)["a"]
        return F.struct(F.lit(k).alias("k"), start.alias("s"), (start + F.char_length(x)).alias("e"), F.get(F.col(v), i).alias("v"))

    return one


def _at_least(hits: Column, least: int) -> Column:
    return F.filter(hits, lambda x: F.char_length(x["v"]) >= least)


def _count(hits: str, field: str, value: int | str) -> Column:
    return F.size(F.filter(hits, lambda x: x[field] == value)).cast("long")


def _hits(df: DataFrame, text: str, kinds: tuple, out: str) -> DataFrame:
    """Adds `out`: the matches of all kinds as (kind number, start, end, value), offsets in code points.

    What lies between matches and the matches themselves give the offsets. Running sums are taken in
    blocks of 256, so that a text of very many matches costs little more than in proportion."""
    names = []
    for k, (_, pattern, group, least) in enumerate(kinds):
        g, w, v, b, c = (f"__{x}{k}" for x in "gwvbc")
        quoted = F.lit(pattern)
        df = df.withColumn(w, F.regexp_extract_all(text, quoted, F.lit(0)))
        df = df.withColumn(v, F.regexp_extract_all(text, quoted, F.lit(group)) if group else F.col(w))
        gaps = F.when(F.size(w) > 0, F.transform(F.split(F.col(text), pattern, -1), lambda x: F.char_length(x).cast("long"))).otherwise(F.array().cast("array<bigint>"))
        df = df.withColumn(g, F.transform(F.arrays_zip(gaps.alias("a"), F.transform(w, lambda x: F.char_length(x).cast("long")).alias("b")), lambda x: F.struct(x["a"].alias("a"), F.coalesce(x["b"], F.lit(0)).alias("b"))))
        df = df.withColumn(b, F.transform(g, lambda x: x["a"] + x["b"]))
        df = df.withColumn(f"{c}0", F.when(F.size(b) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(b) - 1) / 256).cast("int")), lambda i: _sum(F.slice(F.col(b), i * 256 + 1, F.lit(256))))).otherwise(F.array().cast("array<bigint>")))
        df = df.withColumn(c, F.transform(f"{c}0", lambda x, i: F.when(i == 0, F.lit(0).cast("long")).otherwise(_sum(F.slice(F.col(f"{c}0"), F.lit(1), i)))))

        df = df.withColumn(f"__h{k}", _at_least(F.transform(w, _placed(k, g, b, c, v)), least))
        names.append(f"__h{k}")
    return df.withColumn(out, F.array_sort(F.concat(*names), lambda x, y: F.when(x["s"] != y["s"], F.sign(x["s"] - y["s"])).otherwise(F.sign(x["k"] - y["k"])).cast("int"))).drop(*[c for c in df.columns if c.startswith("__") and c not in (text, "__row", "__rest")])


def _spans(hits: Column) -> Column:
    name = F.array(*[F.lit(n) for n, *_ in (*KINDS, OWNED)])
    return F.array_join(F.transform(hits, lambda x: F.concat_ws(":", F.get(name, x["k"]), x["s"], x["e"])), ",")


def _live(value: str) -> Column:
    """Looks random: at least 8 different characters, letters and digits."""
    return (F.size(F.array_distinct(F.split(value, ""))) >= 8) & F.col(value).rlike("[0-9]") & F.col(value).rlike("[A-Za-z]")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str | None = None) -> DataFrame:
    """Row for row: doc_id, digest (of the text), base and more (kind, start, end, value), found with built-in functions.

    base holds the base kinds' matches, more the owned kind's candidates clear of them. repo_col: the
    repository a row belongs to; by default equal texts are one. Null text is empty text. Texts of
    any length are searched whole; running sums keep very many matches in proportion."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    df = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.col(owner_col).cast("string").alias("owner"), (F.col(repo_col) if repo_col else F.xxhash64(text)).cast("string").alias("repo"))
    df = df.withColumn("digest", F.xxhash64("text")).withColumn("text", F.when(may_hold(F.col("text")), F.col("text")).otherwise(""))
    df = _hits(df, "text", (*KINDS, OWNED), "all")
    own = len(KINDS)
    base = F.filter("all", lambda x: x["k"] < own)
    df = df.withColumn("base", base)
    more = F.filter("all", lambda x: (x["k"] == own) & x["v"].rlike("[0-9]") & x["v"].rlike("[a-z]") & x["v"].rlike("[A-Z]") & ~F.exists("base", lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"])))
    return df.select("doc_id", "owner", "repo", "digest", "base", more.alias("more"))


def ownership(found: DataFrame, owners: int = OWNERS, repos: int = REPOS) -> DataFrame:
    """(hash, n_repos, n_owners, class): each candidate value's distinct repositories and owners over the corpus.

    Sums run from (hash, owner, repository) to (hash, owner) and (hash, repository) and then to hash,
    each pre-aggregated, so that a value which a third of all rows hold is never gathered."""
    each = found.select("owner", "repo", F.explode(F.concat("base", "more")).alias("h")).select("owner", "repo", F.col("h.v").alias("v")).withColumn("hash", F.sha2("v", 256)).withColumn("random", _live("v"))
    rows = each.groupBy("hash", "owner", "repo").agg(F.max("random").alias("random"))
    by_owner = rows.groupBy("hash", "owner").agg(F.max("random").alias("random"))
    n_owners = by_owner.groupBy("hash").agg(F.count("*").alias("n_owners"), F.max("random").alias("random"))
    n_repos = rows.groupBy("hash", "repo").agg(F.lit(1).alias("one")).groupBy("hash").agg(F.count("*").alias("n_repos"))
    kind = F.when((F.col("n_owners") >= owners) & (F.col("n_repos") >= repos), "example").when(F.col("random"), "live").otherwise("unsure")
    return n_owners.join(n_repos, "hash").select("hash", "n_repos", "n_owners", kind.alias("class"))


def _classed(found: DataFrame, owners: int) -> DataFrame:
    """(doc_id, digest, h, hash, n_repos, n_owners, class): a row for each kept span; those of the owned kind only where they are live."""
    some = found.where((F.size("base") > 0) | (F.size("more") > 0)).select("doc_id", "digest", F.explode(F.concat("base", "more")).alias("h"))
    met = some.select("doc_id", "digest", "h", F.sha2("h.v", 256).alias("hash")).join(ownership(found, owners), "hash")
    return met.where((F.col("h.k") < len(KINDS)) | (F.col("class") == "live"))


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str | None = None, owners: int = OWNERS) -> DataFrame:
    """One row per input row: doc_id, digest, base (matches of the fixed kinds), judged (all kept spans with value hash, counts and class).

    Spans of the owned kind are kept where their value is live. Base spans are always kept, whatever
    their class. Null and empty texts have no spans; very long ones are searched whole. Rows that
    repeat a doc_id and text give equal rows; a null owner counts as one owner of its own. Other
    columns are not read, whatever their names. An empty table gives none."""
    found = written(scan(docs, id_col, text_col, owner_col, repo_col), "secret-hits")
    judged = _classed(found, owners).groupBy("doc_id", "digest").agg(F.collect_set(F.struct(F.col("h.s").alias("s"), F.col("h.k").alias("k"), F.col("h.e").alias("e"), "hash", "n_repos", "n_owners", "class")).alias("judged"))
    j = judged.select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"), F.array_sort("judged").alias("judged"))
    rows = found.select("doc_id", "digest", "base")
    joined = rows.join(j, rows["doc_id"].eqNullSafe(j["__id"]) & (rows["digest"] == j["__digest"]), "left")
    return joined.select("doc_id", "digest", "base", F.coalesce("judged", F.array().cast(dict(judged.dtypes)["judged"])).alias("judged"))


def _between(pieces: Column, a: Column, b: Column) -> Column:
    """Code points a to b of a text that was cut into pieces of PIECE; costs what it gives and two pieces."""
    i, j = F.floor(a / PIECE).cast("int"), F.floor((b - 1) / PIECE).cast("int")
    at = lambda k: F.get(pieces, k)
    one = F.substring(at(i), (a - i * PIECE + 1).cast("int"), (b - a).cast("int"))
    more = F.concat(F.substring(at(i), (a - i * PIECE + 1).cast("int"), F.lit(PIECE)), F.array_join(F.slice(pieces, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.substring(at(j), F.lit(1), (b - j * PIECE).cast("int")))
    return F.when(b <= a, "").when(i == j, one).otherwise(more)


def _masked(text: Column, cuts: Column, mark: str) -> Column:
    """text with the spans cuts(s, a, e) masked; a is where the span before ended. The lambda holds the pieces, which are made once."""
    last = F.get(cuts, F.size(cuts) - 1)["e"]

    def joined(pieces: Column) -> Column:
        parts = F.transform(cuts, lambda x: F.concat(_between(pieces, x["a"], x["s"]), F.lit(mark)))
        return F.concat(F.array_join(parts, ""), _between(pieces, last, F.char_length(text).cast("long")))

    return F.get(F.transform(F.array(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))), joined), F.lit(0))


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", mark: str = "[SECRET]") -> DataFrame:
    """docs with every live span's text replaced by `mark`; examples, unsure values, null and clean texts are left as they are.

    All columns and rows stay; overlapping spans become one mark. Spans are cut in code points, in
    time that follows the text's length and the number of spans. Texts that can hold no secret stay
    where they are; only the others meet their spans by a join."""
    named, rest, cut = (free_name(docs, x) for x in ("__row", "__digest", "__cut"))
    found = written(scan(docs, id_col, text_col, owner_col), "secret-hits")
    live = _classed(found, OWNERS).where("class = 'live'").select("doc_id", "digest", F.col("h.s").alias("s"), F.col("h.e").alias("e")).distinct()
    # spans that overlap become one: a new one begins where all before it have ended
    before = Window.partitionBy("doc_id", "digest").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    first = live.withColumn("far", F.max("e").over(before)).withColumn("new", (F.col("far").isNull() | (F.col("s") >= F.col("far"))).cast("int"))
    first = first.withColumn("part", F.sum("new").over(Window.partitionBy("doc_id", "digest").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, 0)))
    one = first.groupBy("doc_id", "digest", "part").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    one = one.withColumn("a", F.coalesce(F.lag("e").over(Window.partitionBy("doc_id", "digest").orderBy("s")), F.lit(0)))
    cuts = one.groupBy(F.col("doc_id").alias(named), F.col("digest").alias(rest)).agg(F.sort_array(F.collect_list(F.struct("s", "a", "e"))).alias(cut))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    some = docs.where(may_hold(text))
    joined = some.join(cuts, some[id_col].eqNullSafe(cuts[named]) & (F.xxhash64(text) == cuts[rest]), "left")
    masked = F.when(F.col(cut).isNull(), some[text_col]).otherwise(_masked(text, F.col(cut), mark)).cast(docs.schema[text_col].dataType)
    return docs.where(~may_hold(text)).unionByName(joined.select(*[masked.alias(c) if c == text_col else some[c] for c in docs.columns]))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets(table(spark, sf_dir, "documents"))
    count = [_count("base", "k", k).alias(f"n_{n}") for k, (n, *_) in enumerate(KINDS)]
    classes = [_count("judged", "class", c).alias(f"n_{c}") for c in ("example", "live", "unsure")]
    return found.select("doc_id", *count, F.sha2(_spans(F.col("base")), 256).alias("base_sha256"), _spans(F.col("judged")).alias("spans"), *classes)


def _sql_kind(k: int, pattern: str, group: int) -> str:
    quoted = "'" + pattern.replace("'", "''") + "'"
    return (
        f"SELECT doc_id, source, {k} AS k, i, length(w) AS n, v, gap FROM (SELECT doc_id, source, unnest(regexp_extract_all(text, {quoted}, 0)) AS w, unnest(regexp_extract_all(text, {quoted}, {group})) AS v, "
        f"unnest(list_resize(string_split_regex(text, {quoted}), len(regexp_extract_all(text, {quoted}, 0)))) AS gap, unnest(range(len(regexp_extract_all(text, {quoted}, 0)))) AS i FROM d)"
    )


OP3_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
m AS ({" UNION ALL ".join(_sql_kind(k, p, g) for k, (_, p, g, _) in enumerate((*KINDS, OWNED)))}),
p AS (SELECT *, CAST(sum(length(gap)) OVER w + sum(n) OVER w - n AS BIGINT) AS s FROM m WINDOW w AS (PARTITION BY doc_id, k ORDER BY i)),
h AS (SELECT doc_id, source, k, s, s + n AS e, v, ['assign', 'access', 'hex', 'owned'][k + 1] || ':' || s || ':' || (s + n) AS span FROM p WHERE length(v) >= [6, 20, 24, 20][k + 1]),
o AS (SELECT * FROM h WHERE k = 3 AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]') AND NOT EXISTS (SELECT 1 FROM h b WHERE b.doc_id = h.doc_id AND b.k < 3 AND b.s < h.e AND h.s < b.e)),
c AS (SELECT * FROM h WHERE k < 3 UNION ALL SELECT * FROM o),
f AS (SELECT v, CASE WHEN count(DISTINCT d.source) >= {OWNERS} AND count(DISTINCT d.text) >= {REPOS} THEN 'example'
    WHEN regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND len(list_distinct(string_split(v, ''))) >= 8 THEN 'live' ELSE 'unsure' END AS class FROM c JOIN d ON d.doc_id = c.doc_id GROUP BY v),
j AS (SELECT c.*, class FROM c JOIN f ON f.v = c.v WHERE k < 3 OR class = 'live')
SELECT d.doc_id, count(k) FILTER (k = 0) AS n_assign, count(k) FILTER (k = 1) AS n_access, count(k) FILTER (k = 2) AS n_hex,
  sha256(coalesce(string_agg(span, ',' ORDER BY s, k) FILTER (k < 3), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY s, k), '') AS spans,
  count(k) FILTER (class = 'example') AS n_example, count(k) FILTER (class = 'live') AS n_live, count(k) FILTER (class = 'unsure') AS n_unsure
FROM d LEFT JOIN j ON j.doc_id = d.doc_id GROUP BY d.doc_id
"""
