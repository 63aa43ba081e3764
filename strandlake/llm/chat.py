"""Chat formatting by perspective rotation.

Every participant of a dialogue in turn is the assistant: the dialogue is rendered with that
speaker's turns as the assistant's, all others as named users, and the mask covers the speaker's
own words and their end marks. Long dialogues are rendered in chunks of turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

TURNS = 64  # turns of a chunk
RANGE = 1024  # turn numbers of a range that is ranked in one piece
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
SYSTEM, UNKNOWN = "system", "unknown"


def plain(text: Column) -> Column:
    """Text in which no control mark can begin."""
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def base(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, span: int = RANGE) -> DataFrame:
    """(conv_id, lone, key, part, turn, role, text): lone marks a null conv_id, key stands for it; part is the range of turn numbers."""
    conv = F.col(conv_col)
    t = turns.select(conv.alias("conv_id"), conv.isNull().alias("lone"), F.coalesce(conv.cast("string"), F.lit("")).alias("key"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit(UNKNOWN)).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return t.withColumn("part", F.coalesce(F.floor(F.col("turn") / span), F.lit(-(1 << 62))))


def rendered(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", chunk: int = TURNS, span: int = RANGE) -> DataFrame:
    """(conv_id, perspective, chunk, n_turns, n_own, text, masks): one row for each chunk and participant of its dialogue.

    Turns are ordered by turn, role and text; chunks of `chunk` turns are cut within ranges of `span`
    turn numbers and counted through from 0, so that a dialogue that holds a third of all rows is
    many tasks' work. Texts are shuffled once, by dialogue and range; who takes part and how many
    chunks lie before a range comes to them in small rows.

    Participants are the roles of the whole dialogue but the system; a dialogue of system turns only
    has none. Null roles are 'unknown', null texts empty, a null turn comes first; a null conv_id is
    a dialogue. Repeated turns are all rendered; turns of one number (or of none) of one dialogue are
    ranked in one piece. Texts of any length are rendered whole; '<|' in them becomes '< |', so that
    no control mark can be forged. masks are spans of text in code points. Other columns are not
    read, whatever their names. An empty table gives none.

    The chunks of a dialogue and perspective, end to end in their order, are the whole dialogue; see
    whole()."""
    t = base(turns, conv_col, turn_col, role_col, text_col, span)
    at, whole = ["lone", "key", "part"], ["lone", "key"]
    people = t.where(F.col("role") != SYSTEM).select(*whole, F.col("role").alias("perspective")).distinct()
    over = Window.partitionBy(*whole).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = t.groupBy(*at).agg(F.ceil(F.count("*") / chunk).alias("n")).select(*at, F.coalesce(F.sum("n").over(over), F.lit(0)).alias("before"))
    within = Window.partitionBy(*at).orderBy(F.asc_nulls_first("turn"), "role", "text")
    ranked = t.withColumn("rank", F.row_number().over(within) - 1).withColumn("piece", F.floor(F.col("rank") / chunk))
    held = ranked.groupBy(*at, "piece").agg(F.first("conv_id").alias("conv_id"), F.sort_array(F.collect_list(F.struct("rank", "role", "text"))).alias("turns"))
    rows = held.join(ranges.join(people, whole), at).select("conv_id", "perspective", (F.col("before") + F.col("piece")).alias("chunk"), "turns")
    name = lambda role: F.regexp_replace(plain(role), r"\s", " ")

    def head(x: Column) -> Column:
        who = F.when(x["role"] == SYSTEM, F.lit("system")).when(x["role"] == F.col("perspective"), F.lit("assistant")).otherwise(F.concat(F.lit("user name="), name(x["role"])))
        return F.concat(F.lit(OPEN), who, F.lit("\n"))

    rows = rows.withColumn("heads", F.transform("turns", head)).withColumn("bodies", F.transform("turns", lambda x: F.concat(plain(x["text"]), F.lit(CLOSE))))
    sizes = F.transform(F.arrays_zip("heads", "bodies"), lambda x: F.char_length(x["heads"]) + F.char_length(x["bodies"]))
    rows = rows.withColumn("sizes", sizes)

    def mask(x: Column, i: Column) -> Column:
        start = F.aggregate(F.slice("sizes", F.lit(1), i), F.lit(0), lambda a, b: a + b) + F.char_length(F.get(F.col("heads"), i))
        return F.when(x["role"] == F.col("perspective"), F.struct(start.alias("s"), (start + F.char_length(F.get(F.col("bodies"), i))).alias("e")))

    rows = rows.withColumn("masks", F.filter(F.transform("turns", mask), lambda x: x.isNotNull()))
    text = F.array_join(F.transform(F.arrays_zip("heads", "bodies"), lambda x: F.concat(x["heads"], x["bodies"])), "")
    return rows.select("conv_id", "perspective", "chunk", F.size("turns").cast("long").alias("n_turns"), F.size("masks").cast("long").alias("n_own"), text.alias("text"), "masks")


def whole(chunks: DataFrame) -> DataFrame:
    """(conv_id, perspective, n_turns, n_own, text, masks): the chunks of rendered() put together, a row for each dialogue and participant.

    For dialogues that fit into a row (2 GB of text); longer ones stay in chunks. masks are spans of
    the whole text."""
    held = chunks.groupBy("conv_id", "perspective").agg(F.sum("n_turns").alias("n_turns"), F.sum("n_own").alias("n_own"), F.sort_array(F.collect_list(F.struct("chunk", "text", "masks"))).alias("all"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<s:bigint,e:bigint>>").alias("masks"))
    moved = lambda a, x: F.concat(a["masks"], F.transform(x["masks"], lambda m: F.struct((m["s"] + a["at"]).alias("s"), (m["e"] + a["at"]).alias("e"))))
    masks = F.aggregate("all", start, lambda a, x: F.struct((a["at"] + F.char_length(x["text"])).alias("at"), moved(a, x).alias("masks")), lambda a: a["masks"])
    return held.select("conv_id", "perspective", "n_turns", "n_own", F.array_join(F.transform("all", lambda x: x["text"]), "").alias("text"), masks.alias("masks"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.array_join(F.transform("masks", lambda x: F.concat_ws(":", x["s"], x["e"])), ",")
    return rendered(table(spark, sf_dir, "conversations")).withColumn("masks", said)


OP2_SQL = """
WITH t AS (
  SELECT conv_id, coalesce(turn // 1024, -9223372036854775807) AS part, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id, turn // 1024 ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) - 1 AS rank
  FROM conversations
), b AS (
  SELECT conv_id, part, CAST(coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM (SELECT conv_id, part, (count(*) + 63) // 64 AS n FROM t GROUP BY ALL)
), p AS (
  SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'
), s AS (
  SELECT t.conv_id, perspective, before + rank // 64 AS chunk, rank, role = perspective AS own,
         '<|im_start|>' || CASE WHEN role = 'system' THEN 'system' WHEN role = perspective THEN 'assistant' ELSE 'user name=' || regexp_replace(replace(role, '<|', '< |'), '\\s', ' ', 'g') END || chr(10) AS head,
         replace(text, '<|', '< |') || '<|im_end|>' || chr(10) AS body
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id JOIN b ON t.conv_id IS NOT DISTINCT FROM b.conv_id AND t.part = b.part
), o AS (
  SELECT *, coalesce(sum(length(head) + length(body)) OVER (PARTITION BY conv_id, perspective, chunk ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS pos FROM s
)
SELECT conv_id, perspective, chunk, count(*) AS n_turns, count(*) FILTER (own) AS n_own, string_agg(head || body, '' ORDER BY rank) AS text,
       coalesce(string_agg(CAST(CAST(pos AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(pos AS BIGINT) + length(body) AS VARCHAR), ',' ORDER BY rank) FILTER (own), '') AS masks
FROM o GROUP BY conv_id, perspective, chunk
"""
