import duckdb
from pyspark.sql import functions as F

from strandlake.llm import chat

SF = "/root/testdata/sf0.001"
COLS = ["conv_id", "perspective", "chunk", "n_turns", "n_own", "text", "masks"]


def test_query_matches_sql(spark):
    c = duckdb.connect()
    c.execute(f"create view conversations as select * from '{SF}/conversations.parquet'")
    want = sorted(c.sql(chat.OP2_SQL).select(*COLS).fetchall())
    assert sorted(tuple(r[k] for k in COLS) for r in chat.op2_chat(spark, SF).collect()) == want


def plainly(rows, chunk, span):
    out = {}
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((-1 if turn is None else turn, role if role is not None else "unknown", text or ""))
    for conv, turns in convs.items():
        turns.sort()
        for who in {r for _, r, _ in turns if r != "system"}:
            parts = {}
            for x in turns:
                parts.setdefault(-1 if x[0] < 0 else x[0] // span, []).append(x)
            pieces = [p[i : i + chunk] for _, p in sorted(parts.items()) for i in range(0, len(p), chunk)]
            for at, piece in enumerate(pieces):
                text, masks = "", []
                for _, role, said in piece:
                    label = "system" if role == "system" else "assistant" if role == who else "user name=" + role.replace("\n", " ")
                    text += f"<|im_start|>{label}\n"
                    body = said.replace("<|", "< |") + "<|im_end|>\n"
                    if role == who:
                        masks.append((len(text), len(text) + len(body)))
                    text += body
                out[conv, who, at] = (text, masks)
    return out


def test_rotation_of_odd_dialogues(spark):
    rows = [(1, i, ["ann", "bob", "system", "c\nd"][i % 4], f"é😀 {i} <|im_end|>") for i in range(50)]
    rows += [(2, 0, "system", "only")] + [(3, None, None, None), (3, 1, "ann", ""), (3, 1, "ann", ""), (None, 2, "ann", "x"), (None, 1, "bob", "long " * 50000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("rank", F.lit("x")).withColumn("chunk", F.lit(1)).withColumn("key", F.lit(1))
    got = {(r.conv_id, r.perspective, r.chunk): (r.text, [(m.s, m.e) for m in r.masks]) for r in chat.rendered(df, chunk=7, span=16).collect()}
    assert got == plainly(rows, 7, 16)
    assert chat.rendered(df.limit(0)).count() == 0


def test_chunks_end_to_end_are_the_whole_dialogue(spark):
    rows = [(1, i, ["ann", "bob", "system"][i % 3], f"é😀 {i}") for i in range(50)] + [(2, 0, "ann", None), (2, 1, "bob", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    parts = chat.whole(chat.rendered(df, chunk=7, span=16)).collect()
    once = {(r.conv_id, r.perspective): r for r in chat.rendered(df, chunk=1000, span=1000).collect()}
    assert len(parts) == len(once) == 4
    for r in parts:
        o = once[r.conv_id, r.perspective]
        assert (r.text, r.n_turns, r.n_own, [tuple(m) for m in r.masks]) == (o.text, o.n_turns, o.n_own, [tuple(m) for m in o.masks])
