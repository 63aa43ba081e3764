import random

import corpus_pipeline as cp
import pytest
from pyspark.sql import functions as F

from strandlake.llm import near


def slow_shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def slow_groups(rows):
    """{doc_id: smallest doc_id it reaches} by all pairs of similarity 0.8 or more."""
    sets = [(d, slow_shingles(t)) for d, t in rows]
    root = {d: d for d, _ in rows}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[i + 1 :]:
            if 5 * len(s & t) >= 4 * len(s | t):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {d: top(d) for d, _ in rows}


def planted():
    random.seed(11)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for g in range(40):
        text = [random.choice(words) for _ in range(random.randint(20, 200))]
        rows.append(" ".join(text))
        for _ in range(3):  # the more places changed the smaller the similarity: both sides of 0.8 are met
            copy = list(text)
            for _ in range(random.randint(1, max(1, len(text) // 25))):
                copy[random.randrange(len(copy))] = "other"
            rows.append(" ".join(copy))
        rows.append(" ".join(text[: int(len(text) * random.uniform(0.7, 1))]).upper())
    shared = " ".join(random.choice(words) for _ in range(30))  # a passage of many texts, which makes none alike
    rows += [shared + " " + " ".join(random.choice(words) for _ in range(40)) for _ in range(60)]
    rows += ["a b c", "A b  c", "", None, " \n"]
    random.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("chunk", "sample"), [(near.CHUNK, near.SAMPLE), (16, 50)])
def test_planted_near_copies(spark, chunk, sample):
    rows = planted()
    want = slow_groups(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near.groups(df, chunk=chunk, sample=sample).collect()} == want


def test_stage_keeps_one_of_each_group(spark):
    rows = planted()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in cp.simhash_stage(spark, df, "").collect()) == sorted(d for d, r in slow_groups(rows).items() if d == r)


def test_table_without_rows_and_repeated_ids(spark):
    df = spark.createDataFrame([(7, "a b"), (7, "a b"), (None, "a b"), (3, "c")], "doc_id long, text string")
    assert sorted(((r.doc_id or 0, r.component_id) for r in near.groups(df).collect())) == [(0, 7), (3, 3), (7, 7), (7, 7)]
    assert near.groups(df.limit(0)).collect() == []


@pytest.mark.parametrize("chunk", [near.CHUNK, 16])
def test_what_a_large_group_makes_follows_its_rows(spark, monkeypatch, chunk):
    """Copies that are all alike, but whose fingerprints are not, give no pairs of each with each, neither as candidates nor as links."""
    random.seed(3)
    text = [f"w{random.randrange(5000)}" for _ in range(400)]
    rows = []
    for i in range(200):
        copy = list(text)
        for _ in range(4):
            copy[random.randrange(len(copy))] = f"x{random.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    rows += [(1000 + i, " ".join(f"w{random.randrange(5000)}" for _ in range(100))) for i in range(20)]
    sizes = {}

    def counted(df, label, real=near.written):
        out = real(df, label)
        sizes[label] = sizes.get(label, 0) + out.count()
        return out

    monkeypatch.setattr(near, "written", counted)
    got = {r.doc_id: r.component_id for r in near.groups(spark.createDataFrame(rows, "doc_id long, text string"), chunk=chunk).collect()}
    assert got == slow_groups(rows) and set(got.values()) == {0, *range(1000, 1020)}
    assert max(sizes["near-pairs"], sizes["near-links"]) <= 8 * len(rows)  # four tables of fingerprints, then at most a row for each of a task's


def test_rows_of_different_roots_meet_and_rows_of_one_root_are_not_dealt(spark):
    random.seed(4)
    rows = [(g, i, 100 * g + min(i % 40, r), 1) for g, r, k in ((1, 39, 90), (2, 2, 300), (3, 0, 500)) for i in range(k)]
    rows += [(2, 1000 + i, 299, 1) for i in range(400)]
    df = spark.createDataFrame(rows, "key long, node long, root long, n long")
    met, dealt = set(), near.dealt(df, "key", lambda c, w: F.ceil(c / 16).cast("int")).collect()
    tasks = {}
    for r in dealt:
        tasks.setdefault(r.task, []).append(r)
    for rs in tasks.values():
        assert len(rs) <= 100
        met |= {(a.node, b.node) for a in rs for b in rs if a.key == b.key and a.root < b.root}
    assert not any(r.key == 3 for r in dealt)
    assert met == {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[2] < b[2]}
