import random

import xxhash

from strandlake.llm import simhash


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            if word:
                words.append(word)
            word = ""
        else:
            word += c
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def slow_components(items):
    root = {d: d for d, _ in items}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, fa) in enumerate(items):
        for b, fb in items[i + 1 :]:
            if (fa ^ fb).bit_count() <= 3:
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {d: top(d) for d, _ in items}


def test_fingerprint_matches_plain_code():
    random.seed(3)
    for n in (0, 1, 2, 3, 4, 50, 400):
        text = " ".join(random.choice(["Ab", "É", "ǅ", "x y", "the", "K"]) + str(random.randrange(9)) for _ in range(n)) + "\t\n"
        assert simhash.fingerprint(text) == slow_fingerprint(text)
    assert simhash.fingerprint(None) == 0


def test_links_and_components_match_brute_force(spark):
    random.seed(5)
    base = [random.getrandbits(64) for _ in range(60)] + [0, (1 << 64) - 1]
    fps = set(base)
    for b in base[:25]:
        x = b
        for _ in range(6):
            for _ in range(random.randrange(1, 5)):
                x ^= 1 << random.randrange(64)
            fps.add(x)
    x = random.getrandbits(64)
    for _ in range(300):  # a large group of distinct near copies, cut into chunks
        fps.add(x ^ 1 << random.randrange(64) ^ 1 << random.randrange(64))
    items = sorted(fps)
    want = slow_components([(f - (1 << 64) if f >> 63 else f, f) for f in items])
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in items], "fp long")
    for blocks in (4, 5):
        got = {r.node: r.root for r in simhash.components(simhash.links(df, chunk=64, blocks=blocks)).collect()}
        assert {k: got.get(k, k) for k in want} == want


def test_groups_edge_cases(spark):
    rows = [(5, None, "a"), (3, "", "b"), (9, "one two three four five", None), (9, "one two three four five", None), (4, "ONE two\tthree four  five", "x"), (8, "w " * 70000, "y")]
    got = sorted((r.doc_id, r.component_id) for r in simhash.groups(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect())
    assert got == [(3, 3), (4, 4), (5, 3), (8, 8), (9, 4), (9, 4)]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.groups(empty).collect() == []


def test_query_matches_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    items = [(r.doc_id, slow_fingerprint(r.text)) for r in docs]
    want = slow_components(items)
    got = simhash.op10_simhash(spark, "/root/testdata/sf0.001").collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(d, f"{f:016x}", want[d]) for d, f in items}
