import random

import pytest
import xxhash
from strandlake.llm import repeats
from strandlake.llm.repeats import LAST, LEAST, RUN, WINDOW, Units

LONG = "This passage of rather more than sixteen words repeats in many documents of this small fixture, truly and always."
SHORT = "So it goes."


def plain_units(text):
    """(first word, end) of lines and runs; borders are taken from the operator, all else is plain."""
    u = Units([text])
    return list(zip(u.a.tolist(), u.b.tolist(), strict=True))


def brute(rows, least):
    """Earliest holder of every unit by its words themselves, then what goes from each row."""
    held, first = [], {}
    for doc, text in rows:
        words = (text or "").lower().split()
        units = [(a, b, tuple(words[a:b])) for a, b in plain_units(text or "")]
        held.append(units)
        for *_, w in units:
            first[w] = min(first.get(w, LAST), LAST if doc is None else doc)
    out = []
    for (doc, text), units in zip(rows, held, strict=True):
        last, gone = {}, []
        for a, b, w in sorted(units):
            if first[w] < (LAST if doc is None else doc) or (w in last and last[w] <= a):
                gone.append((a, b))
            if w not in last or last[w] <= a:
                last[w] = b
        # words of stretches of repeated units end to end
        cuts = []
        for a, b in sorted(gone):
            if cuts and a <= cuts[-1][1]:
                cuts[-1] = [cuts[-1][0], max(b, cuts[-1][1]), cuts[-1][2] + 1]
            else:
                cuts.append([a, b, 1])
        cuts = [c for c in cuts if c[1] - c[0] >= least]
        spans = repeats.char_spans(text, [x for a, b, _ in cuts for x in (a, b)]) if cuts else []
        keep, at = "", 0
        for s, e in [*spans, (len(text or ""), len(text or ""))]:
            keep += (text or "")[at:s]
            at = e
        out.append((doc, None if text is None else keep, spans, sum(c[2] for c in cuts)))
    return sorted(out, key=str)


def got(df, **kw):
    return sorted(((r.doc_id, r.text, [(x.s, x.e) for x in r.removed], r.units) for r in repeats.without_repeats(df, **kw).collect()), key=str)


def test_digests_are_of_the_words_alone():
    a, b = Units([f"x\n{LONG}"]), Units(["other words first", f"  {LONG.upper().replace(' ', chr(9))}\n\ny"])
    i = a.a.tolist().index(1)
    j = next(k for k in range(len(b.a)) if (b.doc[k], b.a[k], b.b[k]) == (1, 0, a.b[i] - 1))
    assert (a.d0[i], a.d1[i]) == (b.d0[j], b.d1[j])


def test_borders_are_those_of_plain_code():
    random.seed(5)
    text = " ".join(random.choice(["ab", "cd.", "ef", "gh", "ij", "kl!"]) for _ in range(300)) + "\n" + " ".join(words(80))
    low = text.lower().split()
    lines = [len(x.split()) for x in text.split("\n")]
    ends = {lines[0], len(low)} | {i + 1 for i, w in enumerate(low) if w[-1] in ".!?"}
    starts = {0, lines[0]} | ends
    h = {w: int.from_bytes(xxhash.xxh3_128_digest(w.encode())[:8], "little") for w in low}
    m = (1 << 64) - 1

    def mix(x):
        x = (x ^ x >> 32) * int(repeats.M2) & m
        return x ^ x >> 29

    value = [(i not in starts, mix((h[w] * int(repeats.M1) + (h[low[i + 1]] if i + 1 < len(low) else 0)) & m) >> 1) for i, w in enumerate(low)]
    borders = {min(range(i, i + WINDOW), key=lambda k: (value[k], k)) for i in range(len(low) - WINDOW + 1)}
    borders = {i for i in borders if not i or value[i] != value[i - 1]}
    runs = set()
    for a in borders:
        stop = [e for e in range(a + RUN, len(low) + 1) if e in borders or e in ends]
        runs |= {(a, stop[0])} if stop else set()
    assert set(plain_units(text)) == runs | {(0, lines[0]), (lines[0], len(low))}


def test_passage_is_cut_wherever_it_stands(spark):
    a, b, c = f"Alpha one.\n{LONG} {SHORT}\nBeta", f"Alpha two\n{LONG} {SHORT}", f"{LONG.upper()} {SHORT}\nrest é😀 {SHORT}"
    rows = [(2, b), (1, a), (3, c), (4, f"{LONG}\n{LONG}"), (None, LONG), (5, None), (6, ""), (7, f"{SHORT}\nown"), (8, f"{SHORT}\nother")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as th", "text as gone", "2 as span")
    found = {r.doc_id: r for r in repeats.without_repeats(df).collect()}
    assert found[1].text == a and found[2].text == "Alpha two\n" and found[3].text == f"rest é😀 {SHORT}"
    assert found[4].text == f"{LONG}\n" and found[None].text == "" and found[5].text is None and found[6].text == ""
    assert found[8].text == f"{SHORT}\nother" and found[8].units == 0  # a short repeated line alone stays
    assert "".join(c[x.s : x.e] for x in found[3].kept) == found[3].text


@pytest.mark.parametrize("held", [repeats.HELD, 3000, 1])
def test_matches_brute_force(spark, held):
    random.seed(7)
    pool = [" ".join(random.choice("abcdefgXY") * random.randint(1, 3) for _ in range(random.randint(1, 9))) + random.choice([".", "!", ""]) for _ in range(40)]
    rows = [(i if i % 9 else None, random.choice(["\n", " "]).join(random.choice(pool) for _ in range(random.randint(0, 30)))) for i in range(120)]
    rows += [rows[3], (500, "w " * 60000 + ". " + pool[0]), (501, " ".join(pool)), (501, "\n".join(pool)), (502, "a b " * 200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df, least=4, held=held) == brute(rows, 4)


def test_table_without_rows(spark):
    assert repeats.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_matches_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    want = {d: (n, ",".join(f"{s}:{e}" for s, e in cuts), len(t or "")) for d, t, cuts, n in brute(docs, LEAST)}
    rows = repeats.op9_repeats(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: (r.units, r.removed, r.kept_chars) for r in rows} == want and len(rows) == len(docs)


def words(n):
    return [random.choice("bcdfglmnprst") + random.choice("aeiou") + random.choice("bdklmnrst") + str(random.randrange(50)) for _ in range(n)]


def test_passages_of_fifty_words_are_found_wherever_they_stand(spark):
    random.seed(13)
    own = lambda: " ".join(words(12))
    rows, passages = [], []
    for i in range(60):
        w = words(random.randint(50, 90))
        short = [" ".join(w[k : k + 7]) for k in range(0, len(w), 7)]
        passage = ["\n".join(short), ". ".join(short) + ".", " ".join(w)][i % 3]  # short lines, short sentences, one sentence without a capital
        hosts = [f"{own()}.\n{passage}\n{own()}.", f"{own()} {passage} {own()}.", f"Short own one. {passage} and {own()}. Then so."]
        random.shuffle(hosts)
        rows += [(10 * i + k, t) for k, t in enumerate(hosts)]
        passages.append(set(w))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in repeats.without_repeats(df).collect()}
    stayed = total = 0
    for i, mine in enumerate(passages):
        assert got[10 * i].text == rows[3 * i][1]
        for k in (1, 2):
            r, text = got[10 * i + k], rows[3 * i + k][1]
            stays = [x for x in r.text.split() if x.lower().strip(".") in mine]
            assert r.removed and len(stays) <= len(mine) - RUN
            stayed, total = stayed + len(stays), total + len(mine)
            gone = [x for s in r.removed for x in text[s.s : s.e].split()]
            assert all(x.strip(".") in mine for x in gone)  # nothing of the host's own goes
    print(f"{stayed / total:.2f} of the passages' words stay")


def test_a_word_over_and_over_keeps_its_first_run(spark):
    df = spark.createDataFrame([(1, "w " * 200)], "doc_id long, text string")
    assert len(repeats.without_repeats(df).first().text.split()) >= RUN
