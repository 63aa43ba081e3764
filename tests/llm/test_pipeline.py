import json

import corpus_pipeline as cp
import pytest
from pyspark.sql import functions as F

from strandlake.llm import mixing, packing, quality, secrets

from .test_packing import OWN
from .test_near import slow_groups

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def between(spark):
    """What lies after each stage."""
    out = [spark.read.parquet(f"{SF}/documents.parquet").cache()]
    for _, stage in cp.STAGES:
        out.append(stage(spark, out[-1], SF).cache())
    return out


def test_stages_in_order():
    assert [n for n, _ in cp.STAGES] == ["quality classifier", "simhash near-dedup", "secret scans", "mixing sources to target weights", "best-fit packing"]
    assert cp.ORACLE_SQL is None


def test_each_stage_does_its_work(spark, between):
    docs, good, unique, clean, mixed, packed = between
    assert all(d.columns == docs.columns for d in (good, unique, clean, mixed))
    score = {r.doc_id: r.keep for r in quality.scored(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    kept = {r.doc_id: r.text for r in good.collect()}
    assert set(kept) == {d for d, k in score.items() if k} and len(kept) < docs.count()
    roots = slow_groups(list(kept.items()))
    left = {r.doc_id: r.text for r in unique.collect()}
    assert set(left) == {d for d, r in roots.items() if d == r}
    told = {r.doc_id: [(j.s, j.e) for j in sorted(r.judged) if j["class"] == "live"] for r in secrets.secrets(unique).collect()}
    for r in clean.collect():
        want, at = "", 0
        for s, e in told[r.doc_id]:
            if s >= at:
                want += left[r.doc_id][at:s] + "[SECRET]"
            at = max(at, e)
        assert r.text == want + left[r.doc_id][at:] and r.n_chars == len(r.text)
    place = {r.doc_id: r.mix_position for r in mixing.mixed(clean).collect()}
    assert place == {r.doc_id: r.mix_position for r in mixing.mixed(mixed).collect()}  # made again from the same rows
    order = [r.doc_id for r in mixed.collect()]
    assert order == sorted(place, key=place.get) and len(order) == unique.count()
    rows = packed.collect()
    assert {r.doc_id for r in rows} == set(order)
    texts = {r.doc_id: r.text for r in mixed.collect()}
    assert sum(r.length for r in rows) == sum(len(OWN.encode(t, add_special_tokens=False).ids) + 1 for t in texts.values())
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    assert max(r.offset + r.length for r in rows) <= packing.CAPACITY


def test_run_gives_the_same_rows(spark, between):
    key = lambda r: json.dumps([r.doc_id, r.piece, r.start, r.length, r.ids_crc32])
    assert sorted(map(key, cp.run(spark, SF).collect())) == sorted(map(key, between[-1].collect()))


def test_sequences_follow_the_mixture(spark, monkeypatch):
    """Whatever share of the sequences is read first, each source has its share of their documents, to a block or two at either end of a range."""
    monkeypatch.setattr(packing, "NODE", 500)
    monkeypatch.setattr(packing.pack, "__defaults__", (packing.CAPACITY, 500, *packing.pack.__defaults__[2:]))
    n = {"a": 3200, "b": 800, "c": 200}
    rows = [(i, "w " * (i % 300), "en", s, 0) for i, s in enumerate(s for s, k in n.items() for _ in range(k))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    source, place = {r[0]: r[3] for r in rows}, {r.doc_id: r.mix_position for r in mixing.mixed(docs).collect()}
    out = cp.packing_stage(spark, cp.mixing_stage(spark, docs, ""), "").collect()
    order = [r.doc_id for r in sorted(out, key=lambda r: (r.sequence_id, r.offset))]
    by_place = sorted(place, key=place.get)
    for k in range(500, len(order), 500):
        for s in n:
            assert abs(sum(source[d] == s for d in order[:k]) - sum(source[d] == s for d in by_place[:k])) <= 2 * mixing.BLOCK


def test_rows_that_differ_in_nulls_stay_apart(spark):
    rows = [(1, "same text here", "x", None, 3), (1, "same text here", None, "x", 3), (1, "same text here", None, "x", 3), (2, "quite another", "en", "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(map(str, map(tuple, cp.simhash_stage(spark, docs, "").collect()))) == sorted(map(str, {*rows}))


def test_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    odd = spark.createDataFrame([(900, None, None, None, None), (900, None, None, None, None), (901, "", "en", "s", 0), (None, "null id", "en", "s", 7), (902, "long word " * 200_000, "en", "s", 0), (903, "a<|endoftext|>b token=Zq8Lm2Xw9Rt5", None, None, 5)], docs.schema)
    df = docs.unionByName(odd).withColumns({c: F.lit(1) for c in ("__id", "extra", "__at", "__row", "__cut", "__hash", "__bin", "place", "h", "mix_slot")})
    for rows in (df, df.limit(0)):
        for _, stage in cp.STAGES:
            columns, rows = rows.columns, stage(spark, rows, SF)
            assert stage is cp.packing_stage or rows.columns == columns
        assert rows.count() >= 0
    got = cp.simhash_stage(spark, odd, SF).collect()
    assert [r.doc_id for r in got if r.doc_id == 900] == [900] and not any(r.doc_id == 901 for r in got)
