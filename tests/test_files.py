"""Readers, the panel store and whole plans over files."""

import json
import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandlake.functions.assembly import chromosome_length
from strandlake.operators import calls, match, select, weights
from strandlake.operators import sites as site_ops
from strandlake.plans import cli, files
from strandlake.sources import files as side
from strandlake.sources import panel, vcf

HEAD = "##fileformat=VCFv4.2\n##contig=<ID=20,length=64444167>\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT"


def vcf_file(path, names, rows):
    path.write_text(HEAD + "".join(f"\t{n}" for n in names) + "\n" + "".join("\t".join(map(str, r)) + "\n" for r in rows))
    return str(path)


@pytest.fixture(scope="module")
def world(tmp_path_factory):
    """A panel of 30 samples at 40 sites made of 6 founders, and 3 targets typed at every second site."""
    d = tmp_path_factory.mktemp("world")
    rng = random.Random(8)
    founders = [[rng.randint(0, 1) for _ in range(40)] for _ in range(6)]

    def hap():
        a, b, cut = rng.randrange(6), rng.randrange(6), rng.randrange(40)
        return founders[a][:cut] + founders[b][cut:]

    people = [(hap(), hap()) for _ in range(33)]
    site = lambda i: ["20", 1000 + 50 * i, "." if i % 4 else "", "ACGT"[i % 4], "CGTA"[i % 4], ".", "PASS", ".", "GT"]
    rows = lambda some, at: [[*site(i), *(f"{a[i]}|{b[i]}" for a, b in some)] for i in at]
    full = vcf_file(d / "panel.vcf", [f"p{i}" for i in range(30)], rows(people[:30], range(40)))
    chip = vcf_file(d / "target.vcf", ["t0", "t1", "t2"], rows(people[30:], range(0, 40, 2)))
    truth = vcf_file(d / "truth.vcf", ["t0", "t1", "t2"], rows(people[30:], range(40)))
    (d / "map.txt").write_text("# a map\n20 . 0.0 900\n20 . 0.5 2000\n20 . 2.0 3100\n")
    return d, full, chip, truth, people


def test_prepare_impute_score(spark, world, capsys):
    d, full, chip, truth, people = world
    store = str(d / "store")
    cli.main(["prepare", "--vcf", full, "--panel", store, "--chunk-size", "16"])
    sites, alt, samples = panel.read(spark, store)
    assert sites.count() == 40 and samples.count() == 30 and sorted(r.chunk for r in alt.select("chunk").distinct().collect()) == [0, 1, 2]
    assert alt.count() == sum(map(sum, (h for p in people[:30] for h in p)))
    facts = json.loads(panel.metadata(spark, store).first().metadata)
    assert facts == {"chrom": "20", "n_variants": 40, "min_position": 1000, "max_position": 2950, "n_chunks": 3, "n_samples": 30, "n_haps": 60}
    assert tuple(vcf.file_stats(vcf.lines(spark, full)).first()) == ("20", 40, 2950, 64444167)
    files.prepare(spark, full, store)  # there already: nothing happens
    cli.main(["impute", "--panel", store, "--target", chip, "--map", str(d / "map.txt"), "--out", str(d / "out.txt")])
    name = capsys.readouterr().out.strip().splitlines()[-1]
    assert name == str(d / "out.vcf.gz")
    lines = [r.value for r in spark.read.text(name).collect()]
    body = sorted((x.split("\t") for x in lines if not x.startswith("#")), key=lambda f: int(f[1]))
    assert len(body) == 40 and any(x.startswith("##fileformat") for x in lines) and [x for x in lines if x.startswith("#CHROM")][0].endswith("t0\tt1\tt2")
    for i, f in enumerate(body):
        own = [f"{a[i]}|{b[i]}" for a, b in people[30:]]
        if i % 2 == 0:
            assert f[8] == "GT" and f[9:] == own and "IMP" not in f[7]
        else:
            assert f[8] == "GT:DS:AP1:AP2" and f[7].endswith(";IMP")
    variants, by_sample = files.score_files(spark, truth, name, str(d / "score"), chunk_size=10, phased=True)
    assert variants.count() == 40 and by_sample.count() == 3
    assert min(r.accuracy for r in by_sample.collect()) > 0.8
    assert spark.read.csv(str(d / "score_accuracy_variants.csv"), header=True).count() == 40
    some, _ = files.score_files(spark, truth, name, names=["t1"])
    assert {r.tp + r.tn + r.fp + r.fn for r in some.collect()} == {2}


def test_errors(spark, world, tmp_path):
    d, full, _, _, _ = world
    store = str(tmp_path / "store")
    files.prepare(spark, full, store)
    other = vcf_file(tmp_path / "o.vcf", ["x"], [["21", 5, ".", "A", "C", ".", "PASS", ".", "GT", "0|1"]])
    bare = vcf_file(tmp_path / "b.vcf", [], [])
    for target in (other, bare):
        with pytest.raises(ValueError):
            files.impute(spark, store, target, str(d / "map.txt"), str(tmp_path / "x"))


def test_vcf_reader(spark, tmp_path):
    rows = [
        ["20", 1, "a", "a", ".", ".", ".", ".", "GT", "0|0", "./."],
        ["20", 2, "b", "C", "g,ta", ".", ".", ".", "DP:GT", "3:1/2", "4:0|1"],
        ["20", 3, "c", "G", "T", ".", ".", ".", "GT", "1", "0"],
        ["20", 4, "d", "G", "T", ".", ".", ".", "DP", "1", "0"],
    ]
    text = vcf.lines(spark, vcf_file(tmp_path / "r.vcf", ["NA1", "NA2"], rows))
    assert [(r.sample_idx, r.sample_id) for r in vcf.samples(text).collect()] == [(0, "NA1"), (1, "NA2")]
    split = vcf.split_alleles(vcf.records(text))
    assert sorted((r.pos, r.ref, r.alt) for r in split.collect()) == [(1, "A", "."), (2, "C", "G"), (2, "C", "TA"), (3, "G", "T"), (4, "G", "T")]
    got = {(r.pos, r.alt, r.sample_idx, r.h): (r.allele, r.is_missing) for r in vcf.genotypes(split).collect()}
    assert got[1, ".", 1, 0] == (0, True) and got[2, "G", 0, 0] == (1, False) and got[2, "TA", 0, 1] == (1, False) and got[2, "TA", 1, 1] == (0, False)
    assert got[3, "T", 0, 0] == got[3, "T", 0, 1] == (1, False) and not any(k[0] == 4 for k in got)
    assert vcf.contig_line(text, "20") == "##contig=<ID=20,length=64444167>" and vcf.contig_line(text, "7") == "##contig=<ID=7>"
    mixed = vcf.lines(spark, vcf_file(tmp_path / "m.vcf", ["A", "B"], [["20", 1, ".", "A", "C", ".", ".", ".", "GT", "1", "0|1"]]))
    with pytest.raises(Exception, match="mixed ploidy"):
        vcf.genotypes(vcf.split_alleles(vcf.records(mixed))).collect()
    assert vcf.output_name("/x/a.b.txt") == "/x/a.b.vcf.gz" and vcf.output_name("a.vcf.gz") == "a.vcf.gz"


def test_side_files(spark, tmp_path):
    (tmp_path / "s").write_text("ID_1 ID_2\n0 0\nann POP:x\nbob\n")
    assert [(r.sample_idx, r.sample_id) for r in side.sample_list(spark, str(tmp_path / "s")).collect()] == [(0, "ann"), (1, "bob")]
    (tmp_path / "f").write_text("1\n0\nx\n1\n")
    assert [r.keep for r in side.site_filter(spark, str(tmp_path / "f"), 4).orderBy("site").collect()] == [1, 0, 0, 1]
    with pytest.raises(ValueError):
        side.site_filter(spark, str(tmp_path / "f"), 5)
    (tmp_path / "t").write_text("20\t5\ta\tc\n")
    assert tuple(side.site_list(spark, str(tmp_path / "t")).first()) == ("20", 5, "A", "C")


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 6), st.integers(1, 14), st.integers(1, 4), st.integers(0, 10**6))
def test_run_lengths_match_plain_code(haps, n, least, seed):
    rng = np.random.default_rng(seed)
    p, t = rng.integers(0, 2, (haps, n)), rng.integers(0, 2, n)
    want = []
    for h in range(haps):
        start = 0
        for k in range(n):
            if k == n - 1 or p[h, k] != t[k]:
                if k - start >= least:
                    want.append((h, start, k - start))
                start = k + 1
    assert sorted(zip(*(x.tolist() for x in match.run_lengths(p, t, least)), strict=True)) == sorted(want)


def test_blocks_give_the_same_runs(spark):
    rng = random.Random(3)
    bits = lambda n: [(i, "".join(rng.choice("01") for _ in range(30))) for i in range(n)]
    p, t = spark.createDataFrame(bits(20), "hap int, bits string"), spark.createDataFrame(bits(7), "hap int, bits string")
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(match.runs(p, t, 4, block_bytes=60)) == key(match.runs(p, t, 4)) == key(match.runs(p, t, 4, parts=1)) != []
    assert match.runs(p, t.limit(0)).count() == 0


def test_gap_rules(spark):
    rows = [(0, 5, 3, 4), (0, 6, 9, 2), (0, 7, 4, 3)]  # sites 3-6 and 9-10 of 14
    df = spark.createDataFrame(rows, "target_hap int, ref_hap int, start int, len int")
    got = {r.ref_hap: (r.low, r.high, r.added) for r in select.coverage(df, 14).collect()}
    assert got == {5: (0, 8, 5), 6: (9, 13, 3), 7: (4, 8, 2)}
    assert sorted(r.n for r in select.missing_sites(select.coverage(df, 14), 14).collect()) == [0, 1, 2, 7, 8, 11, 12, 13]


def test_fallback_keeps_a_site_whole(spark):
    rows = spark.createDataFrame([(0, 1, 5), (0, 1, 6), (0, 2, 7), (0, 2, 8)], "target_hap int, n int, ref_hap int")
    kept = spark.createDataFrame([(0, 6)], "target_hap int, ref_hap int")
    assert sorted((r.n, r.ref_hap) for r in select.restricted(rows, kept).collect()) == [(1, 6), (2, 7), (2, 8)]


def test_weights_sum_to_one_and_bear_no_error():
    rng = np.random.default_rng(1)
    m = rng.random((12, 9)) < 0.5
    m[:, 0] = True
    for error in (0.0, 0.01):
        w, pruned = weights.combined(*weights.passes(m, rng.random(12), rng.random(12), error), m)
        assert np.allclose(w.sum(axis=1), 1) and (pruned <= w).all() and ((pruned == 0) | (pruned >= 1 / 10)).all()


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 30), st.integers(1, 7), st.integers(1, 9), st.integers(0, 10**6))
def test_blocked_passes_equal_dense_ones(n, haps, block, seed):
    rng = np.random.default_rng(seed)
    m = rng.random((n, haps)) < 0.5
    m[:, 0] = True
    before, after, error = rng.random(n), rng.random(n), float(rng.choice([0.0, 0.01, 0.2]))
    _, stays = weights.combined(*weights.passes(m, before, after, error), m)
    site, col = np.nonzero(m)
    got = np.zeros_like(stays)
    row, at, w = weights.blocked(site, col, n, haps, before, after, error, block)
    got[row, at] = w
    assert np.allclose(got, stays, atol=1e-12) and len(w) == np.count_nonzero(stays)


def test_ranks_by_ranges(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), rng.randint(0, 500), rng.choice("ACGT")) for _ in range(300)]
    got = site_ops.dense(spark.createDataFrame(rows, "chrom string, pos long, ref string"), "pos", "ref", width=64).collect()
    for c in "ab":
        mine = sorted((r.pos, r.ref, r.n) for r in got if r.chrom == c)
        assert [(p, x) for p, x, _ in mine] == sorted((p, x) for q, p, x in rows if q == c) and sorted(n for *_, n in mine) == list(range(len(mine)))


def test_store_reads_only_the_chunks_of_a_slice(spark, world, tmp_path):
    _, full, *_ = world
    files.prepare(spark, full, str(tmp_path / "s"), 8)
    _, alt, _ = panel.read(spark, str(tmp_path / "s"))
    some = site_ops.rows_between(alt, 9, 20, 2, 8)
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, site_ops.rows_between(alt, 9, 20, 2).collect())) != []
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "chunk" in plan.split("PartitionFilters")[1][:120]
    assert len(some.inputFiles()) <= len(alt.inputFiles()) and site_ops.rows_at(alt, 17, 8).select("chunk").distinct().first().chunk == 2
    uneven = spark.createDataFrame([("1", 5, "A", "C", 0, 0, 1), ("1", 5, "A", "C", 0, 1, 1), ("1", 6, "A", "C", 0, 0, 1)], "chrom string, pos long, ref string, alt string, sample_idx int, h int, allele int")
    with pytest.raises(ValueError, match="haplotypes"):
        panel.prepare(uneven.select("chrom", "pos", "ref", "alt").distinct(), uneven)


def test_matcher_commands(spark, world, tmp_path, capsys):
    d, full, chip, truth, people = world
    (tmp_path / "list").write_text("20\t1000\tA\tC\n20\t1100\tg\tt\n20\t9\tA\tC\n")
    (tmp_path / "names").write_text("p7\np3\n")
    cli.main(["filter-sites", "--vcf", full, "--sites", str(tmp_path / "list"), "--out", str(tmp_path / "f.vcf.gz")])
    cli.main(["select-samples", "--vcf", full, "--samples", str(tmp_path / "names"), "--out", str(tmp_path / "n.vcf.gz")])
    cli.main(["stats", "--vcf", full])
    said = capsys.readouterr().out.strip().splitlines()
    assert json.loads(said[-1]) == {"chrom": "20", "n_records": 40, "last_pos": 2950, "length": 64444167}
    kept = vcf.records(vcf.lines(spark, str(tmp_path / "f.vcf.gz"))).collect()
    assert [(r.pos, len(r.fields)) for r in kept] == [(1000, 30), (1100, 30)]
    text = vcf.lines(spark, str(tmp_path / "n.vcf.gz"))
    assert [r.sample_id for r in vcf.samples(text).orderBy("sample_idx").collect()] == ["p7", "p3"]
    assert {r.pos: list(r.fields) for r in vcf.records(text).collect()}[1050] == [f"{people[k][0][1]}|{people[k][1][1]}" for k in (7, 3)]
    cli.main(["prepare", "--vcf", full, "--panel", str(tmp_path / "p")])
    cli.main(["match", "--panel", str(tmp_path / "p"), "--target", chip, "--map", str(d / "map.txt"), "--out", str(tmp_path / "m")])
    assert spark.read.parquet(str(tmp_path / "m")).count() > 0
    part, _ = files.score_files(spark, truth, full.replace("panel.vcf", "truth.vcf"), region=("20", 1100, 1200))
    assert part.count() == 3


def test_assembly():
    assert chromosome_length("chr20") == 64444167 and chromosome_length("X") == 156040895 and chromosome_length("GL1") is None and chromosome_length("chrM") == chromosome_length("MT") == 16569


def test_slices_and_counts(spark):
    df = spark.createDataFrame([(h, s, (h + s) % 2) for h in range(4) for s in range(10)], "hap int, site long, allele int")
    at = lambda d: sorted({r.site for r in d.collect()})
    for s in (slice(None, 7), slice(2, None, 3), slice(8, 1, -2), slice(3, 3)):
        assert at(site_ops.rows_between(df, s.start, s.stop, s.step or 1)) == sorted(range(10)[s])
    probs = spark.createDataFrame([(0, 0, 0.5), (0, 1, 0.51), (0, 2, 1.0), (0, 3, 0.0)], "site long, target_hap int, p double")
    c = calls.calls(probs)
    assert {(r.sample_idx, r.gt1, r.gt2, r.ds) for r in c.collect()} == {(0, 0, 1, 1.01), (1, 1, 0, 1.0)}
    assert tuple(calls.allele_counts(c).first()) == (0, 2, 4, 0.5)


def test_best_runs_equal_the_ranking_of_all_runs(spark):
    """Ties, copies, runs longer than a word of sites, and panels of one block and of several."""
    key = lambda df: sorted(map(tuple, df.collect()))
    for seed, (n, least, flip) in enumerate([(31, 4, 0.5), (200, 70, 0.01)]):
        rng = random.Random(seed)
        base = [rng.choice("01") for _ in range(n)]
        some = lambda count, odd: [(2 * i + odd, "".join("10"[int(c)] if rng.random() < flip else c for c in base)) for i in range(count)]
        rows = some(30, 0)
        rows += [(1001 + i, x) for i, (_, x) in enumerate(rows[:10])]
        p, t = spark.createDataFrame(rows, "hap int, bits string"), spark.createDataFrame(some(8, 1), "hap int, bits string")
        table = np.array([[int(c) for c in x] for _, x in rows])
        found = []
        for hap, x in t.collect():
            row, start, length = match.run_lengths(table, np.array([int(c) for c in x]), least)
            found += [(hap, rows[r][0], s, k) for r, s, k in zip(row.tolist(), start.tolist(), length.tolist(), strict=True)]
        assert key(match.runs(p, t, least)) == sorted(found) != []
        forward = match.best_forward(spark.createDataFrame(found, "target_hap int, ref_hap int, start int, len int"), p, t, 4)
        for size in (match.BLOCK_BYTES, 700):
            assert key(match.top_forward(p, t, least, 4, size)) == key(forward) != []
            assert key(match.top_backward(p, t, least, 4, 2, size)) == key(match.best_backward(forward, 2)) != []


def test_best_runs_leave_most_of_a_large_panel_unmade():
    """Of 4,096 haplotypes few more runs are looked at than are kept."""
    rng = np.random.default_rng(0)
    words = lambda count, fill: np.packbits(np.c_[rng.integers(0, 2, (count, 40)), np.full((count, 24), fill)], axis=1).view(">u8").T.astype(np.uint64)
    block = match.Block(np.arange(4096), words(4096, 1), np.arange(8), words(8, 0), 40, 5)
    every = sum(len(f.of) for f in block.met(10, slice(0, 8)))
    looked = sum(len(f.of) for f in block.met(10, slice(0, 8), 10))
    assert 8 * 10 <= looked < 8 * 45 < every


def test_genotypes_take_time_by_samples_not_by_their_square(spark):
    """A record's line is split a bounded number of times, however many samples it has."""
    n, k = 3000, 12
    line = ["20", "5", "x", "A", "C", ".", "PASS", ".", "DP:GT", *["7:0|1", "7:1/1", "7:.|0"] * (n // 3)]
    text = spark.createDataFrame([("\t".join(line),)] * k, "value string")
    start = time.time()
    got = {(r.sample_idx % 3, r.h, r.allele, r.is_missing): r.n for r in vcf.genotypes(vcf.split_alleles(vcf.records(text))).groupBy((F.col("sample_idx") % 3).alias("sample_idx"), "h", "allele", "is_missing").agg(F.count("*").alias("n")).collect()}
    assert got == {(0, 0, 0, False): 12000, (0, 1, 1, False): 12000, (1, 0, 1, False): 12000, (1, 1, 1, False): 12000, (2, 0, 0, True): 12000, (2, 1, 0, False): 12000}
    assert time.time() - start < 30  # by the square it took minutes


def test_tables_that_grow_are_not_broadcast(spark):
    """However small they are: on 0.1 GB they were small enough to be broadcast and too large for the driver."""
    rows = spark.createDataFrame([(t, r, s, 5) for t in (0, 1) for r in range(4) for s in range(0, 12, 6)], "target_hap int, ref_hap int, start int, len int")
    chosen, cut = select.selected(rows, 12, 9)
    rates = spark.createDataFrame([(n, 0.1, 0.1) for n in range(12)], "n int, before double, after double")
    for df in (chosen, weights.pruned(chosen, F.broadcast(rates), cut, 12)):
        assert df.count()
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join ") - plan.count("rightHint=(strategy=merge)") == plan.count("rightHint=(strategy=broadcast)")
