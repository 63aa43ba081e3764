import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from strandlake.llm import mixing


def test_every_prefix_is_within_one_block():
    random.seed(1)
    for _ in range(40):
        w = [random.randint(1, 40) for _ in range(random.randint(1, 9))]
        total, count = sum(w), [0] * len(w)
        at = {t: i for i, s in enumerate(mixing.period(w)) for t in s}
        assert sorted(at) == list(range(total))
        for t in range(total):
            count[at[t]] += 1
            assert all(abs(c - x * (t + 1) / total) < 1 for c, x in zip(count, w, strict=True))


def test_schedule_matches_plain_simulation():
    random.seed(2)
    for _ in range(30):
        w = [random.randint(1, 12) for _ in range(random.randint(1, 5))]
        blocks = [random.randint(0, 60) for _ in w]
        plan = mixing.Schedule(blocks, w)
        slots = sorted(int(s) for i, n in enumerate(blocks) for s in plan.slot(i, __import__("numpy").arange(n)))
        assert slots == list(range(sum(blocks))) and plan.length == sum(blocks)
        # until the first source runs out, less than one block from the target
        order = sorted((int(s), i) for i, n in enumerate(blocks) if n for s in plan.slot(i, __import__("numpy").arange(n)))
        live = [i for i, n in enumerate(blocks) if n]
        total, count = sum(w[i] for i in live), dict.fromkeys(live, 0)
        for t, (_, i) in enumerate(order):
            count[i] += 1
            assert all(abs(count[j] - w[j] * (t + 1) / total) < 1 for j in live)
            if any(count[j] == blocks[j] for j in live):
                break


def test_all_rows_are_placed(spark):
    rows = [(i, f"s{i % 3}" if i % 7 else None, "x") for i in range(700)] + [(5, "s2", "y"), (5, "s2", "y"), (None, "s1", None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, __rank string").withColumn("__N", F.lit(1))
    out = mixing.mixed(df, {"s0": 5, "s1": 3, "s2": 1}, block=4, rows=32)
    got = out.collect()
    assert len(got) == len(rows) and len({r.mix_position for r in got}) == len(rows)
    assert out.columns[: len(df.columns)] == df.columns
    by = {}
    for r in got:
        by.setdefault((r.mix_source, r.mix_slot), []).append(r)
    assert max(map(len, by.values())) <= 4 and len({s for _, s in by}) == len(by)
    head = [r.mix_source for r in sorted(got, key=lambda r: r.mix_position)[:160]]
    assert 70 < head.count("s0") < 100
    again = {(r.doc_id, r.mix_position) for r in mixing.mixed(df.repartition(7), {"s0": 5, "s1": 3, "s2": 1}, block=4, rows=16).collect()}
    assert again == {(r.doc_id, r.mix_position) for r in got}
    assert mixing.mixed(df.limit(0)).count() == 0
    assert mixing.mixed(out, {"s0": 5}, block=4).columns == out.columns
    with pytest.raises(ValueError):
        mixing.mixed(df, {"s0": 0})


def plain_slots(sizes, block):
    """Source of each slot: earliest deadline first among released blocks, in fractions, every block looked at in every slot."""
    names = sorted(sizes)
    weight = {s: Fraction(sizes[s] ** 0.5) for s in names}
    blocks = {s: -(-sizes[s] // block) for s in names}
    time = lambda v: sum(min(weight[s] * v, blocks[s]) for s in names)
    todo = {s: [(math.floor(time(k / weight[s])), math.ceil(time((k + 1) / weight[s]))) for k in range(blocks[s])] for s in names}
    out = []
    for t in range(sum(blocks.values())):
        _, s = min((x[0][1], s) for s, x in todo.items() if x and x[0][0] <= t)
        todo[s].pop(0)
        out.append(s)
    return out


def test_query_matches_plain_code(spark):
    """Every document's place in op8_mixing, from the table itself."""
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("doc_id", F.coalesce("source", F.lit("\x00null")).alias("source"), F.xxhash64(F.lit(11), F.col("doc_id").cast("string"), *docs.columns).alias("h")).collect()
    unsigned = lambda h: h % (1 << 64)
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append((unsigned(r.h), r.doc_id))
    slots, done, want = {}, dict.fromkeys(by, 0), {}
    for t, s in enumerate(plain_slots({s: len(v) for s, v in by.items()}, mixing.BLOCK)):
        slots[s, done[s]] = t
        done[s] += 1
    for s, v in by.items():
        for rank, (_, d) in enumerate(sorted(v)):
            want[d] = (s, rank // mixing.BLOCK, slots[s, rank // mixing.BLOCK], slots[s, rank // mixing.BLOCK] * mixing.BLOCK + rank % mixing.BLOCK)
    got = {r.doc_id: (r.mix_source, r.mix_block, r.mix_slot, r.mix_position) for r in mixing.op8_mixing(spark, sf).drop("text").collect()}
    assert got == want


def test_a_million_blocks_stay_within_one_of_the_given_weights():
    given = [0.7, 0.299999, 1e-6]
    w, n = [Fraction(x) for x in given], 1_000_000
    total, count = sum(w), [0, 0, 0]
    for t, i in enumerate(mixing.order([n] * 3, mixing.whole(given))):
        count[i] += 1
        if t % 997 == 0 or t > n - 2000:
            assert all(abs(c - x / total * (t + 1)) < 1 for c, x in zip(count, w, strict=True))
        if t == n:
            break


def test_each_of_many_sources_has_its_own_weight(spark):
    # more than 256 sources and blocks of two rows: each stays within one block of its share until the first runs out
    rows = [(i, f"s{i % 400:03}") for i in range(400 * 20)] + [(10_000 + i, f"t{i % 8}") for i in range(8 * 200)]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    got = mixing.mixed(df, block=2).collect()
    assert len(got) == len(rows) and len({r.mix_position for r in got}) == len(rows)
    assert {r.mix_source for r in got} == {s for _, s in rows}
    n = {f"s{i:03}": 20 for i in range(400)} | {f"t{i}": 200 for i in range(8)}
    total, count, size = sum(c**0.5 for c in n.values()), dict.fromkeys(n, 0), {s: c // 2 for s, c in n.items()}
    for t, (_, s) in enumerate(sorted({(r.mix_slot, r.mix_source) for r in got})):
        count[s] += 1
        assert all(abs(count[x] - n[x] ** 0.5 / total * (t + 1)) < 1 for x in n)
        if count[s] == size[s]:
            break


def test_given_weights_are_not_rounded():
    w = mixing.whole([0.00001, 1.0, 0.3])
    total, count = sum(w), [0, 0, 0]
    for t, i in enumerate(mixing.order([20_000] * 3, w)):
        count[i] += 1
        assert all(abs(c - x * (t + 1) / total) < 1 for c, x in zip(count, w, strict=True))
        if max(count) == 20_000:
            break


def test_shares_hold_after_sources_run_out():
    random.seed(4)
    for _ in range(20):
        w = [random.randint(1, 12) for _ in range(6)]
        n = [random.randint(1, 60) for _ in w]
        share = lambda v: [min(x * v, m) for x, m in zip(w, n, strict=True)]  # noqa: B023, E731
        count = [0] * 6
        for t, i in enumerate(mixing.order(n, w)):
            count[i] += 1
            lo, hi = 0.0, 100.0
            for _ in range(60):
                mid = (lo + hi) / 2
                lo, hi = (mid, hi) if sum(share(mid)) < t + 1 else (lo, mid)
            assert all(abs(c - s) < 1 + 1e-6 for c, s in zip(count, share(hi), strict=True))
        assert count == n
