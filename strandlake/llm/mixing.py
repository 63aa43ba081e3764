"""Mixing sources to target weights by Pfair scheduling.

Each source is a task of weight w. Were rows divisible, all sources that have not run out would be
served at once, each at the rate of its weight; at virtual time v source i has had min(w_i v, n_i)
blocks, and the sum over all sources is the slot T(v). The k-th block (from 0) of a source is
released at floor(T(k / w)) and due at ceil(T((k + 1) / w)); earliest deadline first then keeps every
source within less than one block of its share at every slot, also after others have run out.
Weights are exact: floats are fractions, scaled to whole numbers of any length. The schedule is made
by one Arrow task that holds a bounded state for each source and gives a table of blocks.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free_name, table, written

BLOCK = 64
TEMPERATURE = 0.5
ROWS = 1024


def whole(weights: list[float]) -> list[int]:
    """The weights as whole numbers of the same ratios, exactly."""
    parts = [Fraction(w) for w in weights]
    unit = math.lcm(*(p.denominator for p in parts))
    return [p.numerator * (unit // p.denominator) for p in parts]


def order(blocks: list[int], weights: list[int]) -> Iterator[int]:
    """The task of each slot: earliest deadline first among released blocks, until all blocks have a slot."""
    tasks = [i for i, n in enumerate(blocks) if n]
    ends = sorted(tasks, key=lambda i: Fraction(blocks[i], weights[i]))
    near = [blocks[i] / weights[i] for i in ends]  # close enough to find the place, which is then made exact
    gone, rate = [0], [sum(weights[i] for i in tasks)]  # of the first tasks that have run out: their blocks; the others' weight
    for i in ends:
        gone.append(gone[-1] + blocks[i])
        rate.append(rate[-1] - weights[i])

    def slot(i: int, k: int) -> tuple[int, int]:
        """T(k / w) as a fraction."""
        w = weights[i]
        at = bisect_left(near, k / w)
        while at < len(ends) and blocks[ends[at]] * w < k * weights[ends[at]]:
            at += 1
        while at and blocks[ends[at - 1]] * w >= k * weights[ends[at - 1]]:
            at -= 1
        return k * rate[at] + w * gone[at], w

    waiting = [(0, i, 0) for i in tasks]
    ready: list[tuple[int, int, int]] = []
    heapq.heapify(waiting)
    for t in range(sum(blocks)):
        while waiting and waiting[0][0] <= t:
            _, i, k = heapq.heappop(waiting)
            over, w = slot(i, k + 1)
            heapq.heappush(ready, (-(-over // w), i, k))
            if k + 1 < blocks[i]:
                heapq.heappush(waiting, (over // w, i, k + 1))
        yield heapq.heappop(ready)[1]


def period(weights: list[int]) -> list[list[int]]:
    """Slots of each task in one period of sum(weights) slots."""
    slots: list[list[int]] = [[] for _ in weights]
    for t, i in enumerate(order(weights, weights)):
        slots[i].append(t)
    return slots


class Schedule:
    """Slot of every block."""

    def __init__(self, blocks: list[int], weights: list[int]):
        self.slots: list[list[int]] = [[] for _ in blocks]
        for t, i in enumerate(order(blocks, weights)):
            self.slots[i].append(t)
        self.length = sum(blocks)

    def slot(self, task: int, k: np.ndarray) -> np.ndarray:
        """Slots of blocks k (from 0) of a task."""
        return np.array(self.slots[task], dtype=np.int64)[k]


def plan_of(sizes: DataFrame, weights: dict[str, float] | None, block: int) -> DataFrame:
    """sizes(source, n) -> (source, block, slot) for every block of every source, by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((s, n) for b in batches for s, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        least = min(weights.values(), default=1.0) if weights is not None else None
        target = whole([n**TEMPERATURE if weights is None else weights.get(s, least) for s, n in rows])
        done = [0] * len(rows)
        who: list[int] = []
        ks: list[int] = []
        start = 0

        def rest() -> pa.RecordBatch:
            at = pa.array(np.arange(start, start + len(who)))
            return pa.RecordBatch.from_arrays([pa.array([rows[i][0] for i in who], pa.string()), pa.array(ks, pa.int64()), at], names=["source", "block", "slot"])

        for i in order([-(-n // block) for _, n in rows], target):
            who.append(i)
            ks.append(done[i])
            done[i] += 1
            if len(who) == 50_000:
                yield rest()
                start += len(who)
                who, ks = [], []
        yield rest()

    return sizes.repartition(1).mapInArrow(run, "source string, block long, slot long")


def _hashable(docs: DataFrame) -> list[str]:
    return [c for c, t in docs.dtypes if "map<" not in t and "variant" not in t]


def mixed(docs: DataFrame, weights: dict[str | None, float] | None = None, id_col: str = "doc_id", source_col: str = "source", block: int = BLOCK, seed: int = 11, rows: int = ROWS) -> DataFrame:
    """docs with mix_source, mix_block (within the source), mix_slot and mix_position (unique, the place in the mixture).

    weights: target weight of each source; a source without one has the least of them. Without
    weights, each source has count ** 0.5. Within a source, rows come in the order of a seeded hash
    of their id and columns, so that rows of one id, or of none, spread; only rows that are equal in
    every column (maps left out) lie together. Every row has its place: once a source has run out
    the others go on at their own ratios. A null source is a source, named by a zero character and
    'null'. Rows that repeat an id, or have none, are placed each. Texts of any length and columns
    of any name pass through; only an earlier mixture's four columns are replaced. Weights must be
    positive. An empty table gives none.

    Whole rows are shuffled once, by source and hash range; what a range needs of the schedule comes
    to it in one small row."""
    docs = docs.drop("mix_source", "mix_block", "mix_slot", "mix_position")  # of an earlier mixture
    source, h, bucket, rank, before, slots = (free_name(docs, x) for x in ("mix_source", "__hash", "__bucket", "__rank", "__before", "__slots"))
    raw = F.coalesce(F.col(source_col).cast("string"), F.lit("\x00null"))
    target = None if weights is None else {"\x00null" if k is None else k: float(w) for k, w in weights.items()}
    if target and not all(0 < w < math.inf for w in target.values()):
        raise ValueError("weights must be positive")
    named = docs.withColumn(source, raw).withColumn(h, F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), *_hashable(docs)))
    sizes = written(named.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n")), "mix-sizes")
    plan = written(plan_of(sizes, target, block), "mix-plan")
    bits = max(0, math.ceil(math.log2(max(1, plan.count() * block / rows))))

    # place within the source: rows before this hash range, and the rank in it; a range knows the slots of its blocks
    named = named.withColumn(bucket, F.shiftrightunsigned(F.col(h), 64 - bits) if bits else F.lit(0).cast("long"))
    counts = named.groupBy(F.col(source).alias("source"), F.col(bucket).alias("bucket")).agg(F.count("*").alias("n"))
    over = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counts.withColumn("before", F.coalesce(F.sum("n").over(over), F.lit(0)))
    span = ahead.withColumn("block", F.explode(F.sequence(F.floor(F.col("before") / block), F.floor((F.col("before") + F.col("n") - 1) / block))))
    held = span.join(plan, ["source", "block"]).groupBy("source", "bucket", "before").agg(F.transform(F.sort_array(F.collect_list(F.struct("block", "slot"))), lambda x: x["slot"]).alias("slots"))
    held = written(held, "mix-ranges").toDF(source, bucket, before, slots)
    within = Window.partitionBy(source, bucket).orderBy(h, id_col)
    out = named.withColumn(rank, F.row_number().over(within) - 1).join(held, [source, bucket]).withColumn(rank, F.col(rank) + F.col(before))
    number = F.floor(F.col(rank) / block)
    out = out.withColumn("mix_block", number).withColumn("mix_slot", F.get(slots, (number - F.floor(F.col(before) / block)).cast("int")))
    return out.select(*docs.columns, F.col(source).alias("mix_source"), "mix_block", "mix_slot", (F.col("mix_slot") * block + F.col(rank) % block).alias("mix_position"))


def in_order(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", block: int = BLOCK, **how) -> DataFrame:
    """docs, columns as they are, in the order of the mixture: partitions are even ranges of it, sorted."""
    spark = docs.sparkSession
    out = mixed(docs, None, id_col, source_col, block, **how)
    slots = docs.groupBy(source_col).agg(F.ceil(F.count("*") / block).alias("n")).agg(F.sum("n")).first()[0] or 1
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    part = F.expr(f"cast(mix_slot * {parts} div {slots} as int)")
    return out.repartitionById(parts, part).sortWithinPartitions("mix_position").select(*docs.columns)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))
