"""Maximal shared runs between target and panel haplotypes, and the best runs at each start.

A block of the panel is met with a block of targets in one task. At each start the panel's haplotypes
are sorted by the allele before it and those from it on, so that the runs which begin there are a
range for each target, and those of some length or more a narrower one: only runs that may be kept are
looked at, however large the panel is. Earlier runs of such a pair are counted in words of 64 sites.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import met

MIN_LENGTH, FORWARD, BACKWARD = 5, 450, 60
BLOCK_BYTES = 32 << 20  # of packed alleles and row numbers of a block of panel or target haplotypes
PIECE, KEPT = 1 << 16, 8 << 20  # runs looked at together, runs kept of some targets
HEAD = "target_hap int, ref_hap int, start int, len int"


def packed(alleles: DataFrame, site: str = "n") -> DataFrame:
    """(hap, bits): alleles of the typed sites in order, a '0' or '1' each."""
    return alleles.groupBy("hap").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(site, "allele"))), lambda x: x["allele"].cast("string")), "").alias("bits"))


def run_lengths(panel: np.ndarray, target: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, length) of each maximal run of equal alleles, the last site left out of every run."""
    n = panel.shape[1] - 1
    if n < 1:
        return (np.zeros(0, np.int64),) * 3
    differ = np.ones((len(panel), n + 2), dtype=bool)
    differ[:, 1:-1] = panel[:, :n] != target[None, :n]
    row, at = np.nonzero(differ)
    length = at[1:] - at[:-1] - 1
    keep = (row[1:] == row[:-1]) & (length >= least)
    return row[:-1][keep], at[:-1][keep], length[keep]


def leading(x: np.ndarray) -> np.ndarray:
    """How many of the highest bits are 0; 64 where all are."""
    top = x & ~(x >> np.uint64(1))  # the highest bit stays and the next one goes, so that rounding can't carry
    return np.where(x == 0, 64, 1086 - (top.astype(np.float64).view(np.int64) >> 52))


def _later(y: list[np.ndarray], by: int) -> list[np.ndarray]:
    """The words with every site's bit moved `by` sites ahead."""
    q, r = divmod(by, 64)
    low = lambda j: y[j] << np.uint64(r) if j < len(y) else np.zeros_like(y[0])
    return [low(i + q) | y[i + q + 1] >> np.uint64(64 - r) if r and i + q + 1 < len(y) else low(i + q) for i in range(len(y))]


def held_before(panel: np.ndarray, targets: np.ndarray, row: np.ndarray, of: np.ndarray, start: int, least: int) -> np.ndarray:
    """Total length of the runs of `least` sites or more of pairs (row, of) that end before `start`."""
    if start < least:
        return np.zeros(len(row), np.int64)
    y = [~(panel[i][row] ^ targets[i][of]) for i in range(-(-start // 64))]
    if start % 64:
        y[-1] &= np.uint64(((1 << start % 64) - 1) << (64 - start % 64))
    have = 1
    while have < least:  # a bit stays where a run of so many sites begins within the run
        step = min(have, least - have)
        y, have = [a & b for a, b in zip(y, _later(y, step), strict=True)], have + step
    total, before = np.zeros(len(row), np.int64), None
    for a in y:
        first = a & ~(a >> np.uint64(1) if before is None else a >> np.uint64(1) | before << np.uint64(63))
        total += np.bitwise_count(a)
        if least > 1:
            total += np.bitwise_count(first).astype(np.int64) * (least - 1)
        before = a
    return total


class Found(NamedTuple):
    """Runs that begin at one start, in the order of their targets."""

    of: np.ndarray  # target
    row: np.ndarray  # panel haplotype
    length: np.ndarray


class Block:
    """A block of the panel and one of the targets: words [word, haplotype] of the first n sites, the first site highest.

    After site n - 1 the panel's bits are 1 and the targets' 0, so that every run ends there."""

    def __init__(self, haps: np.ndarray, panel: np.ndarray, of: np.ndarray, targets: np.ndarray, n: int, least: int):
        order, own = np.argsort(haps, kind="stable"), np.argsort(of, kind="stable")
        self.haps, self.panel, self.of, self.targets = haps[order], np.ascontiguousarray(panel[:, order]), of[own], np.ascontiguousarray(targets[:, own])
        self.n, self.least = n, least
        self.index_bits = max(1, int(len(haps) - 1).bit_length())
        self.most = 63 - self.index_bits  # sites that the order tells apart
        self.low = np.uint64((1 << self.index_bits) - 1)

    def starts(self) -> range:
        return range(0, self.n - max(self.least, 1) + 1)

    def window(self, words: np.ndarray, site: int) -> np.ndarray:
        """The 64 sites from `site` on."""
        q, r = divmod(site, 64)
        out = words[q] << np.uint64(r)
        return out | words[q + 1] >> np.uint64(64 - r) if r and q + 1 < len(words) else out

    def keys(self, start: int, some: slice) -> tuple[np.ndarray, np.ndarray]:
        """(sorted keys of the panel: the allele before start, those from it on, the row; keys of targets, the allele before turned round)."""
        a, b = (self.window(w, max(0, start - 1)) for w in (self.panel, self.targets[:, some]))
        a, b = (a >> np.uint64(1), b >> np.uint64(1)) if start == 0 else (a, b ^ np.uint64(1 << 63))
        return np.sort(a & ~self.low | np.arange(len(a), dtype=np.uint64)), b & ~self.low

    @staticmethod
    def ranges(keys: np.ndarray, own: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first key, number of keys) that share `length` sites from the start on with each target."""
        rest = np.uint64((1 << 63) - 1) >> length.astype(np.uint64)
        low = np.searchsorted(keys, own & ~rest)
        return low, np.searchsorted(keys, own | rest, side="right") - low

    def candidates(self, keys: np.ndarray, own: np.ndarray, cap: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Ranges that hold all runs of `least` sites, or else the `cap` longest and all of the length of the last of them."""
        length = np.full(len(own), min(self.least, self.most))
        first, count = self.ranges(keys, own, length)
        if cap is None:
            return first, count
        full = np.flatnonzero(count > cap)
        over = np.full(len(full), self.most + 1)
        while len(full):
            go = over - length[full] > 1
            full, over = full[go], over[go]
            if not len(full):
                break
            mid = (over + length[full]) // 2
            f, c = self.ranges(keys, own[full], mid)
            enough = c >= cap
            first[full[enough]], count[full[enough]], length[full[enough]] = f[enough], c[enough], mid[enough]
            over = np.where(enough, over, mid)
        return first, count

    def met(self, start: int, some: slice, cap: int | None = None) -> Iterator[Found]:
        """Runs that begin at start, in pieces of whole targets; see candidates."""
        keys, own = self.keys(start, some)
        first, count = self.candidates(keys, own, cap)
        ends = np.cumsum(count)
        at = 0
        while at < len(own):
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + PIECE, side="right")))
            c = count[at:to]
            of = np.repeat(np.arange(at, to), c)
            k = keys[np.arange(len(of)) + np.repeat(first[at:to] - (ends[at:to] - c - base), c)]
            row = (k & self.low).astype(np.int64)
            length = np.minimum(leading((k ^ own[of]) & ~self.low) - 1, self.most)
            more, done = np.flatnonzero(length == self.most), self.most
            while len(more):  # the key does not tell where these end
                x = self.window(self.panel[:, row[more]], start + done) ^ self.window(self.targets[:, some][:, of[more]], start + done)
                length[more] += (same := leading(x))
                more, done = more[same == 64], done + 64
            if self.least > self.most:
                keep = length >= self.least
                of, row, length = of[keep], row[keep], length[keep]
            if len(of):
                yield Found(of, row, length)
            at = to

    def runs(self) -> Iterator[tuple[np.ndarray, ...]]:
        """(target, panel haplotype, start, length) of all runs, in pieces."""
        every = slice(0, len(self.of))
        for start in self.starts():
            for f in self.met(start, every):
                yield self.of[f.of], self.haps[f.row], np.full(len(f.of), start), f.length

    def some_targets(self, cap: int) -> int:
        """How many targets are taken at a time, so that what is kept of them is bounded."""
        tried, every = list(self.starts())[:: max(1, len(self.starts()) // 16)], slice(0, min(64, len(self.of)))
        kept = sum(np.minimum(self.ranges(*self.keys(s, every), np.full(every.stop, min(self.least, self.most)))[1], cap).sum() for s in tried)
        each = max(1, int(kept / max(1, len(tried)) / every.stop * len(self.starts()) * 2))
        bits = 63 - self.index_bits - 2 * self.n.bit_length()
        return max(1, min(len(self.of), KEPT // each, 1 << min(30, max(0, bits))))

    def forward(self, some: slice, cap: int) -> Iterator[tuple[int, Found, np.ndarray, np.ndarray]]:
        """(start, runs, tot, rank from 0) of the best `cap` runs of each target at each start, in the order of ranks.

        Order: see best_forward. Rows lie in the order of reversed prefixes; what is sorted is one
        number made of target, length, total and place in that order."""
        n, size, wide = self.n, len(self.haps), self.n.bit_length()
        order, place = np.arange(size), np.arange(size)
        for start in self.starts():
            up = np.ones(some.stop - some.start, dtype=bool)
            if start:
                shift, q = np.uint64(63 - (start - 1) % 64), (start - 1) // 64
                alt = (self.panel[q][order] >> shift & np.uint64(1)).astype(bool)
                order = np.concatenate([order[~alt], order[alt]])
                place[order] = np.arange(size)
                up = (self.targets[q, some] >> shift & np.uint64(1)).astype(bool)
            parts = []
            for f in self.met(start, some, cap):
                tot = held_before(self.panel, self.targets[:, some], f.row, f.of, start, self.least) + f.length
                at = np.where(up[f.of], place[f.row], size - 1 - place[f.row])
                key = np.sort((((f.of << wide | n - f.length) << wide | n - tot) << self.index_bits) | at)
                of = key >> (2 * wide + self.index_bits)
                rank = _rank(of)
                keep = rank < cap
                key, of, rank = key[keep], of[keep], rank[keep]
                at = key & int(self.low)
                row = order[np.where(up[of], at, size - 1 - at)]
                mask = (1 << wide) - 1
                parts.append((of, row, n - (key >> (wide + self.index_bits) & mask), n - (key >> self.index_bits & mask), rank))
            if parts:
                of, row, length, tot, rank = (np.concatenate(x) for x in zip(*parts, strict=True))
                yield start, Found(of, row, length), tot, rank

    def best_forward(self, cap: int) -> Iterator[tuple[np.ndarray, ...]]:
        """(target, panel haplotype, start, length, tot, rank) of the best `cap` of this block's runs."""
        step = self.some_targets(cap)
        for low in range(0, len(self.of), step):
            for start, f, tot, rank in self.forward(slice(low, min(len(self.of), low + step)), cap):
                yield self.of[low + f.of], self.haps[f.row], np.full(len(rank), start), f.length, tot, rank + 1

    def best_backward(self, cap: int, most: int) -> Iterator[tuple[np.ndarray, ...]]:
        """(target, panel haplotype, start, length, rest, k) of the best `most` of the best `cap` of this block's runs."""
        step, n, size, wide, ranks = self.some_targets(cap), self.n, len(self.haps), self.n.bit_length(), min(cap, len(self.haps)).bit_length()
        for low in range(0, len(self.of), step):
            some = slice(low, min(len(self.of), low + step))
            kept = [(np.full(len(rank), start, np.int32), f.of.astype(np.int32), f.row.astype(np.int32), f.length.astype(np.int32), rank.astype(np.int32)) for start, f, _, rank in self.forward(some, cap)]
            if not kept:
                continue
            cuts = np.cumsum([len(x[0]) for x in kept])
            starts, ofs, rows, lengths, places = (np.concatenate(x) for x in zip(*kept, strict=True))
            del kept
            onward = _onward(ofs.astype(np.int64) * size + rows, starts, lengths, n)
            for first, end in zip(np.r_[0, cuts[:-1]], cuts, strict=True):
                of, row, length, rest, rank = (x[first:end] for x in (ofs, rows, lengths, onward, places))
                key = np.sort(((of.astype(np.int64) << wide | n - length) << wide | n - rest) << ranks | rank)
                of, mask = key >> (2 * wide + ranks), (1 << wide) - 1
                k = _rank(of)
                row = row[np.arange(len(k)) - k + (key & ((1 << ranks) - 1))]
                keep = k < most
                key, of, row, k = key[keep], of[keep], row[keep], k[keep]
                yield self.of[low + of], self.haps[row], np.full(len(k), starts[first]), n - (key >> (wide + ranks) & mask), n - (key >> ranks & mask), k + 1


def _onward(pair: np.ndarray, start: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """Total length of the runs of each run's pair from its start on."""
    order = np.argsort(pair * (n + 1) + (n - start), kind="stable")
    pair, length = pair[order], length[order].astype(np.int64)
    total = np.cumsum(length)
    new = np.r_[True, pair[1:] != pair[:-1]]
    rest = np.empty(len(order), np.int32)
    rest[order] = total - (total - length)[new][np.cumsum(new) - 1]
    return rest


def _rank(of: np.ndarray) -> np.ndarray:
    """Place of each row among those of its (sorted) target."""
    new = np.r_[True, of[1:] != of[:-1]] if len(of) else np.zeros(0, dtype=bool)
    return np.arange(len(of)) - np.flatnonzero(new)[np.cumsum(new) - 1] if len(of) else np.zeros(0, np.int64)


def _words(haps: DataFrame, side: int) -> DataFrame:
    """(side, hap, n, words): the alleles but the last as bits, filled up with 1 for the panel (side 0) and with 0 for targets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b["bits"].to_pylist()
            n = max(0, len(text[0]) - 1) if text else 0
            line = np.full((len(text), n // 64 * 64 + 64), 1 - side, dtype=np.uint8)
            line[:, :n] = np.frombuffer("".join(text).encode(), dtype=np.uint8).reshape(len(text), -1)[:, :n] == ord("1")
            words = pa.array([x.tobytes() for x in np.packbits(line, axis=1)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(text), side, np.int32)), b["hap"].cast(pa.int32()), pa.array(np.full(len(text), n, np.int32)), words], names=["side", "hap", "n", "words"])

    return haps.select("hap", "bits").mapInArrow(run, "side int, hap int, n int, words binary")


def _count(haps: DataFrame, block_bytes: int) -> tuple[int, int]:
    """(haplotypes, blocks of at most about block_bytes that hold them)."""
    x = haps.agg(F.count("*").alias("n"), F.coalesce(F.max(F.length("bits")), F.lit(0)).alias("sites")).first()
    return x.n, max(1, -(-x.n * (x.sites // 64 * 8 + 40) // block_bytes))


def _dealt(panel: DataFrame, targets: DataFrame, block_bytes: int, parts: int | None) -> tuple[DataFrame, int]:
    """(rows of the panel and the targets, a partition for each pair of blocks; number of the panel's blocks).

    Targets are cut into `parts` blocks at least where they are enough for it, to keep the executors busy."""
    (_, n), (count, m) = _count(panel, block_bytes), _count(targets, block_bytes)
    m = max(m, min(parts or max(32, 2 * panel.sparkSession.sparkContext.defaultParallelism), -(-count // 16)))
    block = lambda of: F.pmod(F.xxhash64(F.lit(5), "hap"), F.lit(of)).cast("int")
    left = _words(panel, 0).withColumn("block", block(n)).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(m - 1)))).withColumn("part", F.col("block") * m + F.col("part"))
    right = _words(targets, 1).withColumn("block", block(m)).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("part", F.col("part") * m + F.col("block"))
    return left.unionByName(right).repartitionById(n * m, F.col("part")).select("side", "hap", "n", "words"), n


def _blocks(rows: DataFrame, least: int, schema: str, ask) -> DataFrame:
    """What ask(Block) yields for each pair of blocks."""
    names = [x.split()[0] for x in schema.split(", ")]
    types = [{"int": np.int32, "long": np.int64}[x.split()[1]] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        haps, words, n = ([], []), ([], []), 0
        for b in batches:
            side, n = b["side"].to_numpy(), b["n"][0].as_py() if b.num_rows else n
            for s in (0, 1):
                haps[s].append(b["hap"].to_numpy()[side == s])
                words[s].extend(b.filter(pa.array(side == s))["words"].to_pylist())
        if n < 1 or not words[0] or not words[1]:
            return
        packed_ = [np.frombuffer(b"".join(w), dtype=">u8").reshape(len(w), -1).T.astype(np.uint64) for w in words]
        block = Block(np.concatenate(haps[0]), packed_[0], np.concatenate(haps[1]), packed_[1], n, least)
        some, held = [], 0
        for piece in ask(block):
            some.append(piece)
            held += len(piece[0])
            if held >= 1 << 18:
                yield batch(some)
                some, held = [], 0
        if held:
            yield batch(some)

    def batch(some: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(t)) for x, t in zip(zip(*some, strict=True), types, strict=True)], names=names)

    return rows.mapInArrow(run, schema)


def runs(panel: DataFrame, targets: DataFrame, least: int = MIN_LENGTH, block_bytes: int = BLOCK_BYTES, parts: int | None = None) -> DataFrame:
    """(target_hap, ref_hap, start, len) of every maximal run of `least` sites or more.

    Panel and targets (of equal sites) are cut into blocks of bounded size, and every pair of blocks
    is a task of its own, so neither side is ever held whole, on the driver or in a task, nor are the
    runs: they leave in pieces. There are as many as pairs of haplotypes share."""
    rows, _ = _dealt(panel, targets, block_bytes, parts)
    return _blocks(rows, least, HEAD, Block.runs)


def top_forward(panel: DataFrame, targets: DataFrame, least: int = MIN_LENGTH, cap: int = FORWARD, block_bytes: int = BLOCK_BYTES, parts: int | None = None) -> DataFrame:
    """best_forward(runs(...)), without making the other runs: each pair of blocks gives its best, and those of several blocks are ranked anew."""
    rows, n = _dealt(panel, targets, block_bytes, parts)
    found = _blocks(rows, least, f"{HEAD}, tot long, rank int", lambda b: b.best_forward(cap))
    return found if n == 1 else ranked(found.drop("rank"), panel, targets, cap)


def top_backward(panel: DataFrame, targets: DataFrame, least: int = MIN_LENGTH, cap: int = FORWARD, most: int = BACKWARD, block_bytes: int = BLOCK_BYTES, parts: int | None = None) -> DataFrame:
    """best_backward(best_forward(runs(...))), in the same way."""
    rows, n = _dealt(panel, targets, block_bytes, parts)
    if n == 1:
        return _blocks(rows, least, f"{HEAD}, rest long, k int", lambda b: b.best_backward(cap, most))
    found = _blocks(rows, least, f"{HEAD}, tot long, rank int", lambda b: b.best_forward(cap))
    return best_backward(ranked(found.drop("rank"), panel, targets, cap), most)


def best_forward(found: DataFrame, panel: DataFrame, targets: DataFrame, cap: int = FORWARD) -> DataFrame:
    """Adds tot and rank, and keeps the best `cap` runs at each (target, start).

    Order: longer first; then the larger total length of that panel haplotype's runs so far; then
    the order of reversed panel prefixes before the start, ascending where the target's allele just
    before is 1 or there is none, descending else. Prefixes are made for tied rows only."""
    so_far = Window.partitionBy("target_hap", "ref_hap").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    return ranked(found.withColumn("tot", F.sum("len").over(so_far)), panel, targets, cap)


def ranked(found: DataFrame, panel: DataFrame, targets: DataFrame, cap: int = FORWARD) -> DataFrame:
    """The best `cap` of runs that have their tot, with rank; see best_forward."""
    same = Window.partitionBy("target_hap", "start", "len", "tot")
    found = found.withColumn("tied", F.count("*").over(same) > 1)
    tied = found.where("tied").join(met(panel.select(F.col("hap").alias("ref_hap"), "bits")), "ref_hap")
    tied = tied.join(met(targets.select(F.col("hap").alias("target_hap"), F.col("bits").alias("own"))), "target_hap")
    up = (F.col("start") == 0) | (F.expr("substring(own, start, 1)") == "1")
    prefix = F.reverse(F.expr("substring(bits, 1, start)"))
    tied = tied.select("target_hap", "ref_hap", "start", "len", "tot", F.when(up, prefix).alias("asc_key"), F.when(up, F.col("ref_hap")).alias("asc_hap"), F.when(~up, prefix).alias("desc_key"), F.when(~up, F.col("ref_hap")).alias("desc_hap"))
    lone = found.where(~F.col("tied")).select("target_hap", "ref_hap", "start", "len", "tot", *[F.lit(None).cast(t).alias(c) for c, t in (("asc_key", "string"), ("asc_hap", "int"), ("desc_key", "string"), ("desc_hap", "int"))])
    order = Window.partitionBy("target_hap", "start").orderBy(F.desc("len"), F.desc("tot"), F.asc("asc_key"), F.asc("asc_hap"), F.desc("desc_key"), F.desc("desc_hap"))
    return lone.unionByName(tied).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cap).select("target_hap", "ref_hap", "start", "len", "tot", "rank")


def best_backward(kept: DataFrame, cap: int = BACKWARD) -> DataFrame:
    """Of the forward survivors the best `cap` at each (target, start): length, then the haplotype's kept length from here on, then forward rank."""
    onward = Window.partitionBy("target_hap", "ref_hap").orderBy(F.desc("start")).rowsBetween(Window.unboundedPreceding, 0)
    order = Window.partitionBy("target_hap", "start").orderBy(F.desc("len"), F.desc("rest"), "rank")
    out = kept.withColumn("rest", F.sum("len").over(onward)).withColumn("k", F.row_number().over(order)).where(F.col("k") <= cap)
    return out.select("target_hap", "ref_hap", "start", "len", "rest", "k")
