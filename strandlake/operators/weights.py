"""Haplotype weights: an ordered forward and backward pass for each target, normalised and pruned.

The passes are affine recurrences along the sites, one for each panel haplotype; only the row sums
couple them. A group is one target haplotype with its selected rows, all haplotypes stepped at once.
`pruned` goes block by block: the backward pass leaves one row for each block, and the forward pass
makes a block's backward rows again from there, so that no more than two blocks of dense rows exist,
and only cells that stay are given out. `folds` gives every cell of both passes, to be looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import met

SCHEMA = "target_hap int, row int, ref_hap int, fwd double, bwd double, w double, pruned double"
BLOCK = 256  # sites of a block


def passes(match: np.ndarray, before: np.ndarray, after: np.ndarray, error: float) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward values, [site + 1, haplotype] with a row for either end.

    match: [site, haplotype] whether the haplotype is selected there."""
    n, count = len(match), match.sum(axis=1)
    step = np.where(match, 1 - error, error)
    fwd, bwd = np.zeros((n + 2, match.shape[1])), np.zeros((n + 2, match.shape[1]))
    fwd[0] = match[0] / count[0]
    for i in range(n):
        fwd[i + 1] = step[i] * (fwd[i] + match[i] * (before[i] / count[i]))
    fwd[n + 1] = match[-1] / count[-1]
    bwd[n + 1] = 1 / count[-1]
    for i in range(n - 1, -1, -1):
        bwd[i + 1] = step[i] * (bwd[i + 2] + match[i] * (after[i] / count[i]))
    bwd[0] = 1 / count[0]
    return fwd, bwd


def combined(fwd: np.ndarray, bwd: np.ndarray, match: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalised weights, and the same with those below 1 / (haplotypes + 1) set to 0; a row that is all 0 stays so."""
    w = fwd * bwd
    w[0] = w[1] = match[0] / match[0].sum()
    w[-1] = w[-2] = match[-1] / match[-1].sum()
    total = w.sum(axis=1, keepdims=True)
    w = np.divide(w, total, out=np.zeros_like(w), where=total > 0)
    return w, np.where(w < 1 / (w.shape[1] + 1), 0, w)


def blocked(site: np.ndarray, col: np.ndarray, n: int, haps: int, before: np.ndarray, after: np.ndarray, error: float, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, weight) of the cells of `combined(*passes(...))` that stay, from the selected cells in the order of sites."""
    count = np.bincount(site, minlength=n)
    first = np.r_[0, np.cumsum(count)]

    def dense(low: int, high: int) -> np.ndarray:
        m = np.zeros((high - low, haps), dtype=bool)
        m[site[first[low] : first[high]] - low, col[first[low] : first[high]]] = True
        return m

    starts = list(range(0, n, block))
    after_of, x = {}, np.full(haps, 1 / count[-1])
    for low in reversed(starts):  # bwd[i + 1] from bwd[i + 2]: kept is what a block begins from
        after_of[low] = x
        m = dense(low, min(n, low + block))
        for i in range(len(m) - 1, -1, -1):
            x = np.where(m[i], 1 - error, error) * (x + m[i] * (after[low + i] / count[low + i]))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def keep(row: int, w: np.ndarray) -> None:
        total = w.sum(axis=1, keepdims=True)
        w = np.divide(w, total, out=np.zeros_like(w), where=total > 0)
        r, c = np.nonzero((w >= 1 / (haps + 1)) & (w > 0))
        out.append((r + row, c, w[r, c]))

    ends = dense(0, 1).astype(float), dense(n - 1, n).astype(float)
    keep(0, ends[0] / count[0])
    y = dense(0, 1)[0] / count[0]
    for low in starts:
        m = dense(low, min(n, low + block))
        step = np.where(m, 1 - error, error)
        bwd, fwd, x = np.empty(m.shape), np.empty(m.shape), after_of[low]
        for i in range(len(m) - 1, -1, -1):
            x = bwd[i] = step[i] * (x + m[i] * (after[low + i] / count[low + i]))
        for i in range(len(m)):
            y = fwd[i] = step[i] * (y + m[i] * (before[low + i] / count[low + i]))
        w = fwd * bwd
        if low == 0:
            w[0] = ends[0][0] / count[0]
        if low + len(m) == n:
            w[-1] = ends[1][0] / count[-1]
        keep(low + 1, w)
    keep(n + 1, ends[1] / count[-1])
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _grouped(selected: DataFrame, rates: DataFrame, errors: DataFrame) -> DataFrame:
    rows = selected.join(rates.select("n", "before", "after"), "n").join(met(errors.select("target_hap", "error")), "target_hap")
    return rows.select("target_hap", "n", "ref_hap", "before", "after", "error")


def _of_target(key: tuple, t: pa.Table, n_sites: int) -> tuple:
    """(target, haplotypes, sites and columns in the order of sites, before, after, error)."""
    n, of = t["n"].to_numpy(), key[0].as_py()
    haps, col = np.unique(t["ref_hap"].to_numpy(), return_inverse=True)
    before, after = np.zeros(n_sites), np.zeros(n_sites)
    before[n], after[n] = t["before"].to_numpy(), t["after"].to_numpy()
    if len(np.unique(n)) < n_sites:
        raise ValueError(f"target {of} has a site without haplotypes")
    order = np.lexsort((col, n))
    return of, haps, n[order], col[order], before, after, float(t["error"][0].as_py())


def pruned(selected: DataFrame, rates: DataFrame, errors: DataFrame, n_sites: int, block: int = BLOCK) -> DataFrame:
    """(target_hap, row, ref_hap, w) for rows 0 to n_sites + 1: the weights that stay after pruning.

    selected(target_hap, n, ref_hap); rates(n, before, after) travel with the rows, errors(target_hap,
    error) with the target. Every site of a target must hold a haplotype, as selection leaves it."""

    def fold(key: tuple, t: pa.Table) -> pa.Table:
        of, haps, n, col, before, after, error = _of_target(key, t, n_sites)
        row, at, w = blocked(n, col, n_sites, len(haps), before, after, error, block)
        return pa.table({"target_hap": np.full(len(row), of, np.int32), "row": row.astype(np.int32), "ref_hap": haps[at].astype(np.int32), "w": w})

    return _grouped(selected, rates, errors).groupBy("target_hap").applyInArrow(fold, "target_hap int, row int, ref_hap int, w double")


def folds(selected: DataFrame, rates: DataFrame, errors: DataFrame, n_sites: int) -> DataFrame:
    """(target_hap, row, ref_hap, fwd, bwd, w, pruned): all cells, zeros included, of a target at once."""

    def fold(key: tuple, t: pa.Table) -> pa.Table:
        of, haps, n, col, before, after, error = _of_target(key, t, n_sites)
        match = np.zeros((n_sites, len(haps)), dtype=bool)
        match[n, col] = True
        fwd, bwd = passes(match, before, after, error)
        w, stays = combined(fwd, bwd, match)
        row, at = (x.ravel() for x in np.indices(w.shape))
        return pa.table({"target_hap": np.full(len(row), of, np.int32), "row": row.astype(np.int32), "ref_hap": haps[at].astype(np.int32), "fwd": fwd.ravel(), "bwd": bwd.ravel(), "w": w.ravel(), "pruned": stays.ravel()})

    return _grouped(selected, rates, errors).groupBy("target_hap").applyInArrow(fold, SCHEMA)


def site_counts(selected: DataFrame) -> DataFrame:
    return selected.groupBy("target_hap", "n").agg(F.count("*").alias("n_haps"))
