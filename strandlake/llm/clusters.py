"""Centres of vectors from a bounded sample, for the operators that divide vectors into cells."""

from __future__ import annotations

import numpy as np

ROUNDS = 6


def normalised(m: np.ndarray) -> np.ndarray:
    """Rows of length 1; zero rows stay zero."""
    n = np.sqrt(np.einsum("ij,ij->i", m, m))
    return m / np.where(n > 0, n, 1)[:, None]


def centres(unit: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 5) -> np.ndarray:
    """At most k unit vectors: spherical k-means of the sample, begun from vectors far from each other."""
    rng = np.random.default_rng(seed)
    k = min(k, len(unit))
    start = unit[rng.permutation(len(unit))[: min(len(unit), 8 * k)]]
    chosen = [0]
    near = start @ start[0]
    for _ in range(k - 1):  # the vector that is farthest from all chosen ones
        chosen.append(int(near.argmin()))
        near = np.maximum(near, start @ start[chosen[-1]])
    c = start[np.unique(chosen)]
    for _ in range(rounds):
        home = (unit @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, home, unit)
        held = np.bincount(home, minlength=len(c)) > 0
        new = normalised(np.where(held[:, None], sums, c))
        if np.allclose(new, c):
            break
        c = new
    return np.unique(c, axis=0)
