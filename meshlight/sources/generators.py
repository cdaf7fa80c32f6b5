"""Synthetic graphs for benchmarks and tests, as numpy edge arrays."""

from __future__ import annotations

import numpy as np


def barabasi_albert(n: int, m: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Preferential attachment: a clique of m + 1 nodes, then each node links to m others drawn by degree."""
    rng = np.random.default_rng(seed)
    ends: list[int] = []
    src, dst = [], []
    for v in range(1, n):
        if v <= m:
            chosen = set(range(v))
        else:
            chosen = set()
            while len(chosen) < m:
                chosen.add(ends[rng.integers(len(ends))])
        for u in sorted(chosen):
            src.append(u)
            dst.append(v)
            ends += (u, v)
    return np.array(src, np.int64), np.array(dst, np.int64)


def perturb(src: np.ndarray, dst: np.ndarray, n: int, remove: int, add: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Drops random edges and adds random ones without self-loops."""
    rng = np.random.default_rng(seed)
    keep = np.ones(len(src), bool)
    keep[rng.choice(len(src), min(remove, len(src)), replace=False)] = False
    a = rng.integers(0, n, add)
    b = (a + rng.integers(1, n, add)) % n
    return np.concatenate([src[keep], np.minimum(a, b)]), np.concatenate([dst[keep], np.maximum(a, b)])


def random_edges(n: int, count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Uniform pairs without self-pairs; repeats may occur."""
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, n, count), rng.integers(0, n, count)
    return np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]
