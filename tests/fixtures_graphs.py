"""Small graphs with known answers."""

from pathlib import Path

import numpy as np

#: tests/fixtures/karate.csv is the karate club of Zachary (1977), members numbered from 0; these joined the officer's club.
OFFICER = {8, 9, 14, 15, 18, 20, 22, 23, 24, 25, 26, 27, 28, 29, 30, 31, 32, 33}

_LINES = (Path(__file__).parent / "fixtures" / "karate.csv").read_text().split()[1:]
KARATE_EDGES = [tuple(map(int, line.split(","))) for line in _LINES]
KARATE_CLUBS = [(n, int(n in OFFICER)) for n in range(34)]
TRIANGLES = [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5)]


def planted(groups: int, size: int, inside: float, outside: float, seed: int):
    """A planted partition: edges and each node's group."""
    rng = np.random.default_rng(seed)
    n = groups * size
    group = np.arange(n) // size
    a, b = np.triu_indices(n, 1)
    keep = rng.random(len(a)) < np.where(group[a] == group[b], inside, outside)
    return list(zip(a[keep].tolist(), b[keep].tolist())), list(enumerate(group.tolist()))
