"""Bucketed local moving on arrays: many small graphs at once, in numpy.

The same method as the DataFrame loop (see detect.py), for graphs that fit one
task: each level is one sweep in ``buckets`` steps; the nodes of a step choose
against one state; the level's communities are contracted to the next level's
nodes. Independent graphs (``group``) are moved together, each with its own
total weight, best partition and stop, so thousands of neighbourhood graphs
cost a few array operations and none disturbs another.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: The modulus and multipliers of the bucket hash, small enough for 64-bit products in any engine.
HASH_MOD, HASH_NODE, HASH_SEED = 2_147_483_647, 48_271, 40_692


@dataclass(frozen=True)
class MoveOptions:
    """How to move: see detect.LouvainOptions."""

    resolution: float = 1.0
    seed: int = 1
    max_passes: int = 0
    buckets: int = 8
    gain: str = "reference"
    self_loops: str = "reference"
    connected: bool = False


@dataclass
class Outcome:
    """community: of each node, numbered from 0 in each graph; the rest: of each graph."""

    community: np.ndarray
    modularity: np.ndarray
    passes: np.ndarray
    moves: np.ndarray


def bucket_of(ids: np.ndarray, seed: int, buckets: int) -> np.ndarray:
    return (np.mod(ids, HASH_MOD) * HASH_NODE + seed % HASH_MOD * HASH_SEED) % HASH_MOD % buckets


def dense(*keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Numbers rows from 0 by the order of their keys, the first key first."""
    if len(keys) == 1:
        low, high = (int(keys[0].min()), int(keys[0].max())) if len(keys[0]) else (0, 0)
        if high - low < 4 * len(keys[0]):  # few numbers are left out, so marking those present beats sorting
            there = np.zeros(high - low + 1, bool)
            there[keys[0] - low] = True
            number = np.cumsum(there) - 1
            return number[keys[0] - low], int(number[-1]) + 1
        values, inverse = np.unique(keys[0], return_inverse=True)
        return inverse, len(values)
    first = dense(keys[0])[0]
    second, n = dense(*keys[1:])
    return dense(first.astype(np.int64) * max(n, 1) + second)


def rank_in_group(group: np.ndarray) -> np.ndarray:
    """Position of each entry among those of its group; entries of a group lie together."""
    if not len(group):
        return group.astype(np.int64)
    starts = np.flatnonzero(np.concatenate([[True], np.diff(group) != 0]))
    return np.arange(len(group)) - np.repeat(starts, np.diff(np.append(starts, len(group))))


def both_ways(src: np.ndarray, dst: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Adjacency: each edge from both ends, a self-loop once."""
    turn = src != dst
    return np.concatenate([src, dst[turn]]), np.concatenate([dst, src[turn]]), np.concatenate([w, w[turn]])


class Quality:
    """Modularity of each graph; what does not depend on the communities is kept."""

    def __init__(self, group: np.ndarray, graphs: int, src: np.ndarray, dst: np.ndarray, w: np.ndarray, resolution: float):
        self.group, self.graphs, self.src, self.dst, self.resolution = group, graphs, src, dst, resolution
        turn = src != dst
        self.owner, self.ends = group[src], np.where(turn, 2 * w, w)  # an edge counts from both ends, a self-loop once
        self.two_m = np.bincount(self.owner, w, minlength=graphs) * 2
        self.k = np.bincount(src, w, minlength=len(group)) + np.bincount(dst, np.where(turn, w, 0.0), minlength=len(group))

    def of(self, comm: np.ndarray) -> np.ndarray:
        """``comm`` numbers communities across graphs."""
        safe = np.where(self.two_m > 0, self.two_m, 1)
        same = comm[self.src] == comm[self.dst]
        intra = np.bincount(self.owner[same], self.ends[same], minlength=self.graphs)
        degree = np.bincount(comm, self.k)
        owner = np.zeros(len(degree), np.int64)
        owner[comm] = self.group
        square = np.bincount(owner, degree * degree, minlength=self.graphs)
        return np.where(self.two_m > 0, intra / safe - self.resolution * square / (safe * safe), 0.0)


def sort_keys(key: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys, below ``bound``, in order and the place each had; equal ones keep their order.

    The place rides along in the low digits, as sorting numbers is faster than
    sorting places, wherever both fit 63 bits.
    """
    bits = len(key).bit_length()
    if bound << bits < 1 << 63:
        both = np.sort(key << bits | np.arange(len(key)))
        return both >> bits, both & (1 << bits) - 1
    order = np.argsort(key, kind="stable")
    return key[order], order


def sweep(ids: np.ndarray, group: np.ndarray, graphs: int, edges: tuple, comm: np.ndarray, options: MoveOptions, live: np.ndarray) -> np.ndarray:
    """One sweep in place over the nodes of live graphs; returns moves by graph."""
    src, dst, w = edges
    a, b, x = both_ways(src, dst, w)
    n = len(ids)
    m = np.bincount(group[src], w, minlength=graphs)
    k = np.bincount(a, x, minlength=n)
    total = np.bincount(comm, k, minlength=n)
    factor = 4.0 if options.gain == "reference" else 2.0
    bucket = bucket_of(ids, options.seed, options.buckets)
    of_edge = bucket.astype(np.int16)[a] if options.buckets < 1 << 15 else bucket[a]  # short numbers are sorted by digits
    by_bucket = np.argsort(of_edge, kind="stable")
    bounds = np.searchsorted(of_edge[by_bucket], np.arange(options.buckets + 1))
    moves = np.zeros(graphs, np.int64)
    for r in range(options.buckets):
        own = np.flatnonzero((bucket == r) & live[group] & (k > 0))
        if not len(own):
            continue
        e = by_bucket[bounds[r] : bounds[r + 1]]
        e = e[live[group[a[e]]]]
        node = np.concatenate([a[e], own])
        to = np.concatenate([comm[b[e]], comm[own]])
        weight = np.concatenate([x[e], np.zeros(len(own))])
        key, order = sort_keys(node * n + to, n * n)
        weight = weight[order]
        first = np.flatnonzero(np.concatenate([[True], np.diff(key) != 0]))
        kin = np.add.reduceat(weight, first)
        node, to = key[first] // n, key[first] % n
        stay = to == comm[node]
        score = factor * m[group[node]] * kin - options.resolution * (total[to] - np.where(stay, k[node], 0.0)) * k[node]
        starts = np.flatnonzero(np.concatenate([[True], np.diff(node) != 0]))
        best = np.maximum.reduceat(score, starts)
        sizes = np.diff(np.append(starts, len(node)))
        now = np.repeat(-np.inf, len(starts))
        now[np.repeat(np.arange(len(starts)), sizes)[stay]] = score[stay]
        is_best = np.flatnonzero(score == np.repeat(best, sizes))
        place = np.searchsorted(is_best, starts)  # the lowest community of equal ones comes first
        goes = best > now
        mover, target = node[starts][goes], to[is_best[place]][goes]
        np.subtract.at(total, comm[mover], k[mover])
        np.add.at(total, target, k[mover])
        comm[mover] = target
        moves += np.bincount(group[mover], minlength=graphs)
    return moves


def split_components(src: np.ndarray, dst: np.ndarray, comm: np.ndarray) -> np.ndarray:
    """Communities cut into connected parts, numbered by (community, least node)."""
    label = np.arange(len(comm))
    own = (comm[src] == comm[dst]) & (src != dst)
    s, d = src[own], dst[own]
    while True:
        low = label.copy()
        np.minimum.at(low, s, label[d])
        np.minimum.at(low, d, label[s])
        low = low[low]
        if (low == label).all():
            break
        label = low
    return dense(comm, label)[0]


def contract(comm: np.ndarray, src: np.ndarray, dst: np.ndarray, w: np.ndarray, self_loops: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges between communities; what lies inside becomes a self-loop."""
    a, b = np.minimum(comm[src], comm[dst]), np.maximum(comm[src], comm[dst])
    x = np.where(src == dst, w / 2, w) if self_loops == "reference" else w
    n = int(comm.max()) + 1 if len(comm) else 1
    key, order = sort_keys(a.astype(np.int64) * n + b, n * n)
    first = np.concatenate([[True], np.diff(key) != 0])[: len(key)]
    number = np.cumsum(first) - 1
    key = key[first]
    return key // n, key % n, np.bincount(number, x[order], minlength=len(key))


def detect(ids: np.ndarray, group: np.ndarray, src: np.ndarray, dst: np.ndarray, w: np.ndarray, options: MoveOptions, initial: np.ndarray | None = None) -> Outcome:
    """Communities of all graphs.

    ids: node ids, ascending in each graph; group: the graph of each node, from
    0, ascending; src, dst: positions of nodes; w: positive weights;
    initial: a community for each node, unique across graphs, for a warm start.
    """
    graphs = int(group.max()) + 1 if len(group) else 0
    level_ids, level_group = ids.astype(np.int64), group
    edges = (src, dst, w.astype(float))
    at = np.arange(len(ids))  # the level's node of each original node
    comm = np.arange(len(ids)) if initial is None else _compact(initial)
    best = comm.copy() if initial is None else dense(group, comm)[0]
    best_q = np.full(graphs, -np.inf)
    passes, moves = np.zeros(graphs, np.int64), np.zeros(graphs, np.int64)
    live = np.bincount(group[src], w, minlength=graphs) > 0
    quality = Quality(group, graphs, *edges, options.resolution)
    while live.any():
        moved = sweep(level_ids, level_group, graphs, edges, comm, options, live)
        if options.connected:
            comm = split_components(edges[0], edges[1], comm)
        passes += live
        moves += moved
        found = comm[at]
        q = quality.of(found)
        better = live & (q > best_q + 1e-15)
        best_q = np.where(better, q, best_q)
        best = np.where(better[group], found + len(ids), best)
        best = dense(group, best)[0]
        live &= moved > 0
        if options.max_passes:
            live &= passes < options.max_passes
        if not live.any():
            break
        new, count = dense(level_group, comm)
        edges = contract(new, *edges, options.self_loops)
        next_group = np.zeros(count, np.int64)
        next_group[new] = level_group
        # nodes of one step can swap places: a level that joins nothing is the last
        live &= np.bincount(next_group, minlength=graphs) < np.bincount(level_group, minlength=graphs)
        at, level_group = new[at], next_group
        level_ids = rank_in_group(level_group)
        live &= np.bincount(level_group, minlength=graphs) > 1
        comm = np.arange(count)
    community = rank_dense_in_group(group, best)
    return Outcome(community, quality.of(dense(group, best)[0]), np.maximum(passes, 1), moves)


def _compact(initial: np.ndarray) -> np.ndarray:
    """Community ids by first appearance in node order."""
    _, first, inverse = np.unique(initial, return_index=True, return_inverse=True)
    order = np.empty(len(first), np.int64)
    order[np.argsort(first)] = np.arange(len(first))
    return order[inverse]


def rank_dense_in_group(group: np.ndarray, comm: np.ndarray) -> np.ndarray:
    """Communities numbered from 0 in each graph, in ascending order of their ids."""
    number, count = dense(group, comm)
    owner = np.zeros(count, np.int64)
    owner[number] = group
    first = np.zeros(int(group.max()) + 1 if len(group) else 0, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], np.diff(owner) != 0])) if count else np.zeros(0, np.int64)
    first[owner[starts]] = starts
    return number - first[group]
