"""All triangles of an undirected graph, listed on arrays in tasks of bounded size.

Nodes are cut into ranges of about equal numbers of edge ends. An edge whose
ends lie in ranges a and b goes to the tasks {a, b, c}, of which each lists the
triangles with a corner in each of its three ranges (which may be the same), so
every triangle is found once. A task is left out where one of its three
kinds of edges doesn't exist. How fine the ranges are is chosen from counts of
edges by pairs of ranges: the fewest copies of edges at which no task has more
than ``MOST`` of them, or the smallest tasks if that can't be had. Only edges
move, packed by bytes; wedges never leave their task. There they start at the
corner of least (degree, id), so a hub starts few, and are handled in parts of
bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlight.runtime import cut, ensure_importable, lean

MOST, FINEST, WEDGES, SAMPLE, SPREAD = 1_500_000, 256, 1_000_000, 400_000, 4
NETS = "ego long, src long, dst long, weight double"


def ranges(edges: DataFrame, most: int, finest: int) -> tuple[np.ndarray, np.ndarray]:
    """The upper bounds of the ranges but the last, and the edges by pairs of them (lower range first)."""
    rows = edges.count()
    parts = 1
    while parts < finest and rows > parts * most / 3:
        parts *= 2
    if parts == 1:
        return np.zeros(0, np.int64), np.array([[rows]])
    t = edges.sample(min(1.0, SAMPLE / 2 / rows), 1).select("src", "dst").toArrow()  # decides sizes only
    ends = np.concatenate([t.column(k).to_numpy() for k in (0, 1)])
    bounds = np.quantile(ends, np.arange(1, parts) / parts, method="lower").astype(np.int64) if len(ends) else np.zeros(parts - 1, np.int64)
    counts = np.zeros(parts * parts, np.int64)
    for pair, n in _pair_counts(edges, bounds).collect():  # a number for each pair of ranges
        counts[pair] += n
    counts = counts.reshape(parts, parts)
    best = None
    while True:
        copies, largest = cost(counts)
        rank = (max(largest, most), copies)
        if best is None or rank < best[0]:
            best = rank, bounds, counts
        if len(counts) == 1:
            return best[1:]
        counts = counts[0::2] + counts[1::2]
        counts = counts[:, 0::2] + counts[:, 1::2]
        bounds = bounds[1::2]


def cost(counts: np.ndarray) -> tuple[int, int]:
    """How many copies of edges all tasks get, and the most that one gets."""
    both = counts + counts.T - np.diag(np.diag(counts))
    there = both > 0
    total = largest = 0
    for a, b in zip(*np.nonzero(np.triu(there))):
        c = np.flatnonzero(there[a] & there[b])
        total += int(both[a, b]) * len(c)
        if len(c):
            kinds = both[a, b] + np.where(c != b, both[a, c], 0) + np.where((c != a) & (a != b), both[b, c], 0)
            largest = max(largest, int(kinds.max()))
    return total, largest


def _pair_counts(edges: DataFrame, bounds: np.ndarray) -> DataFrame:
    parts = len(bounds) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(parts * parts, np.int64)
        for b in batches:
            n += np.bincount(pair_of(b.column(0).to_numpy(), b.column(1).to_numpy(), bounds), minlength=parts * parts)
        there = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(n[there])], ["pair", "n"])

    return edges.select("src", "dst").mapInArrow(lean(run), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def pair_of(src: np.ndarray, dst: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The number of an edge's pair of ranges, the lower range first."""
    a, b = np.searchsorted(bounds, src), np.searchsorted(bounds, dst)  # a bound belongs to the range below it
    return np.minimum(a, b) * (len(bounds) + 1) + np.maximum(a, b)


def tasks_of(counts: np.ndarray) -> dict[int, list[int]]:
    """For each pair of ranges the numbers of the tasks that need its edges."""
    parts = len(counts)
    there = (counts + counts.T) > 0
    out = {}
    for a, b in zip(*(x.tolist() for x in np.nonzero(np.triu(there)))):
        out[a * parts + b] = [(x * parts + y) * parts + z for x, y, z in (sorted((a, b, c)) for c in np.flatnonzero(there[a] & there[b]).tolist())]
    return out


def planes(x: np.ndarray) -> bytes:
    """Numbers as their lowest bytes, then the next ones: what is alike lies together for the shuffle's compression."""
    return np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unplanes(raw: memoryview, kind: str = "<i8") -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(kind).reshape(-1)


def pack(src: np.ndarray, dst: np.ndarray, w: np.ndarray) -> bytes:
    order = np.lexsort((dst, src))
    src, dst = src[order], dst[order]
    return planes(np.diff(src, prepend=0)) + planes(dst - src) + planes(w[order].astype("<f8").view("<i8"))


def unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, view = len(raw) // 3, memoryview(raw)
    src = np.cumsum(unplanes(view[:n]))
    return src, src + unplanes(view[n : 2 * n]), unplanes(view[2 * n :], "<f8")


def _packed(edges: DataFrame, bounds: np.ndarray, tasks: dict[int, list[int]]) -> DataFrame:
    """(task, data): the edges by task, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= WEDGES:
                yield from packed(held)
                held, rows = [], 0
        if rows:
            yield from packed(held)

    def packed(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        src, dst, w = (np.concatenate([b.column(k).to_numpy() for b in held]) for k in range(3))
        pair = pair_of(src, dst, bounds)
        order = np.argsort(pair, kind="stable")
        found, first = np.unique(pair[order], return_index=True)
        for k, at in enumerate(np.split(order, first[1:])):
            wanted = tasks.get(int(found[k]), [])
            if wanted:
                yield pa.RecordBatch.from_arrays([pa.array([wanted], pa.list_(pa.int64())), pa.array([pack(src[at], dst[at], w[at])], pa.binary())], ["tasks", "data"])

    return edges.select("src", "dst", "weight").mapInArrow(lean(run), "tasks array<long>, data binary").select(F.explode("tasks").alias("task"), "data")


def listed(src: np.ndarray, dst: np.ndarray, w: np.ndarray, bounds: np.ndarray, task: tuple[int, int, int]) -> Iterator[tuple[np.ndarray, ...]]:
    """Parts of the triangles that have a corner in each range of the task: node ids x, y, z and the weights of xy, xz, yz."""
    ids, ends = np.unique(np.concatenate([src, dst]), return_inverse=True)
    n, m = len(ids), len(src)
    degree = np.bincount(ends, minlength=n)
    by_rank = np.argsort(degree, kind="stable")  # equal degrees by id
    rank = np.empty(n, np.int64)
    rank[by_rank] = np.arange(n)
    ids = ids[by_rank]
    s, d = rank[ends[:m]], rank[ends[m:]]
    low, high = np.minimum(s, d), np.maximum(s, d)
    a, b, c = task
    odd = None  # the range that only one corner has, where two share one
    if a != c and (a == b or b == c):
        odd = np.searchsorted(bounds, ids) == (c if a == b else a)
    # out-edges of each node, by rank of the other end; those to the odd range come last
    key = low * n + high
    by_key = np.argsort(key)
    key, weight = key[by_key], w[by_key]
    at = np.arange(m) if odd is None else np.lexsort((odd[key % n], key // n))
    x, y = key[at] // n, key[at] % n
    start = np.searchsorted(x, np.arange(n))
    count = np.arange(m) - start[x]  # an edge makes a wedge with each one before it
    if odd is not None:
        count = np.where(odd[x] | odd[y], count, 0)
    bits = max(16, min(24, int(m).bit_length() + 4))
    mix, shift = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - bits)
    maybe = np.zeros(1 << bits, bool)
    maybe[(key.view(np.uint64) * mix) >> shift] = True
    total = np.concatenate([[0], np.cumsum(count)])
    begin = 0
    while begin < m:
        stop = max(begin + 1, int(np.searchsorted(total, total[begin] + WEDGES, side="right")) - 1)
        size = int(total[stop] - total[begin])
        if size:
            yield from _wedges(ids, key, weight, at, x, y, start, count, maybe, mix, shift, begin, stop, size, n)
        begin = stop


def _wedges(ids, key, weight, at, x, y, start, count, maybe, mix, shift, begin, stop, size, n) -> Iterator[tuple[np.ndarray, ...]]:
    """The triangles of the wedges that end with the edges from ``begin`` to ``stop``; one edge's wedges may be many."""
    first = 0
    while first < size:
        take = min(size - first, 2 * WEDGES)
        if take == size:
            edge = np.repeat(np.arange(begin, stop), count[begin:stop])
            place = np.arange(size) - np.repeat(np.cumsum(count[begin:stop]) - count[begin:stop], count[begin:stop])
        else:  # a single edge
            edge, place = np.full(take, begin), np.arange(first, first + take)
        other = start[x[edge]] + place
        u, v = y[other], y[edge]
        close = np.minimum(u, v) * n + np.maximum(u, v)
        hit = np.flatnonzero(maybe[(close.view(np.uint64) * mix) >> shift])
        found = np.minimum(np.searchsorted(key, close[hit]), len(key) - 1)
        right = key[found] == close[hit]
        hit, found = hit[right], found[right]
        if len(hit):
            e, o = edge[hit], other[hit]
            yield ids[x[e]], ids[y[o]], ids[y[e]], weight[at[o]], weight[at[e]], weight[found]
        first += take


Columns = tuple[np.ndarray, ...]


def rows_of(found: Iterator[Columns]) -> Iterator[pa.RecordBatch]:
    for cols in found:
        for k in range(0, len(cols[0]), 1 << 17):
            yield pa.RecordBatch.from_arrays([pa.array(c[k : k + (1 << 17)]) for c in cols], ["ego", "src", "dst", "weight"])


def nets(edges: DataFrame, most: int = MOST, written: bool = False, give: Callable[[Iterator[Columns]], Iterator[pa.RecordBatch]] = rows_of, schema: str = NETS) -> DataFrame:
    """(ego, src, dst, weight): of each triangle, the edge opposite to each corner; or what ``give`` makes of these columns in the task.

    edges: one row for each pair of nodes, no self-loops; read more than once, so they are written first unless they are already.
    """
    edges = edges.select("src", "dst", "weight")
    edges = edges if written else cut(edges)
    ensure_importable(edges.sparkSession)
    bounds, counts = ranges(edges, most, FINEST)
    parts = len(counts)
    tasks = tasks_of(counts)
    dealt = _packed(edges, bounds, tasks)
    # more partitions than tasks, and not put together again, so that few of them get two
    dealt = (dealt.repartition(min(SPREAD * len({t for some in tasks.values() for t in some}), 2000), "task") if parts > 1 else dealt.repartition("task")).sortWithinPartitions("task")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[Columns]:
        now, held = None, []
        for b in batches:
            for task, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if task != now and held:
                    yield from done(now, held)
                    held = []
                now = task
                held.append(unpack(data))
        if held:
            yield from done(now, held)

    def done(task: int, held: list) -> Iterator[Columns]:
        src, dst, w = (np.concatenate(x) for x in zip(*held))
        for x, y, z, xy, xz, yz in listed(src, dst, w, bounds, (task // parts // parts, task // parts % parts, task % parts)):
            ego, one, two = np.concatenate([x, y, z]), np.concatenate([y, x, x]), np.concatenate([z, z, y])
            yield ego, np.minimum(one, two), np.maximum(one, two), np.concatenate([yz, xz, xy])

    return dealt.mapInArrow(lean(lambda batches: give(found(batches))), schema)
