"""The levels of detection with edges packed in tasks and one number a node on the driver.

While a graph has at most ``NODES`` nodes (counted), the driver keeps each
node's community and sends it to the tasks, as broadcast arrays. Edges stay in
the cluster: each end of an edge lies in a row of (bucket, data) with all other
ends of its node, dealt by node number, so a step is one stage without a
shuffle, and only the nodes that move come back. Contraction shuffles packed
ends that were summed in the task before. The rule is that of the join loop
(detect.py) and of the kernel; levels of few edges are handled on the driver
by the same functions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlight.runtime import cut, drop, ensure_importable, lean

from .kernel import MoveOptions, bucket_of, dense

NODES, PART, BATCH, AT_ONCE = 32_000_000, 1_000_000, 400_000, 2_000_000
Ends = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # nodes, how many ends each has, the other ends in order, weights


@dataclass(frozen=True)
class Level:
    """Nodes 0 to n - 1 and their edges' ends: a table (bucket, ends, data), or the same rows on the driver."""

    spark: SparkSession
    n: int
    table: DataFrame | None
    rows: list[tuple[int, bytes]] | None = None


@dataclass
class Found:
    community: np.ndarray
    modularity: float
    passes: int
    moves: int


def unpack(raw) -> Ends:
    nodes, ends, size = np.frombuffer(raw, "<i8", 3).tolist()
    at = 24 + size * ends
    w = np.frombuffer(raw, "u1" if size == 1 else "<f8", ends, 24).astype(float)
    low = np.frombuffer(raw, np.uint8, 4 * ends, at + 8 * nodes).reshape(4, -1)
    dst = low[0].astype(np.int32)
    for k in (1, 2, 3):
        if k < 3 or low[k].any():
            dst |= low[k].astype(np.int32) << 8 * k
    return np.frombuffer(raw, "<i4", nodes, at).astype(np.int64), np.frombuffer(raw, "<i4", nodes, at + 4 * nodes), dst, w


def merged(key: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order and the sums of their weights.

    Whole weights ride along in the low digits where they fit, as sorting
    numbers is faster than sorting places.
    """
    if not len(key):
        return key, w
    top = float(w.max())
    bits = int(top).bit_length() if 0 <= float(w.min()) and top < 1 << 31 else 63
    if int(key.max()).bit_length() + bits < 63 and ((whole := w.astype(np.int64)) == w).all():
        both = np.sort(key << bits | whole)
        key, w = both >> bits, (both & ((1 << bits) - 1)).astype(float)
    else:
        order = np.argsort(key, kind="stable")
        key, w = key[order], w[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    if new.all():
        return key, w
    first = np.flatnonzero(new)
    return key[first], np.add.reduceat(w, first)


def summed(key: np.ndarray, s: np.ndarray, d: np.ndarray, w: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """Ends in the order of (key, s, d), equal ones summed; s decides the key."""
    bits = max(1, n.bit_length())
    if int(key.max(initial=0)).bit_length() + 2 * bits < 63:
        both, w = merged((key << bits | s) << bits | d, w)
        there = (1 << bits) - 1
        return both >> 2 * bits, both >> bits & there, both & there, w
    order = np.lexsort((d, s, key))
    key, s, d, w = key[order], s[order], d[order], w[order]
    new = np.concatenate([[True], (s[1:] != s[:-1]) | (d[1:] != d[:-1])])
    if new.all():
        return key, s, d, w
    first = np.flatnonzero(new)
    return key[first], s[first], d[first], np.add.reduceat(w, first)


def packed(key: np.ndarray, s: np.ndarray, d: np.ndarray, w: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """(key, ends, data) of ends in order: other ends by their lowest bytes, then the next; a key's weights as bytes if all are whole and small."""
    if not len(key):
        return
    cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    first = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (key[1:] != key[:-1])]))
    nodes, count = s[first].astype("<i4"), np.diff(np.append(first, len(s))).astype("<i4")
    of = np.searchsorted(first, cuts)
    low = np.ascontiguousarray(d.astype("<i4").view(np.uint8).reshape(-1, 4).T)
    small = np.where((w >= 0) & (w < 256), w, 0.5).astype(np.uint8)
    bytewise = np.logical_and.reduceat(small == w, cuts[:-1])
    w = w.astype("<f8", copy=False)
    for k, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
        x, y = of[k], of[k + 1]
        own = small if bytewise[k] else w
        yield int(key[a]), b - a, np.array([y - x, b - a, own.itemsize], "<i8").tobytes() + own[a:b].tobytes() + nodes[x:y].tobytes() + count[x:y].tobytes() + low[:, a:b].tobytes()


def dealt(s: np.ndarray, d: np.ndarray, w: np.ndarray, of: Callable[[np.ndarray], np.ndarray], n: int, parts: int, options: MoveOptions) -> Iterator[tuple[int, int, bytes]]:
    """Edges (s, d) from both ends, a self-loop once, by bucket and part of the end's node."""
    turn = s != d
    yield from dealt_ends(np.concatenate([s, d[turn]]), np.concatenate([d, s[turn]]), np.concatenate([w, w[turn]]), of, n, parts, options)


def dealt_ends(s: np.ndarray, d: np.ndarray, w: np.ndarray, of: Callable[[np.ndarray], np.ndarray], n: int, parts: int, options: MoveOptions) -> Iterator[tuple[int, int, bytes]]:
    """Ends of edges by bucket and part of their node."""
    key = bucket_of(of(s), options.seed, options.buckets) * parts + s % parts
    yield from packed(*summed(key, s, d, w, n))


def _share(spark: SparkSession, *values):
    return spark.sparkContext.broadcast(values)


def _built(packs: DataFrame, n: int, parts: int, local: int) -> Level:
    """The level of packed ends (key, ends, data): one row for each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            for key, data in zip(b.column(0).to_pylist(), b.column(1)):
                if key != now and held:
                    yield done(now, held)
                    held = []
                now = key
                held.append(data.as_buffer().to_pybytes())
        if held:
            yield done(now, held)

    def done(key: int, held: list[bytes]) -> pa.RecordBatch:
        if len(held) > 1:
            s, d, w = joined([unpack(x) for x in held])
            ((_, ends, data),) = packed(*summed(np.zeros(len(s), np.int64), s, d, w, n))
        else:
            data, ends = held[0], int(np.frombuffer(held[0], "<i8", 2)[1])
        return pa.RecordBatch.from_arrays([pa.array([ends]), pa.array([data], pa.binary()), pa.array([key // parts], pa.int32())], ["ends", "data", "bucket"])

    table = cut(packs.repartition("key").sortWithinPartitions("key").select("key", "data").mapInArrow(lean(run), "ends long, data binary, bucket int"), "bucket")
    spark = packs.sparkSession
    if (table.agg(F.sum("ends")).first()[0] or 0) > local:
        return Level(spark, n, table)
    rows = [(r.bucket, bytes(r.data)) for r in table.collect()]
    drop(table)
    return Level(spark, n, None, rows)


def joined(some: list[Ends]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(s, d, weight) of packed ends."""
    return np.concatenate([np.repeat(x[0], x[1]) for x in some]), np.concatenate([x[2].astype(np.int64) for x in some]), np.concatenate([x[3] for x in some])


def _rows(rows: Iterator[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    """In one batch: there are many rows of few ends."""
    keys, _, data = zip(*found) if (found := list(rows)) else ((), (), ())
    if keys:
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(data, pa.binary())], ["key", "data"])


@dataclass(frozen=True)
class Names:
    """The ids of nodes 0 to n - 1, ascending: base, base + 1, ... or else ``ids``."""

    n: int
    base: int
    ids: np.ndarray | None

    def places(self, ids: np.ndarray) -> np.ndarray:
        return ids - self.base if self.ids is None else np.searchsorted(self.ids, ids)

    def of(self, places: np.ndarray) -> np.ndarray:
        return places + self.base if self.ids is None else self.ids[places]


def names_of(vertices: DataFrame) -> Names:
    """vertices (id), distinct; ids are sent to the driver only if they have gaps."""
    low, high, n = vertices.agg(F.min("id"), F.max("id"), F.count(F.lit(1))).first()
    return Names(n, low, None if high - low + 1 == n else np.sort(vertices.select("id").toArrow().column(0).to_numpy()))


def start_of(prior: DataFrame, vertices: DataFrame, names: Names) -> np.ndarray:
    """A community for each node from a written prior (node, community), numbered by least nodes: what partition.warm_start() gives, with one number a node.

    Only entries of nodes are sent; without gaps in the ids a comparison tells them.
    """
    prior = prior.filter("community is not null")
    if names.ids is None:
        own = prior.filter((F.col("node") >= names.base) & (F.col("node") < names.base + names.n)).select((F.col("node") - names.base).cast("int").alias("node"), "community")
    else:
        own = prior.join(vertices.select(F.col("id").alias("node")), "node", "left_semi")
    high = prior.agg(F.max("community")).first()[0] or 0
    t = own.withColumn("community", F.col("community").cast("int" if high < 1 << 31 else "long")).toArrow()
    place, had = t.column(0).to_numpy(), t.column(1).to_numpy()
    del t
    place = place if names.ids is None else names.places(place).astype(np.int32)
    if high >= 4 * names.n + 1000:
        had = dense(had)[0]
    first = np.full(int(had.max(initial=0)) + 1, names.n, np.int32)
    np.minimum.at(first, had, place)
    start = np.arange(names.n, dtype=np.int32)
    start[place] = first[had]
    return compact(start, names.n)[0]


def first_level(edges: DataFrame, rows: int, names: Names, options: MoveOptions, local: int) -> Level:
    """The level of edges (src, dst, weight), one row for each pair of nodes."""
    spark, n = edges.sparkSession, names.n
    ensure_importable(spark)
    parts = max(1, -(-2 * rows // PART))
    known = _share(spark, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= BATCH:
                yield from done(known.value[0], held)
                held, size = [], 0
        if size:
            yield from done(known.value[0], held)

    def done(names: Names, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        src, dst, w = (np.concatenate([b.column(k).to_numpy() for b in held]) for k in range(3))
        yield from _rows(dealt(names.places(src), names.places(dst), w, names.of, n, parts, options))

    level = _built(edges.select("src", "dst", "weight").mapInArrow(lean(run), "key long, data binary"), n, parts, local)
    known.destroy()
    return level


def each(level: Level, work: Callable[..., tuple[np.ndarray, ...]], kinds: dict[str, str], *arrays: np.ndarray, bucket: int | None = None) -> list[np.ndarray]:
    """What ``work`` gives for each row of ends and the arrays, in columns ``kinds``, for one bucket or all."""
    if level.table is None:
        found = [work(*unpack(data), *arrays) for b, data in level.rows if bucket is None or b == bucket]
        return [np.concatenate([f[k] for f in found]) if found else np.zeros(0, kind) for k, kind in enumerate(kinds.values())]
    shared = _share(level.spark, *arrays)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                got = work(*unpack(data.as_buffer()), *shared.value)
                if len(got[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(x.astype(k)) for x, k in zip(got, kinds.values())], list(kinds))

    rows = level.table if bucket is None else level.table.filter(F.col("bucket") == bucket)
    sql = {"int32": "int", "int64": "long", "float64": "double"}
    t = rows.select("data").mapInArrow(lean(run), ", ".join(f"{k} {sql[v]}" for k, v in kinds.items())).toArrow()
    out = [t.column(k).to_numpy() for k in kinds]
    shared.destroy()
    return out


def strengths(nodes, count, dst, w):
    return nodes, np.add.reduceat(w, np.cumsum(count) - count), np.add.reduceat(np.where(dst == np.repeat(nodes, count), w, 0.0), np.cumsum(count) - count)


def movers(nodes, count, dst, w, comm, total, setting):
    """(node, community, strength) of the nodes that move: each takes the best score, ties to the lowest community."""
    n, (factor, resolution) = len(comm), setting
    k = np.add.reduceat(w, np.cumsum(count) - count)
    place = np.concatenate([np.repeat(np.arange(len(nodes)), count), np.arange(len(nodes))])
    key, kin = merged(place * n + np.concatenate([comm[dst], comm[nodes]]), np.concatenate([w, np.zeros(len(nodes))]))
    place, to = key // n, key % n
    stay = to == comm[nodes][place]
    score = factor * kin - resolution * (total[to].astype(float) - np.where(stay, k[place], 0.0)) * k[place]
    starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))  # each node has its own community at least
    best = np.maximum.reduceat(score, starts)
    is_best = np.flatnonzero(score == best[place])
    target = to[is_best[np.searchsorted(is_best, starts)]]
    goes = (best > score[stay]) & (k > 0)
    return nodes[goes], target[goes], k[goes]


def inside(nodes, count, dst, w, comm, loops):
    """The weight of ends whose edge lies inside a community; self-loops only at the first level."""
    s = np.repeat(nodes, count)
    return (np.array([w[(comm[dst] == comm[s]) & (loops[0] | (dst != s))].sum()]),)


def least(nodes, count, dst, w, comm, label, left):
    """(node, label): the least label among neighbours of the same community, where it is less than the node's; of nodes that are left."""
    mine = left[nodes]
    if not mine.all():
        nodes, count, dst = nodes[mine], count[mine], dst[np.repeat(mine, count)]
    if not len(nodes):
        return nodes, nodes
    low = np.minimum.reduceat(np.where(comm[dst] == np.repeat(comm[nodes], count), label[dst], len(comm)), np.cumsum(count) - count)
    less = low < label[nodes]
    return nodes[less], low[less]


def sweep(level: Level, comm: np.ndarray, total: np.ndarray, m: float, options: MoveOptions) -> tuple[np.ndarray, int]:
    """One sweep over all buckets, in place; total: the strength of each community."""
    factor = 4.0 if options.gain == "reference" else 2.0
    moves = 0
    for r in range(options.buckets):
        small = total.astype(np.float32)  # sent so only where nothing is lost
        small = small if (small == total).all() else total
        node, to, k = each(level, movers, {"node": "int32", "to": "int32", "k": "float64"}, comm, small, (factor * m, options.resolution), bucket=r)
        np.subtract.at(total, comm[node], k)
        np.add.at(total, to, k)
        comm[node] = to
        moves += len(node)
    return comm, moves


def connected(level: Level, comm: np.ndarray) -> np.ndarray:
    """Communities cut into connected parts, numbered by (community, least node): labels sink along edges and through the nodes they name."""
    label = np.arange(level.n, dtype=np.int32)
    own = label.copy()
    while True:
        left = (np.bincount(comm[label == own], minlength=level.n) > 1)[comm]  # whole communities of one label are done
        node, low = each(level, least, {"node": "int32", "low": "int32"}, comm, label, left) if left.any() else (own[:0], own[:0])
        if not len(node):
            return dense(comm, label)[0].astype(np.int32)
        np.minimum.at(label, label[node], low)
        np.minimum.at(label, node, low)
        while not ((up := label[label]) == label).all():
            label = up


def contracted(level: Level, comm: np.ndarray, count: int, options: MoveOptions, local: int) -> Level:
    """The communities (0 to count - 1) as nodes of the next level; what lies inside becomes a self-loop."""
    half = 0.5 if options.self_loops == "reference" else 1.0

    def new(some: list[Ends], comm: np.ndarray, parts: int) -> Iterator[tuple[int, int, bytes]]:
        s, d, w = joined(some)
        a, b = comm[s].astype(np.int64), comm[d].astype(np.int64)
        once = (a != b) | (s <= d)  # an edge between two communities has an end of each already
        if half != 1:
            w = np.where(s == d, half * w, w)
        yield from dealt_ends(a[once], b[once], w[once], lambda places: places, count, parts, options)

    if level.table is None:
        rows = list(new([unpack(x) for _, x in level.rows], comm, 1)) if level.rows else []
        return Level(level.spark, count, None, [(key, data) for key, _, data in rows])
    ends = level.table.agg(F.sum("ends")).first()[0]
    parts = max(1, -(-ends // PART))
    shared = _share(level.spark, comm)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for data in b.column(0):
                held.append(unpack(data.as_buffer()))
                size += len(held[-1][2])
                if size >= 2 * BATCH:
                    yield from _rows(new(held, shared.value[0], parts))
                    held, size = [], 0
        if held:
            yield from _rows(new(held, shared.value[0], parts))

    built = _built(level.table.select("data").mapInArrow(lean(run), "key long, data binary"), count, parts, local)
    shared.destroy()
    return built


def detect(edges: DataFrame, rows: int, names: Names, options: MoveOptions, start: np.ndarray | None, local: int) -> Found:
    """The loop over levels; start: a community below names.n for each node. Levels of at most ``local`` edges are taken to the driver."""
    level = first_level(edges, rows, names, options, 2 * local)
    at = best = degree = None
    best_q, inner, two_m, passes, moves, last = float("-inf"), 0.0, 0.0, 0, 0, False
    while not last:
        n = level.n
        comm = np.arange(n, dtype=np.int32) if start is None or passes else start.astype(np.int32, copy=False)
        total, ends = np.zeros(n), 0.0
        for r in range(options.buckets) if n > AT_ONCE else [None]:  # some nodes at once
            node, own, loop = each(level, strengths, {"node": "int32", "k": "float64", "loop": "float64"}, bucket=r)
            total[node] = own
            ends += float(own.sum()) + float(loop.sum())
        if degree is None and options.connected:  # parts need the strengths of their nodes; else the sweep's sums do
            degree = total.copy()
        if start is not None and not passes:
            total = np.bincount(comm, total, minlength=n)
        two_m = two_m or ends
        comm, moved = sweep(level, comm, total, ends / 2, options)
        if options.connected:
            comm = connected(level, comm)
        comm, count, before = *compact(comm, n), comm
        passes, moves = passes + 1, moves + moved
        inner += float(each(level, inside, {"w": "float64"}, comm, np.array([passes == 1]))[0].sum())
        if degree is None:
            degree = np.zeros(count)
            degree[comm] = total[before]
        else:
            degree = np.bincount(comm, degree, minlength=count)
        q = float(inner / two_m - options.resolution * (degree * degree).sum() / (two_m * two_m))
        found = comm if at is None else comm[at]
        if q > best_q + 1e-15:
            best, best_q = found, q
        last = moved == 0 or (options.max_passes > 0 and passes >= options.max_passes) or count <= 1 or count == n
        after = None if last else contracted(level, comm, count, options, 2 * local)
        if level.table is not None:
            drop(level.table)
        at, level = found, after
    return Found(best, best_q, passes, moves)


def compact(comm: np.ndarray, n: int) -> tuple[np.ndarray, int]:
    """Communities below n numbered from 0 in the order of their ids, and how many there are."""
    there = np.zeros(n, bool)
    there[comm] = True
    number = np.cumsum(there, dtype=np.int32) - np.int32(1)
    return number[comm], int(number[-1]) + 1


def partition(spark: SparkSession, names: Names, community: np.ndarray) -> DataFrame:
    """(node, community) as a table, written by the tasks."""
    shared = _share(spark, names, community)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i = b.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(shared.value[0].of(i)), pa.array(shared.value[1][i].astype(np.int64))], ["node", "community"])

    ensure_importable(spark)
    table = cut(spark.range(names.n).mapInArrow(lean(run), "node long, community long"))
    shared.destroy()
    return table
