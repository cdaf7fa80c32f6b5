"""All ego nets of a graph, packed: found, detected and turned into persona edges without writing or joining their rows.

Egos are dealt to groups of about equal numbers of neighbours, by bounds from a
sample, which decides sizes only. The tasks that list triangles send the net
edges of a group packed by bytes, the edges their ends; a group's task puts
its nets together and detects them. Both ends of an edge meet the same way for
the persona edges, where the driver holds one persona id a node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlight.runtime import cut, ensure_importable, lean

from . import triangles
from .detect import ArrayDetector
from .sweeps import _share

GROUP, HELD, AT_ONCE, SAMPLE = 20_000, 500_000, 60_000, 400_000
PACKS = "key long, kind int, data binary"
LABELS = "ego long, node long, local_comm long, rank long, weight double, lead boolean"


def pack(*cols: np.ndarray) -> bytes:
    """Columns of whole numbers by their lowest bytes, as many as they need above their least; then the weights, as bytes if they are whole and small."""
    out, head = [], [len(cols[0])]
    for c in cols[:-1]:
        low = int(c.min())
        size = max(1, (int(c.max()) - low).bit_length() + 7 >> 3)
        out.append(np.ascontiguousarray((c - low).astype("<i8").view(np.uint8).reshape(-1, 8)[:, :size].T).tobytes())
        head += [low, size]
    w = cols[-1]
    small = w.astype(np.uint8) if w.min() >= 0 and w.max() < 256 else w
    w = small if (small == w).all() else w.astype("<f8")
    return np.array([*head, w.itemsize], "<i8").tobytes() + b"".join(out) + w.tobytes()


def unpack(raw, cols: int) -> list[np.ndarray]:
    head = np.frombuffer(raw, "<i8", 2 * cols)
    n, at, out = int(head[0]), 16 * cols, []
    for low, size in head[1:-1].reshape(-1, 2).tolist():
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :size] = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T
        out.append(wide.view("<i8").reshape(-1) + low)
        at += n * size
    return [*out, np.frombuffer(raw, "u1" if head[-1] == 1 else "<f8", n, at).astype(float)]


def by_first(cols: list[np.ndarray]) -> list[np.ndarray]:
    """Rows in the order of the first two columns."""
    a, b = cols[0] - cols[0].min(), cols[1] - cols[1].min()
    span = int(b.max()) + 1
    order = np.argsort(a * span + b, kind="stable") if (int(a.max()) + 1).bit_length() + span.bit_length() < 63 else np.lexsort((b, a))
    return [c[order] for c in cols]


def grouped(held: list[tuple[np.ndarray, ...]], bounds: np.ndarray, kind: int, without: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows by the group of their first column, packed."""
    cols = [np.concatenate(x) for x in zip(*held)]
    if len(without):
        cols = [c[keep] for keep in [~np.isin(cols[0], without)] for c in cols]
    if not len(cols[0]):
        return
    cols = by_first(cols)
    group = np.searchsorted(bounds, cols[0])
    at = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(group)]])
    data = [pack(*(c[a:b] for c in cols)) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
    yield pa.RecordBatch.from_arrays([pa.array(group[at[:-1]]), pa.array([kind] * len(data), pa.int32()), pa.array(data, pa.binary())], ["key", "kind", "data"])


def gathered(found: Iterator[tuple[np.ndarray, ...]], bounds: np.ndarray, kind: int, without: np.ndarray) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for cols in found:
        held.append(cols)
        size += len(cols[0])
        if size >= HELD:
            yield from grouped(held, bounds, kind, without)
            held, size = [], 0
    if held:
        yield from grouped(held, bounds, kind, without)


def both_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    for b in batches:
        src, dst, w = (b.column(k).to_numpy() for k in range(3))
        yield np.concatenate([src, dst]), np.concatenate([dst, src]), np.concatenate([w, w])


def by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[int, list]]]:
    """(key, kind -> packed rows) of rows in the order of their keys."""
    now, held = None, {}
    for b in batches:
        for key, kind, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            if key != now and held:
                yield now, held
                held = {}
            now = key
            held.setdefault(kind, []).append(data.as_buffer())
    if held:
        yield now, held


def labelled(members: list[np.ndarray], nets: list[np.ndarray], local: ArrayDetector) -> Iterator[tuple[np.ndarray, ...]]:
    """(ego, node, local_comm, rank, weight, lead) of whole nets; those without weight give each neighbour a community of its own."""
    ego, node, weight = by_first(members)
    names, number = np.unique(ego, return_inverse=True)
    known, place = np.unique(node, return_inverse=True)
    key = number * len(known) + place  # ascending
    starts = np.searchsorted(number, np.arange(len(names)))
    label = np.arange(len(ego)) - starts[number]
    if len(nets[0]):
        of = np.searchsorted(names, nets[0])
        order = np.argsort(of, kind="stable")
        of, src, dst, w = of[order], nets[1][order], nets[2][order], nets[3][order]
        heavy = np.bincount(of, w, minlength=len(names)) > 0
        ends = np.searchsorted(of, np.arange(len(names) + 1))
        here = np.append(starts, len(ego))
        work = np.cumsum(np.diff(ends) + np.diff(here))
        first = 0
        while first < len(names):  # some nets at once
            stop = max(first + 1, int(np.searchsorted(work, (work[first - 1] if first else 0) + AT_ONCE, side="right")))
            mine = np.flatnonzero(heavy[number[here[first] : here[stop]]]) + here[first]
            if len(mine):
                own = np.arange(ends[first], ends[stop])
                own = own[heavy[of[own]]]
                group = np.unique(number[mine], return_inverse=True)[1]
                find = lambda x: np.searchsorted(key[mine], of[own] * len(known) + np.searchsorted(known, x[own]))  # noqa: E731,B023
                label[mine] = local.detect_arrays(node[mine], group, find(src), find(dst), w[own])
            first = stop
    low = int(label.min())
    span = int(label.max()) - low + 1
    there, lead, at = np.unique(number * span + (label - low), return_index=True, return_inverse=True)  # the distinct communities of each ego, in order
    rank = at - np.searchsorted(there // span, np.arange(len(names)))[number]
    yield ego, node, label, rank, weight, np.bincount(lead, minlength=len(ego)) > 0


def labels(plain: DataFrame, rows: int, local: ArrayDetector, without: np.ndarray) -> DataFrame:
    """(ego, node, local_comm, rank, weight, lead) of all egos but ``without``: the community of each neighbour, its rank among the ego's, the edge's weight, and whether it is the first of its community.

    plain: written edges, one row for each pair of nodes, no self-loops.
    """
    ensure_importable(plain.sparkSession)
    ends = plain.sample(min(1.0, SAMPLE / 2 / max(rows, 1)), 1).select(F.explode(F.array("src", "dst")).alias("id")).toArrow().column(0).to_numpy()
    groups = max(1, 2 * rows // GROUP)
    bounds = np.unique(np.quantile(ends, np.arange(1, groups) / groups, method="lower")) if len(ends) else np.zeros(0, np.int64)
    nets = triangles.nets(plain, written=True, give=lambda found: gathered(found, bounds, 1, without), schema=PACKS)
    members = plain.select("src", "dst", "weight").mapInArrow(lean(lambda batches: gathered(both_ends(batches), bounds, 0, without)), PACKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, kinds in by_key(batches):
            own = [np.concatenate(x) for x in zip(*(unpack(d, 3) for d in kinds[0]))]
            net = [np.concatenate(x) for x in zip(*(unpack(d, 4) for d in kinds[1]))] if 1 in kinds else [np.zeros(0, np.int64)] * 3 + [np.zeros(0)]
            for cols in labelled(own, net, local):
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols[:4]] + [pa.array(c) for c in cols[4:]], ["ego", "node", "local_comm", "rank", "weight", "lead"])

    return nets.unionByName(members).withColumn("_deal", F.xxhash64("key")).repartition("_deal").sortWithinPartitions("key").drop("_deal").mapInArrow(lean(run), LABELS)


def persona_edges(found: DataFrame, rows: int, nodes: np.ndarray, first: np.ndarray) -> DataFrame:
    """(src, dst, weight): each edge between the two personas that its ends have for it. first: the least persona id of each of the nodes, in order."""
    spark = found.sparkSession
    ensure_importable(spark)
    n, parts = len(nodes), max(1, rows // 100_000)
    bounds = (np.arange(1, parts) * n // parts) - 1
    shared = _share(spark, nodes, first)

    def halves(batches: Iterator[pa.RecordBatch], low: bool) -> Iterator[tuple[np.ndarray, ...]]:
        for b in batches:
            ego, node, rank, w = (b.column(k).to_numpy() for k in range(4))
            ego, node = np.searchsorted(shared.value[0], ego), np.searchsorted(shared.value[0], node)
            own = ego < node if low else ego > node
            if own.any():
                yield (ego[own], node[own], rank[own], w[own]) if low else (node[own], ego[own], rank[own], np.zeros(int(own.sum())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = shared.value[1]
        for _, kinds in by_key(batches):
            a, b = (by_first([np.concatenate(x) for x in zip(*(unpack(d, 4) for d in kinds[k]))]) for k in (0, 1))
            one, two = start[a[0]] + a[2], start[b[1]] + b[2]  # the same edges in the same order
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(one, two)), pa.array(np.maximum(one, two)), pa.array(a[3])], ["src", "dst", "weight"])

    none = np.zeros(0, np.int64)
    narrow = found.select("ego", "node", "rank", "weight")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low in (True, False):
                yield from gathered(halves([b], low), bounds, 0 if low else 1, none)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches of some size, so that packed rows are long."""
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= HELD:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    table = cut(narrow.mapInArrow(lean(lambda batches: send(joined(batches))), PACKS).withColumn("_deal", F.xxhash64("key")).repartition("_deal").sortWithinPartitions("key").drop("_deal").mapInArrow(lean(run), "src long, dst long, weight double"))
    shared.destroy()
    return table
