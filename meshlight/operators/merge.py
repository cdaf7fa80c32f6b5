"""Merging of small communities after detection.

The rule is sequential: candidates go by (size, id) and each sees what earlier
ones did. It needs only the graph of communities, contracted in Spark. While
that graph has at most ``local_rows`` rows (counted), it is walked on the
driver. Beyond that candidates merge in rounds of joins: a candidate takes its
turn when no earlier one is left that touches it, or touches what its gain
depends on. Candidates that don't touch each other neither read nor write the
same sums, so the rounds give what the walk gives.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlight.errors import InvalidMergeOptions, PartitionGraphMismatch
from meshlight.functions.metrics import modularity
from meshlight.runtime import cut, ensure_importable, lean

from .detect import CommunityResult
from .ego import OverlappingResult, sent
from .graph import Graph
from .partition import contract, normalize
from .skew import spread_join

LOCAL_ROWS, LOCAL_MEMBERS, LINKS, BIN = 500_000, 5_000_000, 20_000_000, 500_000


@dataclass(frozen=True)
class MergeOptions:
    """A community is small below max(min_size, ceil(min_fraction * nodes)). strategy: "connectivity" or "modularity"."""

    min_size: int = 0
    min_fraction: float = 0.0
    strategy: str = "connectivity"
    resolution: float = 0.0

    def check(self) -> None:
        if self.min_size < 0 or not 0 <= self.min_fraction <= 1 or self.strategy not in ("connectivity", "modularity"):
            raise InvalidMergeOptions(f"bad merge options: {self}")

    def threshold(self, nodes: int) -> int:
        return max(self.min_size, math.ceil(self.min_fraction * nodes))


def candidates(partition: DataFrame, threshold: int) -> DataFrame:
    """(community, size) of small communities, in the order in which they are merged."""
    return partition.groupBy("community").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") < threshold).orderBy("size", "community")


def best_target(links: dict[int, float], strength: dict[int, float], own: int, total: float, options: MergeOptions) -> int:
    """The community to join: most weight, or the gain 2w/m - 2 r s t / m^2; ties to the lowest id."""
    if options.strategy == "connectivity" or total == 0:
        return min(links, key=lambda c: (-links[c], c))
    r = options.resolution or 1.0
    gain = {c: 2 * w / total - 2 * r * strength.get(own, 0.0) * strength.get(c, 0.0) / (total * total) for c, w in links.items()}
    return min(gain, key=lambda c: (-gain[c], c))


def merge_communities(graph: Graph, result: CommunityResult, options: MergeOptions, local_rows: int = LOCAL_ROWS) -> CommunityResult:
    """Merges small communities into neighbours; those without an edge outside stay. Passes and moves are 0 in the result."""
    options.check()
    graph = graph.kept()
    part = cut(result.partition.select("node", "community"))
    ids = graph.vertices.select(F.col("id").alias("node"))
    if not part.join(ids, "node", "left_anti").isEmpty():
        raise PartitionGraphMismatch("the partition has nodes that the graph lacks")
    threshold = options.threshold(part.count())
    small = candidates(part, threshold)
    if small.isEmpty():
        return CommunityResult(normalize(part), lambda: modularity(graph, part).first()[0], 0, 0)
    links = cut(contract(graph.merged, part).filter("src <> dst"))
    strength = part.groupBy("community").agg(F.count(F.lit(1)).alias("size")).join(graph.community_strength(part), "community", "left")
    sums = cut(strength.select("community", "size", F.coalesce("strength", F.lit(0.0)).alias("strength")))
    total = graph.total_weight().first()[0]
    walk = _walk if links.count() + sums.count() <= local_rows else _rounds
    moved = walk(links, sums, threshold, total, options)
    merged = cut(normalize(part.join(moved, "community", "left").select("node", F.coalesce("_to", "community").alias("community"))))
    return CommunityResult(merged, lambda: modularity(graph, merged).first()[0], 0, 0)


def _walk(links: DataFrame, sums: DataFrame, threshold: int, total: float, options: MergeOptions) -> DataFrame:
    """(community, _to) of the communities that merged: the rule as it stands, on a graph of bounded size."""
    near: dict[int, dict[int, float]] = {}
    for a, b, w in links.select("src", "dst", "weight").collect():
        near.setdefault(a, {})[b] = w
        near.setdefault(b, {})[a] = w
    sizes, strength = {}, {}
    for c, n, k in sums.select("community", "size", "strength").collect():
        sizes[c], strength[c] = n, k
    into: dict[int, int] = {}
    for _, c in sorted((n, c) for c, n in sizes.items() if n < threshold):
        if sizes[c] >= threshold or not near.get(c):
            continue
        target = best_target(near[c], strength, c, total, options)
        into[c] = target
        sizes[target] += sizes[c]
        strength[target] += strength[c]
        for other, w in near.pop(c).items():
            near[other].pop(c, None)
            if other != target:
                near[target][other] = near[target].get(other, 0.0) + w
                near[other][target] = near[target][other]
    return links.sparkSession.createDataFrame([(c, _last(into, c)) for c in into], "community long, _to long")


def _last(into: dict[int, int], c: int) -> int:
    end = c
    while end in into:
        end = into[end]
    while c != end:  # the way is shorter next time
        into[c], c = end, into[c]
    return end


def both_ways(links: DataFrame) -> DataFrame:
    return links.select("src", "dst", "weight").unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def targets(both: DataFrame, ready: DataFrame, sums: DataFrame, total: float, options: MergeOptions) -> DataFrame:
    """(community, _to): what each community of ``ready`` would join; both (src, dst, weight) are the links from both ends."""
    own = both.join(ready.select(F.col("community").alias("src")), "src", "left_semi")
    gain = F.col("weight")
    if options.strategy != "connectivity" and total:
        of = lambda end, name: sums.select(F.col("community").alias(end), F.col("strength").alias(name))
        own = spread_join(own.join(of("src", "s"), "src"), of("dst", "t"), ["dst"], F.col("src"))
        gain = 2 * F.col("weight") / total - 2 * F.lit(options.resolution or 1.0) * F.col("s") * F.col("t") / (total * total)
    best = own.groupBy("src").agg(F.max(F.struct(gain.alias("gain"), (-F.col("dst")).alias("low"))).alias("b"))
    return best.select(F.col("src").alias("community"), (-F.col("b.low")).alias("_to"))


def _least_near(links: DataFrame, turns: DataFrame) -> DataFrame:
    """(community, turn): the least turn of each community and those linked to it; links stand from both ends."""
    seen = spread_join(links.select("src", "dst"), turns.withColumnRenamed("community", "dst"), ["dst"], F.col("src")).select(F.col("src").alias("community"), "turn")
    return seen.unionByName(turns.select("community", "turn")).groupBy("community").agg(F.min("turn").alias("turn"))


def _ready(waiting: DataFrame, links: DataFrame, far: bool) -> DataFrame:
    """(community): candidates whose turn it is. ``far`` looks at neighbours of neighbours too, whose sums a gain may share."""
    least = _least_near(links, waiting.select("community", "turn"))
    least = _least_near(links, least) if far else least
    return waiting.join(least.withColumnRenamed("turn", "first"), "community").filter(F.col("turn") == F.col("first")).select("community")


def _renamed(moved: DataFrame, name: str) -> DataFrame:
    return moved.select(F.col("community").alias(name), F.col("_to").alias(f"_{name}"))


def _rounds(links: DataFrame, sums: DataFrame, threshold: int, total: float, options: MergeOptions) -> DataFrame:
    """The same as _walk, in rounds; names (community, _to) follow a community through all merges."""
    turn = F.struct("size", F.col("community").alias("id"))
    waiting = cut(sums.filter(F.col("size") < threshold).select("community", turn.alias("turn")))
    names = sums.select("community", F.col("community").alias("_to"))
    both = cut(both_ways(links))
    while True:
        open_ = waiting.join(sums.filter(F.col("size") < threshold).select("community"), "community", "left_semi")
        waiting = cut(open_.join(both.select(F.col("src").alias("community")).distinct(), "community", "left_semi"))
        if waiting.isEmpty():
            return names.filter("community <> _to")
        ready = cut(_ready(waiting, both, options.strategy == "modularity"))
        moved = cut(targets(both, ready, sums, total, options))
        waiting = waiting.join(moved, "community", "left_anti")
        names = cut(names.join(moved.select(F.col("community").alias("_to"), F.col("_to").alias("_now")), "_to", "left").select("community", F.coalesce("_now", "_to").alias("_to")))
        sums = cut(sums.join(moved, "community", "left").groupBy(F.coalesce("_to", "community").alias("community")).agg(F.sum("size").alias("size"), F.sum("strength").alias("strength")))
        near = both.join(_renamed(moved, "src"), "src", "left").join(_renamed(moved, "dst"), "dst", "left")
        near = near.select(F.coalesce("_src", "src").alias("src"), F.coalesce("_dst", "dst").alias("dst"), "weight").filter("src <> dst")
        both = cut(near.groupBy("src", "dst").agg(F.sum("weight").alias("weight")))


def overlap_counts(members: DataFrame, small: DataFrame) -> DataFrame:
    """(community, other, shared): members that a small community shares with each other one."""
    a = members.join(small.select("community"), "community", "left_semi")
    b = members.select("node", F.col("community").alias("other"))
    return a.join(b, "node").filter("community <> other").groupBy("community", "other").agg(F.count(F.lit(1)).alias("shared"))


def merge_overlapping(graph: Graph, result: OverlappingResult, options: MergeOptions, local_rows: int = LOCAL_MEMBERS) -> OverlappingResult:
    """Merges small communities: most shared members, ties to the lowest id, else most edge weight, else not at all.

    Sizes are those from before, growth does not save a candidate. The state to update from is dropped.
    """
    options.check()
    graph = graph.kept()
    members = cut(result.memberships.select("node", "community").distinct())
    threshold = options.threshold(members.select("node").distinct().count() if options.min_fraction else 0)
    small = cut(candidates(members, threshold))
    if small.isEmpty():
        return OverlappingResult(members)
    # merges change only the sets of nodes that candidates touch: their members, and members of what they may join.
    # Edges count where no member is shared; a node in a community that is no candidate shares it to the end
    held = members.join(small.select("community", F.lit(True).alias("_small")), "community", "left").groupBy("node").agg(F.count("_small").alias("had"), F.count(F.lit(1)).alias("n")).filter("had > 0")
    held = cut(held.select("node", (F.col("had") == F.col("n")).alias("bound")))
    edges = cut(graph.adjacency.filter("src <> dst").join(sent(cut(held.filter("bound").select(F.col("node").alias("src")))), "src", "left_semi"))
    around = held.select("node").unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    touched = cut(members.join(around, "node", "left_semi"))
    size = edges.count() + touched.count()
    if size <= local_rows:
        moved = _walk_overlapping(edges, touched, small)
    else:
        bins = _bins(members, edges, touched, small, local_rows) if local_rows else None
        moved = _rounds_overlapping(edges, touched, small) if bins is None else _walk_in_tasks(edges, touched, small, *bins)
    merged = members.join(moved, "community", "left").select("node", F.coalesce("_to", "community").alias("community")).distinct()
    return OverlappingResult(cut(normalize(merged)))


def _walk_overlapping(edges: DataFrame, touched: DataFrame, small: DataFrame) -> DataFrame:
    """(community, _to) of the communities that merged: the rule as it stands, on frames of bounded size."""
    order = small.orderBy("size", "community").toArrow().column("community").to_numpy()
    t = touched.select("node", "community").toArrow()
    into = walked(order, t.column(0).to_numpy(), t.column(1).to_numpy(), edges.select("src", "dst", "weight").toLocalIterator())
    frame = pa.table({"community": pa.array(list(into), pa.int64()), "_to": pa.array([_last(into, c) for c in into], pa.int64())})
    return edges.sparkSession.createDataFrame(frame)


def walked(order: np.ndarray, node: np.ndarray, comm: np.ndarray, edges: Iterable[tuple[int, int, float]]) -> dict[int, int]:
    """What each candidate of ``order`` merges into, from memberships (node, comm) and edges (src, dst, weight)."""
    by_node = np.argsort(node, kind="stable")
    node, comm = node[by_node], comm[by_node]
    first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if len(node) else np.zeros(0, np.int64)
    place = dict(zip(node[first].tolist(), range(len(first))))
    ends = np.append(first, len(node)).tolist()
    own: dict[int, list[int]] = {c: [] for c in order.tolist()}
    mine = np.isin(comm, order)
    for n, c in zip(node[mine].tolist(), comm[mine].tolist()):
        own[c].append(n)
    all_of = comm.tolist()
    weights: dict[int, list[tuple[int, float]]] = {}
    for a, b, w in edges:
        weights.setdefault(a, []).append((b, w))
    into: dict[int, int] = {}

    def now(n: int) -> set[int]:
        """The communities of a node after the merges so far."""
        at = place.get(n)
        return set() if at is None else {_last(into, c) if c in into else c for c in all_of[ends[at] : ends[at + 1]]}

    for c in order.tolist():
        members = set(own[c])
        shared: dict[int, int] = {}
        for n in members:
            for o in now(n) - {c}:
                shared[o] = shared.get(o, 0) + 1
        if shared:
            most = max(shared.values())
            target = min(o for o, k in shared.items() if k == most)
        else:
            weight: dict[int, float] = {}
            for n in members:
                for other, w in weights.get(n, ()):
                    for o in now(other) - {c}:
                        weight[o] = weight.get(o, 0.0) + w
            if not weight:
                continue
            target = min(weight, key=lambda o: (-weight[o], o))
        into[c] = target
        moved = own.pop(c)
        if target in own:
            own[target] += moved
    return into


def _bins(members: DataFrame, edges: DataFrame, touched: DataFrame, small: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Touched nodes in order and the bin of each, so that candidates of different bins never meet; None if a bin can't be had within ``most`` rows.

    A candidate reads and changes only what its members, or neighbours of bound
    ones, are in. So nodes that candidates or these edges link lie in one
    component, and components are walked apart. Only links come to the driver.
    """
    own = cut(members.join(small.select("community"), "community", "left_semi").select("node", "community"))
    if own.count() + edges.count() > LINKS:
        return None
    spark_rows = lambda df: [c.to_numpy() for c in df.toArrow().columns]
    ids, rows = spark_rows(touched.groupBy("node").agg(F.count(F.lit(1)).cast("int").alias("n")))
    order = np.argsort(ids)
    ids, rows = ids[order], rows[order].astype(np.int64)
    of, comm = spark_rows(own.select("node", "community"))
    of = np.searchsorted(ids, of).astype(np.int32)
    src, dst = spark_rows(edges.select("src", "dst"))
    if len(src):
        np.add.at(rows, np.searchsorted(ids, src), 1)
    by_comm = np.argsort(comm, kind="stable")
    comm, of = comm[by_comm], of[by_comm]
    chain = np.flatnonzero(comm[1:] == comm[:-1])  # members of a candidate, one after the other
    a, b = np.concatenate([of[chain], np.searchsorted(ids, src).astype(np.int32)]), np.concatenate([of[chain + 1], np.searchsorted(ids, dst).astype(np.int32)])
    label = np.arange(len(ids), dtype=np.int32)
    while len(a):
        low = label.copy()
        np.minimum.at(low, label[a], label[b])
        np.minimum.at(low, label[b], label[a])
        while not ((up := low[low]) == low).all():
            low = up
        label = low
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    total = np.bincount(label, rows, minlength=len(ids))
    if total.max(initial=0) > most:
        return None
    number = (np.cumsum(total) - total) // max(1, min(most, BIN))  # components one after the other
    return ids, number[label].astype(np.int32)


def _walk_in_tasks(edges: DataFrame, touched: DataFrame, small: DataFrame, ids: np.ndarray, bins: np.ndarray) -> DataFrame:
    """The same as _walk_overlapping, the bins apart from each other."""
    spark = touched.sparkSession
    ensure_importable(spark)
    shared = spark.sparkContext.broadcast((ids, bins))
    sizes = touched.join(small.select("community", "size"), "community", "left").select("node", F.col("community").alias("other"), "size", F.lit(None).cast("double").alias("weight"))
    rows = sizes.unionByName(edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), F.lit(None).cast("long").alias("size"), "weight"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, bins = shared.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(bins[np.searchsorted(ids, b.column(0).to_numpy())])], [*b.schema.names, "bin"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            number = b.column(4).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)]
            for x, y in zip(cuts[:-1], cuts[1:]):
                if x == y:
                    continue
                if number[x] != now and held:
                    yield done(held)
                    held = []
                now = number[x]
                held.append(b.slice(x, y - x))
        if held:
            yield done(held)

    def done(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        edge = t.column(3).is_valid().to_numpy()
        node, other, size = (t.column(k).fill_null(0).to_numpy() for k in range(3))
        weight = t.column(3).fill_null(0.0).to_numpy()[edge]
        own = t.column(2).is_valid().to_numpy()
        comm, at = np.unique(other[own], return_index=True)
        into = walked(comm[np.lexsort((comm, size[own][at]))], node[~edge], other[~edge], zip(node[edge].tolist(), other[edge].tolist(), weight.tolist()))
        return pa.RecordBatch.from_arrays([pa.array(list(into), pa.int64()), pa.array([_last(into, c) for c in into], pa.int64())], ["community", "_to"])

    kinds = "node long, other long, size long, weight double, bin int"
    packed = rows.mapInArrow(lean(deal), kinds).repartition("bin").sortWithinPartitions("bin")
    found = cut(packed.mapInArrow(lean(run), "community long, _to long"))
    shared.destroy()
    return found


def edge_weights(members: DataFrame, edges: DataFrame, small: DataFrame) -> DataFrame:
    """(community, other, weight): summed weight of edges from a small community's members to members of each other one; edges stand from both ends."""
    own = members.join(small.select("community"), "community", "left_semi").withColumnRenamed("node", "src")
    far = own.join(edges, "src")
    met = far.groupBy("community", "dst").agg(F.sum("weight").alias("weight")).join(members.select(F.col("node").alias("dst"), F.col("community").alias("other")), "dst")
    return met.filter("community <> other").groupBy("community", "other").agg(F.sum("weight").alias("weight"))


def _rounds_overlapping(edges: DataFrame, touched: DataFrame, small: DataFrame) -> DataFrame:
    """The same as _walk_overlapping, in rounds: candidates touch each other if they share a member or an edge."""
    waiting = cut(small.select("community", F.struct("size", F.col("community").alias("id")).alias("turn")))
    members = touched
    names = small.select("community", F.col("community").alias("_to"))
    while not waiting.isEmpty():
        shared = cut(overlap_counts(members, waiting))
        weighed = cut(edge_weights(members, edges, waiting))
        pairs = shared.select("community", "other").unionByName(weighed.select("community", "other"))
        links = pairs.select(F.col("community").alias("src"), F.col("other").alias("dst")).unionByName(pairs.select(F.col("other").alias("src"), F.col("community").alias("dst"))).distinct()
        waiting = waiting.join(links.select(F.col("src").alias("community")).distinct(), "community", "left_semi")
        ready = cut(_ready(waiting, links, False))
        best = lambda of, value: of.join(ready, "community", "left_semi").groupBy("community").agg(F.max(F.struct(value, (-F.col("other")).alias("low"))).alias("b")).select("community", (-F.col("b.low")).alias("_to"))
        by_members = best(shared, "shared")
        moved = cut(by_members.unionByName(best(weighed, "weight").join(by_members, "community", "left_anti")))
        waiting = cut(waiting.join(ready, "community", "left_anti"))
        names = cut(names.join(moved.select(F.col("community").alias("_to"), F.col("_to").alias("_now")), "_to", "left").select("community", F.coalesce("_now", "_to").alias("_to")))
        members = cut(members.join(moved, "community", "left").select("node", F.coalesce("_to", "community").alias("community")).distinct())
    return names.filter("community <> _to")


def first_targets(graph: Graph, partition: DataFrame, threshold: int, strategy: str = "connectivity", resolution: float = 1.0) -> DataFrame:
    """(community, target): what each small community would join if it were the first to merge; those without an edge outside are left out."""
    sums = graph.community_strength(partition)
    both = both_ways(contract(graph.merged, partition).filter("src <> dst"))
    total = graph.total_weight().first()[0]
    return targets(both, candidates(partition, threshold), sums, total, MergeOptions(strategy=strategy, resolution=resolution)).withColumnRenamed("_to", "target")
