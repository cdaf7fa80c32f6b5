"""Disjoint communities: multi-level local moving on DataFrames.

One level is one sweep: nodes are dealt to ``buckets`` by a hash of id and
seed, and the buckets choose in turn, each node by the gain against the state
its bucket finds, ties to the lowest community. Then communities become the
nodes of the next level. The best partition of any level is the result.

A bucket's step is joins and group-bys on node and community: partial sums
combine before each shuffle, so hubs and large communities are no hot spots
beyond what adaptive execution splits; each step is checkpointed, so plans
stay small and a lost executor costs one step. Graphs of at most
``local_threshold`` edges, a documented bound, are handled on the driver by
the same rule on arrays (kernel.py), with the same result. Larger ones of at
most ``local_nodes`` nodes keep their edges packed in tasks (sweeps.py); the
joins take what is beyond.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import cached_property
from typing import Protocol

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshlight.errors import DirectedNotSupported, InvalidInput
from meshlight.functions.metrics import modularity
from meshlight.runtime import cut

from . import kernel, sweeps
from .graph import Graph
from .partition import compose, contract, dense_ids, normalize, refine, warm_start

LOCAL_EDGES = 200_000


@dataclass(frozen=True)
class LouvainOptions:
    """resolution 0 means 1; seed 0 the time; max_passes 0 no limit; tolerance is accepted and not used."""

    resolution: float = 0.0
    seed: int = 0
    max_passes: int = 0
    tolerance: float = 0.0
    initial_partition: DataFrame | None = None
    buckets: int = 8
    gain: str = "reference"
    self_loops: str = "reference"
    local_threshold: int = LOCAL_EDGES
    local_nodes: int = sweeps.NODES


@dataclass(frozen=True)
class LeidenOptions:
    """As LouvainOptions; num_runs (0 means 3) counts only where seed is 0: the best of several seeds."""

    resolution: float = 0.0
    seed: int = 0
    max_iterations: int = 0
    num_runs: int = 0
    tolerance: float = 0.0
    initial_partition: DataFrame | None = None
    buckets: int = 8
    gain: str = "reference"
    self_loops: str = "reference"
    local_threshold: int = LOCAL_EDGES
    local_nodes: int = sweeps.NODES


@dataclass(frozen=True)
class CommunityResult:
    """partition (node, community from 0); modularity at the resolution used; passes; moves. ``quality`` may also make the modularity, when it is asked for."""

    partition: DataFrame
    quality: float | Callable[[], float]
    passes: int
    moves: int
    table: bool = False  # whether the partition was written

    @cached_property
    def modularity(self) -> float:
        return self.quality() if callable(self.quality) else self.quality

    def metrics(self) -> DataFrame:
        row = [(float(self.modularity), int(self.passes), int(self.moves))]
        return self.partition.sparkSession.createDataFrame(row, "modularity double, passes int, moves long")


class Detector(Protocol):
    """What a local or global detector has to offer."""

    def detect(self, graph: Graph) -> CommunityResult: ...


class ArrayDetector(Protocol):
    """What a local detector may offer beside detect(): it is then run inside the tasks, on many small graphs at once.

    Nodes are ordered by (graph, id); ``group`` numbers the graphs from 0, src
    and dst are positions of nodes. The result labels each node, with numbers
    from 0 on in each graph.
    """

    def detect_arrays(self, ids: np.ndarray, group: np.ndarray, src: np.ndarray, dst: np.ndarray, weight: np.ndarray) -> np.ndarray: ...


@dataclass(frozen=True)
class Louvain:
    options: LouvainOptions = LouvainOptions()

    def detect(self, graph: Graph) -> CommunityResult:
        o = self.options
        return _detect(graph, moves_of(o), o.initial_partition, o.local_threshold, o.local_nodes)

    def fixed(self) -> Louvain:
        """With a seed of its own, so that a task that is done again finds the same."""
        return Louvain(replace(self.options, seed=moves_of(self.options).seed))

    def warm(self, prior: DataFrame) -> Louvain:
        return Louvain(replace(self.options, initial_partition=prior))

    def detect_arrays(self, ids: np.ndarray, group: np.ndarray, src: np.ndarray, dst: np.ndarray, weight: np.ndarray) -> np.ndarray:
        return kernel.detect(ids, group, src, dst, weight, moves_of(self.options)).community


@dataclass(frozen=True)
class Leiden:
    """As Louvain, but each level cuts its communities into connected parts first."""

    options: LeidenOptions = LeidenOptions()

    def detect(self, graph: Graph) -> CommunityResult:
        o = self.options
        first = moves_of(o)
        runs = max(1, o.num_runs or 3) if o.seed == 0 else 1
        best = None
        for k in range(runs):
            found = _detect(graph, replace(first, seed=first.seed + k), o.initial_partition, o.local_threshold, o.local_nodes)
            if best is None or found.modularity > best.modularity:
                best = found
        return best

    def fixed(self) -> Leiden:
        return Leiden(replace(self.options, seed=moves_of(self.options).seed))

    def warm(self, prior: DataFrame) -> Leiden:
        return Leiden(replace(self.options, initial_partition=prior))

    def detect_arrays(self, ids: np.ndarray, group: np.ndarray, src: np.ndarray, dst: np.ndarray, weight: np.ndarray) -> np.ndarray:
        return kernel.detect(ids, group, src, dst, weight, moves_of(self.options)).community


def moves_of(o: LouvainOptions | LeidenOptions) -> kernel.MoveOptions:
    connected = isinstance(o, LeidenOptions)
    passes = o.max_iterations if connected else o.max_passes
    return kernel.MoveOptions(o.resolution or 1.0, o.seed or time.time_ns() % 1_000_000_007, passes, o.buckets, o.gain, o.self_loops, connected)


def _detect(graph: Graph, options: kernel.MoveOptions, initial: DataFrame | None, local_threshold: int, local_nodes: int) -> CommunityResult:
    if graph.directed:
        raise DirectedNotSupported("community detection needs an undirected graph")
    graph = graph.kept()
    nodes = graph.vertices.select("id")
    few = nodes.limit(2).collect()
    if len(few) < 2:
        rows = [(r[0], 0) for r in few]
        return CommunityResult(graph.spark.createDataFrame(rows, "node long, community long"), 0.0, len(few), 0)
    if initial is not None:
        initial = cut(initial.select(F.col("node").cast("long").alias("node"), F.col("community").cast("long").alias("community")))
        if not initial.filter("community < 0").isEmpty():
            raise InvalidInput("community ids must not be negative")
    edges = graph.edges
    total, rows = edges.agg(F.sum("weight"), F.count(F.lit(1))).first()
    if not total:
        own = dense_ids(nodes, "id", "community").select(F.col("id").alias("node"), "community")
        return CommunityResult(own, 0.0, 1, 0)
    size = nodes.count()
    if local_threshold < rows or size > 2 * local_threshold + 1000:
        if size <= local_nodes:
            return _in_tasks(graph, rows, options, initial, local_threshold)
        return _distributed(graph, options, warm_start(nodes, initial) if initial is not None else None)
    return _on_driver(graph, options, warm_start(nodes, initial) if initial is not None else None)


def _in_tasks(graph: Graph, rows: int, options: kernel.MoveOptions, prior: DataFrame | None, local_threshold: int) -> CommunityResult:
    names = sweeps.names_of(graph.vertices)
    start = sweeps.start_of(prior, graph.vertices, names) if prior is not None else None
    found = sweeps.detect(graph.edges, rows, names, options, start, local_threshold)
    return CommunityResult(sweeps.partition(graph.spark, names, found.community), found.modularity, found.passes, found.moves, True)


def _on_driver(graph: Graph, options: kernel.MoveOptions, start: DataFrame | None) -> CommunityResult:
    ids = np.sort(np.array([r[0] for r in graph.vertices.select("id").collect()], np.int64))
    e = graph.edges.select("src", "dst", "weight").toPandas()
    src, dst = np.searchsorted(ids, e["src"].to_numpy()), np.searchsorted(ids, e["dst"].to_numpy())
    initial = None
    if start is not None:
        known = dict(start.collect())
        initial = np.array([known[i] for i in ids.tolist()], np.int64)
    found = kernel.detect(ids, np.zeros(len(ids), np.int64), src, dst, e["weight"].to_numpy(), options, initial)
    import pandas as pd

    frame = graph.spark.createDataFrame(pd.DataFrame({"node": ids, "community": found.community.astype(np.int64)}), "node long, community long")
    return CommunityResult(frame, float(found.modularity[0]), int(found.passes[0]), int(found.moves[0]))


def bucket_column(node: Column, seed: int, buckets: int) -> Column:
    mod = F.lit(kernel.HASH_MOD)
    return F.pmod(F.pmod(node, mod) * kernel.HASH_NODE + seed % kernel.HASH_MOD * kernel.HASH_SEED, mod) % buckets


def step(adjacency: DataFrame, state: DataFrame, total: float, bucket: int, options: kernel.MoveOptions) -> DataFrame:
    """(node, community) of the nodes of one bucket that move. state (node, k, community): k is the strength."""
    own = state.filter((bucket_column(F.col("node"), options.seed, options.buckets) == bucket) & (F.col("k") > 0)).select("node", "k", F.col("community").alias("now"))
    near = adjacency.filter(F.col("bucket") == bucket).join(state.select(F.col("node").alias("dst"), "community"), "dst").select(F.col("src").alias("node"), "community", "weight")
    near = near.unionByName(own.select("node", F.col("now").alias("community"), F.lit(0.0).alias("weight")))
    into = near.groupBy("node", "community").agg(F.sum("weight").alias("kin"))
    sums = state.groupBy("community").agg(F.sum("k").alias("sum"))
    factor = 4.0 if options.gain == "reference" else 2.0
    seen = into.join(own, "node").join(sums, "community")
    stay = F.col("community") == F.col("now")
    score = F.lit(factor * total) * F.col("kin") - F.lit(options.resolution) * (F.col("sum") - F.when(stay, F.col("k")).otherwise(0.0)) * F.col("k")
    scored = seen.select("node", "community", score.alias("score"), stay.alias("stay"))
    best = scored.groupBy("node").agg(F.max(F.struct("score", (-F.col("community")).alias("low"))).alias("best"), F.max(F.when(F.col("stay"), F.col("score"))).alias("staying"))
    return best.filter(F.col("best.score") > F.col("staying")).select("node", (-F.col("best.low")).alias("community"))


def sweep(graph: Graph, part: DataFrame, total: float, options: kernel.MoveOptions) -> tuple[DataFrame, int]:
    """One sweep over all buckets; the new partition and the number of moves.

    The strength of a node travels with its community, so a step joins the
    edges of its bucket with the state and nothing else of their size; moves
    are counted in the state and summed once.
    """
    adjacency = cut(graph.adjacency.withColumn("bucket", bucket_column(F.col("src"), options.seed, options.buckets)))
    strength = adjacency.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("k"))
    state = cut(part.join(strength, "node", "left").select("node", F.coalesce("k", F.lit(0.0)).alias("k"), "community", F.lit(0).alias("moves")))
    for r in range(options.buckets):
        moved = step(adjacency, state, total, r, options).withColumnRenamed("community", "_to")
        state = cut(state.join(moved, "node", "left").select("node", "k", F.coalesce("_to", "community").alias("community"), (F.col("moves") + F.col("_to").isNotNull().cast("int")).alias("moves")))
    return state.select("node", "community"), state.agg(F.sum("moves")).first()[0] or 0


def _distributed(graph: Graph, options: kernel.MoveOptions, start: DataFrame | None) -> CommunityResult:
    nodes = graph.vertices.select("id")
    level, passes, moves = graph, 0, 0
    mapping = None  # original node -> node of this level
    best, best_q = None, float("-inf")
    while True:
        if start is not None and passes == 0:
            part = cut(start)
        else:
            part = cut(level.vertices.select(F.col("id").alias("node"), F.col("id").alias("community")))
        total = level.edges.agg(F.sum("weight")).first()[0] or 0.0
        part, moved = sweep(level, part, total, options)
        if options.connected:
            part = refine(level.edges, part)
        part = cut(normalize(part))
        passes, moves = passes + 1, moves + moved
        found = cut(part if mapping is None else compose(mapping, part))
        q = modularity(graph, found, options.resolution).first()[0]
        if q > best_q + 1e-15:
            best, best_q = found, q
        if moved == 0 or (options.max_passes and passes >= options.max_passes):
            break
        before, after = part.count(), part.select("community").distinct().count()
        if after <= 1 or after == before:
            break
        mapping = found
        merged = cut(contract(level.edges, part, options.self_loops))
        level = Graph(part.select(F.col("community").alias("id")).distinct().withColumn("weight", F.lit(1.0)), merged, simple=True)
    return CommunityResult(normalize(best), best_q, passes, moves)
