"""Overlapping communities: ego nets, personas, a global pass over the persona graph.

Ego nets come from triangles (triangles.py); each is found once and given to
its three egos. All nets of a graph are sent packed, put together and
detected in the tasks (egonets.py); where only some egos are asked for, nets
without an edge are settled in SQL and the others partitioned by ego and
detected many at a time on arrays. Ego nets of more than ``most`` edges run one by one through
the distributed detector, so that no task holds an unbounded net; so do all
nets of a detector that offers no detect_arrays().

Where only some egos are asked for, only edges at these and among their
neighbours take part in the search for triangles.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshlight.errors import DirectedNotSupported, EmptyGraph
from meshlight.runtime import cut, ensure_importable, lean

from .detect import ArrayDetector, Detector, Louvain, LouvainOptions
from . import egonets, sweeps, triangles
from .graph import Graph
from .partition import dense_ids

EGO_EDGES, ENDS = 2_000_000, 4_000_000
EGO_PARTITION = "ego long, node long, local_comm long"


@dataclass(frozen=True)
class EgoSplittingOptions:
    """Detectors default to Louvain, globally with one pass; resolution is stored and not passed on."""

    local: Detector = Louvain()
    glob: Detector = Louvain(LouvainOptions(max_passes=1))
    resolution: float = 0.0
    most: int = EGO_EDGES


@dataclass(frozen=True)
class OverlapState:
    """What an update needs of the run before: frames, and how many updates the ego partition was not written again for."""

    personas: DataFrame
    ego_partition: DataFrame
    persona_partition: DataFrame
    persona_edges: DataFrame
    layers: int = 0


@dataclass(frozen=True)
class OverlappingResult:
    """memberships (node, community from 0), and the state to go on from (none after a merge). ``given`` may also make the memberships, when they are asked for."""

    given: DataFrame | Callable[[], DataFrame]
    state: OverlapState | None = field(default=None)

    @cached_property
    def memberships(self) -> DataFrame:
        return self.given() if callable(self.given) else self.given

    def communities(self) -> DataFrame:
        """(community, nodes): members in ascending order."""
        return self.memberships.groupBy("community").agg(F.array_sort(F.collect_list("node")).alias("nodes"))

    def node_communities(self) -> DataFrame:
        """(node, communities) in ascending order."""
        return self.memberships.groupBy("node").agg(F.array_sort(F.collect_list("community")).alias("communities"))


@dataclass(frozen=True)
class EgoSplitting:
    options: EgoSplittingOptions = EgoSplittingOptions()

    def detect(self, graph: Graph) -> OverlappingResult:
        graph = guard(graph)
        return finish(*split(graph, self.options), self.options.glob)


def split(graph: Graph, options: EgoSplittingOptions) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Personas, ego partition and persona edges of all nodes, as tables."""
    nodes = graph.vertices.select(F.col("id").alias("node"))
    plain = graph.merged.filter("src <> dst")
    rows = plain.count()
    local = options.local.fixed() if hasattr(options.local, "fixed") else options.local
    if not rows or not hasattr(local, "detect_arrays") or nodes.count() > sweeps.NODES:
        egos = cut(ego_partition(graph, local, most=options.most))
        people = cut(personas(nodes, egos))
        return people, egos, cut(persona_edges(graph, people, egos))
    wide = wide_egos(plain, options.most)
    without = np.sort(wide.toArrow().column(0).to_numpy())
    found = egonets.labels(plain, rows, local, without)
    if len(without):
        alone = ego_partition(graph, local, wide, options.most).withColumn("rank", (F.dense_rank().over(Window.partitionBy("ego").orderBy("local_comm")) - 1).cast("long"))
        alone = alone.withColumn("lead", F.row_number().over(Window.partitionBy("ego", "local_comm").orderBy("node")) == 1)
        found = found.unionByName(alone.join(graph.adjacency.select(F.col("src").alias("ego"), F.col("dst").alias("node"), "weight"), ["ego", "node"]))
    found = cut(found)
    egos = found.select("ego", "node", "local_comm")
    ids = np.sort(nodes.toArrow().column(0).to_numpy())
    heads = found.filter("lead").select(F.col("ego").alias("node"), "local_comm", "rank")
    least = _first_personas(heads, ids)
    people = _numbered(heads, nodes, ids, least)
    edges = egonets.persona_edges(found, rows, ids, least[:-1])
    loops = graph.merged.filter("src = dst").join(people.filter("local_comm = 0").select(F.col("node").alias("src"), "persona_id"), "src")
    loops = cut(loops.select(F.col("persona_id").alias("src"), F.col("persona_id").alias("dst"), "weight"))
    return people, egos, edges if loops.isEmpty() else edges.unionByName(loops)


def _first_personas(heads: DataFrame, ids: np.ndarray) -> np.ndarray:
    """The least persona id of each of the nodes, in order, and the one after the last: as personas() numbers them. heads: one row for each ego and local community."""
    t = heads.groupBy("node").agg(F.count(F.lit(1)).alias("n")).toArrow()
    count = np.ones(len(ids), np.int64)
    count[np.searchsorted(ids, t.column(0).to_numpy())] = t.column(1).to_numpy()
    return int(ids[-1]) + 1 + np.concatenate([[0], np.cumsum(count)])


def _numbered(heads: DataFrame, nodes: DataFrame, ids: np.ndarray, least: np.ndarray) -> DataFrame:
    """(node, local_comm, persona_id) of personas(), numbered where the rows lie."""
    shared = heads.sparkSession.sparkContext.broadcast((ids, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, comm, rank = (b.column(k).to_numpy() for k in range(3))
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(comm), pa.array(shared.value[1][np.searchsorted(shared.value[0], node)] + rank)], ["node", "local_comm", "persona_id"])

    zero = F.lit(0).cast("long")
    lone = nodes.join(heads.filter("rank = 0").select("node"), "node", "left_anti").select("node", zero.alias("local_comm"), zero.alias("rank"))
    table = cut(heads.unionByName(lone).mapInArrow(lean(run), "node long, local_comm long, persona_id long"))
    shared.destroy()
    return table


def wide_egos(plain: DataFrame, most: int) -> DataFrame:
    """(ego), written: nodes of so many neighbours d that their net may have more than ``most`` edges, d (d - 1) / 2 at most.

    Tasks that read the edges count their ends; only the counts are shuffled.
    """
    ensure_importable(plain.sparkSession)
    few = (1 + math.isqrt(1 + 8 * most)) // 2  # neighbours that are not too many

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends, size = [], 0
        for b in batches:
            ends += [b.column(k).to_numpy() for k in (0, 1)]
            size += b.num_rows
            if size >= ENDS:
                yield done(ends)
                ends, size = [], 0
        if size:
            yield done(ends)

    def done(ends: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in counted(np.concatenate(ends))], ["ego", "n"])

    degree = plain.select("src", "dst").mapInArrow(lean(run), "ego long, n long").groupBy("ego").agg(F.sum("n").alias("d"))
    return cut(degree.filter(F.col("d") > few).select("ego"))


def counted(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids and how often each occurs; ids close to each other are counted without sorting."""
    low = int(ids.min(initial=np.iinfo(np.int64).max))
    if len(ids) and int(ids.max()) - low < 4 * len(ids):
        n = np.bincount(ids - low)
        there = np.flatnonzero(n)
        return there + low, n[there]
    return np.unique(ids, return_counts=True)


def guard(graph: Graph) -> Graph:
    """The graph, written once."""
    if graph.directed:
        raise DirectedNotSupported("overlapping detection needs an undirected graph")
    graph = graph.kept()
    if graph.vertices.isEmpty():
        raise EmptyGraph("overlapping detection needs at least one node")
    return graph


def finish(people: DataFrame, egos: DataFrame, edges: DataFrame, detector: Detector, prior: DataFrame | None = None) -> OverlappingResult:
    """Global detection on the persona graph and the memberships it gives."""
    graph = Graph(people.select(F.col("persona_id").alias("id"), F.lit(1.0).alias("weight")), edges, simple=True, tables=True)
    found = (detector.warm(prior) if prior is not None and hasattr(detector, "warm") else detector).detect(graph)
    parts = found.partition.select(F.col("node").alias("persona_id"), "community")
    parts = parts if found.table else cut(parts)
    return OverlappingResult(lambda: memberships(people, parts), OverlapState(people, egos, parts, edges))


def ego_net_edges(graph: Graph, egos: DataFrame | None = None) -> DataFrame:
    """(ego, src, dst, weight): edges among the neighbours of each ego (ego), of all if not given; self-loops take no part."""
    plain = graph.merged.filter("src <> dst")
    if egos is not None:
        plain = near_edges(plain, egos)
    nets = triangles.nets(plain, written=graph.tables or egos is not None)
    return nets if egos is None else nets.join(sent(egos.select("ego")), "ego", "left_semi")


def sent(ids: DataFrame, most: int = 100_000) -> DataFrame:
    """A written frame of ids, to be joined by sending it to all tasks if it has few rows (counted): what it is joined with isn't shuffled then."""
    return F.broadcast(ids) if ids.limit(most + 1).count() <= most else ids


def near_edges(plain: DataFrame, egos: DataFrame) -> DataFrame:
    """The edges at the egos and among neighbours of egos."""
    own = sent(cut(egos.select("ego").distinct()))
    ends = lambda ids, name: ids.select(F.col("ego").alias(name), F.lit(True).alias(f"_{name}"))
    marked = plain.join(ends(own, "src"), "src", "left").join(ends(own, "dst"), "dst", "left")
    spokes = cut(marked.filter("_src or _dst").select("src", "dst", "weight"))
    around = sent(cut(spokes.select(F.explode(F.array("src", "dst")).alias("ego")).distinct()))
    rims = plain.join(around.select(F.col("ego").alias("src")), "src", "left_semi").join(around.select(F.col("ego").alias("dst")), "dst", "left_semi")
    return cut(spokes.unionByName(rims.select("src", "dst", "weight")).distinct())


def ego_members(graph: Graph, egos: DataFrame | None = None) -> DataFrame:
    """(ego, node): each ego's neighbours, itself left out."""
    m = graph.adjacency.filter("src <> dst").select(F.col("src").alias("ego"), F.col("dst").alias("node"))
    return m if egos is None else m.join(sent(egos.select("ego")), "ego", "left_semi")


def ego_partition(graph: Graph, local: Detector, egos: DataFrame | None = None, most: int = EGO_EDGES) -> DataFrame:
    """(ego, node, local_comm): the community of each neighbour in the ego's net, from 0."""
    nets, members = cut(ego_net_edges(graph, egos)), ego_members(graph, egos)
    members = members if egos is None else cut(members)  # few, of all edges
    sizes = cut(nets.groupBy("ego").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w")))
    bare = members.join(sizes.filter("w > 0"), "ego", "left_anti")
    alone = bare.withColumn("local_comm", (F.row_number().over(Window.partitionBy("ego").orderBy("node")) - 1).cast("long"))
    local = local.fixed() if hasattr(local, "fixed") else local
    quick = hasattr(local, "detect_arrays")
    small = sizes.filter((F.col("w") > 0) & (F.col("n") <= most)) if quick else sizes.filter("false")
    large = sizes.filter((F.col("w") > 0) & (F.col("n") > most)) if quick else sizes.filter("w > 0")
    found = alone
    if quick:
        found = found.unionByName(_many(members.join(small, "ego", "left_semi"), nets.join(small, "ego", "left_semi"), local))
    for row in large.select("ego").toLocalIterator():
        own = Graph(members.filter(F.col("ego") == row[0]).select(F.col("node").alias("id"), F.lit(1.0).alias("weight")), nets.filter(F.col("ego") == row[0]).select("src", "dst", "weight"))
        part = local.detect(own).partition
        found = found.unionByName(part.select(F.lit(row[0]).cast("long").alias("ego"), "node", F.col("community").alias("local_comm")))
    return found


def _many(members: DataFrame, nets: DataFrame, local: ArrayDetector) -> DataFrame:
    """The detector on all ego nets of a batch at once; a net lies whole in its partition."""
    rows = members.select("ego", F.col("node").alias("src"), F.lit(None).cast("long").alias("dst"), F.lit(0.0).alias("weight")).unionByName(nets.select("ego", "src", "dst", "weight"))
    # dealt by a hash of its own: a repartition that a union seems to satisfy is left out of the plan, and adaptive execution may then part a net
    dealt = rows.withColumn("_deal", F.xxhash64("ego")).repartition("_deal").sortWithinPartitions("ego").drop("_deal")
    ensure_importable(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            kept = t if kept is None else pa.concat_tables([kept, t])
            ego = kept.column(0).to_numpy()
            at = int(np.searchsorted(ego, ego[-1])) if len(ego) else 0  # the last net may go on
            if at > 50_000:
                yield detected(kept.slice(0, at))
                kept = kept.slice(at)
        if kept is not None and kept.num_rows:
            yield detected(kept)

    def detected(t: pa.Table) -> pa.RecordBatch:
        ego, src, w = (t.column(k).to_numpy() for k in (0, 1, 3))
        edge = t.column(2).is_valid().to_numpy()
        dst = t.column(2).fill_null(0).to_numpy()
        m_ego, m_node = ego[~edge], src[~edge]
        order = np.lexsort((m_node, m_ego))
        m_ego, m_node = m_ego[order], m_node[order]
        names, group = np.unique(m_ego, return_inverse=True)
        place = {(e, n): i for i, (e, n) in enumerate(zip(m_ego.tolist(), m_node.tolist()))}
        find = lambda nodes: np.array([place[k] for k in zip(ego[edge].tolist(), nodes[edge].tolist())], np.int64)
        labels = local.detect_arrays(m_node, group, find(src), find(dst), w[edge])
        return pa.RecordBatch.from_arrays([pa.array(m_ego), pa.array(m_node), pa.array(np.asarray(labels, np.int64))], ["ego", "node", "local_comm"])

    return dealt.mapInArrow(run, EGO_PARTITION)


def personas(nodes: DataFrame, egos: DataFrame, above: int | None = None) -> DataFrame:
    """(node, local_comm, persona_id): one persona for each node and local community, one for a node without neighbours.

    Ids go on above the largest node id (or ``above``), by (node, local_comm).
    """
    own = egos.select(F.col("ego").alias("node"), "local_comm").distinct()
    every = nodes.select("node").join(own, "node", "left").select("node", F.coalesce("local_comm", F.lit(0).cast("long")).alias("local_comm"))
    top = above if above is not None else (nodes.agg(F.max("node")).first()[0] or 0)
    return dense_ids(every, ["node", "local_comm"], "persona_id", top + 1)


def persona_edges(graph: Graph, people: DataFrame, egos: DataFrame, at: DataFrame | None = None) -> DataFrame:
    """(src, dst, weight), of the edges at the nodes (ego) of ``at`` only if it is given: each edge u-v between u's persona for v's side and v's persona for u's side.

    A self-loop stays at its node's persona of local community 0. Weights are kept in sum.
    """
    side = lambda ego, node, name: egos.select(F.col("ego").alias(ego), F.col("node").alias(node), F.col("local_comm").alias(name))
    zero = F.lit(0).cast("long")
    plain = graph.merged
    if at is not None:
        ids = sent(cut(at.select("ego").distinct()))
        egos = cut(egos.join(ids.withColumn("_e", F.lit(True)), "ego", "left").join(ids.select(F.col("ego").alias("node"), F.lit(True).alias("_n")), "node", "left").filter("_e or _n").select("ego", "node", "local_comm"))
        marked = plain.join(ids.select(F.col("ego").alias("src"), F.lit(True).alias("_s")), "src", "left").join(ids.select(F.col("ego").alias("dst"), F.lit(True).alias("_d")), "dst", "left")
        plain = marked.filter("_s or _d").select("src", "dst", "weight")
    e = plain.withColumnsRenamed({"src": "u", "dst": "v"}).join(side("u", "v", "_cu"), ["u", "v"], "left").join(side("v", "u", "_cv"), ["u", "v"], "left")
    e = e.select("u", "v", "weight", F.coalesce("_cu", zero).alias("_cu"), F.coalesce("_cv", zero).alias("_cv"))
    a = people.select(F.col("node").alias("u"), F.col("local_comm").alias("_cu"), F.col("persona_id").alias("_pu"))
    b = people.select(F.col("node").alias("v"), F.col("local_comm").alias("_cv"), F.col("persona_id").alias("_pv"))
    return e.join(a, ["u", "_cu"]).join(b, ["v", "_cv"]).groupBy(F.least("_pu", "_pv").alias("src"), F.greatest("_pu", "_pv").alias("dst")).agg(F.sum("weight").alias("weight"))


def memberships(people: DataFrame, persona_partition: DataFrame) -> DataFrame:
    """(node, community): distinct, communities numbered from 0 in ascending order of the persona communities."""
    found = cut(people.join(persona_partition, "persona_id").select("node", "community").distinct())
    low, high, n = found.agg(F.min("community"), F.max("community"), F.count_distinct("community")).first()
    if low == 0 and high == n - 1:  # numbered so already
        return found
    return found.join(dense_ids(found, "community"), "community").select("node", F.col("new").alias("community"))
