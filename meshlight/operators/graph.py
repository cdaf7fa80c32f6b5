"""The graph as two DataFrames, and everything that reads or edits it.

vertices (id LONG, weight DOUBLE); edges (src LONG, dst LONG, weight DOUBLE),
undirected edges with src <= dst. Frames are immutable, so every edit returns
a new graph and copies cost nothing.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlight.errors import InvalidInput
from meshlight.runtime import cut

FEW = 100_000  # edges that are added by sending them to all tasks
VERTICES, EDGES = "id long, weight double", "src long, dst long, weight double"
PARTITION, MEMBERSHIPS = "node long, community long", "node long, community long"


@dataclass(frozen=True)
class Graph:
    """``edges`` keeps parallel rows as given (edge_count needs them); ``merged`` sums them.

    ``simple`` says that no pair of nodes has more than one row, so that
    nothing is left to sum; ``tables`` that both frames were written by kept();
    ``whole`` that the vertices hold every end of an edge, once. ``grown``: the
    simple graph and the few edges, written, that this one was made of.
    """

    vertices: DataFrame
    edges: DataFrame
    directed: bool = False
    simple: bool = False
    tables: bool = False
    whole: bool = False
    grown: tuple[Graph, DataFrame] | None = None

    @property
    def spark(self) -> SparkSession:
        return self.edges.sparkSession

    def kept(self) -> Graph:
        """The graph written once, with its parallel edges summed: for callers that read it again and again."""
        if self.tables:
            return self
        return replace(self, vertices=cut(self.vertices), edges=cut(self.merged), simple=True, tables=True, grown=None)

    def is_directed(self) -> bool:
        return self.directed

    def clone(self) -> Graph:
        return replace(self)

    @cached_property
    def merged(self) -> DataFrame:
        """One row for each pair of nodes: parallel edges add up."""
        if self.simple:
            return self.edges.select("src", "dst", "weight")
        if self.grown is not None:  # pairs with new edges are summed, the others stay
            before, new = self.grown
            pairs = F.broadcast(new.select("src", "dst").distinct())
            both = before.merged.join(pairs, ["src", "dst"], "left_semi").unionByName(new)
            return before.merged.join(pairs, ["src", "dst"], "left_anti").unionByName(both.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))).select("src", "dst", "weight")
        return self.edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))

    @cached_property
    def adjacency(self) -> DataFrame:
        """(src, dst, weight): an undirected edge from both ends, a self-loop once."""
        if self.directed:
            return self.merged
        one, turned = F.struct("src", "dst", "weight"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
        return self.merged.select(F.inline(F.when(F.col("src") == F.col("dst"), F.array(one)).otherwise(F.array(one, turned))))

    def neighbors(self, node: int) -> DataFrame:
        """(to, weight) of a node's edges; no rows for unknown nodes. The filter reaches the edge scan."""
        own = self.edges.filter(F.col("src") == node).select(F.col("dst").alias("to"), "weight")
        if self.directed:
            return own
        return own.unionByName(self.edges.filter((F.col("dst") == node) & (F.col("src") != node)).select(F.col("src").alias("to"), "weight"))

    def nodes(self) -> DataFrame:
        return self.vertices.select("id").orderBy("id")

    def node_count(self) -> DataFrame:
        return self.vertices.agg(F.count(F.lit(1)).alias("node_count"))

    def edge_count(self) -> DataFrame:
        """Adjacency entries over 2, rounded down: a self-loop is half an entry pair."""
        if self.directed:
            return self.edges.agg(F.count(F.lit(1)).alias("edge_count"))
        entries = F.coalesce(F.sum(F.when(F.col("src") == F.col("dst"), 1).otherwise(2)), F.lit(0))
        return self.edges.agg(F.floor(entries / 2).alias("edge_count"))

    def total_weight(self) -> DataFrame:
        return self.edges.agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("total_weight"))

    def strength(self) -> DataFrame:
        """(id, strength): summed weight of a node's edges, self-loops once; 0 without edges."""
        k = self.adjacency.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("k"))
        return self.vertices.join(k, "id", "left").select("id", F.coalesce("k", F.lit(0.0)).alias("strength"))

    def add_nodes(self, nodes: DataFrame) -> Graph:
        """nodes (id, weight); nodes that exist keep their weight."""
        new = nodes.groupBy("id").agg(F.min("weight").alias("weight")).join(self.vertices, "id", "left_anti")
        return replace(self, vertices=self.vertices.unionByName(new.select("id", "weight")), tables=False, grown=None)

    def add_edges(self, edges: DataFrame) -> Graph:
        """edges (src, dst, weight); missing ends are added with weight 1."""
        new = canonical(edges, self.directed)
        if self.whole and self.simple and self.tables and not self.directed:
            new = cut(new)
            if new.limit(FEW + 1).count() <= FEW:  # only these are joined with what was there, by sending them to all tasks
                ends = new.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
                there = self.vertices.join(F.broadcast(ends), "id", "left_semi").select("id")
                added = ends.join(F.broadcast(there), "id", "left_anti").select("id", F.lit(1.0).alias("weight"))
                vertices = self.vertices.select("id", F.coalesce("weight", F.lit(1.0)).alias("weight")).unionByName(added)
                return Graph(vertices, self.edges.unionByName(new), whole=True, grown=(self, new))
        return build(self.edges.unionByName(new), self.vertices, self.directed, checked=True)  # may hold parallel rows from here on

    def remove_edges_for(self, nodes: DataFrame) -> Graph:
        """Drops all edges that touch one of the nodes (id); the nodes stay."""
        ids = nodes.select(F.col("id").alias("_id")).distinct()
        left = self.edges.join(ids, F.col("src") == F.col("_id"), "left_anti").join(ids, F.col("dst") == F.col("_id"), "left_anti")
        return replace(self, edges=left, tables=False, grown=None)

    def subgraph(self, nodes: DataFrame) -> Graph:
        """The graph induced by the nodes (id); unknown ids are ignored."""
        ids = nodes.select(F.col("id").alias("_id")).distinct()
        kept = self.edges.join(ids, F.col("src") == F.col("_id"), "left_semi").join(ids, F.col("dst") == F.col("_id"), "left_semi")
        return replace(self, vertices=self.vertices.join(ids, F.col("id") == F.col("_id"), "left_semi"), edges=kept, tables=False, grown=None)

    def weight_to_communities(self, partition: DataFrame) -> DataFrame:
        """(node, community, weight): summed weight of a node's edges into each community; unassigned neighbours don't count."""
        to = partition.select(F.col("node").alias("dst"), "community")
        return self.adjacency.join(to, "dst").groupBy(F.col("src").alias("node"), "community").agg(F.sum("weight").alias("weight"))

    def weight_to_community(self, node: int, community: int, partition: DataFrame) -> DataFrame:
        own = replace(self, edges=self.edges.filter((F.col("src") == node) | (F.col("dst") == node)), grown=None)
        return own.weight_to_communities(partition.filter(F.col("community") == community)).filter(F.col("node") == node)

    def community_strength(self, partition: DataFrame) -> DataFrame:
        """(community, strength): summed strength of its nodes."""
        k = self.strength().withColumnRenamed("id", "node")
        return partition.join(k, "node").groupBy("community").agg(F.sum("strength").alias("strength"))


def canonical(edges: DataFrame, directed: bool = False) -> DataFrame:
    """Typed edges; undirected ones from the lower to the higher id. Edges with a null end go; a null weight is 1."""
    src, dst = F.col("src").cast("long"), F.col("dst").cast("long")
    ends = (src, dst) if directed else (F.least(src, dst), F.greatest(src, dst))
    weight = F.coalesce(F.col("weight").cast("double"), F.lit(1.0)) if "weight" in edges.columns else F.lit(1.0)
    return edges.filter("src is not null and dst is not null").select(ends[0].alias("src"), ends[1].alias("dst"), weight.alias("weight"))


def build(edges: DataFrame, vertices: DataFrame | None = None, directed: bool = False, strict: bool = False, checked: bool = False) -> Graph:
    """A graph from edges (src, dst[, weight]) and, if given, vertices (id[, weight]).

    Ends of edges become nodes of weight 1. Of repeated vertices the least
    weight is taken, where no order tells which came first. ``strict`` looks
    for negative weights, which no operator supports.
    """
    edges = edges if checked else canonical(edges, directed)
    if strict and not edges.filter("weight < 0").isEmpty():
        raise InvalidInput("negative edge weights are not supported")
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).select("id", F.lit(None).cast("double").alias("weight"))
    if vertices is not None:
        given = F.coalesce(F.col("weight").cast("double"), F.lit(1.0)) if "weight" in vertices.columns else F.lit(1.0)
        ends = ends.unionByName(vertices.filter("id is not null").select(F.col("id").cast("long").alias("id"), given.alias("weight")))
    nodes = ends.groupBy("id").agg(F.coalesce(F.min("weight"), F.lit(1.0)).alias("weight"))  # min skips the nulls of ends
    return Graph(nodes, edges, directed, whole=True)


def empty(spark: SparkSession, directed: bool = False) -> Graph:
    return Graph(spark.createDataFrame([], VERTICES), spark.createDataFrame([], EDGES), directed)
