"""Partitions as (node, community) frames: numbering, composition, contraction, refinement, warm starts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlight.operators.components import connected_components
from meshlight.runtime import cut

PLACE_BITS = 33  # of monotonically_increasing_id(): the partition stands above, the place in it below


def dense_ids(values: DataFrame, key: str | list[str], name: str = "new", start: int = 0) -> DataFrame:
    """The distinct keys and their rank from ``start`` on.

    Keys are range-partitioned, and each key's place in its partition is written
    with it; the sizes of the partitions, as many as there are partitions, give
    the offsets. No stage puts all keys into one task, and nothing is shuffled again.
    """
    keys = [key] if isinstance(key, str) else key
    spread = values.select(*keys).distinct().repartitionByRange(*keys).sortWithinPartitions(*keys)
    fixed = cut(spread.withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", PLACE_BITS), F.col("_at").bitwiseAND((1 << PLACE_BITS) - 1)
    sizes = dict(fixed.groupBy(part.alias("_part")).count().collect())
    before, offsets = start, {}
    for k in sorted(sizes):
        offsets[k] = before
        before += sizes[k]
    if not offsets:
        return fixed.select(*keys, F.lit(None).cast("long").alias(name))
    offset = F.element_at(F.create_map(*(F.lit(x).cast("long") for p in offsets.items() for x in p)), part)
    return fixed.select(*keys, (offset + place).alias(name))


def normalize(partition: DataFrame) -> DataFrame:
    """Communities numbered from 0 in ascending order of their ids."""
    ids = dense_ids(partition, "community")
    return partition.join(ids, "community").select("node", F.col("new").alias("community"))


def compose(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """node -> community of its community: ``inner`` maps to the nodes of ``outer``."""
    return inner.select("node", F.col("community").alias("_mid")).join(outer.select(F.col("node").alias("_mid"), F.col("community")), "_mid").select("node", "community")


def contract(edges: DataFrame, partition: DataFrame, self_loops: str = "reference") -> DataFrame:
    """Edges between communities (src <= dst); edges inside become self-loops.

    A stored self-loop counts one adjacency entry, so the reference way halves
    it again; "textbook" keeps its weight.
    """
    of = lambda end, name: partition.select(F.col("node").alias(end), F.col("community").alias(name))
    joined = edges.join(of("src", "_a"), "src").join(of("dst", "_b"), "dst")
    weight = F.when(F.col("src") == F.col("dst"), F.col("weight") / 2).otherwise(F.col("weight")) if self_loops == "reference" else F.col("weight")
    return joined.groupBy(F.least("_a", "_b").alias("src"), F.greatest("_a", "_b").alias("dst")).agg(F.sum(weight).alias("weight"))


def refine(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """Every community cut into its connected parts, numbered from 0 by (community, least node)."""
    parts = components_within(edges, partition)
    ids = dense_ids(parts, ["community", "component"])
    return parts.join(ids, ["community", "component"]).select("node", F.col("new").alias("community"))


def components_within(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """(node, community, component): the least node reachable inside the node's community."""
    of = lambda end, name: partition.select(F.col("node").alias(end), F.col("community").alias(name))
    inside = edges.filter("src <> dst").join(of("src", "_a"), "src").join(of("dst", "_b"), "dst").filter("_a = _b").select("src", "dst")
    found = connected_components(inside)
    return partition.join(found, "node", "left").select("node", "community", F.coalesce("component", "node").alias("component"))


def warm_start(nodes: DataFrame, prior: DataFrame) -> DataFrame:
    """A start from an earlier partition, numbered by each community's least node.

    Known nodes keep their community; nodes (id) without one get their own,
    above all prior ids; prior entries of unknown nodes are ignored.
    """
    known = nodes.select(F.col("id").alias("node")).join(prior.select("node", "community"), "node", "left")
    # a community is named by its least node; fresh nodes are their own
    least = known.filter("community is not null").groupBy("community").agg(F.min("node").alias("first"))
    named = known.join(least, "community", "left").select("node", F.coalesce("first", "node").alias("first"))
    ids = dense_ids(named, "first")
    return named.join(ids, "first").select("node", F.col("new").alias("community"))
