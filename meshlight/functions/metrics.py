"""Quality of partitions and covers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlight.operators.graph import Graph


def modularity(graph: Graph, partition: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row, modularity: sum over communities of intra / 2W - resolution * (degree / 2W)^2.

    Nodes that the partition leaves out form one virtual community together.
    0 without weight or without any assigned node. For directed graphs 2W is W
    and degrees are out-strengths.
    """
    of = lambda end, name: partition.select(F.col("node").alias(end), F.col("community").alias(name))
    none = F.lit(-1).cast("long")
    ends = graph.adjacency.join(of("src", "_a"), "src", "left").join(of("dst", "_b"), "dst", "left")
    by = ends.select(F.coalesce("_a", none).alias("c"), F.coalesce("_b", none).alias("d"), "weight", (F.col("src") == F.col("dst")).alias("loop"), F.col("_a").isNotNull().alias("known")).groupBy("c").agg(
        F.sum("weight").alias("degree"), F.sum(F.when(F.col("loop"), F.col("weight")).otherwise(0.0)).alias("loops"), F.sum(F.when(F.col("c") == F.col("d"), F.col("weight")).otherwise(0.0)).alias("intra"), F.max("known").alias("known")
    )
    total = F.sum("degree") if graph.directed else F.sum("degree") + F.sum("loops")  # an undirected self-loop stands once among the ends
    q = F.sum("intra") / total - resolution * F.sum(F.col("degree") * F.col("degree")) / (total * total)
    return by.agg(F.when((total > 0) & F.max("known"), q).otherwise(F.lit(0.0)).alias("modularity"))


def nmi(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row, nmi of two partitions over the nodes of both: 2 I / (H + H); 1 if both are one community, 0 if empty."""
    cells = a.select("node", F.col("community").alias("x")).join(b.select("node", F.col("community").alias("y")), "node").groupBy("x", "y").agg(F.count(F.lit(1)).cast("double").alias("n"))
    rows = cells.groupBy("x").agg(F.sum("n").alias("nx"))
    cols = cells.groupBy("y").agg(F.sum("n").alias("ny"))
    total = cells.agg(F.sum("n").alias("t"))
    entropy = lambda df, n, name: df.crossJoin(total).agg(F.coalesce(-F.sum(F.col(n) / F.col("t") * F.log2(F.col(n) / F.col("t"))), F.lit(0.0)).alias(name))  # noqa: E731  one row each
    info = cells.join(rows, "x").join(cols, "y").crossJoin(total).agg(F.coalesce(F.sum(F.col("n") / F.col("t") * F.log2(F.col("n") * F.col("t") / (F.col("nx") * F.col("ny")))), F.lit(0.0)).alias("i"), F.count(F.lit(1)).alias("cells"))
    both = info.crossJoin(entropy(rows, "nx", "hx")).crossJoin(entropy(cols, "ny", "hy"))
    return both.select(F.when(F.col("cells") == 0, 0.0).when(F.col("hx") + F.col("hy") <= 0, 1.0).otherwise(2 * F.col("i") / (F.col("hx") + F.col("hy"))).alias("nmi"))


def shared_memberships(members: DataFrame) -> DataFrame:
    """(u, v, shared): in how many communities two nodes meet, u < v; pairs that never meet are left out.

    Pairs exist only inside communities, as the measure asks for; repeated memberships count once.
    """
    m = members.select("node", "community").distinct()
    a, b = m.select(F.col("node").alias("u"), "community"), m.select(F.col("node").alias("v"), "community")
    return a.join(b, "community").filter("u < v").groupBy("u", "v").agg(F.count(F.lit(1)).alias("shared"))


def omega_index(found: DataFrame, truth: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """One row, omega: agreement of two covers (node, community) beyond chance, in [0, 1].

    Nodes are those of both covers and of ``nodes`` (node). Pairs that meet in
    neither cover are counted, not listed. 0 for fewer than two nodes, 1 if
    chance alone agrees everywhere.
    """
    every = found.select("node").unionByName(truth.select("node"))
    every = (every.unionByName(nodes.select("node")) if nodes is not None else every).distinct()
    n = F.count(F.lit(1)).cast("double")
    total = every.agg((n * (n - 1) / 2).alias("total"), n.alias("n"))
    pairs = shared_memberships(found).withColumnRenamed("shared", "a").join(shared_memberships(truth).withColumnRenamed("shared", "b"), ["u", "v"], "full").select(F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))
    cells = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).cast("double").alias("k"))
    listed = cells.agg(F.coalesce(F.sum("k"), F.lit(0.0)).alias("listed"), F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), F.col("k")).otherwise(0.0)), F.lit(0.0)).alias("same"))
    left = cells.groupBy(F.col("a").alias("s")).agg(F.sum("k").alias("ka"))
    right = cells.groupBy(F.col("b").alias("s")).agg(F.sum("k").alias("kb"))
    by = left.join(right, "s", "full").select("s", F.coalesce("ka", F.lit(0.0)).alias("ka"), F.coalesce("kb", F.lit(0.0)).alias("kb"))
    # pairs that meet nowhere belong to both counts of zero
    chance = by.crossJoin(listed).crossJoin(total).agg(
        F.coalesce(F.sum(F.when(F.col("s") > 0, F.col("ka") * F.col("kb")).otherwise(0.0)), F.lit(0.0)).alias("above"),
        F.coalesce(F.sum(F.when(F.col("s") == 0, F.col("ka"))), F.lit(0.0)).alias("za"),
        F.coalesce(F.sum(F.when(F.col("s") == 0, F.col("kb"))), F.lit(0.0)).alias("zb"),
    )
    one = chance.crossJoin(listed).crossJoin(total)  # one row each
    rest = F.col("total") - F.col("listed")
    observed = (F.col("same") + rest) / F.col("total")
    expected = (F.col("above") + (F.col("za") + rest) * (F.col("zb") + rest)) / (F.col("total") * F.col("total"))
    omega = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (observed - expected) / (1 - expected)))
    return one.select(F.when(F.col("n") < 2, 0.0).when(expected >= 1, 1.0).otherwise(omega).alias("omega"))


def community_count(partition: DataFrame) -> DataFrame:
    return partition.agg(F.count_distinct("community").alias("communities"))


def disconnected(graph: Graph, partition: DataFrame) -> DataFrame:
    """(community, parts) of communities that are not connected."""
    from meshlight.operators.partition import components_within

    return components_within(graph.merged, partition).groupBy("community").agg(F.count_distinct("component").alias("parts")).filter("parts > 1")
