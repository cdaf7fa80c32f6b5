"""Connected components of an edge list, as a checkpointed loop of joins and group-bys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlight.operators.skew import SALTS
from meshlight.runtime import cut


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node of ``edges``; component is its least node.

    Alternates large-star and small-star steps: each replaces edges by edges
    to the least neighbour, so that every component ends as one star. The
    number of rounds grows with the logarithm of a component's size. Least
    neighbours are combined map-side and come back on (node, salt), so a hub's
    edges are spread over tasks. Self-loops keep isolated nodes; nulls are
    dropped. An empty edge list gives no rows.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter("u is not null and v is not null")
    e = cut(e.distinct())
    nodes = e.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    e = cut(e.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = _mark(e)
    while mark[0]:
        e = cut(_large_star(e))  # each step reads its edges twice: two in one plan would read them four times
        e = cut(_small_star(e))
        now = _mark(e)
        if now == mark:
            break
        mark = now
    least = e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return nodes.join(least, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _mark(e: DataFrame) -> tuple:
    """Equal before and after a round only if the edge set stayed the same, up to hash collisions."""
    h = F.xxhash64("u", "v")
    r = e.agg(F.count(F.lit(1)), F.sum(h.cast("decimal(20,0)")), F.bit_xor(h)).first()
    return tuple(r)


def _to_least(rows: DataFrame) -> DataFrame:
    """(u, v, m): m is the least of all v of u and u itself."""
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    part = dealt.groupBy("u", "salt").agg(F.min("v").alias("m"))
    whole = part.groupBy("u").agg(F.least(F.min("m"), F.col("u")).alias("m"), F.collect_list("salt").alias("salts"))
    return dealt.join(whole.select("u", "m", F.explode("salts").alias("salt")), ["u", "salt"]).select("u", "v", "m")


def _large_star(e: DataFrame) -> DataFrame:
    """For each u: its larger neighbours get an edge to the least of u and its neighbours."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _to_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """For each u: its smaller neighbours and u itself get an edge to the least neighbour; v < u in all rows."""
    found = _to_least(e)
    linked = found.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(found.select("u", F.col("m").alias("v"))).distinct()
