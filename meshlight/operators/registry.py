"""Names and node ids: a dictionary frame (name STRING, id LONG)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .partition import dense_ids


@dataclass(frozen=True)
class NodeRegistry:
    entries: DataFrame

    @classmethod
    def new(cls, spark: SparkSession) -> NodeRegistry:
        return cls(spark.createDataFrame([], "name string, id long"))

    def register(self, names: DataFrame, order: str | None = None) -> NodeRegistry:
        """Adds names (name[, order]) that are new, numbered on from the last id by first appearance, else by name.

        Names that are known keep their ids; nulls are no names.
        """
        seen = names.filter("name is not null").join(self.entries.select("name"), "name", "left_anti")
        keys = ["name"]
        if order:
            seen = seen.groupBy("name").agg(F.min(order).alias("_first"))
            keys = ["_first", "name"]
        start = (self.entries.agg(F.max("id")).first()[0] if not self.entries.isEmpty() else None)
        new = dense_ids(seen, keys, "id", 0 if start is None else start + 1)
        return NodeRegistry(self.entries.unionByName(new.select("name", "id")))

    def ids(self, names: DataFrame) -> DataFrame:
        """(name, id, known) for names; id 0 and known false for those that are not registered."""
        return names.select("name").join(self.entries, "name", "left").select("name", F.coalesce("id", F.lit(0).cast("long")).alias("id"), F.col("id").isNotNull().alias("known"))

    def names(self, ids: DataFrame) -> DataFrame:
        """(id, name, known) for ids; an empty name and known false for those out of range."""
        return ids.select("id").join(self.entries, "id", "left").select("id", F.coalesce("name", F.lit("")).alias("name"), F.col("name").isNotNull().alias("known"))

    def count(self) -> DataFrame:
        return self.entries.agg(F.count(F.lit(1)).alias("n"))

    def encode(self, edges: DataFrame, src: str, dst: str) -> DataFrame:
        """Edges between names as edges between ids; other columns stay."""
        a = self.entries.select(F.col("name").alias(src), F.col("id").alias("_src"))
        b = self.entries.select(F.col("name").alias(dst), F.col("id").alias("_dst"))
        rest = [c for c in edges.columns if c not in (src, dst)]
        return edges.join(a, src).join(b, dst).select(F.col("_src").alias("src"), F.col("_dst").alias("dst"), *rest)
