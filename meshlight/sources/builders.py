"""Edge lists from files and tables, and sinks for results."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from meshlight.operators import egonets
from meshlight.operators.graph import EDGES, Graph, build
from meshlight.runtime import ensure_importable, lean, table

PAIRED, SAMPLE = 100_000, 100_000
EDGE_SCHEMA = "src long, dst long, weight double"


def read_edges(spark: SparkSession, path: str, fmt: str = "parquet", directed: bool = False, vertices: DataFrame | None = None, **options: str) -> Graph:
    """A graph from an edge list (src, dst[, weight]) in Parquet, ORC, CSV or JSON; text formats are read by schema."""
    reader = spark.read.options(**options)
    edges = reader.format(fmt).load(path) if fmt in ("parquet", "orc") else reader.schema(EDGE_SCHEMA).format(fmt).load(path)
    return build(edges, vertices, directed)


def write_frame(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """A result frame, such as a partition, to files."""
    df.write.mode(mode).format(fmt).save(path)


def co_occurrence(rows: DataFrame, group: str, item: str, least: int = 1) -> DataFrame:
    """(src, dst, weight): in how many groups two items meet, if in at least ``least``. Groups are expected to be small (lines of an order).

    Groups of whole numbers are paired on arrays; pairs travel summed and packed, by ranges of src.
    """
    kind = rows.schema[group].dataType
    own = rows.select(F.col(group).alias("g"), F.col(item).cast("long").alias("i")).filter("g is not null and i is not null")
    if isinstance(kind, (ByteType, ShortType, IntegerType, LongType)):
        return _paired(own.withColumn("g", F.col("g").cast("long")), least)
    own = own.distinct()
    a, b = own.withColumnRenamed("i", "src"), own.withColumnRenamed("i", "dst")
    return a.join(b, "g").filter("src < dst").groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight")).filter(F.col("weight") >= least)


def _paired(own: DataFrame, least: int) -> DataFrame:
    """co_occurrence() of groups g and items i."""
    ensure_importable(own.sparkSession)
    n = own.count()
    seen = own.sample(min(1.0, SAMPLE / max(n, 1)), 1).select("i").toArrow().column(0).to_numpy()  # decides sizes only
    parts = max(1, n // PAIRED)
    bounds = np.unique(np.quantile(seen, np.arange(1, parts) / parts, method="lower")) if len(seen) else np.zeros(0, np.int64)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Whole groups, many at once."""
        g, i = np.zeros(0, np.int64), np.zeros(0, np.int64)
        some, size = [], 0
        for b in batches:
            some.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
            size += b.num_rows
            if size >= PAIRED:
                g, i = (np.concatenate([x, *y]) for x, y in zip((g, i), zip(*some)))
                at = int(np.searchsorted(g, g[-1]))  # the last group may go on
                if at:
                    yield g[:at], i[:at]
                g, i, some, size = g[at:], i[at:], [], 0
        if some or len(g):
            yield tuple(np.concatenate([x, *y]) for x, y in zip((g, i), zip(*some))) if some else (g, i)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for g, i in held(batches):
            if not len(g):
                continue
            order = np.lexsort((i, g))
            g, i = g[order], i[order]
            once = np.concatenate([[True], (g[1:] != g[:-1]) | (i[1:] != i[:-1])])
            g, i = g[once], i[once]
            first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            stop = np.repeat(np.append(first[1:], len(g)), np.diff(np.append(first, len(g))))
            count = stop - np.arange(len(g)) - 1  # later items of the group
            total = np.concatenate([[0], np.cumsum(count)])
            begin = 0
            while begin < len(g):
                end = max(begin + 1, int(np.searchsorted(total, total[begin] + 4 * PAIRED, side="right")) - 1)
                n = count[begin:end]
                if n.any():
                    src = np.repeat(np.arange(begin, end), n)
                    dst = src + 1 + np.arange(len(src)) - np.repeat(np.cumsum(n) - n, n)
                    yield i[src], i[dst], np.ones(len(src))
                begin = end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, kinds in egonets.by_key(batches):
            src, dst, w = egonets.by_first([np.concatenate(x) for x in zip(*(egonets.unpack(d, 3) for d in kinds[0]))])
            first = np.flatnonzero(np.concatenate([[True], (src[1:] != src[:-1]) | (dst[1:] != dst[:-1])]))
            w = np.add.reduceat(w, first)
            keep = w >= least
            yield pa.RecordBatch.from_arrays([pa.array(src[first][keep]), pa.array(dst[first][keep]), pa.array(w[keep])], ["src", "dst", "weight"])

    none = np.zeros(0, np.int64)
    packed = own.repartition("g").sortWithinPartitions("g").mapInArrow(lean(lambda batches: egonets.gathered(pairs(batches), bounds, 0, none)), egonets.PACKS)
    return packed.withColumn("_deal", F.xxhash64("key")).repartition("_deal").sortWithinPartitions("key").drop("_deal").mapInArrow(lean(run), EDGES)


def meeting(rows: DataFrame, group: str, item: str) -> DataFrame:
    """(id): items that share a group with another one, without listing pairs."""
    own = rows.select(F.col(group).alias("g"), F.col(item).cast("long").alias("i")).filter("g is not null and i is not null")
    return own.groupBy("g").agg(F.collect_set("i").alias("items")).filter(F.size("items") > 1).select(F.explode("items").alias("id")).distinct()


def strangers(rows: DataFrame, item: str, known: DataFrame) -> bool:
    """Whether some item is not among known (id), distinct; ids without gaps are told by a comparison."""
    own = rows.select(F.col(item).cast("long").alias("id")).filter("id is not null")
    low, high, n = known.agg(F.min("id"), F.max("id"), F.count(F.lit(1))).first()
    if n and high - low + 1 == n:
        return not own.filter((F.col("id") < low) | (F.col("id") > high)).isEmpty()
    return not own.distinct().join(known, "id", "left_anti").isEmpty()


def co_order_graph(spark: SparkSession, sf_dir: str, item: str, known: DataFrame, least: int) -> Graph:
    """Items that stand in the same order; known (id) are nodes with or without edges."""
    lines = table(spark, sf_dir, "lineitem")
    edges = co_occurrence(lines, "l_orderkey", item, least)
    if least > 1:
        return replace(build(edges, known), simple=True)
    known = known.filter("id is not null").distinct()
    nodes = known.unionByName(meeting(lines, "l_orderkey", item)).distinct() if strangers(lines, item, known) else known
    return Graph(nodes.select("id", F.lit(1.0).alias("weight")), edges, simple=True, whole=True)


def part_graph(spark: SparkSession, sf_dir: str, least: int = 1) -> Graph:
    """Parts that stand in the same order."""
    return co_order_graph(spark, sf_dir, "l_partkey", table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("id")), least)


def supplier_graph(spark: SparkSession, sf_dir: str, least: int = 1) -> Graph:
    """Suppliers that stand in the same order."""
    return co_order_graph(spark, sf_dir, "l_suppkey", table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("id")), least)
