"""The named queries of the graph operators and their SQL.

The graphs come from the orders: parts ("p") or suppliers ("u") that stand in
one order. All queries take whole tables. Weights are whole numbers or halves
of such, so sums agree between engines; quotients are rounded to 9 places.

Detection to the end is unrolled in SQL for LEVELS levels; a level counts
while the one before moved a node and joined some, so more levels than a run
needs change nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlight.functions import metrics
from meshlight.operators import detect, ego, kernel, merge, partition
from meshlight.operators.graph import Graph, build
from meshlight.operators.registry import NodeRegistry
from meshlight.runtime import cut, table
from meshlight.sources.builders import part_graph, supplier_graph
from meshlight.streaming import online

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
LEVELS = 7  # of the unrolled SQL; the graphs here need 4 at most


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def pairs_sql(item: str, least: int) -> str:
    return f"""SELECT a.i AS src, b.i AS dst, CAST(count(*) AS DOUBLE) AS weight
  FROM (SELECT DISTINCT l_orderkey AS g, {item} AS i FROM lineitem) a JOIN (SELECT DISTINCT l_orderkey AS g, {item} AS i FROM lineitem) b ON a.g = b.g AND a.i < b.i
  GROUP BY 1, 2 HAVING count(*) >= {least}"""


def graph_sql(rest: str, item: str = "l_partkey", least: int = 1, vertices: str = "SELECT DISTINCT p_partkey AS id FROM part", recursive: bool = False) -> str:
    """CTEs e (edges), adj (both ways), v (vertices), k (strengths), m (total weight), p (a partition), q (one with gaps), then the rest."""
    return f"""WITH {"RECURSIVE " if recursive else ""}e AS ({pairs_sql(item, least)}),
v AS (SELECT id FROM ({vertices}) UNION SELECT src FROM e UNION SELECT dst FROM e),
adj AS (SELECT src, dst, weight FROM e UNION ALL SELECT dst, src, weight FROM e),
k AS (SELECT v.id AS node, coalesce(sum(weight), 0.0) AS k FROM v LEFT JOIN adj ON v.id = adj.src GROUP BY 1),
m AS (SELECT coalesce(sum(weight), 0.0) AS m FROM e),
p AS (SELECT id AS node, CAST(id % 13 AS BIGINT) AS community FROM v),
q AS (SELECT id AS node, CAST(id % 13 AS BIGINT) AS community FROM v WHERE id % 5 <> 0)
{rest}"""


def modulo_partition(g: Graph, gaps: bool = False) -> DataFrame:
    v = g.vertices.filter("id % 5 <> 0") if gaps else g.vertices
    return v.select(F.col("id").alias("node"), (F.col("id") % 13).cast("long").alias("community"))


def chosen(g: Graph) -> DataFrame:
    return g.vertices.filter("id % 3 = 0").select("id")


# --- the graph itself


@query("WITH v AS (SELECT DISTINCT p_partkey AS id FROM part) SELECT id, 1.0::DOUBLE AS weight FROM v UNION SELECT DISTINCT l_partkey, 1.0::DOUBLE FROM lineitem WHERE l_partkey NOT IN (SELECT id FROM v)")
def graph_nodes(spark, d):
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("id"))
    items = table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_partkey").alias("dst"))
    return build(items.distinct(), parts).nodes().withColumn("weight", F.lit(1.0))


@query(graph_sql("SELECT * FROM e"))
def graph_edges_canonical(spark, d):
    return part_graph(spark, d).merged


@query(graph_sql("SELECT * FROM adj"))
def graph_adjacency(spark, d):
    return part_graph(spark, d).adjacency


@query(graph_sql("SELECT count(*) AS node_count FROM v"))
def node_count(spark, d):
    return part_graph(spark, d).node_count()


@query(graph_sql("SELECT count(*) AS edge_count FROM e"))
def edge_count(spark, d):
    return part_graph(spark, d).edge_count()


@query(graph_sql("SELECT m AS total_weight FROM m"))
def total_weight(spark, d):
    return part_graph(spark, d).total_weight()


@query(graph_sql("SELECT node AS id, k AS strength FROM k"))
def strength(spark, d):
    return part_graph(spark, d).strength()


@query(graph_sql('SELECT dst AS "to", weight FROM adj WHERE src = 7'))
def neighbors(spark, d):
    return part_graph(spark, d).neighbors(7)


@query(graph_sql("SELECT community, sum(k) AS strength FROM p JOIN k USING (node) GROUP BY 1"))
def comm_strength(spark, d):
    g = part_graph(spark, d)
    return g.community_strength(modulo_partition(g))


@query(graph_sql("SELECT src AS node, community, sum(weight) AS weight FROM adj JOIN q ON q.node = adj.dst GROUP BY 1, 2"))
def weight_to_comm(spark, d):
    g = part_graph(spark, d)
    return g.weight_to_communities(modulo_partition(g, gaps=True))


@query(graph_sql("SELECT src, dst, weight FROM e WHERE src % 3 = 0 AND dst % 3 = 0"))
def subgraph(spark, d):
    g = part_graph(spark, d)
    return g.subgraph(chosen(g)).merged


@query(graph_sql("SELECT src, dst, weight FROM e WHERE src % 3 <> 0 AND dst % 3 <> 0"))
def remove_edges_for(spark, d):
    g = part_graph(spark, d)
    return g.remove_edges_for(chosen(g)).merged


@query("SELECT s_name AS name, row_number() OVER (ORDER BY s_name) - 1 AS id FROM (SELECT DISTINCT s_name FROM supplier)")
def registry_ids(spark, d):
    return NodeRegistry.new(spark).register(table(spark, d, "supplier").select(F.col("s_name").alias("name"))).entries


# --- metrics


def modularity_sql(part: str, resolution: float) -> str:
    return graph_sql(f"""SELECT round(sum(intra) / (2 * max(m)) - {resolution} * sum(degree * degree) / (4 * max(m) * max(m)), 9) AS modularity
FROM (SELECT coalesce(a.community, -1) AS c, sum(weight) AS degree, sum(CASE WHEN coalesce(a.community, -1) = coalesce(b.community, -1) THEN weight ELSE 0 END) AS intra
      FROM adj LEFT JOIN {part} a ON a.node = adj.src LEFT JOIN {part} b ON b.node = adj.dst GROUP BY 1), m""")


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 9).alias(c) for c in df.columns))


@query(modularity_sql("p", 1.0))
def modularity(spark, d):
    g = part_graph(spark, d)
    return rounded(metrics.modularity(g, modulo_partition(g)))


@query(modularity_sql("p", 0.5))
def modularity_resolution(spark, d):
    g = part_graph(spark, d)
    return rounded(metrics.modularity(g, modulo_partition(g), 0.5))


@query(modularity_sql("q", 1.0))
def modularity_missing_nodes(spark, d):
    g = part_graph(spark, d)
    return rounded(metrics.modularity(g, modulo_partition(g, gaps=True)))


@query(
    """WITH a AS (SELECT p_partkey AS node, p_size % 4 AS x, p_partkey % 6 AS y FROM part), t AS (SELECT count(*)::DOUBLE AS t FROM a),
c AS (SELECT x, y, count(*)::DOUBLE AS n FROM a GROUP BY 1, 2), r AS (SELECT x, sum(n) AS nx FROM c GROUP BY 1), s AS (SELECT y, sum(n) AS ny FROM c GROUP BY 1)
SELECT round(2 * (SELECT sum(n / t * log2(n * t / (nx * ny))) FROM c JOIN r USING (x) JOIN s USING (y), t)
 / ((SELECT -sum(nx / t * log2(nx / t)) FROM r, t) + (SELECT -sum(ny / t * log2(ny / t)) FROM s, t)), 9) AS nmi"""
)
def nmi(spark, d):
    part = table(spark, d, "part")
    of = lambda c: part.select(F.col("p_partkey").alias("node"), c.cast("long").alias("community"))
    return rounded(metrics.nmi(of(F.col("p_size") % 4), of(F.col("p_partkey") % 6)))


@query(graph_sql("SELECT count(DISTINCT community) AS communities FROM p"))
def unique_communities(spark, d):
    return metrics.community_count(modulo_partition(part_graph(spark, d)))


# --- partitions and levels


@query(graph_sql("SELECT least(a.community, b.community) AS src, greatest(a.community, b.community) AS dst, sum(weight) AS weight FROM e JOIN p a ON a.node = e.src JOIN p b ON b.node = e.dst GROUP BY 1, 2"))
def contract_supergraph(spark, d):
    g = part_graph(spark, d)
    return partition.contract(g.merged, modulo_partition(g))


@query(graph_sql("SELECT node, dense_rank() OVER (ORDER BY community * 7 % 13 + 100) - 1 AS community FROM p"))
def normalize_partition(spark, d):
    p = modulo_partition(part_graph(spark, d))
    return partition.normalize(p.withColumn("community", F.col("community") * 7 % 13 + 100))


@query(graph_sql("SELECT node, community % 4 AS community FROM p"))
def compose_partition(spark, d):
    p = modulo_partition(part_graph(spark, d))
    outer = p.select(F.col("community").alias("node"), (F.col("community") % 4).alias("community")).distinct()
    return partition.compose(p, outer)


@query(
    graph_sql(
        """, b AS (SELECT id AS node, id // 20 AS community FROM v),
ie AS (SELECT adj.src, adj.dst FROM adj JOIN b x ON x.node = adj.src JOIN b y ON y.node = adj.dst AND x.community = y.community),
reach AS (SELECT node, node AS root FROM b UNION SELECT ie.dst, reach.root FROM reach JOIN ie ON ie.src = reach.node),
c AS (SELECT community, b.node, min(root) AS root FROM b JOIN reach ON reach.node = b.node GROUP BY 1, 2)
SELECT node, dense_rank() OVER (ORDER BY community, root) - 1 AS community FROM c""".lstrip(),
            recursive=True,
    ).replace(")\n, b AS", "),\nb AS")
)
def refine_components(spark, d):
    g = part_graph(spark, d)
    p = g.vertices.select(F.col("id").alias("node"), F.floor(F.col("id") / 20).alias("community"))
    return partition.refine(cut(g.merged), p)


LEVEL_OPTIONS = kernel.MoveOptions(seed=3, buckets=4)


def bucket_sql(node: str, o: kernel.MoveOptions) -> str:
    return f"((({node} % {kernel.HASH_MOD}) * {kernel.HASH_NODE} + {o.seed * kernel.HASH_SEED}) % {kernel.HASH_MOD} % {o.buckets})"


def level_sql(tag: str, nodes: str, edges: str, o: kernel.MoveOptions = LEVEL_OPTIONS, start: str | None = None) -> str:
    """CTEs of one level's sweep, unrolled by bucket; {tag}done (node, community) numbers its result, {tag}moved counts its moves."""
    out = f""", {tag}adj AS MATERIALIZED (SELECT src, dst, weight FROM {edges} UNION ALL SELECT dst, src, weight FROM {edges} WHERE src <> dst),
{tag}k AS MATERIALIZED (SELECT n.node, coalesce(sum(weight), 0.0) AS k FROM {nodes} n LEFT JOIN {tag}adj a ON a.src = n.node GROUP BY 1),
{tag}m AS MATERIALIZED (SELECT sum(weight) AS m FROM {edges}),
{tag}p0 AS MATERIALIZED ({f"SELECT node, community FROM {start}" if start else f"SELECT node, node AS community FROM {nodes}"})"""
    for r in range(o.buckets):
        p = f"{tag}p{r}"
        out += f""",
{tag}o{r} AS MATERIALIZED (SELECT k.node, k, community AS now FROM {tag}k k JOIN {p} USING (node) WHERE k > 0 AND {bucket_sql("k.node", o)} = {r}),
{tag}i{r} AS MATERIALIZED (SELECT node, community, sum(weight) AS kin FROM (SELECT a.src AS node, x.community, weight FROM {tag}adj a JOIN {p} x ON x.node = a.dst WHERE {bucket_sql("a.src", o)} = {r}
  UNION ALL SELECT node, now, 0.0 FROM {tag}o{r}) GROUP BY 1, 2),
{tag}s{r} AS MATERIALIZED (SELECT community, sum(k) AS s FROM {p} JOIN {tag}k USING (node) GROUP BY 1),
{tag}c{r} AS MATERIALIZED (SELECT node, i.community, now, 4.0 * m * kin - (s - CASE WHEN i.community = now THEN k ELSE 0.0 END) * k AS score
  FROM {tag}i{r} i JOIN {tag}o{r} USING (node) JOIN {tag}s{r} s ON s.community = i.community, {tag}m),
{tag}b{r} AS MATERIALIZED (SELECT node, arg_min(community, (-score, community)) AS best, max(score) AS score, max(CASE WHEN community = now THEN score END) AS staying FROM {tag}c{r} GROUP BY 1),
{tag}p{r + 1} AS MATERIALIZED (SELECT p.node, CASE WHEN b.score > b.staying THEN b.best ELSE p.community END AS community FROM {p} p LEFT JOIN {tag}b{r} b USING (node))"""
    last = f"{tag}p{o.buckets}"
    out += f""",
{tag}moved AS MATERIALIZED (SELECT count(*) AS moved FROM {tag}p0 a JOIN {last} z USING (node) WHERE a.community <> z.community)"""
    if o.connected:
        return out + f""",
{tag}in AS MATERIALIZED (SELECT a.src, a.dst FROM {tag}adj a JOIN {last} x ON x.node = a.src JOIN {last} y ON y.node = a.dst AND x.community = y.community WHERE a.src <> a.dst),
{tag}reach AS (SELECT node, node AS root FROM {last} UNION SELECT i.dst, r.root FROM {tag}reach r JOIN {tag}in i ON i.src = r.node),
{tag}root AS MATERIALIZED (SELECT node, min(root) AS root FROM {tag}reach GROUP BY 1),
{tag}done AS MATERIALIZED (SELECT node, dense_rank() OVER (ORDER BY community, root) - 1 AS community FROM {last} JOIN {tag}root USING (node))"""
    return out + f""",
{tag}done AS MATERIALIZED (SELECT node, dense_rank() OVER (ORDER BY community) - 1 AS community FROM {last})"""


def detect_sql(tag: str, nodes: str, edges: str, o: kernel.MoveOptions, levels: int = LEVELS, start: str | None = None) -> str:
    """CTEs of a whole detection; {tag}found (node, community) is its result, {tag}metrics (modularity, passes, moves) one row."""
    out = f""", {tag}1n AS MATERIALIZED (SELECT node FROM {nodes}), {tag}1g AS MATERIALIZED (SELECT src, dst, weight FROM {edges}), {tag}1live AS (SELECT true AS ok)"""
    for t in range(1, levels + 1):
        own, last = f"{tag}{t}", f"{tag}{t - 1}"
        if t > 1:
            out += f""",
{own}live AS MATERIALIZED (SELECT ok AND moved > 0 AND z < b AND z > 1 AS ok FROM {last}live, {last}moved, (SELECT count(DISTINCT community) AS z, count(*) AS b FROM {last}done)),
{own}n AS MATERIALIZED (SELECT DISTINCT community AS node FROM {last}done, {own}live WHERE ok),
{own}g AS MATERIALIZED (SELECT least(x.community, y.community) AS src, greatest(x.community, y.community) AS dst, sum(CASE WHEN src = dst THEN weight / 2 ELSE weight END) AS weight
  FROM {last}g g JOIN {last}done x ON x.node = g.src JOIN {last}done y ON y.node = g.dst, {own}live WHERE ok GROUP BY 1, 2)"""
        out += level_sql(own, f"{own}n", f"{own}g", o, start if t == 1 else None)
        out += f""",
{own}map AS MATERIALIZED ({f"SELECT node, community FROM {own}done" if t == 1 else f"SELECT m.node, d.community FROM {last}map m JOIN {own}done d ON d.node = m.community"}),
{own}q AS MATERIALIZED (SELECT {t} AS t, sum(intra) / (2 * max(m)) - sum(degree * degree) / (4 * max(m) * max(m)) AS q FROM (SELECT x.community, sum(weight) AS degree, sum(CASE WHEN x.community = y.community THEN weight ELSE 0 END) AS intra
  FROM {tag}1adj a JOIN {own}map x ON x.node = a.src JOIN {own}map y ON y.node = a.dst GROUP BY 1), {tag}1m)"""
    each = range(1, levels + 1)
    return out + f""",
{tag}best AS MATERIALIZED (SELECT arg_min(t, (-round(q, 13), t)) AS t, max(q) AS q FROM ({" UNION ALL ".join(f"SELECT t, q FROM {tag}{t}q, {tag}{t}live WHERE ok" for t in each)})),
{tag}metrics AS (SELECT q AS modularity, passes, moves FROM {tag}best, (SELECT CAST(count(*) AS INTEGER) AS passes, CAST(sum(moved) AS BIGINT) AS moves FROM ({" UNION ALL ".join(f"SELECT moved FROM {tag}{t}moved, {tag}{t}live WHERE ok" for t in each)}))),
{tag}found AS MATERIALIZED (SELECT node, dense_rank() OVER (ORDER BY community) - 1 AS community FROM ({" UNION ALL ".join(f"SELECT node, community FROM {tag}{t}map, {tag}best b WHERE b.t = {t}" for t in each)}))"""


def whole_sql(rest: str, *more: str, **options) -> str:
    """graph_sql with n (node) and further CTEs, each of which begins with a comma."""
    head, tail = graph_sql("", recursive=True, **options).rstrip(), "".join(more)
    return f"{head},\nn AS (SELECT id AS node FROM v){tail}\n{rest}"


def one_level(g: Graph) -> DataFrame:
    start = cut(g.vertices.select(F.col("id").alias("node"), F.col("id").alias("community")))
    total = g.edges.agg(F.sum("weight")).first()[0] or 0.0
    return cut(partition.normalize(detect.sweep(g, start, total, LEVEL_OPTIONS)[0]))


ONE = whole_sql("SELECT node, community FROM adone", level_sql("a", "n", "e"))
TWO = whole_sql(
    "SELECT adone.node, zdone.community FROM adone JOIN zdone ON zdone.node = adone.community",
    level_sql("a", "n", "e"),
    """,
e2 AS MATERIALIZED (SELECT least(x.community, y.community) AS src, greatest(x.community, y.community) AS dst, sum(weight) AS weight FROM e JOIN adone x ON x.node = e.src JOIN adone y ON y.node = e.dst GROUP BY 1, 2),
n2 AS (SELECT DISTINCT community AS node FROM adone)""",
    level_sql("z", "n2", "e2"),
)


@query(ONE)
def louvain_one_level(spark, d):
    g = part_graph(spark, d)
    return one_level(Graph(g.vertices, cut(g.merged)))


@query(TWO)
def louvain_two_levels(spark, d):
    g = part_graph(spark, d)
    g = Graph(g.vertices, cut(g.merged))
    first = one_level(g)
    level = Graph(first.select(F.col("community").alias("id")).distinct().withColumn("weight", F.lit(1.0)), cut(partition.contract(g.merged, first)))
    return partition.compose(first, one_level(level))


@query(
    graph_sql(
        """, f AS (SELECT node, min(node) OVER (PARTITION BY community) AS first FROM q UNION ALL SELECT id, id FROM v WHERE id NOT IN (SELECT node FROM q))
SELECT node, dense_rank() OVER (ORDER BY first) - 1 AS community FROM f"""
    ).replace(")\n, f AS", "),\nf AS")
)
def warm_start_seed(spark, d):
    g = part_graph(spark, d)
    return partition.warm_start(g.vertices.select("id"), modulo_partition(g, gaps=True))


# --- overlapping communities


EGO_SQL = """, mem AS (SELECT src AS ego, dst AS node FROM adj),
net AS (SELECT a.ego, e.src, e.dst, e.weight FROM e JOIN mem a ON a.node = e.src JOIN mem b ON b.node = e.dst AND a.ego = b.ego)"""


def ego_sql(rest: str, more: str = "") -> str:
    return graph_sql(EGO_SQL + more + "\n" + rest).replace(")\n, mem AS", "),\nmem AS")


@query(ego_sql("SELECT * FROM net"))
def ego_net_edges(spark, d):
    return ego.ego_net_edges(part_graph(spark, d))


@query(ego_sql("SELECT ego, node, row_number() OVER (PARTITION BY ego ORDER BY node) - 1 AS local_comm FROM mem WHERE ego NOT IN (SELECT ego FROM net)"))
def ego_singletons(spark, d):
    g = part_graph(spark, d).kept()
    bare = cut(ego.ego_members(g).select("ego").distinct().join(ego.ego_net_edges(g).select("ego").distinct(), "ego", "left_anti"))
    return ego.ego_partition(g, detect.Louvain(detect.LouvainOptions(seed=1)), bare)


def split_egos(g: Graph) -> DataFrame:
    """A stand-in for a local detector that SQL can follow: neighbours by parity of their id."""
    return ego.ego_members(g).withColumn("local_comm", F.col("node") % 2)


SPLIT = """, eg AS (SELECT ego, node, node % 2 AS local_comm FROM mem),
pe AS (SELECT node, local_comm, (SELECT max(id) FROM v) + dense_rank() OVER (ORDER BY node, local_comm) AS persona_id
  FROM (SELECT DISTINCT v.id AS node, coalesce(eg.local_comm, 0) AS local_comm FROM v LEFT JOIN eg ON eg.ego = v.id))"""


@query(ego_sql("SELECT node, local_comm, persona_id FROM pe", SPLIT))
def persona_assign(spark, d):
    g = part_graph(spark, d)
    return ego.personas(g.vertices.select(F.col("id").alias("node")), split_egos(g))


@query(ego_sql("SELECT least(a.persona_id, b.persona_id) AS src, greatest(a.persona_id, b.persona_id) AS dst, sum(weight) AS weight FROM e JOIN pe a ON a.node = e.src AND a.local_comm = e.dst % 2 JOIN pe b ON b.node = e.dst AND b.local_comm = e.src % 2 GROUP BY 1, 2", SPLIT))
def persona_edges(spark, d):
    g = part_graph(spark, d)
    egos = split_egos(g)
    return ego.persona_edges(g, ego.personas(g.vertices.select(F.col("id").alias("node")), egos), egos)


@query(ego_sql("SELECT node, dense_rank() OVER (ORDER BY c) - 1 AS community FROM (SELECT DISTINCT node, persona_id % 17 * 3 AS c FROM pe)", SPLIT))
def overlapping_compact(spark, d):
    g = part_graph(spark, d)
    people = ego.personas(g.vertices.select(F.col("id").alias("node")), split_egos(g))
    return ego.memberships(people, people.select("persona_id", (F.col("persona_id") % 17 * 3).alias("community")))


@query(
    ego_sql(
        """SELECT persona_id AS node, had[i % len(had) + 1] AS community FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY local_comm) - 1 AS i FROM pe) JOIN pr USING (node)""",
        SPLIT + ", pr AS (SELECT node, list_sort([node % 4, 10 + node % 3]) AS had FROM v, (SELECT 1) AS one(x), LATERAL (SELECT v.id AS node) WHERE v.id % 2 = 0)",
    )
)
def prior_projection(spark, d):
    g = part_graph(spark, d)
    people = ego.personas(g.vertices.select(F.col("id").alias("node")), split_egos(g))
    even = g.vertices.filter("id % 2 = 0")
    prior = even.select(F.col("id").alias("node"), F.explode(F.array(F.col("id") % 4, 10 + F.col("id") % 3)).alias("community"))
    return online.project_prior(people, prior)


@query(graph_sql("SELECT id AS ego FROM v WHERE id IN (11, 23, 42) UNION SELECT dst FROM adj WHERE src IN (11, 23)"))
def affected_nodes(spark, d):
    g = part_graph(spark, d)
    delta = online.GraphDelta(spark.createDataFrame([(42,)], "id long"), spark.createDataFrame([(11, 23, 1.0)], "src long, dst long, weight double"))
    return online.affected_nodes(g, delta)


# --- merging


SMALL = """, b AS (SELECT id AS node, CAST(CASE WHEN id % 10 = 0 THEN 1000 + id % 40 ELSE id % 5 END AS BIGINT) AS community FROM v),
sz AS (SELECT community, count(*) AS size FROM b GROUP BY 1), th AS (SELECT CAST(ceil(0.1 * (SELECT count(*) FROM v)) AS BIGINT) AS t),
cand AS (SELECT community, size FROM sz, th WHERE size < t),
ln AS (SELECT x.community, y.community AS target, sum(weight) AS weight FROM adj JOIN b x ON x.node = adj.src JOIN b y ON y.node = adj.dst AND y.community <> x.community GROUP BY 1, 2),
st AS (SELECT community, sum(k) AS s FROM b JOIN k USING (node) GROUP BY 1)"""


def merge_sql(rest: str) -> str:
    return graph_sql(SMALL + "\n" + rest).replace(")\n, b AS", "),\nb AS")


def lopsided(g: Graph) -> DataFrame:
    return g.vertices.select(F.col("id").alias("node"), F.when(F.col("id") % 10 == 0, 1000 + F.col("id") % 40).otherwise(F.col("id") % 5).alias("community"))


def tenth(g: Graph) -> int:
    return merge.MergeOptions(min_fraction=0.1).threshold(g.vertices.count())


@query(merge_sql("SELECT community, size FROM cand"))
def merge_threshold_candidates(spark, d):
    g = part_graph(spark, d)
    return merge.candidates(lopsided(g), tenth(g))


@query(merge_sql("SELECT community, arg_min(target, (-weight, target)) AS target FROM ln JOIN cand USING (community) GROUP BY 1"))
def merge_target_connectivity(spark, d):
    g = part_graph(spark, d)
    return merge.first_targets(g, lopsided(g), tenth(g))


@query(
    merge_sql(
        """SELECT community, arg_min(target, (-gain, target)) AS target FROM (SELECT ln.community, target, 2 * weight / m - 2 * 1.0::DOUBLE * a.s * z.s / (m * m) AS gain
FROM ln JOIN cand USING (community) JOIN st a ON a.community = ln.community JOIN st z ON z.community = ln.target, m) GROUP BY 1"""
    )
)
def merge_target_modularity(spark, d):
    g = part_graph(spark, d)
    return merge.first_targets(g, lopsided(g), tenth(g), "modularity")


# --- covers of every part


def small_communities(spark, d, a: int, b: int) -> DataFrame:
    """Two memberships of each part, in communities of at most ``a`` and ``b`` neighbouring ids."""
    part = table(spark, d, "part")
    of = lambda c: part.select(F.col("p_partkey").alias("node"), c.cast("long").alias("community"))
    return of(2 * F.floor(F.col("p_partkey") / a)).unionByName(of(2 * F.floor(F.col("p_partkey") / b) + 1))


SHARED_SQL = """SELECT u, v, CAST(count(*) AS BIGINT) AS shared FROM (SELECT a.node AS u, b.node AS v FROM {0} a JOIN {0} b ON a.community = b.community AND a.node < b.node) GROUP BY 1, 2"""


def members_sql(a: int, b: int) -> str:
    return f"SELECT p_partkey AS node, 2 * (p_partkey // {a}) AS community FROM part UNION ALL SELECT p_partkey, 2 * (p_partkey // {b}) + 1 FROM part"


@query(f"WITH x AS ({members_sql(4, 7)}) {SHARED_SQL.format('x')}")
def shared_memberships(spark, d):
    return metrics.shared_memberships(small_communities(spark, d, 4, 7))


@query(
    f"""WITH x AS ({members_sql(4, 7)}), y AS ({members_sql(3, 8)}), sx AS ({SHARED_SQL.format("x")}), sy AS ({SHARED_SQL.format("y")}),
n AS (SELECT count(*)::DOUBLE * (count(*) - 1) / 2 AS t FROM part),
j AS (SELECT coalesce(sx.shared, 0) AS a, coalesce(sy.shared, 0) AS b FROM sx FULL JOIN sy USING (u, v)),
z AS (SELECT t - (SELECT count(*) FROM j) AS none FROM n),
o AS (SELECT (none + (SELECT count(*) FROM j WHERE a = b)) / t AS obs FROM z, n),
lv AS (SELECT s, sum(fx) AS fx, sum(fy) AS fy FROM (SELECT a AS s, 1.0::DOUBLE AS fx, 0.0::DOUBLE AS fy FROM j UNION ALL SELECT b, 0.0, 1.0 FROM j UNION ALL SELECT 0, none, none FROM z) GROUP BY 1),
c AS (SELECT sum(fx * fy) / (max(t) * max(t)) AS ex FROM lv, n)
SELECT round(least(1.0, greatest(0.0, (obs - ex) / (1 - ex))), 9) AS omega FROM o, c"""
)
def omega_index(spark, d):
    return rounded(metrics.omega_index(small_communities(spark, d, 4, 7), small_communities(spark, d, 3, 8)))


@query(
    """WITH mm AS (SELECT p_partkey AS node, p_partkey % 4 AS community FROM part UNION ALL SELECT p_partkey, 100 + p_partkey % 7 FROM part)
SELECT a.community, b.community AS other, count(*) AS shared FROM mm a JOIN mm b ON a.node = b.node AND a.community <> b.community WHERE a.community >= 100 GROUP BY 1, 2"""
)
def overlap_counts(spark, d):
    part = table(spark, d, "part")
    of = lambda c: part.select(F.col("p_partkey").alias("node"), c.cast("long").alias("community"))
    c = of(F.col("p_partkey") % 4).unionByName(of(100 + F.col("p_partkey") % 7))
    return merge.overlap_counts(c, c.filter("community >= 100").select("community").distinct())


# --- whole algorithms


FIXED = detect.LouvainOptions(seed=42)
EGO = ego.EgoSplittingOptions(detect.Louvain(detect.LouvainOptions(seed=1)), detect.Louvain(detect.LouvainOptions(seed=1, max_passes=1)))
RUN = detect.moves_of(FIXED)
FOUND = detect_sql("d", "n", "e", RUN)


@query(whole_sql("SELECT * FROM dfound", FOUND))
def louvain_full(spark, d):
    return detect.Louvain(FIXED).detect(part_graph(spark, d)).partition


@query(whole_sql("SELECT * FROM dfound", detect_sql("d", "n", "e", detect.moves_of(detect.LeidenOptions(seed=42)))))
def leiden_full(spark, d):
    return detect.Leiden(detect.LeidenOptions(seed=42)).detect(part_graph(spark, d)).partition


@query(whole_sql("SELECT round(modularity, 9) AS modularity, passes, moves FROM dmetrics", FOUND, item="l_suppkey", vertices="SELECT DISTINCT s_suppkey AS id FROM supplier"))
def louvain_metrics(spark, d):
    return detect.Louvain(FIXED).detect(supplier_graph(spark, d)).metrics().withColumn("modularity", F.round("modularity", 9))


WARM = ", w0 AS MATERIALIZED (SELECT node, dense_rank() OVER (ORDER BY first) - 1 AS community FROM (SELECT node, min(node) OVER (PARTITION BY community) AS first FROM dfound))"


@query(whole_sql("SELECT * FROM wfound", FOUND, WARM, detect_sql("w", "n", "e", RUN, start="w0")))
def louvain_warm(spark, d):
    g = part_graph(spark, d).kept()
    prior = detect.Louvain(FIXED).detect(g).partition
    return detect.Louvain(FIXED).warm(prior).detect(g).partition


@query()
def ego_detect(spark, d):
    return ego.EgoSplitting(EGO).detect(part_graph(spark, d)).memberships


@query()
def ego_with_prior(spark, d):
    g = part_graph(spark, d).kept()
    return online.OnlineEgoSplitting(EGO).detect_with_prior(g, modulo_partition(g)).memberships


@query()
def ego_update(spark, d):
    return updated(spark, EGO, d).memberships


@query()
def merge_detected(spark, d):
    """Merging of what detection found, disjoint."""
    g = part_graph(spark, d).kept()
    return merge.merge_communities(g, detect.Louvain(FIXED).detect(g), merge.MergeOptions(min_fraction=0.05)).partition


@query()
def merge_detected_overlapping(spark, d):
    g = part_graph(spark, d).kept()
    return merge.merge_overlapping(g, ego.EgoSplitting(EGO).detect(g), merge.MergeOptions(min_size=3)).memberships


# --- the same from a local detector that SQL can follow


@dataclass(frozen=True)
class Parity:
    """A user's detector: nodes by parity of their id, alone or inside the tasks."""

    def detect(self, graph: Graph) -> detect.CommunityResult:
        return detect.CommunityResult(graph.vertices.select(F.col("id").alias("node"), F.col("id") % 2).toDF("node", "community"), 0.0, 1, 0)

    def detect_arrays(self, ids, group, src, dst, weight):
        return ids % 2


PARITY = ego.EgoSplittingOptions(Parity(), EGO.glob)
ONCE = detect.moves_of(EGO.glob.options)


def egos_sql(tag: str, v: str, e: str, adj: str) -> str:
    """CTEs {tag}eg (ego, node, local_comm) and {tag}lc (node, local_comm): parity in nets with an edge, else one community for each neighbour."""
    return f""", {tag}mem AS MATERIALIZED (SELECT src AS ego, dst AS node FROM {adj}),
{tag}net AS MATERIALIZED (SELECT DISTINCT a.ego FROM {e} JOIN {tag}mem a ON a.node = {e}.src JOIN {tag}mem b ON b.node = {e}.dst AND a.ego = b.ego),
{tag}eg AS MATERIALIZED (SELECT ego, node, CASE WHEN ego IN (SELECT ego FROM {tag}net) THEN node % 2 ELSE row_number() OVER (PARTITION BY ego ORDER BY node) - 1 END AS local_comm FROM {tag}mem),
{tag}lc AS MATERIALIZED (SELECT DISTINCT v.id AS node, coalesce(local_comm, 0) AS local_comm FROM {v} v LEFT JOIN {tag}eg ON ego = v.id)"""


def persona_graph_sql(tag: str, e: str, eg: str, people: str) -> str:
    """CTEs {tag}n (node: persona) and {tag}g (src, dst, weight), and the memberships {tag}mm that {tag}found gives."""
    return f""", {tag}n AS MATERIALIZED (SELECT persona_id AS node FROM {people}),
{tag}g AS MATERIALIZED (SELECT least(a.persona_id, b.persona_id) AS src, greatest(a.persona_id, b.persona_id) AS dst, sum(weight) AS weight FROM {e} JOIN {eg} x ON x.ego = {e}.src AND x.node = {e}.dst JOIN {eg} y ON y.ego = {e}.dst AND y.node = {e}.src
  JOIN {people} a ON a.node = {e}.src AND a.local_comm = x.local_comm JOIN {people} b ON b.node = {e}.dst AND b.local_comm = y.local_comm GROUP BY 1, 2)"""


def members_of_sql(tag: str, people: str) -> str:
    return f"SELECT node, dense_rank() OVER (ORDER BY community) - 1 AS community FROM (SELECT DISTINCT p.node, f.community FROM {people} p JOIN {tag}found f ON f.node = p.persona_id)"


SPLIT_ALL = egos_sql("o", "v", "e", "adj") + ", pe AS MATERIALIZED (SELECT node, local_comm, (SELECT max(id) FROM v) + dense_rank() OVER (ORDER BY node, local_comm) AS persona_id FROM olc)" + persona_graph_sql("x", "e", "oeg", "pe")
SPLIT_DONE = SPLIT_ALL + detect_sql("x", "xn", "xg", ONCE, 1)


@query(whole_sql(members_of_sql("x", "pe"), SPLIT_DONE))
def ego_detect_parity(spark, d):
    return ego.EgoSplitting(PARITY).detect(part_graph(spark, d)).memberships


def start_sql(tag: str, known: str) -> str:
    """A warm start of the nodes {tag}n from known (node, community): named by the least node, fresh ones by themselves."""
    return f""", {tag}s AS MATERIALIZED (SELECT node, dense_rank() OVER (ORDER BY first) - 1 AS community FROM (SELECT n.node, CASE WHEN k.community IS NULL THEN n.node ELSE min(n.node) OVER (PARTITION BY k.community) END AS first FROM {tag}n n LEFT JOIN {known} k ON k.node = n.node))"""


@query(whole_sql(members_of_sql("x", "pe"), SPLIT_ALL, ", pr AS (SELECT persona_id AS node, node % 13 AS community FROM pe)", start_sql("x", "pr"), detect_sql("x", "xn", "xg", ONCE, 1, "xs")))
def ego_with_prior_parity(spark, d):
    g = part_graph(spark, d).kept()
    return online.OnlineEgoSplitting(PARITY).detect_with_prior(g, modulo_partition(g)).memberships


def updated(spark, options: ego.EgoSplittingOptions, d: str) -> ego.OverlappingResult:
    """The result after an edge between two parts and one to a part that is new."""
    g = part_graph(spark, d).kept()
    new = spark.createDataFrame([(11, 23, 1.0), (11, 10**9, 1.0)], "src long, dst long, weight double")
    after = g.add_edges(new)
    before = online.OnlineEgoSplitting(options).detect(g)
    return online.OnlineEgoSplitting(options).update(after, online.GraphDelta(spark.createDataFrame([(10**9,)], "id long"), new), before)


UPDATED = (
    """, e2 AS MATERIALIZED (SELECT src, dst, sum(weight) AS weight FROM (SELECT * FROM e UNION ALL VALUES (11, 23, 1.0::DOUBLE), (11, 1000000000, 1.0::DOUBLE)) t(src, dst, weight) GROUP BY 1, 2),
v2 AS (SELECT id FROM v UNION SELECT src FROM e2 UNION SELECT dst FROM e2),
adj2 AS MATERIALIZED (SELECT src, dst, weight FROM e2 UNION ALL SELECT dst, src, weight FROM e2),
hit AS (SELECT 1000000000 AS node UNION SELECT 11 UNION SELECT 23 UNION SELECT dst FROM adj2 WHERE src IN (11, 23, 1000000000))"""
    + egos_sql("u", "v2", "e2", "adj2")
    + """,
fresh AS MATERIALIZED (SELECT node, local_comm, (SELECT max(t) FROM (SELECT max(persona_id) AS t FROM pe UNION ALL SELECT max(id) FROM v2)) + dense_rank() OVER (ORDER BY node, local_comm) AS persona_id FROM ulc WHERE node IN (SELECT node FROM hit)),
pe2 AS MATERIALIZED (SELECT node, local_comm, persona_id FROM pe WHERE node NOT IN (SELECT node FROM hit) UNION ALL SELECT node, local_comm, persona_id FROM fresh)"""
    + persona_graph_sql("y", "e2", "ueg", "pe2")
    + """,
had AS MATERIALIZED (SELECT p.node, list_sort(list(DISTINCT f.community)) AS had FROM pe p JOIN xfound f ON f.node = p.persona_id GROUP BY 1),
kn AS MATERIALIZED (SELECT f.node, f.community FROM xfound f JOIN pe2 ON persona_id = f.node
  UNION ALL SELECT persona_id, had[i % len(had) + 1] FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY local_comm) - 1 AS i FROM fresh) JOIN had USING (node))"""
)


@query(whole_sql(members_of_sql("y", "pe2"), SPLIT_DONE, UPDATED, start_sql("y", "kn"), detect_sql("y", "yn", "yg", ONCE, 1, "ys")))
def ego_update_parity(spark, d):
    return updated(spark, PARITY, d).memberships


# --- merging from partitions and covers with a fixed number of small communities


UNEVEN = """, m0 AS MATERIALIZED (SELECT id AS node, CAST(CASE WHEN id % 10 = 0 THEN 1000 + id % 80 ELSE id % 5 END AS BIGINT) AS community FROM v)"""
COVER = """, m0 AS MATERIALIZED (SELECT id AS node, CAST(id % 5 AS BIGINT) AS community FROM v WHERE id % 50 <> 7 UNION ALL SELECT id, CAST(100 + id % 40 AS BIGINT) FROM v WHERE id % 10 = 0 UNION ALL SELECT id, CAST(200 + id % 100 AS BIGINT) FROM v WHERE id % 50 = 7)"""
TURNS = """, th AS (SELECT CAST(ceil(0.1 * count(DISTINCT node)) AS BIGINT) AS t FROM m0),
turn AS MATERIALIZED (SELECT community, row_number() OVER (ORDER BY size, community) AS r FROM (SELECT community, count(*) AS size FROM m0 GROUP BY 1), th WHERE size < t)"""


def merge_steps_sql(steps: int, strategy: str = "connectivity") -> str:
    """CTEs m1 to m{steps}: the partition after each candidate's turn."""
    out = TURNS
    for i in range(1, steps + 1):
        now = f"m{i - 1}"
        gain = "w" if strategy == "connectivity" else "2 * w / m - 2 * 1.0::DOUBLE * a.s * z.s / (m * m)"
        more = "" if strategy == "connectivity" else f"JOIN s{i} a ON a.community = c JOIN s{i} z ON z.community = target, m"
        out += f""",
s{i} AS MATERIALIZED (SELECT community, sum(k) AS s FROM {now} JOIN k USING (node) GROUP BY 1),
c{i} AS MATERIALIZED (SELECT community AS c FROM turn, th WHERE r = {i} AND (SELECT count(*) FROM {now} x WHERE x.community = turn.community) < t),
l{i} AS MATERIALIZED (SELECT c, y.community AS target, sum(weight) AS w FROM adj JOIN {now} x ON x.node = adj.src JOIN c{i} ON x.community = c JOIN {now} y ON y.node = adj.dst AND y.community <> c GROUP BY 1, 2),
t{i} AS MATERIALIZED (SELECT c, arg_min(target, (-gain, target)) AS target FROM (SELECT c, target, {gain} AS gain FROM l{i} {more}) GROUP BY 1),
m{i} AS MATERIALIZED (SELECT node, coalesce(target, community) AS community FROM {now} LEFT JOIN t{i} ON c = community)"""
    return out


def merge_cover_steps_sql(steps: int) -> str:
    out = TURNS
    for i in range(1, steps + 1):
        now = f"m{i - 1}"
        out += f""",
c{i} AS MATERIALIZED (SELECT community AS c FROM turn WHERE r = {i}),
o{i} AS MATERIALIZED (SELECT c, node FROM {now} JOIN c{i} ON community = c),
l{i} AS MATERIALIZED (SELECT c, community AS target, 1 AS kind, count(*)::DOUBLE AS w FROM o{i} JOIN {now} USING (node) WHERE community <> c GROUP BY 1, 2
  UNION ALL SELECT c, community, 2, sum(weight) FROM o{i} JOIN adj ON adj.src = o{i}.node JOIN {now} x ON x.node = adj.dst WHERE community <> c GROUP BY 1, 2),
t{i} AS MATERIALIZED (SELECT c, arg_min(target, (kind, -w, target)) AS target FROM l{i} GROUP BY 1),
m{i} AS MATERIALIZED (SELECT DISTINCT node, coalesce(target, community) AS community FROM {now} LEFT JOIN t{i} ON c = community)"""
    return out


def numbered(last: str) -> str:
    return f"SELECT node, dense_rank() OVER (ORDER BY community) - 1 AS community FROM {last}"


def uneven(g: Graph) -> detect.CommunityResult:
    small, large = 1000 + F.col("id") % 80, F.col("id") % 5
    return detect.CommunityResult(g.vertices.select(F.col("id").alias("node"), F.when(F.col("id") % 10 == 0, small).otherwise(large).alias("community")), 0.0, 1, 0)


def covered(g: Graph) -> ego.OverlappingResult:
    i = F.col("id")
    of = lambda kept, c: g.vertices.filter(kept).select(i.alias("node"), c.alias("community"))
    return ego.OverlappingResult(of(i % 50 != 7, i % 5).unionByName(of(i % 10 == 0, 100 + i % 40)).unionByName(of(i % 50 == 7, 200 + i % 100)))


def merged(strategy: str, local_rows: int) -> Query:
    def run(spark, d):
        g = part_graph(spark, d)
        return merge.merge_communities(g, uneven(g), merge.MergeOptions(min_fraction=0.1, strategy=strategy), local_rows).partition

    return run


def merged_cover(local_rows: int) -> Query:
    def run(spark, d):
        g = part_graph(spark, d)
        return merge.merge_overlapping(g, covered(g), merge.MergeOptions(min_fraction=0.1), local_rows).memberships

    return run


for _name, _rows in (("merge_{}", merge.LOCAL_ROWS), ("merge_{}_rounds", 0)):
    for _strategy in ("connectivity", "modularity"):
        QUERIES[_name.format(_strategy)] = merged(_strategy, _rows)
        SQL[_name.format(_strategy)] = whole_sql(numbered("m8"), UNEVEN, merge_steps_sql(8, _strategy))
    QUERIES[_name.format("overlapping")] = merged_cover(_rows)
    SQL[_name.format("overlapping")] = whole_sql(numbered("m6"), COVER, merge_cover_steps_sql(6))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


__all__ = ["oracle_sql", "queries"]
