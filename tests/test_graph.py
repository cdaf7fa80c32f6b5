from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from fixtures_graphs import KARATE_CLUBS, KARATE_EDGES, TRIANGLES
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from meshlight.errors import InvalidInput
from meshlight.functions import metrics
from meshlight.operators import partition
from meshlight.operators.components import connected_components
from meshlight.operators.graph import build, empty
from meshlight.operators.registry import NodeRegistry
from meshlight.sources import builders


def graph(spark, edges, nodes=()):
    rows = [(e[0], e[1], float(e[2]) if len(e) > 2 else 1.0) for e in edges]
    v = spark.createDataFrame([(n, 1.0) for n in nodes], "id long, weight double") if nodes else None
    return build(spark.createDataFrame(rows, "src long, dst long, weight double"), v)


def part(spark, rows):
    return spark.createDataFrame([(int(a), int(b)) for a, b in rows], "node long, community long")


def one(df):
    return df.first()[0]


def test_counts_and_strength(spark):
    g = graph(spark, [(0, 1, 1.5), (1, 2, 2.5), (2, 2, 1.0), (1, 0, 0.5)], nodes=[9])
    assert one(g.node_count()) == 4 and one(g.edge_count()) == 3 and one(g.total_weight()) == 5.5
    assert dict(g.strength().collect()) == {0: 2.0, 1: 4.5, 2: 3.5, 9: 0.0}
    assert sorted(tuple(r) for r in g.neighbors(1).collect()) == [(0, 0.5), (0, 1.5), (2, 2.5)]
    assert g.neighbors(77).count() == 0
    assert not g.is_directed() and g.clone().edges is g.edges


def test_lone_self_loop(spark):
    g = graph(spark, [(0, 0, 1.5)])
    assert one(g.edge_count()) == 0 and one(g.total_weight()) == 1.5 and dict(g.strength().collect()) == {0: 1.5}


def test_subgraph_and_removal(spark):
    g = graph(spark, [(0, 1, 1), (1, 2, 2), (2, 3, 1)])
    ids = spark.createDataFrame([(1,), (2,), (99,)], "id long")
    s = g.subgraph(ids)
    assert one(s.node_count()) == 2 and one(s.edge_count()) == 1 and one(s.total_weight()) == 2.0
    r = g.remove_edges_for(ids)
    assert one(r.node_count()) == 4 and one(r.total_weight()) == 0.0  # an edge inside the set is subtracted once


def test_weights_to_communities(spark):
    g = graph(spark, [(0, 1, 1.5), (1, 2, 2.5)])
    p = part(spark, [(0, 0), (1, 0), (2, 1)])
    assert g.weight_to_community(1, 0, p).first()["weight"] == 1.5 and g.weight_to_community(1, 1, p).first()["weight"] == 2.5
    assert dict(g.community_strength(p).collect()) == {0: 5.5, 1: 2.5}


def test_nodes_keep_their_first_weight(spark):
    g = graph(spark, [(0, 1)], nodes=[5]).add_nodes(spark.createDataFrame([(0, 9.0), (6, 2.0)], "id long, weight double"))
    assert dict(g.vertices.collect()) == {0: 1.0, 1: 1.0, 5: 1.0, 6: 2.0}
    assert dict(g.add_edges(spark.createDataFrame([(6, 7, 1.0)], "src long, dst long, weight double")).vertices.collect())[7] == 1.0


def test_nulls_and_negative_weights(spark):
    rows = spark.createDataFrame([(0, None, 1.0), (1, 2, None)], "src long, dst long, weight double")
    assert [tuple(r) for r in build(rows).merged.collect()] == [(1, 2, 1.0)]
    with pytest.raises(InvalidInput):
        build(spark.createDataFrame([(0, 1, -1.0)], "src long, dst long, weight double"), strict=True)


def test_registry(spark):
    names = spark.createDataFrame([("bob", 2), ("alice", 1), ("alice", 5), (None, 0)], "name string, at int")
    r = NodeRegistry.new(spark).register(names, "at")
    assert dict(r.entries.collect()) == {"alice": 0, "bob": 1}
    r = r.register(spark.createDataFrame([("carol",), ("alice",)], "name string"))
    assert dict(r.entries.collect()) == {"alice": 0, "bob": 1, "carol": 2} and one(r.count()) == 3
    assert [tuple(x) for x in r.ids(spark.createDataFrame([("zoe",)], "name string")).collect()] == [("zoe", 0, False)]
    assert [tuple(x) for x in r.names(spark.createDataFrame([(-1,)], "id long")).collect()] == [(-1, "", False)]


@pytest.mark.parametrize(
    "edges, labels, want",
    [
        (KARATE_EDGES, KARATE_CLUBS, 0.371466),
        ([(0, 1)], [(0, 0), (1, 1)], -0.5),
        ([(0, 1, 1), (1, 2, 2), (0, 2, 3)], [(0, 0), (1, 0), (2, 1)], 2 / 12 - (7 / 12) ** 2 - (5 / 12) ** 2),
        ([(i, (i + 1) % 6) for i in range(6)], [(i, i // 3) for i in range(6)], 1 / 6),
        (TRIANGLES, [(i, i // 3) for i in range(6)], 0.5),
        ([(a, b) for a in range(5) for b in range(a)], [(i, 0) for i in range(5)], 0.0),
        ([(0, 1)], [], 0.0),
    ],
)
def test_modularity(spark, edges, labels, want):
    assert one(metrics.modularity(graph(spark, edges), part(spark, labels))) == pytest.approx(want, abs=1e-6)


def test_omega_and_nmi(spark):
    a, single = part(spark, [(0, 0), (1, 0), (2, 1), (3, 1)]), part(spark, [(i, i) for i in range(4)])
    assert one(metrics.omega_index(a, a)) == pytest.approx(1.0) and one(metrics.nmi(a, a)) == pytest.approx(1.0)
    assert one(metrics.omega_index(part(spark, [(i, 0) for i in range(4)]), single)) < 0.5
    assert one(metrics.omega_index(part(spark, []), part(spark, []))) == 0.0 and one(metrics.nmi(part(spark, []), part(spark, []))) == 0.0
    assert one(metrics.omega_index(part(spark, [(0, 0), (1, 0)]), part(spark, [(0, 0), (1, 0)]))) == 1.0
    overlap = one(metrics.omega_index(part(spark, [(0, 0), (1, 0), (2, 0), (1, 1), (2, 1), (3, 1)]), part(spark, [(0, 0), (1, 0), (2, 1), (3, 1)])))
    assert 0 <= overlap <= 1


def test_contract_halves_and_keeps_q(spark):
    g = graph(spark, [*TRIANGLES, (2, 3), (0, 0, 4)])
    p = part(spark, [(i, i // 3) for i in range(6)])
    assert sorted(tuple(r) for r in partition.contract(g.merged, p).collect()) == [(0, 0, 5.0), (0, 1, 1.0), (1, 1, 3.0)]
    assert sorted(tuple(r) for r in partition.contract(g.merged, p, "textbook").collect()) == [(0, 0, 7.0), (0, 1, 1.0), (1, 1, 3.0)]


def test_normalize_compose_warm(spark):
    p = part(spark, [(0, 7), (1, 3), (2, 7)])
    assert dict(partition.normalize(p).collect()) == {0: 1, 1: 0, 2: 1}
    assert dict(partition.compose(p, part(spark, [(7, 5), (3, 6)])).collect()) == {0: 5, 1: 6, 2: 5}
    ids = spark.createDataFrame([(i,) for i in range(4)], "id long")
    assert dict(partition.warm_start(ids, part(spark, [(1, 9), (2, 9), (77, 0)])).collect()) == {0: 0, 1: 1, 2: 1, 3: 2}
    assert partition.normalize(part(spark, [])).count() == 0


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=30))
def test_components(spark, edges):
    root = {n: n for e in edges for n in e}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    found = connected_components(spark.createDataFrame(edges, "src long, dst long"))
    assert dict(found.collect()) == {n: find(n) for n in root}


def test_components_of_many_edges(spark):
    """More edges than a sum of shortened hashes would bear."""
    edges = spark.range(1, 200_000).selectExpr("id AS src", "id - id % 100 AS dst")
    found = connected_components(edges)
    assert found.count() == 200_000 and found.filter("component <> node - node % 100").count() == 0


def test_empty_graph(spark):
    g = empty(spark)
    assert one(g.node_count()) == 0 and one(g.edge_count()) == 0 and one(g.total_weight()) == 0.0 and g.strength().count() == 0


def test_pairs_of_groups_in_parts(spark, monkeypatch):
    """Repeated items, nulls and groups that go on in the next batch; pairs by many ranges, for numbers and names of groups alike."""
    rng = np.random.default_rng(3)
    rows = [(int(g), int(i)) for g, i in zip(rng.integers(0, 300, 4000), rng.integers(-40, 40, 4000))] + [(None, 1), (2, None)]
    want = Counter((a, b) for g in range(300) for a, b in combinations(sorted({i for h, i in rows if h == g and i is not None}), 2))
    monkeypatch.setattr(builders, "PAIRED", 150)
    lines = spark.createDataFrame(rows, "g long, i int")
    for least in (1, 3):
        for of in (lines, lines.withColumn("g", F.col("g").cast("string"))):
            got = builders.co_occurrence(of, "g", "i", least)
            assert got.columns == ["src", "dst", "weight"]
            assert sorted((r[0], r[1], r[2]) for r in got.collect()) == sorted((a, b, float(n)) for (a, b), n in want.items() if n >= least)
    assert builders.co_occurrence(lines.filter("false"), "g", "i").isEmpty()
    assert "MapInArrow" in builders.co_occurrence(lines, "g", "i")._jdf.queryExecution().toString()
