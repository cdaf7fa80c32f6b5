"""Triangles against brute force, over ranges of every number and tasks of every kind."""

from itertools import combinations

import numpy as np
import pytest

from meshlight.operators import triangles
from meshlight.operators.graph import build


def random_edges(nodes, tries, seed):
    rng = np.random.default_rng(seed)
    e = np.unique(np.sort(rng.integers(0, nodes, (tries, 2)), axis=1), axis=0)
    e = e[e[:, 0] < e[:, 1]] * 7 - 30  # ids with gaps, some negative
    return {(a, b): 1.0 + k for k, (a, b) in enumerate(e.tolist())}


def brute(edges):
    ids = sorted({x for e in edges for x in e})
    found = [c for c in combinations(ids, 3) if all(p in edges for p in combinations(c, 2))]
    return sorted((ego, *e, edges[e]) for c in found for ego, e in ((c[0], c[1:]), (c[1], (c[0], c[2])), (c[2], c[:2])))


@pytest.mark.parametrize("finest,most", [(1, 10**6), (4, 10), (16, 10)])
def test_every_triangle_once(spark, monkeypatch, finest, most):
    edges = random_edges(40, 260, 5) | {(-1000, 7 * k - 30): 0.5 for k in range(40)}  # a hub beside it
    monkeypatch.setattr(triangles, "FINEST", finest)
    monkeypatch.setattr(triangles, "WEDGES", 50)
    df = spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "src long, dst long, weight double")
    assert sorted(map(tuple, triangles.nets(df, most).collect())) == brute(edges)


def test_no_wedge_leaves_its_task(spark):
    df = spark.createDataFrame([(a, b, 1.0) for a, b in combinations(range(30), 2)], "src long, dst long, weight double")
    found = triangles.nets(df)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and found.count() == 3 * 4060


def test_packed_edges_come_back():
    src, dst, w = np.array([5, -3, 2**60, 5]), np.array([9, 2**61, 2**61, 7]), np.array([1.0, 0.25, -2.0, 3.5])
    got = list(zip(*(x.tolist() for x in triangles.unpack(triangles.pack(src, dst, w)))))
    assert got == sorted(zip(src.tolist(), dst.tolist(), w.tolist()))


def test_a_kept_graph_is_read_from_its_tables(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 1, 2.0), (2, 3, 1.0)], "src long, dst long, weight double")
    kept = build(edges).kept()
    assert kept.kept() is kept and sorted(map(tuple, kept.merged.collect())) == [(1, 2, 3.0), (2, 3, 1.0)]
    assert len(kept.adjacency.inputFiles()) > 0  # files of its own, not the rows it was made of
    more = kept.add_edges(spark.createDataFrame([(1, 2, 4.0)], "src long, dst long, weight double"))
    assert not more.tables and sorted(map(tuple, more.merged.collect())) == [(1, 2, 7.0), (2, 3, 1.0)]
