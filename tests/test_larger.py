from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from test_graph import graph, part

from meshlight.operators import ego, sweeps
from meshlight.operators.detect import Louvain, LouvainOptions
from meshlight.operators.graph import build
from meshlight.operators.kernel import MoveOptions
from meshlight.operators.partition import dense_ids, warm_start
from meshlight.runtime import cut
from meshlight.sources.builders import part_graph


def test_start_on_driver_is_warm_start(spark):
    for ids in ([n + 3 for n in range(40)], [n * 7 for n in range(40)]):  # without and with gaps
        vertices = spark.createDataFrame([(n, 1.0) for n in ids], "id long, weight double")
        for name in (lambda n: n % 5, lambda n: n % 7 * 10**12):  # few and far numbers
            prior = part(spark, [(n, name(n)) for n in ids[3:] if n % 3] + [(-5, 2), (10**6, 0)])
            names = sweeps.names_of(vertices)
            got = dict(zip(names.of(np.arange(40)).tolist(), sweeps.start_of(prior, vertices, names).tolist()))
            assert got == dict(warm_start(vertices.select("id"), prior).collect())


def test_numbering_shuffles_once(spark):
    rows = [(n * 37 % 1000, n % 3) for n in range(1000)]
    ids = dense_ids(part(spark, rows), ["node", "community"], "new", 7)
    assert {(n, c): k for n, c, k in ids.collect()} == {key: k for k, key in enumerate(sorted(rows), 7)}
    assert "Exchange" not in ids._jdf.queryExecution().toString()
    people = spark.createDataFrame([(n, 0, 100 + n) for n in range(9)], "node long, local_comm long, persona_id long")
    for c, joined in ((lambda n: n % 4, False), (lambda n: n % 4 * 2 + 1, True)):
        found = ego.memberships(people, spark.createDataFrame([(100 + n, c(n)) for n in range(9)], "persona_id long, community long"))
        assert dict(found.collect()) == {n: n % 4 for n in range(9)}
        assert ("Join" in found._jdf.queryExecution().toString()) == joined  # numbers that need no change are not joined


def test_wide_nets_are_found_without_counting_all(spark):
    rng = np.random.default_rng(3)
    pairs = {(min(a, b), max(a, b)) for a, b in rng.integers(0, 300, (2500, 2)).tolist() if a != b} | {(0, k) for k in range(1, 250)} | {(5, k) for k in range(6, 90)}
    plain = cut(spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src long, dst long, weight double").repartition(7))
    degree = np.bincount(np.array(list(pairs)).ravel())
    for most in (3, 100, 250, 2000, 10**6):
        assert sorted(r[0] for r in ego.wide_egos(plain, most).collect()) == np.flatnonzero(degree * (degree - 1) / 2 > most).tolist()


def test_few_added_edges_are_summed_alone(spark):
    old = {(a, b): 1.0 + a for a in range(30) for b in range(a, 30, 7)}
    g = build(spark.createDataFrame([(a, b, w) for (a, b), w in old.items()], "src long, dst long, weight double")).kept()
    new = [(0, 7, 2.0), (7, 0, 1.0), (3, 3, 5.0), (1, 2, 1.0), (2, 10**9, 4.0)]  # an old pair twice, a loop, a new pair, a new node
    after = g.add_edges(spark.createDataFrame(new, "src long, dst long, weight double"))
    want = Counter(old)
    for a, b, w in new:
        want[min(a, b), max(a, b)] += w
    assert {(r.src, r.dst): r.weight for r in after.merged.collect()} == want and after.merged.count() == len(want)
    assert sorted(after.vertices.collect()) == [(n, 1.0) for n in [*range(30), 10**9]]
    assert after.edges.count() == len(old) + len(new)
    assert "SortMergeJoin" not in (plan := after.merged._jdf.queryExecution().toString()) and "Anti" in plan  # the old edges are not shuffled
    again = after.kept().add_edges(spark.createDataFrame([(1, 2, 3.0)], "src long, dst long, weight double"))
    assert again.merged.filter("src = 1 and dst = 2").first().weight == 4.0


def test_memberships_are_made_when_asked_for(spark):
    result = ego.EgoSplitting().detect(build(spark.createDataFrame([(0, 1), (1, 2), (0, 2), (2, 3)], "src long, dst long")))
    assert "memberships" not in vars(result)
    assert {r.node for r in result.memberships.collect()} == {0, 1, 2, 3} and "memberships" in vars(result)


def test_known_items_need_no_list_of_groups(spark, tmp_path):
    for name, ids, found in (("dense", range(4), False), ("gaps", (0, 1, 2, 9), False), ("fewer", range(3), True), ("gap", (0, 1, 3), True)):
        spark.createDataFrame([(n,) for n in [*ids, None]], "p_partkey long").write.parquet(f"{tmp_path}/{name}/part.parquet")
        rows = [(1, 0), (1, 2 if name != "gap" else 3), (2, 1), (2, 1)] + [(3, 0), (3, 7), (4, 8)] * found  # 7 meets another one, 8 does not
        spark.createDataFrame([*rows, (5, None)], "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/{name}/lineitem.parquet")
        vertices = part_graph(spark, f"{tmp_path}/{name}").vertices
        assert sorted(r.id for r in vertices.collect()) == sorted([*ids, *[7] * found])
        assert ("collect_set" in vertices._jdf.queryExecution().toString()) == found


def test_ends_are_summed_in_order_and_sent_at_once():
    rng = np.random.default_rng(5)
    for scale, n in ((1, 50), (0.5, 50), (300, 50), (1, 1 << 30)):  # whole, halves, above a byte, too far apart for one number
        s, d = rng.integers(n - 50, n, 4000), rng.integers(n - 50, n, 4000)
        w, key = rng.integers(0, 4, 4000) * scale, s % 7
        want = Counter()
        for k, a, b, x in zip(key.tolist(), s.tolist(), d.tolist(), w.tolist()):
            want[k, a, b] += x
        (batch,) = sweeps._rows(sweeps.packed(*sweeps.summed(key, s, d, w, n)))
        got = {}
        for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            nodes, count, dst, x = sweeps.unpack(data)
            got |= {(k, a, b): y for a, b, y in zip(np.repeat(nodes, count).tolist(), dst.tolist(), x.tolist())}
        assert got == want and list(got) == sorted(want)
    assert not list(sweeps._rows(sweeps.packed(*sweeps.summed(s[:0], s[:0], s[:0], w[:0], 5))))


def test_whole_communities_are_not_read_again(monkeypatch):
    src, dst = np.array([0, 1, 0, 3, 4, 3, 6]), np.array([1, 2, 2, 4, 5, 5, 7])
    rows = [(0, data) for _, _, data in sweeps.dealt(src, dst, np.ones(7), lambda n: n, 9, 1, MoveOptions(buckets=1))]
    calls, each = [], sweeps.each
    monkeypatch.setattr(sweeps, "each", lambda *a, **k: calls.append(a) or each(*a, **k))
    level = sweeps.Level(None, 9, None, rows)
    assert sweeps.connected(level, np.array([0, 0, 0, 3, 3, 3, 6, 6, 8])).tolist() == [0, 0, 0, 1, 1, 1, 2, 2, 3] and len(calls) == 1
    assert sweeps.connected(level, np.array([0, 0, 0, 0, 0, 0, 6, 6, 6])).tolist() == [0, 0, 0, 1, 1, 1, 2, 2, 3]


def test_personas_are_numbered_where_rows_lie(spark, monkeypatch):
    """Without a shuffle of all personas, and as personas() numbers them; lone nodes and wide nets too."""
    g = graph(spark, [(0, 1), (1, 2), (0, 2), (2, 3), (3, 4), (2, 4), (4, 5), (5, 5), (6, 7)], [0, 9, 40]).kept()
    wanted = ego.personas
    monkeypatch.setattr(ego, "personas", None)
    for most in (ego.EGO_EDGES, 1):
        people, egos, _ = ego.split(g, ego.EgoSplittingOptions(Louvain(LouvainOptions(seed=1)), most=most))
        want = wanted(g.vertices.select(F.col("id").alias("node")), egos).select("node", "local_comm", "persona_id")
        assert sorted(map(tuple, people.collect())) == sorted(map(tuple, want.collect()))
