import pytest

from meshlight.plans import registry


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """200 parts; two triangles of orders, every pair of parts meets in one order only."""
    d = str(tmp_path_factory.mktemp("tables"))
    spark.range(1, 201).selectExpr("id as p_partkey").write.parquet(f"{d}/part.parquet")
    pairs = [(1, 2), (2, 3), (1, 3), (101, 102), (102, 103), (101, 103)]
    rows = [(o, p) for o, pair in enumerate(pairs) for p in pair]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long").write.parquet(f"{d}/lineitem.parquet")
    return d


def test_covers_of_all_parts(spark, folder):
    got = {(r.community, r.other): r.shared for r in registry.queries()["overlap_counts"](spark, folder).collect()}
    want = {(100 + y, x): sum(p % 4 == x and p % 7 == y for p in range(1, 201)) for x in range(4) for y in range(7)}
    assert got == want
    shared = {(r[0], r[1]): r[2] for r in registry.queries()["shared_memberships"](spark, folder).collect()}
    assert shared == {(a, b): n for b in range(1, 201) for a in range(1, b) if (n := (a // 4 == b // 4) + (a // 7 == b // 7))}


def test_graph_queries_use_pairs_that_meet_once(spark, folder):
    run = lambda name: registry.queries()[name](spark, folder).collect()
    for name in ("louvain_full", "leiden_full"):
        of = {r.node: r.community for r in run(name)}
        assert len(of) == 200 and of[1] == of[2] == of[3] != of[101] == of[102] == of[103]
    nets = {(r.ego, r.src, r.dst) for r in run("ego_net_edges")}
    assert nets == {(1, 2, 3), (2, 1, 3), (3, 1, 2), (101, 102, 103), (102, 101, 103), (103, 101, 102)}
