from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F
from fixtures_graphs import KARATE_CLUBS, KARATE_EDGES, TRIANGLES, planted
from test_graph import graph, one, part

from meshlight.errors import DirectedNotSupported, EmptyGraph, InvalidInput, InvalidMergeOptions, PartitionGraphMismatch
from meshlight.functions import metrics
from meshlight.operators import detect, ego, kernel, merge
from meshlight.operators.graph import EDGES, Graph, build, empty
from meshlight.sources.generators import barabasi_albert, perturb, random_edges
from meshlight.streaming import online

L, LO, E, EO = detect.Louvain, detect.LouvainOptions, detect.Leiden, detect.LeidenOptions
SPLIT = ego.EgoSplittingOptions(L(LO(seed=1)), L(LO(seed=1, max_passes=1)))


@pytest.mark.parametrize("detector", [L(LO(seed=1)), E(EO(seed=1)), E(EO(num_runs=2))])
def test_guards(spark, detector):
    assert detector.detect(empty(spark)).partition.count() == 0
    lone = detector.detect(build(spark.createDataFrame([], EDGES), spark.createDataFrame([(7,)], "id long")))
    assert [tuple(r) for r in lone.partition.collect()] == [(7, 0)] and (lone.modularity, lone.passes, lone.moves) == (0.0, 1, 0)
    five = detector.detect(build(spark.createDataFrame([], EDGES), spark.createDataFrame([(i,) for i in range(5)], "id long")))
    assert sorted(r[1] for r in five.partition.collect()) == [0, 1, 2, 3, 4]
    with pytest.raises(DirectedNotSupported):
        detector.detect(build(spark.createDataFrame([(0, 1, 1.0)], EDGES), directed=True))
    assert len({r[1] for r in detector.detect(graph(spark, TRIANGLES)).partition.collect()}) == 2
    loop = detector.detect(graph(spark, [(0, 0), (0, 1)]))
    assert loop.partition.count() == 2


@pytest.mark.parametrize("seed", [1, 2, 42])
def test_karate_and_planted(spark, seed):
    for d in (L(LO(seed=seed)), E(EO(seed=seed))):
        found = d.detect(graph(spark, KARATE_EDGES))
        assert found.modularity > 0.35 and one(metrics.modularity(graph(spark, KARATE_EDGES), found.partition)) == pytest.approx(found.modularity)
        ids = {r[1] for r in found.partition.collect()}
        assert ids == set(range(len(ids))) and 2 <= len(ids) <= 6
    edges, truth = planted(6, 20, 0.6, 0.02, seed)
    found = E(EO(seed=seed)).detect(graph(spark, edges))
    assert one(metrics.nmi(found.partition, part(spark, truth))) >= 0.95
    assert metrics.disconnected(graph(spark, edges), found.partition).count() == 0


def test_distributed_is_the_same_as_local(spark):
    g = graph(spark, KARATE_EDGES)
    for far, near in ((L(LO(seed=2, max_passes=2, buckets=3, local_threshold=0)), L(LO(seed=2, max_passes=2, buckets=3))), (E(EO(seed=2, max_iterations=1, buckets=2, local_threshold=0)), E(EO(seed=2, max_iterations=1, buckets=2)))):
        a, b = far.detect(g), near.detect(g)
        assert sorted(a.partition.collect()) == sorted(b.partition.collect()) and a.modularity == pytest.approx(b.modularity) and (a.passes, a.moves) == (b.passes, b.moves)


def test_distributed_is_the_same_on_weights_and_ties(spark):
    """Weights that tie often, a self-loop, parallel rows and a lone node."""
    rng = np.random.default_rng(3)
    src, dst = random_edges(40, 90, 3)
    edges = [(int(a), int(b), float(w)) for a, b, w in zip(src, dst, rng.choice([1.0, 2.0, 0.5], len(src)))] + [(5, 5, 3.0)]
    g = graph(spark, edges, nodes=range(42))
    for far, near in ((L(LO(seed=4, max_passes=2, buckets=3, local_threshold=0)), L(LO(seed=4, max_passes=2, buckets=3))), (E(EO(seed=4, max_iterations=2, buckets=3, local_threshold=0)), E(EO(seed=4, max_iterations=2, buckets=3)))):
        a, b = far.detect(g), near.detect(g)
        assert sorted(a.partition.collect()) == sorted(b.partition.collect()) and (a.passes, a.moves) == (b.passes, b.moves)


#: Graphs of the shape of the college football and the political books networks: groups, size, chances of an edge inside and across.
SHAPED = {"football": (12, 10, 0.76, 0.035), "books": (3, 35, 0.22, 0.012)}


@pytest.mark.parametrize("name", SHAPED)
def test_accuracy_on_shaped_graphs(spark, name):
    edges, truth = planted(*SHAPED[name], seed=5)
    g = graph(spark, edges, nodes=[n for n, _ in truth])
    for d in (L(LO(seed=2)), E(EO(seed=2))):
        assert one(metrics.nmi(d.detect(g).partition, part(spark, truth))) >= 0.9
    found = ego.EgoSplitting(SPLIT).detect(g)
    invariants(g, found)
    assert one(metrics.omega_index(found.memberships, part(spark, truth), g.vertices.selectExpr("id AS node"))) > 0.0


def test_accuracy_on_karate(spark):
    g = graph(spark, KARATE_EDGES)
    clubs = part(spark, KARATE_CLUBS)
    for d in (L(LO(seed=2)), E(EO(seed=2))):
        assert one(metrics.nmi(d.detect(g).partition, clubs)) >= 0.6


def test_leiden_takes_the_best_of_its_runs(spark, monkeypatch):
    g = graph(spark, KARATE_EDGES)
    monkeypatch.setattr(detect.time, "time_ns", lambda: 7)
    best = E(EO(num_runs=4)).detect(g)
    each = [E(EO(seed=7 + k)).detect(g).modularity for k in range(4)]
    assert best.modularity == max(each)
    assert E(EO(seed=9, num_runs=4)).detect(g).modularity == E(EO(seed=9)).detect(g).modularity  # a seed means one run


def test_detectors_run_side_by_side(spark):
    from concurrent.futures import ThreadPoolExecutor

    g = graph(spark, KARATE_EDGES)
    d = L(LO(seed=3))
    with ThreadPoolExecutor(4) as pool:
        found = list(pool.map(lambda _: sorted(d.detect(g).partition.collect()), range(4)))
    assert all(f == found[0] for f in found)


def test_update_is_a_full_run_of_the_changed_graph(spark):
    """Parts as a full run gives them: ego nets and persona edges after an update equal those made anew, but for persona ids."""
    g = graph(spark, KARATE_EDGES)
    o = online.OnlineEgoSplitting(SPLIT)
    new = spark.createDataFrame([(16, 24, 2.0), (0, 34, 1.0), (0, 1, 1.0)], EDGES)
    after = g.add_edges(new)
    found = o.update(after, online.GraphDelta(spark.createDataFrame([(34,)], "id long"), new), o.detect(g)).state
    whole = o.detect(after).state
    assert sorted(found.ego_partition.collect()) == sorted(whole.ego_partition.collect())

    def shown(state):
        name = {r.persona_id: (r.node, r.local_comm) for r in state.personas.collect()}
        return sorted((*sorted((name[r.src], name[r.dst])), r.weight) for r in state.persona_edges.collect())

    assert shown(found) == shown(whole)


def test_many_graphs_at_once():
    rng = np.random.default_rng(0)
    ids, group, src, dst, w, alone, at = [], [], [], [], [], [], 0
    for k in range(20):
        n = int(rng.integers(1, 20))
        s, d = random_edges(n, int(rng.integers(0, 40)), k)
        x = rng.integers(1, 4, len(s)).astype(float)
        alone.append(kernel.detect(np.arange(n), np.zeros(n, int), s, d, x, kernel.MoveOptions(seed=5)))
        ids.append(np.arange(n)), group.append(np.full(n, k)), src.append(s + at), dst.append(d + at), w.append(x)
        at += n
    found = kernel.detect(*map(np.concatenate, (ids, group, src, dst, w)), kernel.MoveOptions(seed=5))
    assert (found.community == np.concatenate([a.community for a in alone])).all()
    assert (found.passes == [a.passes[0] for a in alone]).all()


def test_warm_start(spark):
    g = graph(spark, KARATE_EDGES)
    cold = L(LO(seed=2)).detect(g)
    warm = L(LO(seed=2)).warm(cold.partition).detect(g)
    assert warm.modularity >= cold.modularity - 1e-9 and warm.passes <= cold.passes
    with pytest.raises(InvalidInput):
        L(LO(seed=2)).warm(part(spark, [(0, -1)])).detect(g)


def test_generators():
    s, d = barabasi_albert(200, 5, 42)
    assert len(s) == 15 + 194 * 5 and (s < d).all() and len(set(zip(s.tolist(), d.tolist()))) == len(s)
    a, b = perturb(s, d, 200, 10, 10, 1)
    assert len(a) == len(s) and (a != b).all()


def invariants(g, result):
    m = result.memberships.collect()
    nodes, communities = {r[0] for r in m}, {r[1] for r in m}
    assert nodes == {r[0] for r in g.vertices.collect()} and communities == set(range(len(communities))) and len(m) == len(set(m))
    by_node, by_community = {r[0]: r[1] for r in result.node_communities().collect()}, {r[0]: r[1] for r in result.communities().collect()}
    assert sum(map(len, by_node.values())) == sum(map(len, by_community.values())) == len(m)
    if result.state:
        ids = [r[0] for r in result.state.personas.select("persona_id").collect()]
        assert len(ids) == len(set(ids)) and not set(ids) & nodes
        assert result.state.persona_edges.agg({"weight": "sum"}).first()[0] == pytest.approx(one(g.total_weight()))


def test_ego_splitting(spark):
    with pytest.raises(EmptyGraph):
        ego.EgoSplitting(SPLIT).detect(empty(spark))
    with pytest.raises(DirectedNotSupported):
        ego.EgoSplitting(SPLIT).detect(build(spark.createDataFrame([(0, 1, 1.0)], EDGES), directed=True))
    bow = graph(spark, [*TRIANGLES[:3], (2, 3), (3, 4), (2, 4), (0, 0)], nodes=[9])
    found = ego.EgoSplitting(SPLIT).detect(bow)
    invariants(bow, found)
    assert len(dict(found.node_communities().collect())[2]) == 2  # the shared corner is in both triangles
    star = graph(spark, [(0, k) for k in range(1, 6)])
    assert len(dict(ego.EgoSplitting(SPLIT).detect(star).node_communities().collect())[0]) <= 5
    whole = ego.ego_partition(graph(spark, KARATE_EDGES), L(LO(seed=1)))
    large = ego.ego_partition(graph(spark, [*TRIANGLES, (2, 3)]), L(LO(seed=1)), most=0)  # every net through the distributed path
    small = ego.ego_partition(graph(spark, [*TRIANGLES, (2, 3)]), L(LO(seed=1)))
    assert sorted(large.collect()) == sorted(small.collect()) and whole.count() == 156


def test_online_updates(spark):
    g = graph(spark, KARATE_EDGES)
    o = online.OnlineEgoSplitting(SPLIT)
    prior = o.detect(g)
    none = spark.createDataFrame([], "id long")
    assert o.update(g, online.GraphDelta(none, online.empty_edges(spark)), prior) is prior
    new = spark.createDataFrame([(16, 24, 1.0), (0, 34, 1.0)], EDGES)
    after = g.add_edges(new)
    delta = online.GraphDelta(spark.createDataFrame([(34,)], "id long"), new)
    found = o.update(after, delta, prior)
    invariants(after, found)
    # personas of nodes that nothing touched stay
    changed = {r[0] for r in online.affected_nodes(after, delta).collect()}
    same = {tuple(r) for r in prior.state.personas.collect() if r[0] not in changed}
    assert same <= {tuple(r) for r in found.state.personas.collect()}
    lone = after.add_nodes(spark.createDataFrame([(50, 1.0)], "id long, weight double"))
    invariants(lone, o.update(lone, online.GraphDelta(spark.createDataFrame([(50,)], "id long"), online.empty_edges(spark)), found))
    with pytest.raises(PartitionGraphMismatch):
        o.update(after, online.GraphDelta(spark.createDataFrame([(777,)], "id long"), online.empty_edges(spark)), found)
    invariants(after, o.update(after, delta, ego.OverlappingResult(prior.memberships)))
    invariants(g, o.detect_with_prior(g, prior.memberships))


def test_edge_stream(spark, tmp_path):
    source, store = str(tmp_path / "in"), str(tmp_path / "state")
    spark.createDataFrame([(a, b, 1.0) for a, b in TRIANGLES], EDGES).coalesce(1).write.parquet(source)
    stream = lambda: spark.readStream.schema(EDGES).parquet(source).writeStream.foreachBatch(online.batch_updater(spark, store, SPLIT)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    stream()
    spark.createDataFrame([(2, 3, 1.0), (5, 6, 1.0)], EDGES).coalesce(1).write.mode("append").parquet(source)
    stream()
    s = online.StateStore(spark, store)
    assert s.latest() == 2
    g, result = s.read(2)
    assert one(g.edge_count()) == 8
    invariants(g, result)
    online.batch_updater(spark, store, SPLIT)(spark.createDataFrame([(2, 3, 1.0), (5, 6, 1.0)], EDGES), 1)  # the batch comes again
    assert one(s.read(2)[0].edge_count()) == 8


def test_merging(spark):
    star = graph(spark, [(0, 1), (0, 2), (0, 3)])
    single = detect.CommunityResult(part(spark, [(i, i) for i in range(4)]), 0.0, 3, 3)
    done = merge.merge_communities(star, single, merge.MergeOptions(min_size=2))
    assert {r[1] for r in done.partition.collect()} == {0} and (done.passes, done.moves) == (0, 0)
    lone = graph(spark, [(0, 1)], nodes=[2])
    kept = merge.merge_communities(lone, detect.CommunityResult(part(spark, [(0, 0), (1, 0), (2, 1)]), 0, 1, 0), merge.MergeOptions(min_size=2))
    assert len({r[1] for r in kept.partition.collect()}) == 2
    ring = graph(spark, [*((i, (i + 1) % 8) for i in range(8)), (0, 8), (0, 9), (8, 9)])
    both = merge.merge_communities(ring, detect.CommunityResult(part(spark, [*((i, 0) for i in range(8)), (8, 1), (9, 1)]), 0, 1, 0), merge.MergeOptions(min_fraction=0.3))
    assert len({r[1] for r in both.partition.collect()}) == 1
    for bad in (merge.MergeOptions(min_size=-1), merge.MergeOptions(min_fraction=1.5)):
        with pytest.raises(InvalidMergeOptions):
            merge.merge_communities(star, single, bad)
    with pytest.raises(PartitionGraphMismatch):
        merge.merge_communities(star, detect.CommunityResult(part(spark, [(9, 0)]), 0, 1, 0), merge.MergeOptions())
    path = graph(spark, [(0, 1), (1, 2), (2, 3)])
    over = merge.merge_overlapping(path, ego.OverlappingResult(part(spark, [(0, 0), (1, 0), (2, 0), (3, 1)])), merge.MergeOptions(min_size=2))
    assert sorted(tuple(r) for r in over.memberships.collect()) == [(0, 0), (1, 0), (2, 0), (3, 0)] and over.state is None


def test_merge_strategies():
    by_weight = merge.best_target({1: 1.0, 2: 2.0, 3: 2.0}, {}, 0, 10.0, merge.MergeOptions())
    assert by_weight == 2
    gain = merge.best_target({1: 1.0, 2: 1.5}, {0: 2.5, 1: 1.0, 2: 18.0}, 0, 10.0, merge.MergeOptions(strategy="modularity"))
    assert gain == 1


def test_user_detector(spark):
    class One:
        def detect(self, g):
            return detect.CommunityResult(g.vertices.selectExpr("id as node", "0L as community"), 0.0, 1, 0)

    g = graph(spark, TRIANGLES[:3])
    invariants(g, ego.EgoSplitting(ego.EgoSplittingOptions(One(), One())).detect(g))
    assert isinstance(g, Graph)


def test_truth_of_karate(spark):
    assert one(metrics.modularity(graph(spark, KARATE_EDGES), part(spark, KARATE_CLUBS))) == pytest.approx(0.371, abs=0.001)


def test_edges_in_tasks_are_the_same_as_on_the_driver(spark):
    """Several levels, ties, weights, self-loops and ids with gaps; the join loop for one level."""
    rng = np.random.default_rng(7)
    src, dst = random_edges(60, 150, 7)
    edges = [(int(a) * 7, int(b) * 7, float(w)) for a, b, w in zip(src, dst, rng.choice([1.0, 2.0, 0.5], len(src)))] + [(35, 35, 3.0)]
    g = graph(spark, edges, nodes=[*range(0, 420, 7), 1000])
    prior = part(spark, [(n * 7, n % 9) for n in range(50)])
    tasks, joins = {"local_threshold": 0}, {"local_threshold": 0, "local_nodes": 0}
    textbook = LO(seed=6, buckets=2, self_loops="textbook", gain="textbook", resolution=0.5)
    for kind, options, way in ((L, LO(seed=4, buckets=3), tasks), (E, EO(seed=5, buckets=2), tasks), (L, textbook, tasks), (L, LO(seed=8, buckets=2, initial_partition=prior), tasks), (E, EO(seed=9, buckets=2, max_iterations=1), joins)):
        far, near = kind(replace(options, **way)).detect(g), kind(options).detect(g)
        assert sorted(far.partition.collect()) == sorted(near.partition.collect()) and far.modularity == pytest.approx(near.modularity) and (far.passes, far.moves) == (near.passes, near.moves)


def test_packed_ego_nets_are_the_same_as_joined_ones(spark, monkeypatch):
    """Weights, a self-loop, nets without an edge, a lone node and nets above ``most``, in several groups."""
    rng = np.random.default_rng(11)
    src, dst = random_edges(40, 160, 11)
    edges = [(int(a), int(b), float(w)) for a, b, w in zip(src, dst, rng.choice([1.0, 2.5, 300.0], len(src)))] + [(5, 5, 3.0), (90, 91, 1.0)]
    g = graph(spark, edges, nodes=[*range(40), 95]).kept()
    joined = ego.ego_partition(g, SPLIT.local)
    people = ego.personas(g.vertices.select(F.col("id").alias("node")), joined)
    monkeypatch.setattr(ego.egonets, "GROUP", 40)
    for most in (10**6, 20):
        found = ego.split(g, replace(SPLIT, most=most))
        assert all(sorted(a.collect()) == sorted(b.collect()) for a, b in zip(found, (people, joined, ego.persona_edges(g, people, joined))))
