import numpy as np
from test_graph import graph, part

from meshlight.operators import ego, merge


def test_overlapping_merge_reads_few_edges(spark, monkeypatch):
    """Edges only of nodes whose communities are all candidates, and a walk up to millions of memberships."""
    edges = [(n, n + 1) for n in range(200)]
    members = [(n, n // 50) for n in range(200)] + [(n, 100 + n) for n in range(0, 200, 2)] + [(200, 400)]
    seen = []
    walk = merge._walk_overlapping
    monkeypatch.setattr(merge, "_walk_overlapping", lambda e, t, s: seen.append(e.count()) or walk(e, t, s))
    both = [merge.merge_overlapping(graph(spark, edges), ego.OverlappingResult(part(spark, members)), merge.MergeOptions(min_size=3), rows).memberships for rows in (10**6, 0)]
    assert seen == [1] and sorted(map(tuple, both[0].collect())) == sorted(map(tuple, both[1].collect())) == [(n, min(n, 199) // 50) for n in range(201)]


def test_overlapping_merge_walks_parts_in_tasks(spark, monkeypatch):
    """Candidates that never meet are walked apart, in tasks; the result is that of the driver's walk."""
    rng = np.random.default_rng(5)
    edges = [(40 * p + a, 40 * p + b) for p in range(6) for a, b in rng.integers(0, 40, (70, 2)).tolist() if a != b]
    members = [(40 * p + n, 1000 * p + c) for p in range(6) for n in range(40) for c in set(rng.integers(0, 60, 1 if n % 3 else 3).tolist())]
    monkeypatch.setattr(merge, "BIN", 50)
    tasks, rounds, in_tasks = [], [], merge._walk_in_tasks
    monkeypatch.setattr(merge, "_walk_in_tasks", lambda *a: tasks.append(a[-1].max()) or in_tasks(*a))
    monkeypatch.setattr(merge, "_rounds_overlapping", lambda *a: rounds.append(1) or merge._walk_overlapping(*a))
    run = lambda rows: sorted(map(tuple, merge.merge_overlapping(graph(spark, edges), ego.OverlappingResult(part(spark, members)), merge.MergeOptions(min_size=4), rows).memberships.collect()))
    whole, apart = run(10**6), run(300)
    assert not rounds and tasks[0] > 0 and whole == apart
    assert run(20) == whole and rounds  # a part is larger than that
