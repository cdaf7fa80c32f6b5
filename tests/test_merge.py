import random

import pytest
from test_graph import graph, part

from meshlight.functions import metrics
from meshlight.operators import detect, ego, merge


def brute_disjoint(edges, community, threshold, options):
    """The rule step by step; every sum is taken anew from the edges."""
    community = dict(community)
    total = sum(w for *_, w in edges)
    size = lambda c: sum(x == c for x in community.values())
    strength = lambda c: sum(w * ((community[a] == c) + (a != b and community[b] == c)) for a, b, w in edges)
    for _, c in sorted((size(c), c) for c in set(community.values()) if size(c) < threshold):
        if size(c) >= threshold:
            continue
        links = {}
        for a, b, w in edges:
            for x, y in ((community[a], community[b]), (community[b], community[a])):
                if x == c and y != c:
                    links[y] = links.get(y, 0.0) + w
        if not links:
            continue
        if options.strategy == "connectivity":
            target = min(links, key=lambda o: (-links[o], o))
        else:
            gain = {o: 2 * w / total - 2 * strength(c) * strength(o) / (total * total) for o, w in links.items()}
            target = min(gain, key=lambda o: (-gain[o], o))
        community = {n: target if x == c else x for n, x in community.items()}
    ids = {c: i for i, c in enumerate(sorted(set(community.values())))}
    return {n: ids[c] for n, c in community.items()}


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("strategy", ["connectivity", "modularity"])
def test_walk_and_rounds_follow_the_rule(spark, seed, strategy):
    rng = random.Random(seed)
    n = 60
    pairs = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(70)}
    edges = [(a, b, float(rng.randint(1, 4))) for a, b in sorted(pairs)]
    community = {k: rng.randint(0, 25) * 3 for k in range(n)}
    options = merge.MergeOptions(min_size=rng.choice([2, 3, 5]), strategy=strategy)
    want = brute_disjoint(edges, community, options.threshold(n), options)
    result = detect.CommunityResult(part(spark, community.items()), 0.0, 1, 0)
    for local_rows in (10_000, 0):
        found = merge.merge_communities(graph(spark, edges, range(n)), result, options, local_rows)
        assert dict(found.partition.collect()) == want
    assert len(set(want.values())) < len(set(community.values()))


def brute_overlapping(edges, members, threshold):
    own = {}
    for n, c in members:
        own.setdefault(c, set()).add(n)
    for _, c in sorted((len(x), c) for c, x in own.items() if len(x) < threshold):
        shared = {o: len(own[c] & x) for o, x in own.items() if o != c and own[c] & x}
        if not shared:
            shared = {}
            for a, b, w in edges:
                for x, y in {(a, b), (b, a)}:
                    if x in own[c] and x != y:
                        for o in own:
                            if o != c and y in own[o]:
                                shared[o] = shared.get(o, 0.0) + w
        if shared:
            target = min(shared, key=lambda o: (-shared[o], o))
            own[target] |= own.pop(c)
    ids = {c: i for i, c in enumerate(sorted(own))}
    return sorted((n, ids[c]) for c, x in own.items() for n in x)


@pytest.mark.parametrize("seed", range(3))
def test_overlapping_walk_and_rounds(spark, seed):
    rng = random.Random(seed)
    n = 40
    edges = [(a, b, float(rng.randint(1, 3))) for a, b in sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(45)})]
    members = sorted({(k, rng.randint(0, 18)) for k in range(n) for _ in range(rng.choice([1, 1, 2]))})
    options = merge.MergeOptions(min_size=rng.choice([3, 4]))
    want = brute_overlapping(edges, members, options.threshold(n))
    for local_rows in (10_000, 0):
        found = merge.merge_overlapping(graph(spark, edges, range(n)), ego.OverlappingResult(part(spark, members)), options, local_rows)
        assert sorted(tuple(r) for r in found.memberships.collect()) == want
    assert len({c for _, c in want}) < len({c for _, c in members})


def test_merge_asks_for_modularity_only_if_read(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(merge, "modularity", lambda g, p: asked.append(1) or metrics.modularity(g, p))
    g = graph(spark, [(0, 1), (1, 2), (0, 2), (2, 3), (3, 4), (4, 5), (3, 5), (5, 6)])
    found = detect.CommunityResult(part(spark, [(0, 0), (1, 0), (2, 0), (3, 1), (4, 1), (5, 1), (6, 2)]), 0.0, 1, 0)
    for least in (0, 2):
        asked.clear()
        got = merge.merge_communities(g, found, merge.MergeOptions(min_size=least))
        assert got.partition.count() == 7 and not asked
        assert got.modularity == got.modularity == metrics.modularity(g, got.partition).first()[0] and asked == [1]
