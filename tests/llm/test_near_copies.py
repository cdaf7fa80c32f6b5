import random

import corpus_pipeline
from conftest import DOCS, words

from meshlight.llm import line_dedup, near_copies, simhash


def brute_components(texts, least=0.8):
    """The position of the first text of each text's group."""
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    root = list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(k) for k in range(len(texts))]


def edited(rng, text, n):
    w = text.split()
    for k in rng.sample(range(len(w)), n):
        w[k] = f"edit{rng.random()}"
    return " ".join(w)


def test_stage_finds_edited_copies(spark):
    rng = random.Random(5)
    texts = []
    for _ in range(12):
        base = words(rng, rng.randint(80, 300))
        texts += [base, *(edited(rng, base, len(base.split()) * k // 100) for k in (1, 2, 2, 3, 6))]
    texts += [words(rng, rng.randint(1, 60)) for _ in range(30)] + ["a b", "A  b", "", None]
    rows = [(k, t, "en", "s", len(t or ""), "x", 1, 2) for k, t in enumerate(texts)]
    kept = corpus_pipeline.simhash_stage(spark, spark.createDataFrame(rows, DOCS).repartition(3), "")
    least = brute_components(texts)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(least))
    assert len(set(least)) < len(texts) - 30


def test_large_buckets_lose_no_link(spark):
    """Buckets above the bound: copies of one leader, a chain that leaves its reach, and unlike texts."""
    rng = random.Random(9)
    base = words(rng, 200)
    texts = [edited(rng, base, rng.randint(1, 3)) for _ in range(40)]
    chain = [base]
    for _ in range(12):
        chain.append(edited(rng, chain[-1], 2))
    texts += chain + [words(rng, 80) for _ in range(10)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    least = brute_components(texts)
    for most in (4, 4096):
        of = {r.doc_id: r.component for r in near_copies.near_copies(docs, most).collect()}
        first = {}
        assert [first.setdefault(of[k], k) for k in range(len(texts))] == least


def test_forest_spans_what_all_pairs_link():
    rng = random.Random(6)
    base = words(rng, 120)
    texts = [base, *(edited(rng, base, k) for k in (1, 2, 3, 4, 5, 8, 15))] + [words(rng, 90) for _ in range(5)]
    rng.shuffle(texts)
    root = list(range(len(texts)))
    for a, b in near_copies.forest([near_copies.shingles(t) for t in texts]):
        old, new = max(root[a], root[b]), min(root[a], root[b])
        root = [new if r == old else r for r in root]
    assert root == brute_components(texts)


def test_rows_are_decided_one_by_one(spark):
    rng = random.Random(8)
    a, b, c, d, e, f = (words(rng, 60) for _ in range(6))
    held = [
        (None, a), (None, b), (None, edited(rng, b, 1)),  # no id: each group keeps a row
        (7, c), (None, c), (8, edited(rng, c, 1)),  # a copy without an id goes, however small its digest
        (1, d), (9, d), (9, e), (9, e),  # one id, two texts: only the copy of id 1 goes
        (5, f), (5, edited(rng, f, 1)),  # one id, near copies
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), "x", 1, 2) for i, t in held], DOCS).repartition(3)
    stage = corpus_pipeline.simhash_stage(spark, docs, "")
    assert stage.columns == docs.columns
    kept = [(r.doc_id, next(n for n, t in zip("abcdef", (a, b, c, d, e, f)) if r.text.split()[:1] == t.split()[:1] or r.text.split()[-5:] == t.split()[-5:])) for r in stage.collect()]
    assert sorted(kept, key=str) == sorted([(None, "a"), (None, "b"), (7, "c"), (1, "d"), (9, "e"), (5, "f")], key=str)


def test_line_dedup_by_id_and_text(spark):
    lines = [f"line {k}" for k in range(12)]
    first, second, third = ("\n".join(lines[k : k + 4]) for k in (0, 4, 8))
    held = [(1, first), (2, first + "\nx"), (2, second + "\ny"), (None, second + "\nz"), (None, third), (9, third + "\nw"), (9, third + "\nw")]
    found = line_dedup.dedup_lines(spark.createDataFrame(held, "doc_id long, text string").repartition(3), salts=3).collect()
    want = [(1, first), (2, "x"), (2, second + "\ny"), (None, "z"), (None, ""), (9, third + "\nw"), (9, third + "\nw")]
    assert sorted(((r.doc_id, r.text) for r in found), key=str) == sorted(want, key=str)


def test_line_dedup_of_short_documents(spark):
    held = [(1, "a b"), (2, "a b"), (3, "a b\nc"), (4, "a b\nc"), (5, "a b\nc\nd"), (6, "x\na b\nc"), (7, ""), (8, None), (9, " \n"), (10, " \n"), (None, "a b")]
    found = line_dedup.dedup_lines(spark.createDataFrame(held, "doc_id long, text string").repartition(3), salts=3).collect()
    want = dict(held) | {2: "", 4: "", 8: "", None: ""}
    assert {r.doc_id: r.text for r in found} == want
    assert {r.doc_id: (r.n_lines, r.lines_removed) for r in found if r.lines_removed} == {2: (1, 1), 4: (2, 2), None: (1, 1)}


def test_simhash_proposes(spark):
    words = [f"w{k}" for k in range(300)]
    texts = [" ".join(words), " ".join([*words[:-1], "other"]), " ".join(f"x{k}" for k in range(300))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = near_copies.prints(docs)
    rows = {r.doc_id: r for r in found.collect()}
    assert [rows[k].fp & (1 << 64) - 1 for k in range(3)] == [simhash.majority(near_copies.shingles(t)) for t in texts]
    assert 0 < (rows[0].fp ^ rows[1].fp).bit_count() <= 4 or rows[0].fp == rows[1].fp
    key = dict(near_copies.simhash_buckets(found).select("own", "key").collect())
    assert key[rows[0].own] == key[rows[1].own] != key[rows[2].own]


def test_simhash_buckets_chain_and_far(spark):
    rows = [(1, 0), (2, 0b1111), (3, 0b11111111), (4, -1), (5, 0)]
    key = dict(near_copies.simhash_buckets(spark.createDataFrame(rows, "own long, fp long")).collect())
    assert key[1] == key[2] == key[3] == key[5] != key[4] and len(key) == 5
