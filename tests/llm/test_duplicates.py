import hashlib
import re
import unicodedata
from collections import defaultdict

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from meshlight.llm import fingerprints, license_scan, line_dedup, simhash


def brute_lines(rows):
    """Texts after line dedup; rows by doc_id."""
    seen, out = {}, {}
    for i, text in sorted(rows.items()):
        lines = (text or "").split("\n")
        gone = set()
        for p in range(max(len(lines) - 2, 1)):
            w = tuple(lines[p : p + 3])
            if all(not x.strip(" ") for x in w):
                continue
            if w in seen:
                gone |= {*range(p, min(p + 3, len(lines)))}
            seen.setdefault(w, (i, p))
        out[i] = ("\n".join(x for p, x in enumerate(lines) if p not in gone), len(lines), len(gone))
    return out


def test_line_dedup(docs, rows, none):
    want = brute_lines({r[0]: r[1] for r in rows})
    found = line_dedup.dedup_lines(docs, salts=3).collect()
    assert len(found) == len(rows) + 1 and {r.starts for r in found} == {"x"}
    for r in found:
        assert (r.text, r.n_lines, r.lines_removed) == want[r.doc_id]
    assert any(r.lines_removed for r in found) and line_dedup.dedup_lines(none).count() == 0


def brute_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps, radius=4):
    root = list(range(len(fps)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(k) for k in range(len(fps))]


def test_near_duplicates(docs, rows, none):
    found = simhash.near_duplicates(docs).collect()
    assert len(found) == len(rows) + 1
    own = {r.doc_id: r for r in found}
    fps = [brute_simhash(r[1]) for r in rows]
    least = components(fps)  # rows ascend by doc_id
    for k, r in enumerate(rows):
        assert own[r[0]].fingerprint == format(fps[k], "016x") and own[r[0]].component_id == rows[least[k]][0]
    assert simhash.near_duplicates(none).count() == 0


def test_links_lose_nothing_in_crowded_buckets(spark):
    rng = np.random.default_rng(3)
    low = int(rng.integers(0, 1 << 21))  # all share the first two blocks
    fps = {low | int(x) << 22 for x in rng.integers(0, 1 << 41, 30)}
    fps |= {f ^ sum(1 << int(b) for b in rng.choice(60, 4, replace=False)) for f in list(fps)[:6]}
    fps = sorted(fps)
    frame = spark.createDataFrame([(f,) for f in fps], "fp long")
    from meshlight.operators.components import connected_components

    want = components(fps)
    for most in (20_000, 8):  # with 8, the crowded bucket is dealt again
        got = dict(connected_components(simhash.links(frame, most=most)).collect())
        assert [got.get(f, f) for f in fps] == [min(fps[j] for j in range(len(fps)) if want[j] == want[k]) for k in range(len(fps))]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, (1 << 64) - 1), min_size=1, max_size=40))
def test_majority(hashes):
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.majority(np.array(hashes, np.uint64)) == want


def canon(text):
    return " ".join(unicodedata.normalize("NFKC", text or "").casefold().split())


def test_fingerprints(spark, rows, none):
    once = spark.createDataFrame([(r[0], r[1]) for r in rows], "doc_id long, text string").repartition(3)
    for per_range in (4, 1000):
        found = {r.doc_id: r for r in fingerprints.fingerprint_documents(once, rows=per_range).collect()}
        assert len(found) == len(rows)
        texts = [r[1] or "" for r in rows]
        groups = defaultdict(list)
        for r in rows:
            groups[canon(r[1])].append(r[0])
        for k, (i, *_) in enumerate(rows):
            text, following = texts[k], texts[(k + 1) % len(texts)]
            n = len(text) // 4
            edited = text[: len(text) - n] + following[:n]
            r = found[i]
            assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
            assert r.near_edited == float(canon(edited) == canon(text)) and r.near_next == float(canon(following) == canon(text))
            assert (r.group_id, r.copies) == (groups[canon(text)][0], len(groups[canon(text)]))
        assert len({r.fingerprint for r in found.values()}) == len(groups)
    assert fingerprints.fingerprint_documents(none).count() == 0


def test_unequal_texts_of_one_digest_are_told_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(fingerprints, "digest", lambda c: F.lpad(F.length(c).cast("string"), 64, "0"))  # collides by length
    frame = spark.createDataFrame([(1, "ab"), (2, "cd"), (3, "AB"), (4, "x")], "doc_id long, text string")
    found = {r.doc_id: (r.group_id, r.copies) for r in fingerprints.exact_groups(frame).collect()}
    assert found == {1: (1, 2), 2: (2, 1), 3: (1, 2), 4: (4, 1)}


def test_documents_without_or_with_shared_ids(spark):
    """Those without an id come last; rows of one id go by the hash of their texts."""
    texts = [(None, "north wind"), (None, "south"), (4, "alpha beta gamma"), (4, "delta"), (2, None), (None, "north wind"), (-3, "x" * 40)]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    h = {r.t: r.h for r in spark.createDataFrame([(t or "",) for _, t in texts], "t string").selectExpr("t", "xxhash64(t) AS h").collect()}
    order = sorted(((i, t or "") for i, t in texts), key=lambda r: (r[0] is None, r[0] or 0, h[r[1]]))
    want = []
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        n = len(t) // 4
        want.append((i, len(t), hashlib.sha256((t[: len(t) - n] + after[:n]).encode()).hexdigest()))
    for per_range in (1, 2, 1000):
        found = fingerprints.fingerprint_documents(frame.repartition(3), rows=per_range).collect()
        assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in found), key=str) == sorted(want, key=str)
        assert {(r.doc_id, r.n_chars): (r.group_id, r.copies) for r in found if r.n_chars == 10} == {(None, 10): (None, 2)}


def test_forest_deals_again(monkeypatch):
    rng = np.random.default_rng(4)
    base = np.repeat(rng.integers(0, 1 << 63, 40, dtype=np.uint64), 8)
    for _ in range(4):
        base ^= np.uint64(1) << rng.integers(0, 64, len(base)).astype(np.uint64)
    fps = np.unique(np.concatenate([base, rng.integers(0, 1 << 63, 300, dtype=np.uint64)]))
    want = components([int(x) for x in fps])
    for sweeps in (0, 1, 64):
        monkeypatch.setattr(simhash, "SWEEPS", sweeps)
        root = list(range(len(fps)))
        for a, b in zip(*simhash.forest(fps)):
            old, new = max(root[a], root[b]), min(root[a], root[b])
            root = [new if r == old else r for r in root]
        assert root == want


def test_rows_that_repeat_a_doc_id(docs, rows):
    assert fingerprints.fingerprint_documents(docs).count() == len(rows) + 1


def test_licenses(spark, none):
    mit = license_scan.TEXTS["MIT"]
    texts = ["Released under the MIT License.", "words\nlicensed under the apache licence, version 2.0\nwords", "Copyright (c) 2020 A. N. Other\n" + mit.upper(), "we released under the MIT License, too", None, "", "Licensed under CC BY-NC 4.0.\nDistributed under GPLv3"]
    found = {r.doc_id: r for r in license_scan.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert {i: r.licenses for i, r in found.items()} == {0: "MIT", 1: "Apache-2.0", 2: "MIT", 6: "CC-BY-NC-4.0,GPL-3.0"}
    assert found[2].whole_text and not found[1].whole_text and license_scan.scan_licenses(none).count() == 0
    assert len(license_scan.known()) > 200


def test_licenses_like_their_sql(spark, tmp_path):
    import duckdb

    texts = [(1, "Released under MIT\nReleased under MIT\nLicensed under GPLv3"), (1, "Released under MIT\nLicensed under GPLv3"), (2, license_scan.TEXTS["ISC"]), (3, None), (4, "LICENSED UNDER THE MIT LICENCE!"), (2, "Released under MIT")]
    frame = spark.createDataFrame([*texts, texts[0]], "doc_id long, text string").repartition(3)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(license_scan.oracle()).fetchall()
    found = [(r.doc_id, r.licenses, r.n_lines, r.whole_text) for r in license_scan.scan_licenses(frame).collect()]
    assert sorted(found) == sorted(want) and (1, "GPL-3.0,MIT", 2, False) in found
