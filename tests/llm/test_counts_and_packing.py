import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from meshlight.llm import packing
from meshlight.llm.token_counts import PrefixCounter, count_tokens, prefix_tables

PATH = public_tokenizers.path("byte_bpe_50k.json")
HF = Tokenizer.from_file(PATH)


def ids(text):
    return HF.encode(text or "", add_special_tokens=False).ids


def test_every_prefix_has_its_exact_count():
    rng, counter = random.Random(1), PrefixCounter(PATH)
    parts = ["'", "'l", "'ll", "'re", " ", "  ", "\n", "\t", " a", "the", "<|endoftext|>", "<|endo", "é", "🙂", "123", "½", "?!", "\x1c", "\x85", "　", "中文", "I'm", "_", "\xa0", "ſ", "aaaa"]
    for _ in range(300):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        want = [len(ids(text[:k])) for k in range(len(text) + 1)]
        assert counter.table(text) == want
        for budget in (0, 1, 4):
            assert counter.measure(text, budget) == (want[-1], max(k for k, n in enumerate(want) if n <= budget))


def test_counts(docs, rows, none):
    found = {r.doc_id: r for r in count_tokens(docs, PATH, limit=50).collect()}
    for i, text, *_ in rows:
        n = len(ids(text))
        assert (found[i].n_tokens, found[i].n_bytes, found[i].over_limit) == (n, len((text or "").encode()), n > 50)
        assert len(ids((text or "")[: found[i].chars_in_limit])) <= 50
    assert count_tokens(docs, PATH).count() == len(rows) + 1 and count_tokens(none, PATH).count() == 0
    table = {r.doc_id: r.counts for r in prefix_tables(docs, PATH).collect()}
    assert all(table[i][-1] == found[i].n_tokens and len(table[i]) == len(t or "") + 1 for i, t, *_ in rows)


def test_very_long_runs_are_encoded():
    encoder = packing.IdEncoder(PATH)
    for text in (" " * 300_000 + "x", "a" * 300_000):
        assert encoder.ids(text, 1).tolist() == ids(text) + [1]


def test_one_very_long_pre_token():
    import tracemalloc

    rng, counter = random.Random(3), PrefixCounter(PATH)
    run = "".join(rng.choice("acgt") for _ in range(60_000))
    tracemalloc.start()
    assert counter.measure("x " + run, 1024)[0] == len(ids("x " + run))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 << 20 and not any(len(w) > 64 for w in counter.whole)
    short = run[:300]
    assert counter.table(short) == [len(ids(short[:k])) for k in range(301)]


def check_pieces(pieces, texts):
    """pieces: rows of pack(); texts: text by doc_id."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert set(by_doc) == set(texts)
    for i, own in by_doc.items():
        want, at = np.array(ids(texts[i]) + [1], "<u4"), 0
        for p in sorted(own, key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(want)
            assert p.ids_crc32 == zlib.crc32(want[at : at + p.length].tobytes())
            at += p.length
        assert at == len(want)
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
    return by_sequence


def test_pack_round_trip(spark, rows, docs, none):
    once = spark.createDataFrame([(r[0], r[1]) for r in rows], "doc_id long, text string").coalesce(1)
    sequences = check_pieces(packing.pack(once, PATH).collect(), {r[0]: r[1] for r in rows})
    total = sum(p.length for own in sequences.values() for p in own)
    assert len(sequences) <= total / 2048 + 2
    assert packing.pack(none, PATH).count() == 0 and packing.pack(docs, PATH).count() > len(rows)


@pytest.mark.parametrize("seed", range(5))
def test_differencing(seed):
    rng = random.Random(seed)
    sizes = [rng.randint(1, 512) for _ in range(rng.randint(1, 300))]
    found = packing.windows(sizes)
    assert sorted(i for w in found for i in w) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in w) <= 2048 for w in found)
    assert len(found) <= sum(sizes) / 2048 * 1.15 + 2
    two = packing.difference([8, 7, 6, 5, 4], 2)
    assert sorted(s for s, _ in two) == [14, 16]  # the known result of the method


def test_cuts():
    for n in (1, 3, 511, 512, 2047, 2048, 2049, 9000):
        for fine in (False, True):
            assert sum(packing.cuts(n, fine)) == n and min(packing.cuts(n, fine)) > 0
    assert Counter(packing.cuts(4096, True)) == {2048: 2}
