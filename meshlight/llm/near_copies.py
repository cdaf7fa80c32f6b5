"""Near copies on word shingles, for the pipeline: five words, Jaccard similarity 0.8 or more.

A text in lower case (A-Z only) is cut into words at space and 0x09-0x0D. Its
set of 5-word shingles, each hashed by XXH64, stands for it; a text of fewer
words is one shingle, and texts without a word, null included, are equal.
Texts of equal sets collapse first, so copies cost nothing further.

Candidates come from two searches, and whole sets decide on both. SimHash: the
fingerprint of a set (its bits' majority, as in simhash.py) is linked with all
within 4 bits by that operator's exact search, and sets whose fingerprints are
so connected form a bucket. It can't propose all: at 0.8 two fingerprints differ
in 12 bits and more, and blocks short enough to agree on are shared by all
documents. So MinHash proposes beside it: sets that agree on all 5 values of
at least one of 32 bands. A pair of similarity 0.8 meets in none of these with
probability 3e-6, one of 0.9 with 4e-13.

Sets are made again for texts that meet another only. A bucket compares whole
sets and emits a spanning forest; buckets of the same members are handled
once. No bucket is dropped or capped. One of more than ``most`` members is not
held by one task: all its members are compared with one leader, spread over
tasks, and those like it are one component by that. What is left is cut into
blocks of about ``most``; each meets the members in blocks of that size, which
loses no pair. So a large group of near copies costs one comparison a member.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlight.operators.components import connected_components
from meshlight.operators.skew import spread_join

from .common import arrow_map, cut, doc_text
from .simhash import TO_LOWER, links, majority

SHINGLE, LEAST, BANDS, ROWS, MOST = 5, 0.8, 32, 5, 4096
_RNG = np.random.default_rng(42)
#: Each MinHash value is the least of (hash ^ FLIP) * TIMES, modulo 2**32.
FLIP, TIMES = (_RNG.integers(0, 1 << 32, BANDS * ROWS, np.uint32) for _ in range(2))
TIMES |= np.uint32(1)


def shingles(text: str, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; one at least."""
    words = text.encode().translate(TO_LOWER).split()  # bytes.split() cuts at 0x20 and 0x09-0x0D
    line, n = b" ".join(words), max(1, len(words) - size + 1)
    if n == 1:
        return np.array([xxhash.xxh64_intdigest(line, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[:n].tolist()
    stops = (ends[-n:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter([digest(line[a:b], 42) for a, b in zip(starts, stops)], np.uint64, n))


def band_keys(own: np.ndarray) -> list[int]:
    """One signed 64-bit key for each band."""
    low, least = (own >> np.uint64(32)).astype(np.uint32), None
    for at in range(0, len(low), 1 << 12):
        m = ((low[None, at : at + (1 << 12)] ^ FLIP[:, None]) * TIMES[:, None]).min(axis=1)
        least = m if least is None else np.minimum(least, m)
    return [_signed(xxhash.xxh64_intdigest(row.tobytes(), k)) for k, row in enumerate(least.reshape(BANDS, ROWS))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def prints(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, own, fp, keys) per row: XXH64 of the text, of its set, the set's SimHash fingerprint and its band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t) for t in b.column(2).to_pylist()]
            own = pa.array([_signed(xxhash.xxh64_intdigest(s.tobytes(), 42)) for s in sets], pa.int64())
            fp = pa.array([_signed(majority(s)) for s in sets], pa.int64())
            keys = pa.array([band_keys(s) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), own, fp, keys], ["doc_id", "digest", "own", "fp", "keys"])

    return arrow_map(docs.select("doc_id", F.xxhash64(doc_text()).alias("digest"), doc_text().alias("text")), run, "doc_id long, digest long, own long, fp long, keys array<long>")


def sets_of(docs: DataFrame) -> DataFrame:
    """(own, hashes): the sets as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = pa.array([shingles(t).tobytes() for t in b.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), sets], ["own", "hashes"])

    return arrow_map(docs.select("own", doc_text().alias("text")), run, "own long, hashes binary")


def forest(sets: list[np.ndarray], least: float = LEAST) -> list[tuple[int, int]]:
    """Edges that span the components of all pairs of similarity ``least`` or more."""
    sizes, left, out = np.array([len(s) for s in sets]), np.arange(len(sets)), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            own = sets[at]
            maybe = left[np.minimum(sizes[left], len(own)) >= least * np.maximum(sizes[left], len(own)) - 1e-9]
            if not len(maybe):
                continue
            joined = np.concatenate([sets[i] for i in maybe])
            hit = own[np.minimum(np.searchsorted(own, joined), len(own) - 1)] == joined
            both = np.add.reduceat(hit.astype(np.int64), np.concatenate([[0], np.cumsum(sizes[maybe])[:-1]]))
            near = maybe[both >= least * (len(own) + sizes[maybe] - both) - 1e-9]
            if len(near):
                out += [(at, i) for i in near]
                queue.extend(near)
                left = np.setdiff1d(left, near, assume_unique=True)
    return out


def _edges(rows: DataFrame) -> DataFrame:
    """Buckets lie whole in one partition, sorted; each is handled when its last row is seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, sets, src, dst = None, [], [], [], []

        def done() -> None:
            for a, b in forest(sets):
                src.append(ids[a])
                dst.append(ids[b])

        for b in batches:
            for key, own, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if key != now:
                    done()
                    now, ids, sets = key, [], []
                ids.append(own)
                sets.append(np.frombuffer(raw, np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])
            src, dst = [], []
        done()
        yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

    return arrow_map(rows.select("key", "own", "hashes").repartition("key").sortWithinPartitions("key"), run, "src long, dst long")


def similar(a: np.ndarray, b: np.ndarray, least: float = LEAST) -> bool:
    """Whether two sorted sets have this Jaccard similarity."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both) - 1e-9


def _large_edges(members: DataFrame, sets: DataFrame, most: int) -> DataFrame:
    """Spanning edges of buckets too large for one task; members (key, own, n), n being the bucket's size."""
    rows = cut(spread_join(members, sets, ["own"], F.col("key")).select("key", "own", "n", "hashes"))
    chosen = rows.groupBy("key").agg(F.min("own").alias("leader"))
    leaders = chosen.join(sets.select(F.col("own").alias("leader"), F.col("hashes").alias("chief")), "leader").select("key", "leader", "chief")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, chief = b.column(3).to_pylist(), b.column(5).to_pylist()
            near = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(own, chief)]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(5)), pa.array(near, pa.bool_())], ["key", "own", "n", "hashes", "leader", "near"])

    met = spread_join(rows, leaders, ["key"], F.col("own")).select("key", "own", "n", "hashes", "leader", "chief")
    judged = cut(arrow_map(met, run, "key long, own long, n long, hashes binary, leader long, near boolean"))
    star = judged.filter("near and own <> leader").select(F.col("leader").alias("src"), F.col("own").alias("dst"))
    rest = judged.filter("not near").groupBy("key").agg(F.count(F.lit(1)).alias("left"))
    apart = spread_join(judged, rest, ["key"], F.col("own"))
    parts, blocks = F.ceil(F.col("n") / most), F.ceil(F.col("left") / most)
    part, block = F.pmod(F.xxhash64("own"), parts), F.pmod(F.xxhash64("own"), blocks)
    pair = lambda i, j: F.xxhash64("key", i, j).alias("key")
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    everyone = apart.withColumn("part", part).withColumn("block", F.explode(upto(blocks))).select(pair("part", "block"), "own", "hashes")
    lone = apart.filter("not near").withColumn("block", block).withColumn("part", F.explode(upto(parts))).select(pair("part", "block"), "own", "hashes")
    return star.unionByName(_edges(everyone.unionByName(lone).dropDuplicates(["key", "own"])))


def simhash_buckets(found: DataFrame) -> DataFrame:
    """(own, key): sets (own, fp) whose fingerprints are connected by links of the SimHash operator have one key."""
    sets = found.select("own", "fp").distinct()
    linked = connected_components(links(sets)).select(F.col("node").alias("fp"), "component")
    met = spread_join(sets, linked, ["fp"], F.col("own"), "left")
    return met.select("own", F.xxhash64(F.lit("simhash"), F.coalesce("component", "fp")).alias("key"))


def near_copies(docs: DataFrame, most: int = MOST) -> DataFrame:
    """Per row: doc_id, digest (XXH64 of the text) and component, equal for rows linked by near copies."""
    found = cut(prints(docs))
    place = F.struct("doc_id", "digest")
    once = found.groupBy("own").agg(F.min(place).alias("place"), F.first("keys").alias("keys"))
    dealt = once.select("own", F.explode("keys").alias("key")).unionByName(cut(simhash_buckets(found)))
    mixed = F.xxhash64("own")
    buckets = dealt.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(mixed).alias("x"), F.sum(mixed.cast("decimal(20,0)")).alias("s")).filter("n > 1")
    chosen = buckets.groupBy("n", "x", "s").agg(F.min("key").alias("key")).select("key", "n")  # one of those of the same members
    members = cut(spread_join(dealt, chosen, ["key"], F.col("own")))
    needed = once.join(members.select("own").distinct().hint("shuffle_hash"), "own", "left_semi").select("own", F.col("place.doc_id").alias("__id"), F.col("place.digest").alias("__digest"))
    texts = docs.select("doc_id", "text").withColumn("digest", F.xxhash64(doc_text()))
    met = texts.join(needed.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("digest") == F.col("__digest")))
    sets = sets_of(met).dropDuplicates(["own"])
    large = members.filter(F.col("n") > most)
    if large.isEmpty():
        edges = _edges(members.join(sets.hint("shuffle_hash"), "own"))
    else:
        sets = cut(sets)
        edges = _edges(members.filter(F.col("n") <= most).join(sets.hint("shuffle_hash"), "own")).unionByName(_large_edges(large, sets, most))
    linked = connected_components(edges)
    named = linked.select(F.col("node").alias("own"), "component")
    return spread_join(found.select("doc_id", "digest", "own"), named, ["own"], F.struct("doc_id", "digest"), "left").select("doc_id", "digest", F.coalesce("component", "own").alias("component"))
