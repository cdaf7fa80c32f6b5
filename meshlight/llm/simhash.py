"""Operator 4, SimHash near-dedup: fingerprints, pivot distance tables, components.

Fingerprints. A text in lower case (A-Z only) is cut into words at space and
0x09-0x0D; its 4-word shingles, repeats included, are hashed by XXH64 (seed
42), and a bit of the fingerprint is 1 if it is set in over half the hashes.
Texts of fewer words are one shingle; texts without a word, null included,
have fingerprint zero, linked like any other.

Links. Fingerprints within ``radius`` (4) bits are linked. Equal fingerprints
collapse first, so copies cost nothing further. Then 64 bits are cut into 6
blocks: two fingerprints that differ in at most 4 bits agree in at least 2
whole blocks, so they meet in one of 15 buckets (two block numbers and what
is in them) and none is lost. Inside a bucket each fingerprint has a table of
Hamming distances to 16 reference fingerprints; a pair whose largest
coordinate difference exceeds the radius can't be near (triangle inequality)
and is discarded, the rest is verified.

A bucket emits no pairs but a spanning forest: a search from one fingerprint
compares it with those not yet reached, so a large group of near copies is
done in a few sweeps. Fingerprints that are not near each other are dealt
again, by blocks of the bits that they don't share yet and by the same
argument: in the task where a search takes too long, over tasks where a bucket
has more than ``most`` fingerprints. No bucket is dropped or capped.

Result: one row for each row of the table; what is known of a fingerprint
comes back to its rows on (fingerprint, salt), so copies are spread over
tasks. Rows that repeat a doc_id keep their own fingerprint each. Rows without
a doc_id take part; a component of such rows only has no component_id.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlight.operators.components import connected_components

from .common import arrow_map, cut, texts_of

SHINGLE, RADIUS, PIVOTS, BLOCKS, MOST, SWEEPS, SALTS = 4, 4, 16, 6, 100_000, 64, 64
UPPER = bytes(range(65, 91))
TO_LOWER = bytes.maketrans(UPPER, UPPER.lower())
#: The reference fingerprints: hashes of 1, 2, 3 ...
REFERENCES = np.array([xxhash.xxh64_intdigest(struct.pack("<I", k + 1), 42) for k in range(PIVOTS)], np.uint64)


def simhash(text: str, size: int = SHINGLE) -> int:
    """The unsigned fingerprint of a text."""
    words = text.encode().translate(TO_LOWER).split()  # bytes.split() cuts at 0x20 and 0x09-0x0D
    if not words:
        return 0
    line, n = b" ".join(words), max(1, len(words) - size + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[:n].tolist()
    stops = (ends[-n:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter([digest(line[a:b], 42) for a, b in zip(starts, stops)], np.uint64, n)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """Bits that are set in over half of the hashes; sums go bit by bit, in blocks of bounded size."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        bits = np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([simhash(t, size) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])

    return arrow_map(texts_of(docs), run, "doc_id long, fp long")


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def distance_table(fps: np.ndarray) -> np.ndarray:
    """[fingerprint, reference]: Hamming distances."""
    return np.bitwise_count(fps[:, None] ^ REFERENCES[None, :]).astype(np.int8)


def forest(fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Edges that span the components of one bucket's distinct fingerprints.

    The search is quick where most are near each other. Where it has done
    ``SWEEPS`` comparisons for each fingerprint, what is left, and what was
    reached but not compared yet, is dealt again by blocks of the bits in which
    it differs.
    """
    table, left = distance_table(fps), np.arange(len(fps))
    src, dst = [], []
    queue: list[int] = []
    work, most = 0, SWEEPS * max(len(fps), 1000)
    while len(left):
        if not queue:
            queue, left = [left[0]], left[1:]
        at = queue.pop()
        work += len(left)
        maybe = left[np.abs(table[left] - table[at]).max(axis=1) <= radius]
        near = maybe[hamming(fps[maybe], fps[at]) <= radius]
        if len(near):
            src.append(np.full(len(near), at))
            dst.append(near)
            queue.extend(near.tolist())
            left = np.setdiff1d(left, near, assume_unique=True)
        if work > most:
            rest = np.concatenate([np.array(queue, np.int64), left])
            a, b = _dealt_again(fps[rest], radius)
            src.append(rest[a])
            dst.append(rest[b])
            break
    none = np.zeros(0, np.int64)
    return (np.concatenate(src), np.concatenate(dst)) if src else (none, none)


def _dealt_again(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """The edges of forest(), from smaller buckets of the same fingerprints."""
    src, dst = [], []
    differ = int(np.bitwise_or.reduce(fps ^ fps[0])) if len(fps) else 0
    bits = [b for b in range(64) if differ >> b & 1]
    if len(bits) < BLOCKS:
        return _compared(fps, radius)
    for mask, _ in deals(bits, radius):
        key = fps & np.uint64(mask)
        order = np.argsort(key, kind="stable")
        bounds = np.flatnonzero(np.diff(key[order]) != 0) + 1
        starts = np.concatenate([[0], bounds])
        for s, n in zip(starts.tolist(), np.diff(np.append(starts, len(fps))).tolist()):
            if n > 1:
                own = order[s : s + n]
                a, b = forest(fps[own], radius)
                src.append(own[a])
                dst.append(own[b])
    none = np.zeros(0, np.int64)
    return (np.concatenate(src), np.concatenate(dst)) if src else (none, none)


def _compared(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All links of a few fingerprints, 32 at most."""
    i, j = np.triu_indices(len(fps), 1)
    near = hamming(fps[i], fps[j]) <= radius
    return i[near], j[near]


def bucket_edges(starts: np.ndarray, sizes: np.ndarray, fps: np.ndarray, radius: int, small: int = 24) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges of many buckets that lie one after another.

    Small buckets are compared together, position by position; others one by one.
    """
    src, dst = [], []
    few = sizes <= small
    if few.any():
        inside = np.repeat(few, sizes)
        group = np.repeat(np.arange(len(sizes)), sizes)[inside]
        own = fps[inside]
        table = distance_table(own)
        for step in range(1, int(sizes[few].max())):
            i = np.flatnonzero(group[:-step] == group[step:])
            i = i[np.abs(table[i] - table[i + step]).max(axis=1) <= radius]
            i = i[hamming(own[i], own[i + step]) <= radius]
            src.append(own[i])
            dst.append(own[i + step])
    for k in np.flatnonzero(~few):
        own = fps[starts[k] : starts[k] + sizes[k]]
        a, b = forest(own, radius)
        src.append(own[a])
        dst.append(own[b])
    none = np.zeros(0, np.uint64)
    return (np.concatenate(src), np.concatenate(dst)) if src else (none, none)


def blocks_of(bits: list[int], n: int = BLOCKS) -> list[list[int]]:
    return [[*map(int, x)] for x in np.array_split(np.array(bits), n)]


def deals(bits: list[int], radius: int = RADIUS, n: int = BLOCKS) -> list[tuple[int, list[int]]]:
    """(mask, bits not in it): near fingerprints agree on at least one of the masks."""
    agree = n - radius
    out = []
    for own in combinations(blocks_of(bits, n), agree):
        inside = [b for block in own for b in block]
        mask = sum(1 << b for b in inside)
        out.append((mask, [b for b in bits if not mask >> b & 1]))
    return out


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def dealt(fps: DataFrame, done: Column, bits: list[int]) -> DataFrame:
    """Each fingerprint once for each deal: mask (all bits that its bucket shares) and key."""
    masks = F.array(*(F.lit(signed(m)) for m, _ in deals(bits)))
    return fps.select("fp", F.explode(F.transform(masks, lambda m: m.bitwiseOR(done))).alias("mask")).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))


def links(fps: DataFrame, radius: int = RADIUS, most: int = MOST) -> DataFrame:
    """(src, dst): edges between distinct fingerprints that span all links within the radius."""
    rest = dealt(fps.select("fp").distinct(), F.lit(0), list(range(64)))
    edges = None
    while True:
        here = rest.repartition("mask", "key")
        counted = here.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        found = _edges(here.join(counted.filter(F.col("n") <= most).hint("shuffle_hash"), ["mask", "key"]), radius)
        edges = found if edges is None else edges.unionByName(found)
        large = cut(counted.filter(F.col("n") > most))
        masks = [r[0] for r in large.select("mask").distinct().collect()]  # bounded by the number of deals
        if not masks:
            return edges.distinct()
        rows = here.join(large.select("mask", "key").hint("shuffle_hash"), ["mask", "key"], "left_semi")
        parts = []
        for m in masks:
            bits = [b for b in range(64) if not m >> b & 1]
            own = rows.filter(F.col("mask") == m)
            if len(bits) < BLOCKS or 1 << len(bits) <= most:  # as many different values at most
                edges = edges.unionByName(_edges(own, radius))
            else:
                parts.append(dealt(own, F.col("mask"), bits))
        if not parts:
            return edges.distinct()
        rest = parts[0]
        for p in parts[1:]:
            rest = rest.unionByName(p)
        rest = cut(rest.distinct())


def _edges(rows: DataFrame, radius: int) -> DataFrame:
    """Buckets lie whole in one partition, sorted; each is handled when its last row is seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        for b in batches:
            cols = [b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)]
            kept = [np.concatenate([x, y]) for x, y in zip(kept, cols)] if kept else cols
            last = np.flatnonzero((np.diff(kept[0]) != 0) | (np.diff(kept[1]) != 0))
            if len(last):
                at = last[-1] + 1
                yield from one([x[:at] for x in kept])
                kept = [x[at:] for x in kept]
        if kept:
            yield from one(kept)

    def one(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        mask, key, fp = cols
        starts = np.concatenate([[0], np.flatnonzero((np.diff(mask) != 0) | (np.diff(key) != 0)) + 1])
        sizes = np.diff(np.concatenate([starts, [len(fp)]]))
        src, dst = bucket_edges(starts, sizes, fp.view(np.uint64), radius)
        yield pa.RecordBatch.from_arrays([pa.array(src.view(np.int64)), pa.array(dst.view(np.int64))], ["src", "dst"])

    return arrow_map(rows.select("mask", "key", "fp").sortWithinPartitions("mask", "key"), run, "src long, dst long")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS, most: int = MOST) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable)."""
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    prints = cut(fingerprints(docs, size).withColumn("salt", salt))
    part = prints.groupBy("fp", "salt").agg(F.min("doc_id").alias("least"))
    distinct = cut(part.groupBy("fp").agg(F.min("least").alias("least"), F.collect_list("salt").alias("salts")))
    linked = cut(connected_components(links(distinct, radius, most)))
    named = linked.select(F.col("node").alias("fp"), "component").join(distinct.select("fp", "least"), "fp")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_fp = named.select("fp", "component").join(least, "component").select("fp", "component_id")
    found = distinct.join(by_fp, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"), F.explode("salts").alias("salt"))
    shown = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return prints.join(found, ["fp", "salt"], "left").select("doc_id", shown.alias("fingerprint"), "component_id")
