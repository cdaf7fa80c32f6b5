"""Operator 9, benchmark decontamination: q-gram lemma filtering.

Texts and items are compared in lower case with white space folded, as UTF-8
bytes. An item of m bytes leaks into a document if some region of it is within
k = floor(budget * m) edits of the whole item. Such a region shares at least
t = m + 1 - q * (k + 1) of the item's q-grams on diagonals that lie at most k
apart (q-gram lemma), hence within one of overlapping diagonal bands of width
2(k + 1) and step k + 1. Bands with fewer hits are discarded; the regions of
the others are verified by an alignment inside the band, exact matches first.

Each item has its own q, the largest up to 8 with t >= 1, so that items of any
length keep their whole budget. An item too short for one edit must stand
alone: no letter or digit may continue it at an end that is one itself, else
"ten" would leak into every "often".

Empty items match nothing; null and empty documents leak nothing. Items that
repeat are reported each. A document and item give one row, the best region
(fewest edits, then the first found); further places of it aren't listed.

The items are sent to the tasks in blocks of at most ``block_mb``, whatever
the benchmark's size: each block passes over the documents in turn. Documents
are read once for each block and never shuffled. Where texts repeat one pattern,
shared q-grams are as many as document times item; they are taken document by
document, item by item and band by band, so memory stays bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, doc_text, texts_of

Q, BUDGET, BLOCK_MB = 8, 0.1, 16
CHUNK = 1 << 20
#: Shared q-grams that are held at once, about; more are taken in parts.
MOST = 1 << 20
Hits = tuple[np.ndarray, np.ndarray, np.ndarray]
MIX = np.uint64(0x9E3779B97F4A7C15)
BITS = 22
SCHEMA = "doc_id long, item_id long, start_byte long, length_bytes long, edits long"


def folded(text: str) -> bytes:
    return " ".join(text.lower().split()).encode()


def grams(data: bytes) -> np.ndarray:
    """The 8 bytes from each place of the data on as integers; behind the end come zeros."""
    return np.ndarray(len(data), "<u8", data + bytes(Q - 1), strides=(1,)) if data else np.zeros(0, "<u8")


def gram_size(m: int, k: int) -> int:
    """The largest q up to 8 at which a region within k edits of m bytes surely shares a q-gram."""
    return min(Q, m // (k + 1))


def runs(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each run, n of them, one run after the other."""
    return np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())


class GramTable:
    """The q-grams of the items that have this q."""

    def __init__(self, q: int, numbers: list[int], texts: list[bytes]):
        self.q, self.mask = q, np.uint64((1 << 8 * q) - 1)
        own = [grams(t)[: len(t) - q + 1] & self.mask for t in texts]
        flat = np.concatenate(own)
        order = np.argsort(flat, kind="stable")
        self.item = np.repeat(np.array(numbers, np.int64), [len(g) for g in own])[order]
        self.pos = np.concatenate([np.arange(len(g)) for g in own])[order]
        self.distinct, self.first, self.times = np.unique(flat[order], return_index=True, return_counts=True)
        self.seen = np.zeros(1 << BITS, bool)
        self.seen[self.slot(self.distinct)] = True

    @staticmethod
    def slot(g: np.ndarray) -> np.ndarray:
        return (g * MIX) >> np.uint64(64 - BITS)

    def matches(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in the data, number of its q-gram) wherever the data have a q-gram of the items."""
        g = windows[: max(0, len(windows) - self.q + 1)]
        g = g if self.q == Q else g & self.mask
        at = np.flatnonzero(self.seen[self.slot(g)])
        k = np.searchsorted(self.distinct, g[at])
        k[k == len(self.distinct)] = 0
        same = self.distinct[k] == g[at]
        return at[same], k[same]

    def hits(self, at: np.ndarray, k: np.ndarray) -> Hits:
        n = self.times[k]
        entry = runs(self.first[k], n)
        return np.repeat(at, n), self.item[entry], self.pos[entry]

    def hits_in_parts(self, at: np.ndarray, k: np.ndarray, size: int, edits: np.ndarray, need: np.ndarray) -> Iterator[Hits]:
        """The same for one document of ``size`` bytes in parts of about MOST: all of an item in one part, or its bands in turn.

        An item's q-gram that stands in more places than there are bands is
        given once for each band, which is how often it counts there.
        """
        at = at[np.argsort(k, kind="stable")]
        own, times = np.unique(k, return_counts=True)
        first = np.cumsum(times) - times
        n = self.times[own]
        entry, gram = runs(self.first[own], n), np.repeat(np.arange(len(own)), n)
        order = np.argsort(self.item[entry], kind="stable")
        gram, item, pos = gram[order], self.item[entry][order], self.pos[entry][order]
        enough = np.bincount(item, minlength=len(need))[item] >= need[item]
        gram, item, pos = gram[enough], item[enough], pos[enough]
        ids, begins = np.unique(item, return_index=True)
        sizes = np.add.reduceat(times[gram], begins) if len(ids) else np.zeros(0, np.int64)
        part: list[slice] = []
        held = 0
        for i, begin, end, n in zip(ids.tolist(), begins.tolist(), [*begins[1:].tolist(), len(item)], sizes.tolist()):
            if n > MOST:
                yield from self._bands_in_turn(at, first, times, gram[begin:end], i, pos[begin:end], int(edits[i]) + 1, size)
                continue
            if held + n > MOST and part:
                yield self._places(at, first, times, gram, item, pos, part)
                part, held = [], 0
            part.append(slice(begin, end))
            held += n
        if part:
            yield self._places(at, first, times, gram, item, pos, part)

    @staticmethod
    def _places(at: np.ndarray, first: np.ndarray, times: np.ndarray, gram: np.ndarray, item: np.ndarray, pos: np.ndarray, part: list[slice]) -> Hits:
        gram, item, pos = (np.concatenate([x[s] for s in part]) for x in (gram, item, pos))
        n = times[gram]
        return at[runs(first[gram], n)], np.repeat(item, n), np.repeat(pos, n)

    @staticmethod
    def _bands_in_turn(at: np.ndarray, first: np.ndarray, times: np.ndarray, gram: np.ndarray, item: int, pos: np.ndarray, step: int, size: int) -> Iterator[Hits]:
        """One hit for each position in the item and band that has any; consecutive parts share a band."""
        each = max(2, MOST // len(pos))
        by = np.argsort(gram, kind="stable")
        gram, pos = gram[by], pos[by]
        grams_, begins = np.unique(gram, return_index=True)
        spans = list(zip(grams_.tolist(), begins.tolist(), [*begins[1:].tolist(), len(gram)]))
        for low in range(-(int(pos.max()) // step) - 1, size // step + 1, each):
            bands = np.arange(low, low + each + 1)
            places, where = [], []
            for g, begin, end in spans:
                own = at[first[g] : first[g] + times[g]]
                from_ = pos[begin:end, None] + step * bands
                n = np.searchsorted(own, from_)
                there = n < len(own)
                n[~there] = 0
                there &= own[n] < from_ + step
                places.append(own[n[there]])
                where.append(np.broadcast_to(pos[begin:end, None], from_.shape)[there])
            found = np.concatenate(places)
            if len(found):
                order = np.argsort(found, kind="stable")
                yield found[order], np.full(len(found), item, np.int64), np.concatenate(where)[order]


class ItemIndex:
    """The q-grams of a block of items."""

    def __init__(self, items: list[tuple[int, str]], budget: float = BUDGET):
        kept = [(i, t) for i, text in items if (t := folded(text or ""))]
        self.ids, self.texts = [i for i, _ in kept], [t for _, t in kept]
        m = np.array([len(t) for t in self.texts], np.int64)
        self.edits = np.floor(budget * m).astype(np.int64)
        sizes = [gram_size(len(t), int(k)) for t, k in zip(self.texts, self.edits)]
        self.need = m + 1 - np.array(sizes, np.int64) * (self.edits + 1)
        numbers = {q: [n for n, own in enumerate(sizes) if own == q] for q in sorted(set(sizes))}
        self.tables = [GramTable(q, own, [self.texts[n] for n in own]) for q, own in numbers.items()]

    def hits(self, data: bytes, borders: np.ndarray) -> Iterator[Hits]:
        """(position in data, item, position in item) of every shared q-gram, in parts if they are many.

        Documents are then taken one by one, and no q-gram spans two, as folded
        texts have no line feed.
        """
        windows = grams(data)
        found = [t.matches(windows) for t in self.tables]
        if sum(int(t.times[k].sum()) for t, (_, k) in zip(self.tables, found)) <= MOST:
            none = np.zeros(0, np.int64)
            own = [t.hits(*f) for t, f in zip(self.tables, found)]
            yield tuple(np.concatenate([none, *(f[k] for f in own)]) for k in range(3))
        elif len(borders) > 1:
            for a, b in zip(borders.tolist(), [*borders[1:].tolist(), len(data) + 1]):
                for at, item, pos in self.hits(data[a : b - 1], borders[:1]):
                    yield at + a, item, pos
        else:
            for t, (at, k) in zip(self.tables, found):
                yield from t.hits_in_parts(at, k, len(data), self.edits, self.need)


def goes_on(c: int) -> bool:
    """Whether a byte is of a letter, a digit or a character beyond ASCII."""
    return c >= 128 or chr(c).isalnum()


def alone(item: bytes, data: bytes, at: int) -> bool:
    """Whether the item stands at this place and is not a part of a longer word."""
    end = at + len(item)
    if data[at:end] != item or at and goes_on(item[0]) and goes_on(data[at - 1]):
        return False
    return not (end < len(data) and goes_on(item[-1]) and goes_on(data[end]))


def banded(item: bytes, region: bytes, low: int, high: int, most: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best region within ``most`` edits of the item, on diagonals low..high.

    Row i of the table is item[:i]; column d is diagonal low + d, that is region
    end i + low + d. Ends before the item's end cost nothing.
    """
    far, width = most + 1, high - low + 1
    before = max(0, -low) + 1
    region_codes = np.frombuffer(region, np.uint8)
    padded = np.concatenate([np.zeros(before, np.uint8), region_codes, np.zeros(max(0, high) + len(item) + 1, np.uint8)])
    d = np.arange(width)
    row = np.where((low + d >= 0) & (low + d <= len(region)), 0, far).astype(np.int32)
    start = (low + d).astype(np.int64)
    skip, skipped = np.full(width, far, np.int32), np.zeros(width, np.int64)
    for i, c in enumerate(item, 1):
        first = i + low  # the region end of column 0
        a, b = max(0, -first), min(width, len(region) - first + 1)  # columns whose region end exists
        if a >= b:
            return None
        read = padded[before + first - 1 : before + first - 1 + width]
        step = row + (read != c)
        if first <= 0:
            step[: 1 - first] = far  # before the region's first byte there is none to match
        skip[:-1], skipped[:-1] = row[1:] + 1, start[1:]  # the item's byte is missing in the region
        best = np.minimum(step, skip)
        origin = np.where(skip < step, skipped, start)
        best[:a], best[b:] = far, far
        # a byte of the region that the item lacks: a running minimum along the row
        run = best - d
        low_run = np.minimum.accumulate(run)
        if (low_run < run).any():
            where = np.maximum.accumulate(np.where(run == low_run, d, 0))
            best, origin = low_run + d, origin[where]
            best[b:] = far
        row = np.minimum(best, far).astype(np.int32)
        start = origin
        if row.min() >= far:
            return None
    at = int(row.argmin())
    return int(row[at]), int(start[at]), len(item) + low + at


def leaks_in(index: ItemIndex, data: bytes, borders: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(document's number, item, start, length, edits): for each document and item the first best band, of those with the same edits the one of most hits."""
    whole: dict[tuple[int, int], int] = {}
    found: dict[tuple[int, int], tuple[int, int, int, int, int]] = {}
    for hits in index.hits(data, borders):
        _search_bands(index, data, borders, *hits, whole, found)
    return [(d, i, a - int(borders[d]), len(index.texts[i]), 0) for (d, i), a in whole.items()] + [(d, i, s, n, e) for (d, i), (e, _, _, s, n) in found.items()]


def _search_bands(index: ItemIndex, data: bytes, borders: np.ndarray, at: np.ndarray, item: np.ndarray, pos: np.ndarray, whole: dict, found: dict) -> None:
    """Adds to ``whole`` where items stand that allow no edit, to ``found`` (edits, -hits, band, start, length) of the others."""
    doc = np.searchsorted(borders, at, side="right") - 1
    if not index.edits.all():
        standing(index, data, *(x[(index.edits[item] == 0) & (pos == 0)] for x in (at, item, doc)), whole)
    at, item, pos, doc = (x[index.edits[item] > 0] for x in (at, item, pos, doc))
    if not len(at):
        return
    # a document and item with too few hits in all need no bands
    pairs, pair, n = np.unique(doc * len(index.ids) + item, return_inverse=True, return_counts=True)
    enough = n[pair] >= index.need[item]
    at, item, pos, doc, pair = at[enough], item[enough], pos[enough], doc[enough], pair[enough]
    if not len(at):
        return
    step = index.edits[item] + 1
    upper = np.floor_divide(at - borders[doc] - pos, step)
    # band b covers diagonals from b * step on, over two steps; a q-gram of the item counts once in a band
    bands, band = np.unique(np.concatenate([upper, upper - 1]), return_inverse=True)
    width, longest = len(bands), int(pos.max()) + 1
    once = np.sort((np.concatenate([pair, pair]) * width + band) * longest + np.concatenate([pos, pos]))
    once = once[np.concatenate([[True], np.diff(once) != 0])] // longest
    first = np.flatnonzero(np.concatenate([[True], np.diff(once) != 0]))
    key, count = once[first], np.diff(np.append(first, len(once)))
    own = pairs[key // width] % len(index.ids)
    full = count >= index.need[own]
    key, count, own = key[full], count[full], own[full]
    # the band with the most hits first; an exact match ends the search for its item
    todo = sorted(zip((pairs[key // width] // len(index.ids)).tolist(), own.tolist(), bands[key % width].tolist(), (-count).tolist()), key=lambda x: (x[0], x[1], x[3]))
    for d, i, b, n in todo:
        if (d, i) in found and found[d, i][:3] <= (0, n, b):
            continue
        k, text = int(index.edits[i]), index.texts[i]
        low = b * (k + 1)
        high = low + 2 * (k + 1) - 1
        begin = borders[d]
        end = (borders[d + 1] if d + 1 < len(borders) else len(data) + 1) - 1
        own_low, own_high = max(0, low - k), min(end - begin, high + len(text) + k)
        region = data[begin + own_low : begin + own_high]
        exact = region.find(text)
        best = (0, exact, exact + len(text)) if exact >= 0 else banded(text, region, low - k - own_low, high + k - own_low, k)
        if best and ((d, i) not in found or (best[0], n, b) < found[d, i][:3]):
            found[d, i] = (best[0], n, b, own_low + best[1], best[2] - best[1])


def standing(index: ItemIndex, data: bytes, at: np.ndarray, item: np.ndarray, doc: np.ndarray, whole: dict[tuple[int, int], int]) -> None:
    """The first place in each document at which an item that allows no edit stands alone."""
    for a, i, d in zip(at.tolist(), item.tolist(), doc.tolist()):
        if (d, i) not in whole and alone(index.texts[i], data, a):
            whole[d, i] = a


def search(index: ItemIndex, ids: list, texts: list[str]) -> list[tuple]:
    """(id, item_id, start, length, edits) of all leaks, over chunks of whole documents."""
    out: list[tuple] = []
    first, parts, size = 0, [], 0
    for n, text in enumerate(texts, 1):
        parts.append(folded(text))
        size += len(parts[-1]) + 1
        if size >= CHUNK or n == len(texts):
            own = ids[first:n]
            borders = np.cumsum([0, *(len(p) + 1 for p in parts)])[:-1]
            out += [(own[d], index.ids[i], s, k, e) for d, i, s, k, e in leaks_in(index, b"\n".join(parts), borders)]
            first, parts, size = n, [], 0
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, budget: float = BUDGET, block_mb: float = BLOCK_MB) -> DataFrame:
    """Per document and leaked item: doc_id, item_id, start_byte, length_bytes, edits.

    Places are bytes of the folded text. Rows repeated with one doc_id are reported each.
    """
    out = None
    for items in item_blocks(benchmark, block_mb):
        found = _with_block(docs, items, budget)
        out = found if out is None else out.unionByName(found)
    return out


def item_blocks(benchmark: DataFrame, block_mb: float = BLOCK_MB) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about ``block_mb``; one empty block if there are none."""
    items = benchmark.select("item_id", doc_text().alias("text"))
    total = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = max(1, -(-total // int(block_mb * (1 << 20))))
    for k in range(blocks):
        block = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else items
        yield [(r[0], r[1]) for r in block.orderBy("item_id", "text").collect()]


def _with_block(docs: DataFrame, items: list[tuple[int, str]], budget: float) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = ItemIndex(shared.value, budget)
        for batch in batches:
            found = search(index, batch.column(0).to_pylist(), batch.column(1).to_pylist())
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], [c.split()[0] for c in SCHEMA.split(", ")])

    return arrow_map(texts_of(docs), run, SCHEMA)


def decontaminate(docs: DataFrame, benchmark: DataFrame, budget: float = BUDGET, block_mb: float = BLOCK_MB) -> DataFrame:
    """The rows of ``docs`` whose text leaks no item, all columns kept; one pass for each block of items, no shuffle."""
    at = docs.columns.index("text")
    for items in item_blocks(benchmark, block_mb):
        docs = _without(docs, at, items, budget)
    return docs


def _without(docs: DataFrame, at: int, items: list[tuple[int, str]], budget: float) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = ItemIndex(shared.value, budget)
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            leaky = {d for d, *_ in search(index, list(range(len(texts))), texts)}
            yield batch.filter(pa.array([n not in leaky for n in range(len(texts))], pa.bool_()))

    return arrow_map(docs, run, docs.schema)
