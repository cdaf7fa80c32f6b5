"""Operator 10, packing: Karmarkar-Karp multiway differencing into windows of 2048 tokens.

Each document becomes its token ids and one end id. Whole windows are cut off
its front; what remains is cut into pieces of at most ``piece`` ids, the last
of every ``grain``-th document more finely, so that differencing can balance
windows to a few ids. The pieces of a group (those a task has at hand, at
most ``group``) go into near-equal windows: differencing merges the two
partial partitions of largest spread, the full windows of one onto the empty
ones of the other. If a window exceeds the capacity, the number of windows
rises and differencing runs again.

No shuffle: each task packs its own rows in groups of bounded size, so memory
is bounded and a hot source or a group of copies changes nothing. Null and
empty texts are one end id; repeated rows are packed again. A lost task is
done again from the same rows with the same result. sequence_id holds the
task's number above 40 bits of a counter.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .bpe import PRETOKEN, ByteBpe
from .common import arrow_map, per_worker, texts_of

WINDOW, PIECE, GRAIN, GROUP, END_ID = 2048, 512, 6, 1536, 1
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class IdEncoder:
    """Token ids of whole texts, as the tokenizer file gives them; special strings become their ids."""

    def __init__(self, path: str):
        import tiktoken

        bpe = ByteBpe(path)
        order = {a + b: 256 + r for (a, b), r in bpe.rank.items()} | {bytes([b]): b for b in range(256)}
        if all(bpe.vocab[t] == r for t, r in order.items() if len(t) > 1):
            order = dict(bpe.vocab)  # ids already rise with the ranks of merges
        self.to_id = np.zeros(len(order) + len(bpe.special), np.uint32)
        for token, r in order.items():
            self.to_id[r] = bpe.vocab[token]
        special = {s: len(order) + i for i, s in enumerate(bpe.special)}
        for s, r in special.items():
            self.to_id[r] = bpe.special[s]
        self.same = bool((self.to_id == np.arange(len(self.to_id))).all())
        self.enc = tiktoken.Encoding("byte_bpe", pat_str=PRETOKEN, mergeable_ranks=order, special_tokens=special)

    def ids(self, text: str, end: int) -> np.ndarray:
        found = self.enc.encode(text, allowed_special="all", disallowed_special=())
        out = np.empty(len(found) + 1, np.uint32)
        out[:-1] = found
        if not self.same:
            out[:-1] = self.to_id[out[:-1]]
        out[-1] = end
        return out


def cuts(n: int, fine: bool, window: int = WINDOW, piece: int = PIECE) -> list[int]:
    """Lengths of a document's pieces: whole windows, pieces, a rest; the rest halved down if it is to fill gaps."""
    out = [window] * (n // window)
    rest = n % window
    out += [piece] * (rest // piece)
    rest %= piece
    while fine and rest > 3:
        out.append((rest + 1) // 2)
        rest //= 2
    return out + [rest] * (rest > 0)


def difference(sizes: list[int], k: int) -> list[tuple[int, object]]:
    """Karmarkar-Karp: sizes in k windows, as (sum, tree of indices), largest first; empty windows are left out."""
    tie = count()
    heap = [(-s, next(tie), [(s, i)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        over = len(a) + len(b) - k
        if over <= 0:
            merged = a + b
        else:  # the smallest of a meet the smallest of b in reverse; the rest of either keep an empty window
            low_a, low_b = a[len(a) - over :], b[len(b) - over :]
            merged = a[: len(a) - over] + b[: len(b) - over]
            merged += [(x + y, (i, j)) for (x, i), (y, j) in zip(low_a, reversed(low_b))]
        merged.sort(key=lambda w: -w[0])
        spread = merged[0][0] - (merged[-1][0] if len(merged) == k else 0)
        heapq.heappush(heap, (-spread, next(tie), merged))
    return heap[0][2] if heap else []


def leaves(tree: object) -> list[int]:
    out, todo = [], [tree]
    while todo:
        t = todo.pop()
        if isinstance(t, tuple):
            todo += t
        else:
            out.append(t)
    return sorted(out)


def windows(sizes: list[int], capacity: int = WINDOW) -> list[list[int]]:
    """Indices of the sizes by window; the number of windows rises until all fit.

    A first estimate leaves the room that differencing has been seen to need, so that few runs do.
    """
    total = sum(sizes)
    k = max(1, -(-total // capacity))
    while True:
        found = difference(sizes, k)
        most = max((s for s, _ in found), default=0)
        if most <= capacity:
            return [leaves(t) for _, t in found]
        k = max(k + 1, -(-total // (capacity - (most - total // k) // 2))) if most - total // k < capacity // 2 else k + 1


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID, piece: int = PIECE, grain: int = GRAIN, group: int = GROUP) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = per_worker(IdEncoder, (tokenizer_path,))
        context = TaskContext.get()
        first = (context.partitionId() if context else 0) << 40
        sequences = count(first)
        waiting: list[tuple] = []
        seen = 0

        def packed(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            out = []
            for own in windows([r[2] for r in rows], window):
                sequence, offset = next(sequences), 0
                for i in own:
                    out.append((*rows[i], sequence, offset))
                    offset += rows[i][2]
            if out:
                yield batch_of(out)

        for batch in batches:
            full = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encoder.ids(text, end_id)
                at, n = 0, len(ids)
                seen += 1
                for length in cuts(n, seen % grain == 0, window, piece):
                    row = (doc_id, at, length, zlib.crc32(ids[at : at + length].astype("<u4", copy=False)), n)
                    if length == window:
                        full.append((*row, next(sequences), 0))
                    else:
                        waiting.append(row)
                    at += length
                if len(waiting) >= group:
                    yield from packed(waiting)
                    waiting = []
            if full:
                yield batch_of(full)
        if waiting:
            yield from packed(waiting)

    return arrow_map(texts_of(docs), run, SCHEMA)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)
