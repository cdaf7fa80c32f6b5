"""Operator 1, token counts: prefix dynamic programming over byte-level BPE.

For each prefix of a text the exact token count of that prefix is known, so
that truncation and budget questions need no second encoding. Within a
pre-token the recurrence is count[i] = count[j] + 1, where the one token
that may end at byte i starts at j: it is in the vocabulary, and BPE leaves
it and the last token before j apart. Across pre-tokens counts add up; only
the last, cut pre-token of a prefix is looked at again, by its own rules.
States of short pre-tokens are shared by those that begin alike; a long one
(a run of letters without a space, say) has two integers for each of its
bytes and is not kept, so memory is linear in the longest text.

Null and empty texts have 0 tokens; repeated rows give repeated rows; other
columns are not read, so their names can't clash.
"""

from __future__ import annotations

from array import array
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .bpe import ByteBpe
from .common import BoundedCache, arrow_map, per_worker, texts_of

#: Entries of each worker's caches, by memory: some hundred bytes each.
WORD_CACHE = 300_000
PAIR_CACHE = 300_000
STATES = 500_000
#: Pre-tokens of more bytes share no states and are in no cache.
LONG = 64


class PrefixCounter:
    """Token counts of all prefixes of texts."""

    def __init__(self, path: str):
        self.bpe = ByteBpe(path)
        self.blanks, self.blank = regex.compile(r"\s+").match, regex.compile(r"\s+").fullmatch
        self.apart = BoundedCache(self._apart, PAIR_CACHE)
        self.whole = BoundedCache(self._last_count, WORD_CACHE, LONG)
        self.states: dict[bytes, tuple[int, bytes]] = {b"": (0, b"")}
        self.reach: dict[bytes, int] = {}  # by the last two bytes, the length of the longest token with that end
        for token in self.bpe.vocab:
            self.reach[token[-2:]] = max(self.reach.get(token[-2:], 0), len(token))

    def _apart(self, pair: tuple[bytes, bytes]) -> bool:
        """Whether BPE leaves exactly these two tokens (or the one, if the first is empty)."""
        left, right = pair
        return self.bpe.apart(left, right) if left else self.bpe.merge(right) == [right]

    def _grow(self, word: bytes, i: int) -> tuple[int, bytes]:
        """The state of the prefix of i bytes, from the states of all shorter ones: its count and last token."""
        states, vocab, apart = self.states, self.bpe.vocab, self.apart
        for j in range(max(0, i - self.reach.get(word[max(0, i - 2) : i], 1)), i):
            token = word[j:i]
            if token in vocab:
                n, last = states[word[:j]]
                if apart[last, token]:
                    state = states[word[:i]] = (n + 1, token)
                    return state
        raise ValueError(f"no token ends at byte {i} of {word!r}")

    def _state(self, word: bytes) -> tuple[int, bytes]:
        """The state of a whole pre-token; states of shared prefixes are reused."""
        states, known = self.states, len(word)
        if len(states) + known > STATES:
            states.clear()
            states[b""] = (0, b"")
        while word[:known] not in states:
            known -= 1
        state = states[word[:known]]
        for i in range(known + 1, len(word) + 1):
            state = self._grow(word, i)
        return state

    def _run(self, word: bytes) -> array:
        """Of a long pre-token: the token count of each prefix, by bytes from 0 on."""
        vocab, apart, reach = self.bpe.vocab, self.apart, self.reach
        counts, lasts = array("l", bytes(8 * (len(word) + 1))), array("l", bytes(8 * (len(word) + 1)))
        for i in range(1, len(word) + 1):
            for j in range(max(0, i - reach.get(word[max(0, i - 2) : i], 1)), i):
                token = word[j:i]
                if token in vocab and apart[word[j - lasts[j] : j], token]:
                    counts[i], lasts[i] = counts[j] + 1, i - j
                    break
            else:
                raise ValueError(f"no token ends at byte {i}")
        return counts

    def _last_count(self, word: str) -> int:
        raw = word.encode()
        return self._state(raw)[0] if len(raw) <= LONG else self._run(raw)[-1]

    def prefix_counts(self, word: bytes) -> Sequence[int]:
        """Of one pre-token: the token count of each prefix, by bytes from 0 on."""
        if len(word) > LONG:
            return self._run(word)
        if word not in self.states:
            self._state(word)
        return [self.states[word[:i]][0] for i in range(len(word) + 1)]

    def _segments(self, text: str) -> list[tuple[str, bool]]:
        if not self.bpe.special or not any(s in text for s in self.bpe.special):
            return [(text, False)]
        return [(s, s in self.bpe.special) for s in self.bpe.split_special(text) if s]

    def total(self, text: str) -> int:
        """The last entry of the text's table."""
        n, whole = 0, self.whole.__getitem__
        for part, special in self._segments(text):
            n += 1 if special else sum(map(whole, self.bpe.pieces(part)))
        return n

    def table(self, text: str) -> list[int]:
        """Entry k: the exact token count of the text's first k code points."""
        out, base = [0], 0
        for part, special in self._segments(text):
            if special:
                before = text[: len(out) - 1]
                out += [self.total(before + part[:k]) for k in range(1, len(part))]
                base += 1
                out.append(base)
            else:
                base = self._extend(part, out, base)
        return out

    def _extend(self, part: str, out: list[int], base: int) -> int:
        """Adds the entries of a part without special strings; returns its last."""
        blanks, before = 0, base  # white space at the end so far, and the count before it
        run: list[int] = []
        at = 0
        for piece in self.bpe.pieces(part):
            counts = self._by_char(piece)
            for k in range(1, len(piece) + 1):
                head = piece[:k]
                if self.blank(head):
                    if not blanks:
                        before, run = base, self._blank_run(part, at)
                    blanks += 1
                    out.append(before + run[blanks])
                elif head[0] == "'" and k < len(piece) and len(piece) > 1 and piece[1].isalpha():
                    out.append(base + sum(map(self.whole.__getitem__, self.bpe.pieces(head))))
                    blanks = 0
                else:
                    out.append(base + counts[k])
                    blanks = 0
            base += counts[-1]
            at += len(piece)
        return base

    def _blank_run(self, part: str, at: int) -> list[int]:
        return self._by_char(self.blanks(part, at).group())

    def _by_char(self, piece: str) -> list[int]:
        counts, out, n = self.prefix_counts(piece.encode()), [0], 0
        for c in piece:
            n += len(c.encode())
            out.append(counts[n])
        return out

    def measure(self, text: str, budget: int) -> tuple[int, int]:
        """The text's token count, and the length in code points of its longest prefix of at most ``budget`` tokens.

        The count before a pre-token never exceeds the count within it, so only
        the pre-token that crosses the budget and the blanks before it are opened.
        """
        if any(s in text for s in self.bpe.special):
            total = self.total(text)
            return total, len(text) if total <= budget else max(k for k, n in enumerate(self.table(text)) if n <= budget)
        pieces = self.bpe.pieces(text)
        sums = list(accumulate(map(self.whole.__getitem__, pieces)))
        if not sums or sums[-1] <= budget:
            return sums[-1] if sums else 0, len(text)
        i = bisect_right(sums, budget)  # the pre-token that crosses the budget
        start = i
        while start and self.blank(pieces[start - 1]):
            start -= 1
        at = sum(map(len, pieces[:start]))
        out: list[int] = []
        self._extend(text[at : at + sum(map(len, pieces[start : i + 1])) + 1], out, sums[start - 1] if start else 0)
        return sums[-1], at + max((k + 1 for k, n in enumerate(out) if n <= budget), default=0)


def counter(path: str) -> PrefixCounter:
    return per_worker(PrefixCounter, (path,))


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 1024) -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit, chars_in_limit.

    chars_in_limit is the length in code points of the longest prefix that
    keeps within ``limit`` tokens. One pass over doc_id and text, no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(tokenizer_path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n, fit = zip(*(c.measure(t, limit) for t in texts)) if texts else ((), ())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(t.encode()) for t in texts], pa.int64()),
                    pa.array(n, pa.int64()),
                    pa.array([x > limit for x in n], pa.bool_()),
                    pa.array(fit, pa.int64()),
                ],
                ["doc_id", "n_bytes", "n_tokens", "over_limit", "chars_in_limit"],
            )

    return arrow_map(texts_of(docs), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, chars_in_limit long")


def prefix_tables(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Per row: doc_id and counts, whose entry k is the token count of the first k code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(tokenizer_path)
        for batch in batches:
            for i, text in enumerate(batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([c.table(text)], pa.list_(pa.int32()))], ["doc_id", "counts"])

    return arrow_map(texts_of(docs), run, "doc_id long, counts array<int>")
