"""Operator 8, language ID: a linear-chain conditional random field over words.

Words are runs of letters in lower case; each line of a text is one chain.
A word's emission is the sum of learned weights of its character n-grams (1
to 3, with marks at both ends, so that affixes of up to 2 letters are among
them), its affixes of 3 letters, and its lexicon entry if it is a frequent
word; transitions between the labels of neighbouring words are learned too.
Forward-backward gives each word's label distribution, also where a text
switches languages; a document's language is the label with the largest mean
over all its words, and that mean is the score.

Learning uses text and non-null lang of documents that are not held out: at
most ``per_lang`` of each language, by hash of doc_id, and whole texts of at
most ``CHARS`` characters of all languages together, shared equally, beside
one document of each (bounded and documented). Emissions are first fitted to the documents' labels; words that a
sticky chain then gives clearly to another language are relabelled, so that
the transitions are learned from switched text as well; then emissions and
transitions are fitted together by the gradient of the field's likelihood.

Null texts and texts without a letter are ``und`` with score 0; so are all if
nothing is labelled. Ties go to the first label in order. Rows repeated with
one doc_id are labelled each. Scoring is one pass without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, crc_fold, cut, texts_of

CHARS = 40_000_000
PER_LANG, BUCKETS_LOG2, LEXICON, CHUNK, CACHE, UNKNOWN = 150, 16, 2000, 100_000, 100_000, "und"
RUNS, LETTERS = re.compile(r"[^\W\d_]+").findall, regex.compile(r"\p{L}+").findall
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, words long, switches long"
_P = np.uint64(1_099_511_628_211)
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # [feature bucket, label]
    lexicon: dict[str, int] = field(default_factory=dict)  # word -> row in weights
    transitions: np.ndarray = None  # log weights [from, to]


def words_of(line: str) -> list[str]:
    """Runs of letters; numerals such as ½ and Ⅷ, which the quicker pattern takes along, are none."""
    found = RUNS(line)
    return found if not found or "".join(found).isalpha() else LETTERS(line)


def lines_of(text: str) -> list[list[str]]:
    return [w for line in text.lower().split("\n") if (w := words_of(line))]


def features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word's number) of every feature of the words."""
    codes = np.frombuffer(("\x02" + "\x03\x02".join(words) + "\x03").encode("utf-32-le"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])
    edge = (codes == 2) | (codes == 3)
    shift = np.uint64(64 - BUCKETS_LOG2)
    buckets, owners = [], []
    h = codes
    for n in range(1, 5):
        if n > 1:
            if len(codes) < n:
                break
            h = h[:-1] * _P + codes[n - 1 :]
        inside = owner[: len(h)] == owner[n - 1 :]
        if n == 1:
            inside = ~edge
        elif n == 4:
            inside = inside & (edge[: len(h)] | edge[n - 1 :])
        own = np.flatnonzero(inside)
        buckets.append((((h[own] + np.uint64(n)) * _MIX) >> shift).astype(np.int64))
        owners.append(owner[own])
    known = [(lexicon[w], i) for i, w in enumerate(words) if w in lexicon]
    if known:
        row, i = np.array(known).T
        buckets.append(row)
        owners.append(i)
    return np.concatenate(buckets), np.concatenate(owners)


def emissions(weights: np.ndarray, bucket: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """[word, label]: sums of weights, over the root of the number of features."""
    size = np.sqrt(np.maximum(np.bincount(owner, minlength=n), 1))
    return np.stack([np.bincount(owner, weights[bucket, k], minlength=n) for k in range(weights.shape[1])], axis=1) / size[:, None]


@dataclass
class Packed:
    """Chains laid out by step: ``perm`` lists words step by step, longest chain first; ``live`` counts the chains of each step."""

    perm: np.ndarray
    live: np.ndarray
    starts: np.ndarray


def packed(lengths: np.ndarray) -> Packed:
    order = np.argsort(-lengths, kind="stable")
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])[order]
    own = lengths[order]
    live = np.searchsorted(-own, -np.arange(int(own.max())), side="left") if len(own) else np.zeros(0, int)
    step = np.repeat(np.arange(len(live)), live)
    starts = np.concatenate([[0], np.cumsum(live)])
    rank = np.arange(len(step)) - starts[:-1][step]
    return Packed(first[rank] + step, live, starts)


def forward_backward(e: np.ndarray, trans: np.ndarray, p: Packed, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Label distributions of all words, in their own order, and the expected transitions if asked for."""
    x = np.exp(e[p.perm] - e[p.perm].max(axis=1, keepdims=True))
    t = np.exp(trans - trans.max())
    alpha, beta = np.empty_like(x), np.ones_like(x)
    at = p.starts.tolist()
    for s, n in enumerate(p.live.tolist()):
        a = x[at[s] : at[s] + n] if s == 0 else (alpha[at[s - 1] : at[s - 1] + n] @ t) * x[at[s] : at[s] + n]
        alpha[at[s] : at[s] + n] = a / a.sum(axis=1, keepdims=True)
    for s in range(len(p.live) - 2, -1, -1):
        n = int(p.live[s + 1])
        b = (beta[at[s + 1] : at[s + 1] + n] * x[at[s + 1] : at[s + 1] + n]) @ t.T
        beta[at[s] : at[s] + n] = b / b.sum(axis=1, keepdims=True)
    both = alpha * beta
    both /= both.sum(axis=1, keepdims=True)
    out = np.empty_like(both)
    out[p.perm] = both
    if not pairs:
        return out, None
    expected = np.zeros_like(t)
    for s in range(1, len(p.live)):
        n = int(p.live[s])
        left, right = alpha[at[s - 1] : at[s - 1] + n], beta[at[s] : at[s] + n] * x[at[s] : at[s] + n]
        z = np.einsum("bi,ij,bj->b", left, t, right)
        expected += t * ((left / z[:, None]).T @ right)
    return out, expected


def softmax(e: np.ndarray) -> np.ndarray:
    x = np.exp(e - e.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def fit(texts: list[tuple[str, str]], rounds: int = 30, field_rounds: int = 12, rate: float = 0.5, ridge: float = 1e-3) -> Model:
    """Fits the field to (text, language) rows."""
    langs = sorted({g for _, g in texts})
    chains = [(line, langs.index(g)) for t, g in texts for line in lines_of(t)]
    counts = Counter(w for line, _ in chains for w in line)
    n_buckets = 1 << BUCKETS_LOG2
    lexicon = {w: n_buckets + i for i, (w, c) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]) if c >= 10}
    words = sorted(counts)
    number = {w: i for i, w in enumerate(words)}
    size = len(langs)
    model = Model(langs, np.zeros((n_buckets + LEXICON, size)), lexicon, np.zeros((size, size)))
    if not words or size < 2:
        return model
    bucket, owner = features(words, lexicon)
    ids = np.array([number[w] for line, _ in chains for w in line])
    lengths = np.array([len(line) for line, _ in chains])
    doc_label = np.repeat([g for _, g in chains], lengths)
    root = np.sqrt(np.maximum(np.bincount(owner, minlength=len(words)), 1))
    seen = np.zeros_like(model.weights) + 1e-3

    def step(gradient: np.ndarray) -> None:
        """One AdaGrad step from the gradient by word and label, spread to the features."""
        g = np.stack([np.bincount(bucket, (gradient[:, k] / root)[owner], minlength=len(model.weights)) for k in range(size)], axis=1) / len(ids)
        g -= ridge / len(words) * model.weights
        seen[:] += g * g * 1e6
        model.weights += rate * 1e3 * g / np.sqrt(seen)

    def by_word(values: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(ids, values[:, k], minlength=len(words)) for k in range(size)], axis=1)

    target = np.eye(size)[doc_label]
    wanted = by_word(target)
    total = wanted.sum(axis=1, keepdims=True)
    for _ in range(rounds):
        step(wanted - total * softmax(emissions(model.weights, bucket, owner, len(words))))
    layout = packed(lengths)
    sticky = np.log(np.full((size, size), 0.03 / (size - 1)) + np.eye(size) * (0.97 - 0.03 / (size - 1)))
    told, _ = forward_backward(emissions(model.weights, bucket, owner, len(words))[ids], sticky, layout)
    label = np.where(told.max(axis=1) > 0.95, told.argmax(axis=1), doc_label)
    target = np.eye(size)[label]
    wanted = by_word(target)
    inner = np.ones(len(ids), bool)
    inner[np.concatenate([[0], np.cumsum(lengths)[:-1]])] = False
    after = np.flatnonzero(inner)
    pairs = np.zeros((size, size))
    np.add.at(pairs, (label[after - 1], label[after]), 1)
    model.transitions = np.log((pairs + 0.5) / (pairs + 0.5).sum(axis=1, keepdims=True))
    for _ in range(field_rounds):
        mean, expected = forward_backward(emissions(model.weights, bucket, owner, len(words))[ids], model.transitions, layout, pairs=True)
        step(wanted - by_word(mean))
        model.transitions += np.clip((pairs - expected) / max(len(after), 1) * 20, -0.5, 0.5) - ridge * model.transitions
    model.weights = model.weights.astype(np.float32)
    return model


def training_rows(docs: DataFrame, per_lang: int = PER_LANG) -> list[tuple[str, str]]:
    """The bounded sample: (text, lang) of at most ``per_lang`` documents of each language that are not held out."""
    ids = docs.filter("lang is not null and doc_id is not null and text is not null").filter(crc_fold() != 1).select("doc_id", "lang", F.length("text").alias("_chars"))
    counts = cut(ids.groupBy("lang").count())
    share = CHARS // max(1, counts.count())
    order = F.xxhash64("doc_id")
    few = ids.join(F.broadcast(counts), "lang").filter(F.pmod(order, F.col("count")) < 4 * per_lang)  # about so many of each language
    best = Window.partitionBy("lang").orderBy(order, "doc_id")
    ranked = few.withColumn("_rank", F.row_number().over(best)).filter(F.col("_rank") <= per_lang)
    chosen = ranked.withColumn("_sum", F.sum("_chars").over(best)).filter((F.col("_sum") <= share) | (F.col("_rank") == 1)).select("doc_id").distinct()
    rows = docs.filter("lang is not null and text is not null").select("doc_id", "text", "lang").join(F.broadcast(chosen), "doc_id").collect()
    return [(r.text, r.lang) for r in sorted(rows, key=lambda r: (r.lang, r.doc_id, r.text))]


class Labeller:
    def __init__(self, model: Model):
        self.model = model
        self.rows: dict[str, int] = {}
        self.table = np.zeros((0, len(model.langs)), np.float32)

    def emissions(self, words: list[str]) -> np.ndarray:
        """Emissions of the words in order; each different word is worked out once while the cache holds it."""
        new = [w for w in dict.fromkeys(words) if w not in self.rows]
        if len(self.rows) + len(new) > CACHE:
            self.rows, self.table = {}, self.table[:0]
            new = list(dict.fromkeys(words))
        if new:
            bucket, owner = features(new, self.model.lexicon)
            self.rows |= zip(new, range(len(self.rows), len(self.rows) + len(new)))
            self.table = np.concatenate([self.table, emissions(self.model.weights, bucket, owner, len(new)).astype(np.float32)])
        return self.table[np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))]

    def label(self, texts: list[str]) -> list[tuple[str, float, int, int]]:
        """(language, score, words, switches) of each text."""
        out: list[tuple[str, float, int, int]] = []
        waiting: list[list[list[str]]] = []
        size = 0
        for text in texts:
            waiting.append(lines_of(text))
            size += sum(map(len, waiting[-1]))
            if size >= CHUNK:
                out += self._chunk(waiting)
                waiting, size = [], 0
        return out + self._chunk(waiting)

    def _chunk(self, docs: list[list[list[str]]]) -> list[tuple[str, float, int, int]]:
        sizes = np.array([sum(map(len, d)) for d in docs], np.int64)
        words = [w for d in docs for line in d for w in line]
        langs = self.model.langs
        if not words or not langs:
            return [(UNKNOWN, 0.0, int(n), 0) for n in sizes]
        lengths = np.array([len(line) for d in docs for line in d])
        p, _ = forward_backward(self.emissions(words), self.model.transitions.astype(np.float32), packed(lengths))
        owner = np.repeat(np.arange(len(docs)), sizes)
        mean = np.stack([np.bincount(owner, p[:, k], minlength=len(docs)) for k in range(len(langs))], axis=1) / np.maximum(sizes, 1)[:, None]
        best = p.argmax(axis=1)
        turns = np.bincount(owner[1:], (best[1:] != best[:-1]) & (owner[1:] == owner[:-1]), minlength=len(docs))
        return [(langs[k], min(1.0, float(m[k])), int(n), int(s)) if n else (UNKNOWN, 0.0, 0, 0) for m, k, n, s in zip(mean, mean.argmax(axis=1), sizes, turns)]


def learn(docs: DataFrame, per_lang: int = PER_LANG) -> Model:
    return fit(training_rows(docs, per_lang))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score, words, switches (places where the likeliest label changes)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value)
        for b in batches:
            found = labeller.label(b.column(1).to_pylist())
            lang, score, words, switches = zip(*found) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(words, pa.int64()), pa.array(switches, pa.int64())], [c.split()[0] for c in SCHEMA.split(", ")])

    return arrow_map(texts_of(docs, (crc_fold() == 1).alias("held_out")), run, SCHEMA)


def keep_identified(docs: DataFrame, model: Model, least: float = 0.0) -> DataFrame:
    """The rows of ``docs`` with a language other than ``und`` and at least that score; all columns kept, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value)
        for b in batches:
            found = labeller.label([t or "" for t in b.column(at).to_pylist()])
            yield b.filter(pa.array([g != UNKNOWN and s >= least for g, s, *_ in found], pa.bool_()))

    return arrow_map(docs, run, docs.schema)
