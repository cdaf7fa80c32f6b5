"""Operator 5, toxicity: maximum-scoring segments of token log-odds.

Tokens are the words of a text in lower case. Their log-odds come from a tree
of word beginnings: the chance that a document with a word of this beginning
is toxic has a Dirichlet prior of ``strength`` centred on the chance of the
next shorter beginning, up to the share of toxic documents. A beginning that
does not differ from its parent by ``sure`` standard errors is left out, so a
word is scored at its longest telling beginning, and an unseen word takes what
its stem has taught. Log-odds are shifted by ``drift``, so that common text
has a negative mean.

A linear scan (Ruzzo and Tompa) finds all maximal-scoring segments of a text.
Under chance the best score of n tokens follows an extreme-value law: lambda
solves E[exp(lambda s)] = 1 over the tokens of clean documents, and K is set
by the upper quantile of their best scores. A segment is a toxic passage if its
expected number by chance, K n exp(-lambda S), is below ``alpha``. A
document's score is a logistic function of its best and of its summed
normalised passage scores and of their number among its words.

Learning uses the labelled rows that are not held out: at most ``per_class``
toxic and as many clean ones twice over, those of the least XXH64 of doc_id
(a bounded, documented sample), in ``folds`` parts. Each part is scanned with
the tree of the others, so that all rows serve both the tree and the
calibration; of the values of ``sure`` the one is taken whose calibration
loses least, which is how the tree keeps to what a sample of this size can
tell. The model is a table of at most ``nodes`` beginnings. Scoring is one
pass over all whole texts without a shuffle.

Null and empty texts, and all texts if nothing was labelled, get the score
that no passage gives. Labels that are null count as none. Rows repeated with
one doc_id are scored each.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BoundedCache, arrow_map, crc_fold, cut, doc_text, texts_of

PER_CLASS, NODES, DEPTH, STRENGTH, SUPPORT, SURES, FOLDS, DRIFT, ALPHA, CUT = 3000, 200_000, 12, 5.0, 4, (2.5, 5.0, 8.0), 8, 1.0, 0.05, 0.7
WORDS = re.compile(r"\w+").findall
SCHEMA = "doc_id long, held_out boolean, score double, predicted int, passages int, best_passage int, passage_words int"


@dataclass
class Model:
    """Log-odds of word beginnings, the law of chance and the calibration."""

    odds: dict[str, float] = field(default_factory=dict)
    base: float = -DRIFT
    lam: float = 1.0
    log_k: float = 0.0
    weights: tuple[float, ...] = (0.0, 0.0, 0.0, -3.0)

    def token(self, word: str) -> float:
        odds = self.odds
        for n in range(min(len(word), DEPTH), 0, -1):
            found = odds.get(word[:n])
            if found is not None:
                return found
        return self.base


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score), in linear time: Ruzzo and Tompa's scan.

    Only tokens of positive score are visited; the rest enters by a running sum.
    """
    total = np.concatenate([[0.0], np.cumsum(scores)])
    stack: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum after, nearest below with a lower start
    for i in np.flatnonzero(scores > 0).tolist():
        start, before, after = i, total[i], total[i + 1]
        end = i + 1
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= before:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= after:
                stack.append((start, end, before, after, j))
                break
            start, before = stack[j][0], stack[j][2]
            del stack[j:]
    return [(s, e, float(b - a)) for s, e, a, b, _ in stack]


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.known = BoundedCache(model.token, 400_000)

    def scan(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        words = WORDS(text.lower())
        if not words:
            return 0, []
        scores = np.fromiter(map(self.known.__getitem__, words), np.float64, len(words))
        return len(words), segments(scores)

    def features(self, n: int, found: list[tuple[int, int, float]]) -> tuple[float, float, float, list[tuple[int, int, float]]]:
        """Best and summed normalised scores, passages in 100 words, and the significant passages."""
        m, floor = self.model, -math.log(ALPHA)
        normal = [(s, e, m.lam * x - m.log_k - math.log(n)) for s, e, x in found]
        best = max((x for *_, x in normal), default=-8.0)
        passages = [p for p in normal if p[2] > floor]
        return max(-8.0, min(best, 40.0)) / 8, math.log1p(sum(x for *_, x in passages)), min(2.0, 100 * len(passages) / max(n, 1)), passages

    def score(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        n, found = self.scan(text)
        *x, passages = self.features(max(n, 1), found)
        z = sum(w * v for w, v in zip(self.model.weights, [*x, 1.0]))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), passages


def training_rows(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """(text, toxic, part) of the bounded sample, in FOLDS parts by a hash of doc_id."""
    own = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(crc_fold() != 1)
    order = F.xxhash64("doc_id")
    ids = None
    for toxic, n in ((1, per_class), (0, 2 * per_class)):
        part = own.filter(F.col("toxic") == toxic).orderBy(order, "doc_id").limit(n)
        ids = part if ids is None else ids.unionByName(part)
    ids = ids.select("doc_id", "toxic", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(FOLDS)).cast("int").alias("part"))
    return docs.select("doc_id", doc_text().alias("text")).join(F.broadcast(ids), "doc_id").select("text", "toxic", "part")


def beginnings(rows: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(piece, part, toxic, docs): documents of a part and label with a word that begins so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            within: dict[tuple[int, int], Counter] = {}
            for text, toxic, part in zip(*(b.column(k).to_pylist() for k in range(3))):
                own = {w[:n] for w in set(WORDS(text.lower())) for n in range(1, min(len(w), depth) + 1)}
                within.setdefault((part, int(toxic == 1)), Counter()).update(own)
            for (part, toxic), c in within.items():
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array([part] * len(c), pa.int32()), pa.array([toxic] * len(c), pa.int32()), pa.array(list(c.values()), pa.int64())], ["piece", "part", "toxic", "docs"])

    return arrow_map(rows.select("text", "toxic", "part"), run, "piece string, part int, toxic int, docs long")


def learn(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, nodes: int = NODES) -> Model:
    rows = cut(training_rows(docs, labels, per_class))
    sizes = np.zeros((FOLDS, 2))
    for part, toxic, n in rows.groupBy("part", (F.col("toxic") == 1).cast("int")).count().collect():
        sizes[part, toxic] = n
    if not sizes.sum(axis=0).all():
        return Model()
    share = sizes[:, 1].sum() / sizes.sum()
    own = [F.coalesce(F.sum(F.when((F.col("part") == k) & (F.col("toxic") == y), F.col("docs"))), F.lit(0)).alias(f"n{k}_{y}") for k in range(FOLDS) for y in (0, 1)]
    counted = beginnings(rows).groupBy("piece").agg(*own, F.sum("docs").alias("n"), F.sum(F.col("docs") * F.col("toxic")).alias("t"))
    # beginnings that say most, by the normal deviate of their share; the shorter first, so that parents come along
    z = F.abs(F.col("t") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share))
    top = counted.filter((F.col("n") >= SUPPORT) & (z >= 1)).orderBy(z.desc(), F.length("piece"), "piece").limit(nodes).collect()
    top.sort(key=lambda r: len(r[0]))
    pieces = [r[0] for r in top]
    counts = np.array([r[1 : 1 + 2 * FOLDS] for r in top], np.int64).reshape(-1, FOLDS, 2)  # [piece, part, label]

    def model(sure: float, without: int | None = None) -> Model:
        kept = [k for k in range(FOLDS) if k != without]
        own, size = counts[:, kept].sum(axis=1), sizes[kept].sum(axis=0)
        if not size.all():
            return Model()
        return Model(odds=tree(pieces, own[:, 1], own.sum(axis=1), size[1] / size.sum(), sure))

    scans = _scans(rows, [[model(sure, k) for k in range(FOLDS)] for sure in SURES])
    fitted = [calibrate(model(sure), [s[1:] for s in scans if s[0] == i]) for i, sure in enumerate(SURES)]
    return min(fitted, key=lambda f: f[1])[0]


def tree(pieces: list[str], toxic: np.ndarray, n: np.ndarray, share: float, sure: float, strength: float = STRENGTH) -> dict[str, float]:
    """Shifted log-odds against the share of all, each beginning shrunk to its longest known parent; pieces go by length."""
    chance: dict[str, float] = {}
    for piece, t, m in zip(pieces, toxic.tolist(), n.tolist()):
        if m < SUPPORT * (FOLDS - 1) / FOLDS:
            continue
        parent = next((chance[piece[:k]] for k in range(len(piece) - 1, 0, -1) if piece[:k] in chance), share)
        if abs(t - m * parent) >= sure * math.sqrt(m * parent * (1 - parent)):
            chance[piece] = (t + strength * parent) / (m + strength)
    logit = lambda p: math.log(p / (1 - p))
    return {p: max(-1.0, min(8.0, logit(c) - logit(share))) - DRIFT for p, c in chance.items()}


def _scans(rows: DataFrame, models: list[list[Model]]) -> list[tuple[int, int, int, list[float], list[float]]]:
    """(choice, toxic, words, segment scores, token scores by 0.25) of the rows, a bounded sample: each under the model of its part, for each choice."""
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorers = [[Scorer(m) for m in own] for own in shared.value]
        for b in batches:
            out = []
            for text, toxic, part in zip(*(b.column(k).to_pylist() for k in range(3))):
                words = WORDS(text.lower())
                for i, own in enumerate(scorers):
                    scores = np.fromiter(map(own[part].known.__getitem__, words), np.float64, len(words))
                    out.append((i, int(toxic == 1), len(words), [x for *_, x in segments(scores)], np.bincount(np.round((scores + 2) * 4).astype(int), minlength=48).tolist()))
            if out:
                types = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["choice", "toxic", "n", "s", "h"])

    return [tuple(r) for r in arrow_map(rows.select("text", "toxic", "part"), run, "choice int, toxic int, n long, s array<double>, h array<double>").collect()]


def karlin(hist: np.ndarray) -> float:
    """The positive root of E[exp(lambda s)] = 1 over a histogram of scores from -2 on, by 0.25."""
    s, p = np.arange(len(hist)) / 4 - 2, hist / hist.sum()
    if p @ s >= 0 or not (p[s > 0] > 0).any():
        return 1.0
    low, high = 1e-3, 10.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if p @ np.exp(mid * s) < 1 else (low, mid)
    return float(min(max(low, 0.1), 5.0))


def calibrate(model: Model, scans: list[tuple]) -> tuple[Model, float]:
    """Fits the law of chance on clean documents, then the logistic weights on all; the model and its mean loss."""
    clean = [(n, max(s, default=0.0)) for t, n, s, _ in scans if t != 1 and n]
    if len(clean) > 20:
        model.lam = karlin(np.sum([h for t, n, _, h in scans if t != 1 and n], axis=0))
        n, best = np.array(clean).T
        model.log_k = max(math.log(1e-4), float(np.quantile(model.lam * best - np.log(n), 1 - ALPHA)) + math.log(ALPHA))
    scorer = Scorer(model)
    x = np.array([[*scorer.features(max(n, 1), [(0, 0, v) for v in s])[:3], 1.0] for _, n, s, _ in scans])
    y = np.array([t == 1 for t, *_ in scans], float)
    if not len(x) or not 0 < y.sum() < len(y):
        return model, float("inf")
    weights = logistic(x, y)
    model.weights = tuple(map(float, weights))
    told = x @ weights
    return model, float(np.mean(np.logaddexp(0.0, np.where(y == 1, -told, told))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 40) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w -= np.linalg.solve(h, x.T @ (p - y) + ridge * w)
    return w


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted, and the number, the best and the length of toxic passages.

    best_passage is the first word of the best passage, -1 if none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            found = [scorer.score(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    b.column(2),
                    pa.array([s for s, _ in found], pa.float64()),
                    pa.array([int(s >= CUT) for s, _ in found], pa.int32()),
                    pa.array([len(p) for _, p in found], pa.int32()),
                    pa.array([max(p, key=lambda x: x[2])[0] if p else -1 for _, p in found], pa.int32()),
                    pa.array([sum(e - s for s, e, _ in p) for _, p in found], pa.int32()),
                ],
                [c.split()[0] for c in SCHEMA.split(", ")],
            )

    return arrow_map(texts_of(docs, (crc_fold() == 1).alias("held_out")), run, SCHEMA)


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, nodes: int = NODES) -> DataFrame:
    return score_toxicity(docs, learn(docs, labels, per_class, nodes))
