"""What the text operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlight.runtime import cut, ensure_importable, session_folder, table

__all__ = ["BoundedCache", "arrow_map", "crc_fold", "cut", "doc_text", "ensure_importable", "session_folder", "table", "texts_of", "unused"]


def doc_text(column: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def texts_of(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (null: empty) and the columns asked for; others are pruned."""
    return docs.select("doc_id", doc_text().alias("text"), *more)


def unused(df: DataFrame, stem: str) -> str:
    """A beginning of column names that no column of ``df`` has: the stem, after underscores if need be."""
    while any(c.lower().startswith(stem) for c in df.columns):
        stem = f"_{stem}"
    return stem


def crc_fold(doc_id: str = "doc_id", folds: int = 3) -> Column:
    """crc32 of the id's decimal text, modulo the number of folds."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with workers that can import this package and give their buffers back after each task."""
    ensure_importable(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


class BoundedCache(dict):
    """A dict that computes missing values and is emptied when it holds ``cap`` of them.

    Values of keys longer than ``longest`` are not kept. It only saves work: a
    value that went is computed again, the same.
    """

    def __init__(self, compute: Callable, cap: int, longest: int = 1 << 62):
        super().__init__()
        self.compute, self.cap, self.longest = compute, cap, longest

    def __missing__(self, key):
        if len(key) > self.longest:
            return self.compute(key)
        if len(self) >= self.cap:
            self.clear()
        value = self[key] = self.compute(key)
        return value


def per_worker(build: Callable, key: tuple, store: dict = {}) -> object:  # noqa: B006
    """One object for each key and Python worker, kept between its tasks."""
    own = (build.__module__, build.__qualname__, *key)
    if own not in store:
        store[own] = build(*key)
    return store[own]
