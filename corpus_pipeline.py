"""The corpus pipeline: language ID, line dedup, near-dedup on word shingles, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor
kept and returns the columns of documents; the last returns packed pieces.
Columns other than doc_id, text and n_chars pass through untouched.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlight.llm import decontaminate, langid, line_dedup, near_copies, packing
from meshlight.llm.common import cut, doc_text, ensure_importable, session_folder, table, unused

TOKENIZER = "byte_bpe_50k.json"
#: A document goes if no language reaches this share of its words.
LEAST_SHARE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a language: those without a letter and those of no clear language go."""
    return langid.keep_identified(docs, langid.learn(docs), LEAST_SHARE)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes later repeats of three-line windows; documents of which nothing is left go. n_chars follows the text."""
    own = unused(docs, "__count")
    done = line_dedup.dedup_lines(docs, counts=(f"{own}_lines", f"{own}_removed"))
    left = done.filter((F.col(f"{own}_removed") == 0) | (F.length(F.trim(F.col("text"))) > 0))
    n = F.length("text").cast("long")
    return left.select(*(n.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies: 5-word shingles, similarity 0.8 or more.

    SimHash proposes what lies within 4 bits, MinHash bands what differs by more; whole sets decide.

    It is the row of least doc_id, then of least digest of its text; a row
    without an id stays only if no row of its group has one. Each row is
    decided by its own text, so texts that share an id but aren't near copies
    stay. Rows of equal id and text are one.
    """
    found = cut(near_copies.near_copies(docs))
    name = unused(docs, "__kept")
    bare, id_, digest, own = (f"{name}_{c}" for c in ("bare", "id", "digest", "own"))
    place = F.struct(F.col("doc_id").isNull().alias(bare), F.col("doc_id").alias(id_), F.col("digest").alias(digest))
    stays = found.groupBy("component").agg(F.min(place).alias("place")).select(f"place.{id_}", f"place.{digest}")
    rows = docs.withColumn(own, F.xxhash64(doc_text()))
    kept = rows.join(stays.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(own) == F.col(digest)), "left_semi")
    if found.groupBy("doc_id", "digest").count().filter("count > 1").limit(1).count():
        kept = kept.dropDuplicates(["doc_id", own])
    return kept.drop(own)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents into which a benchmark item leaked."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of at most 2048 tokens; one row for each piece."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", simhash_stage),
    ("decontamination", decontamination),
    ("packing", packing_stage),
]

#: SQL can express neither the learned stage nor token ids; tests compare with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again; the files go when the driver ends."""
    ensure_importable(spark)
    folder = f"{session_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents").withColumn("text", doc_text())
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
