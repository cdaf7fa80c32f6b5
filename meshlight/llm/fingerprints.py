"""Operator 7, document fingerprints: canonical exact digest, in SQL functions only.

A text is made canonical (Unicode NFKC, full case folding, white space folded
to single spaces, trimmed) and hashed by XXH64 four times, each run under a
seed value of its own: 256 bits as 64 hex digits. Null and empty texts are one
text.

Grouping: rows of one digest are one group if their canonical texts are equal
byte by byte. Texts are compared only where a digest occurs more than once:
a table of the leading 20 bits of such digests, at most 2^20 rows by its
making, is broadcast to keep most others from moving, whatever is left meets
on (digest, canonical text), combined map-side, so that a large group of
copies sends one text from each task. Equal digests of unequal texts, should
they occur, are told apart by their texts. What is known of a digest comes
back to its rows on (digest, salt), so a large group is spread over tasks.

The edited texts need each document's successor. Documents follow each other
by doc_id, those without one last; documents that share an id, or lack it, by
a hash of their text and then by the text. The keys alone are sorted; every
``rows``-th one begins a range. Texts are dealt to the ranges, each of which
also gets the first row of the next, so they move once. Beyond ``ranges``
ranges, a bound on the driver's memory, the ranges grow. The last document is
followed by the first. An empty table gives no rows.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, doc_text

ROWS, RANGES, LEADING_BITS, SALTS = 1000, 1 << 17, 20, 64
KEY = "struct<bare:boolean,id:bigint,h:bigint>"


def canonical(text: Column) -> Column:
    """NFKC and full case folding by the ICU library that Spark ships, then white space."""
    nfkc = F.call_function("reflect", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))
    folded = F.call_function("reflect", F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), nfkc, F.lit(True))
    return F.trim(F.regexp_replace(folded, r"(?U)\s+", " "))


def digest(canon: Column) -> Column:
    """64 hex digits of four chained XXH64 runs over the same bytes."""
    runs = [F.xxhash64(*[F.lit(k)] * bool(k), canon) for k in range(4)]
    return F.concat(*(F.lpad(F.lower(F.hex(r)), 16, "0") for r in runs))


def fingerprint(text: Column) -> Column:
    return digest(canonical(text))


def likeness(a: Column, b: Column) -> Column:
    """Exact fingerprints are either the same or not."""
    return F.when(a == b, F.lit(1.0)).otherwise(F.lit(0.0))


def place() -> Column:
    """Where a document stands in the order; the text itself decides what is left."""
    id_ = F.col("doc_id").cast("long")
    return F.struct(id_.isNull().alias("bare"), F.coalesce(id_, F.lit(0)).alias("id"), F.xxhash64(doc_text()).alias("h"))


def range_starts(docs: DataFrame, rows: int = ROWS) -> list[tuple]:
    """The first key of each range, in order; at most RANGES keys and one for each partition of the sort."""
    keys = docs.select(place().alias("key")).select("key.*")
    spread = keys.repartitionByRange("bare", "id", "h").withColumn("part", F.spark_partition_id())
    number = F.row_number().over(Window.partitionBy("part").orderBy("bare", "id", "h"))
    step = max(rows, -(-docs.count() // RANGES))
    return sorted(set(map(tuple, spread.withColumn("at", number).filter((F.col("at") - 1) % step == 0).select("bare", "id", "h").collect())))


def constant(value: list, kind: str) -> Column:
    """A list as one literal, which the optimizer folds."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def range_of(key: Column, starts: list[tuple]) -> Column:
    """The number of the range a key is in: two short scans, over the starts of blocks and over one block."""
    size = max(1, round(len(starts) ** 0.5))
    shown = [{"bare": b, "id": i, "h": h} for b, i, h in starts]
    blocks = [shown[k : k + size] for k in range(0, len(shown), size)]
    upto = lambda known: F.size(F.filter(known, lambda start: start <= key)) - 1
    block = upto(constant([own[0] for own in blocks], f"array<{KEY}>"))
    return block * size + upto(F.get(constant(blocks, f"array<array<{KEY}>>"), block))


def with_successor(docs: DataFrame, rows: int = ROWS) -> DataFrame:
    """doc_id, text, fingerprint, and following, next_fingerprint of the next row; after the last, of the first."""
    starts = range_starts(docs, rows) or [(False, 0, 0)]
    n = len(starts)
    dealt = docs.select("doc_id", doc_text().alias("text"), place().alias("key")).withColumn("r", range_of(F.col("key"), starts))
    first = F.get(constant([{"bare": b, "id": i, "h": h} for b, i, h in starts], f"array<{KEY}>"), F.col("r"))
    own = F.struct("r", F.lit(0).alias("copy"))
    lent = F.struct(F.pmod(F.col("r") - 1, F.lit(n)).alias("r"), F.lit(1).alias("copy"))
    copies = F.when(F.col("key") == first, F.array(own, lent)).otherwise(F.array(own))
    spread = dealt.withColumn("fingerprint", fingerprint(F.col("text"))).select("doc_id", "text", "fingerprint", "key", F.inline(copies))
    order = Window.partitionBy("r").orderBy("copy", "key", "text")
    after = spread.withColumn("following", F.lead("text").over(order)).withColumn("next_fingerprint", F.lead("fingerprint").over(order))
    return after.filter("copy = 0").drop("r", "copy", "key")


def fingerprint_edits(docs: DataFrame, rows: int = ROWS) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, digest (XXH64 of the text).

    Edited: the last floor(n_chars / 4) code points replaced by the first as many of the following text.
    """
    d = with_successor(docs, rows)
    n, k = F.length("text"), F.floor(F.length("text") / 4).cast("int")
    d = d.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - k), F.substring("following", F.lit(1), k)))
    d = d.withColumn("edited_fingerprint", fingerprint(F.col("edited")))
    near = {"near_edited": "edited_fingerprint", "near_next": "next_fingerprint"}
    return d.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        *(likeness(F.col("fingerprint"), F.col(other)).alias(name) for name, other in near.items()),
        F.xxhash64("text").alias("digest"),
    )


def leading(print_: Column, bits: int = LEADING_BITS) -> Column:
    return F.shiftright(F.conv(F.substring(print_, 1, 8), 16, 10).cast("long"), 32 - bits)


def _moved(docs: DataFrame, prints: DataFrame) -> DataFrame:
    """(doc_id, digest, fingerprint, canon) of rows with one of these fingerprints and of few others."""
    canon = docs.select("doc_id", F.xxhash64(doc_text()).alias("digest"), canonical(doc_text()).alias("canon")).withColumn("fingerprint", digest(F.col("canon")))
    few = prints.select(leading(F.col("fingerprint")).alias("lead")).distinct()
    return canon.withColumn("lead", leading(F.col("fingerprint"))).join(F.broadcast(few), "lead", "left_semi").drop("lead")


def salt() -> Column:
    return F.pmod(F.xxhash64("doc_id", "digest"), F.lit(SALTS)).cast("int")


def exact_groups(docs: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Adds group_id (least doc_id with the same canonical text) and copies to ``rows``.

    ``rows`` holds doc_id, digest (XXH64 of the text) and fingerprint for each
    row of ``docs``, and is worked out if not given.
    """
    if rows is None:
        rows = docs.select("doc_id", F.xxhash64(doc_text()).alias("digest"), fingerprint(doc_text()).alias("fingerprint"))
    dealt = rows.withColumn("salt", salt())
    part = dealt.groupBy("fingerprint", "salt").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("least"))
    whole = cut(part.groupBy("fingerprint").agg(F.sum("copies").alias("copies"), F.min("least").alias("group_id"), F.collect_list("salt").alias("salts")).filter("copies > 1"))
    texts = _moved(docs, whole).groupBy("fingerprint", "canon").agg(F.count(F.lit(1)).alias("n"))
    mixed = cut(texts.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("texts")).join(whole.select("fingerprint"), "fingerprint", "left_semi").filter("texts > 1"))
    pure = whole.join(mixed, "fingerprint", "left_anti").select("fingerprint", F.explode("salts").alias("salt"), "group_id", "copies")
    named = lambda group, copies: (F.coalesce(group, F.col("doc_id")).alias("group_id"), F.coalesce(copies, F.lit(1).cast("long")).alias("copies"))
    kept = [F.col(c) for c in rows.columns]
    found = dealt.join(pure, ["fingerprint", "salt"], "left").select(*kept, *named(F.col("group_id"), F.col("copies")))
    if mixed.isEmpty():
        return found
    apart = _moved(docs, mixed).join(mixed, "fingerprint", "left_semi")
    own = apart.groupBy("fingerprint", "canon").agg(F.min("doc_id").alias("group_id"), F.count(F.lit(1)).alias("copies"))
    judged = apart.join(own, ["fingerprint", "canon"]).select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), F.col("group_id").alias("_group"), F.col("copies").alias("_copies")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest"))
    return found.join(judged, same, "left").select(*kept, F.coalesce("_group", "group_id").alias("group_id"), F.coalesce("_copies", "copies").alias("copies"))


def fingerprint_documents(docs: DataFrame, rows: int = ROWS) -> DataFrame:
    """fingerprint_edits() and each row's exact group: group_id (null if no copy has an id), copies."""
    return exact_groups(docs, cut(fingerprint_edits(docs, rows))).drop("digest")
