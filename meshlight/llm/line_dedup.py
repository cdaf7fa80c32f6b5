"""Operator 2, line dedup: repeated windows of three consecutive lines.

Lines are what stands between line feeds. Each three consecutive lines form a
window, known by two 64-bit hashes. Of a window that occurs more than once
anywhere, the first occurrence (lowest doc_id, then position) stays and the
lines of all later ones go; overlapping windows are merged by position, so a
long repeated passage goes as a whole. Windows of blank lines only don't
count, so null (treated as empty) and empty texts stay as they are. A document
of fewer than three lines is one window as a whole: it matches only documents
equal to it, of which later ones lose all their lines. A place is a doc_id and a
text (by its 64-bit hash): rows that repeat both keep or lose the same lines,
other texts of the same id are texts of their own, and rows without an id come
after those with one.

Windows are counted with a map-side partial aggregation on (window, salt) and
then by window; what marks a later occurrence comes back on (window, salt),
so a window that a third of all documents share is spread over the salts.
Texts are not shuffled before the positions to remove are known; they meet
their documents in one left join on doc_id and the hash of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts_of, unused

SALTS, SPAN = 64, 3
DIGEST = "__dedup_digest"


def line_windows(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """(doc_id, digest of the text, pos, h1, h2) for each window of lines, one at least; pos counts lines from 0."""
    some = docs.select("doc_id", F.xxhash64("text").alias(DIGEST), F.split(F.col("text"), "\n", -1).alias("lines"))
    hashed = some.select(
        "doc_id",
        DIGEST,
        F.transform("lines", lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(7), x).alias("b"), (F.length(F.trim(x)) == 0).alias("blank"))).alias("h"),
    )
    windows = F.transform(F.sequence(F.lit(0), F.greatest(F.size("h") - span, F.lit(0))), lambda i: _window(i, span))
    return hashed.select("doc_id", DIGEST, F.inline(F.filter(windows, lambda w: ~w["blank"]))).drop("blank")


def _window(i: Column, span: int) -> Column:
    own = [F.get("h", i + k) for k in range(span)]  # null beyond the end, which the hashes skip
    blank = own[0]["blank"]
    for x in own[1:]:
        blank = blank & F.coalesce(x["blank"], F.lit(True))
    return F.struct(i.alias("pos"), F.xxhash64(*(x["a"] for x in own)).alias("h1"), F.xxhash64(*(x["b"] for x in own)).alias("h2"), blank.alias("blank"))


def later_windows(windows: DataFrame, salts: int = SALTS) -> DataFrame:
    """(doc_id, digest, starts) of the windows that occurred before, in one row for each place."""
    dealt = windows.withColumn("salt", F.pmod(F.xxhash64("doc_id", DIGEST), F.lit(salts)).cast("int"))
    place = F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", DIGEST, "pos")
    part = dealt.groupBy("h1", "h2", "salt").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    whole = part.groupBy("h1", "h2").agg(F.min("first").alias("first"), F.sum("n").alias("n"), F.collect_list("salt").alias("own")).filter("n > 1")
    marks = whole.select("h1", "h2", "first", F.explode("own").alias("salt"))
    later = dealt.join(marks, ["h1", "h2", "salt"]).filter(place > F.col("first"))
    return later.groupBy("doc_id", DIGEST).agg(F.collect_set("pos").alias("starts"))


def dedup_lines(docs: DataFrame, span: int = SPAN, salts: int = SALTS, counts: tuple[str, str] = ("n_lines", "lines_removed")) -> DataFrame:
    """Per row: all columns of ``docs``, its text without later repeats, and the two counts.

    The counts replace columns of their names; all other columns pass through.
    """
    docs = docs.drop(*counts).withColumn("text", F.coalesce("text", F.lit("")))
    id_, digest, at, n, dropped = (unused(docs, "__dedup") + c for c in ("_id", "_digest", "_starts", "_n", "_gone"))
    starts = later_windows(line_windows(docs.select("doc_id", "text"), span), salts).select(F.col("doc_id").alias(id_), F.col(DIGEST).alias(digest), F.col("starts").alias(at))
    joined = docs.join(starts.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(digest)), "left")
    lines = F.split(F.col("text"), "\n", -1)
    last = F.col(n) - 1
    gone = F.array_distinct(F.flatten(F.transform(at, lambda s: F.sequence(s, F.least(s + span - 1, last)))))
    # a lambda over an array of one holds the lines, so that they are split once and fetched by position
    kept = F.transform(F.array(lines), lambda own: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(own) - 1), F.col(dropped)), lambda i: F.get(own, i)), "\n"))[0]
    shown = joined.withColumn(n, F.size(lines)).withColumn(dropped, gone)
    text = F.when(F.col(at).isNull(), F.col("text")).otherwise(kept)
    more = (F.col(n).cast("long"), F.coalesce(F.size(dropped).cast("long"), F.lit(0).cast("long")))
    return shown.select(*(text.alias("text") if c == "text" else F.col(c) for c in docs.columns), *(v.alias(k) for k, v in zip(counts, more)))


def op2(docs: DataFrame) -> DataFrame:
    return dedup_lines(texts_of(docs))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS l FROM documents
), w AS (
  SELECT doc_id, unnest(range(0, greatest(len(l) - 2, 1))) AS pos, l FROM lines
), s AS (
  SELECT doc_id, pos, len(l) AS n, l[pos + 1 : pos + 3] AS win FROM w
), r AS (
  SELECT doc_id, pos, n, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS rn
  FROM s WHERE len(list_filter(win, lambda x: trim(x, ' ') <> '')) > 0
), g AS (
  SELECT doc_id, list(DISTINCT pos + k) AS gone FROM r, range(0, 3) AS t(k) WHERE rn > 1 AND pos + k < n GROUP BY doc_id
)
SELECT lines.doc_id,
       array_to_string(list_transform(list_filter(range(0, len(l)), lambda i: NOT coalesce(list_contains(gone, i), false)), lambda i: l[i + 1]), chr(10)) AS text,
       CAST(len(l) AS BIGINT) AS n_lines,
       CAST(coalesce(len(gone), 0) AS BIGINT) AS lines_removed
FROM lines LEFT JOIN g USING (doc_id)
"""
