"""Joins that a hot key does not gather in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 64


def spread_join(rows: DataFrame, table: DataFrame, keys: list[str], by: Column, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """``rows`` joined with ``table``, which has one row for each key.

    A salt from a hash of ``by`` deals the rows of one key to up to ``salts``
    tasks; a row of the table is repeated for the salts that its key has, which
    are combined map-side. Null keys match nothing.
    """
    dealt = rows.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    present = dealt.select(*keys, "__salt").distinct()
    return dealt.join(table.join(present, keys), [*keys, "__salt"], how).drop("__salt")
