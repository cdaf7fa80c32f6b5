"""What __spark_entry__ registers of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import license_scan, line_dedup, queries as q


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [q.op1_token_counts, q.op2_line_dedup, q.op3_html_extraction, q.op4_simhash, q.op5_toxicity, q.op6_license_scan, q.op7_fingerprints, q.op8_language_id, q.op9_decontamination, q.op10_packing]
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    """SQL where it can express an operator; the others are tested against brute force."""
    return {"op2_line_dedup": line_dedup.ORACLE, "op6_license_scan": license_scan.oracle()}
