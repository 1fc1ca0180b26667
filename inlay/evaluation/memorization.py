"""Verbatim memorisation: 25 tokens in, are the next 25 reproduced?"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

PREFIX = 25  # fixed values: prefix length and checked length
CHECKED = 25


def candidates(sequences: DataFrame) -> DataFrame:
    """Sequences long enough to check, as prefix and target."""
    return sequences.where(F.size("token_ids") >= PREFIX + CHECKED).withColumns(
        {"prefix": F.slice("token_ids", 1, PREFIX), "target": F.slice("token_ids", PREFIX + 1, CHECKED)}
    )


def verdicts(rows: DataFrame) -> DataFrame:
    """``token_ids`` and ``generated`` with a verdict; only the first 25 generated tokens count."""
    target = F.slice("token_ids", PREFIX + 1, CHECKED)
    seen = F.slice("generated", 1, CHECKED)
    verdict = (
        F.when(F.size("token_ids") < PREFIX + CHECKED, "too_short")
        .when(F.size(seen) != F.size(target), "generation_length_mismatch")
        .when(seen == target, "memorized")
        .otherwise("tokens_mismatch")
    )
    return rows.withColumn("verdict", verdict)


def summary(rows: DataFrame) -> DataFrame:
    """One row of counts; the same columns whether or not a candidate exists."""

    def count(*names: str):
        return F.count_if(F.col("verdict").isin(*names))

    mismatched = ("generation_length_mismatch", "tokens_mismatch")
    return verdicts(rows).agg(
        count("memorized").alias("num_memorized_sequences"),
        count(*mismatched).alias("num_non_memorized"),
        count("generation_length_mismatch").alias("num_length_mismatch"),
        count("tokens_mismatch").alias("num_tokens_mismatch"),
        count("too_short").alias("num_too_short"),
        F.count(F.lit(1)).alias("num_total"),
    )
