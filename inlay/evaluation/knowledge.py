"""Fictional-knowledge probe: is the target likely, present, and close to what was generated?"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from inlay.functions.similarity import contains_ignoring_case, partial_similarity
from inlay.functions.tokens import suffix_sum


def query_text(queries: DataFrame) -> DataFrame:
    return queries.withColumn("query", F.concat("input", F.lit(" "), "target"))


def details(rows: DataFrame, similarity: bool = True) -> DataFrame:
    """Per-query results; ``input_tokens`` is how many leading log-probabilities belong to the input."""
    out = rows.withColumn(
        "probability", F.exp(suffix_sum(F.col("logprobs"), F.col("input_tokens")))
    ).withColumn("hit", contains_ignoring_case(F.col("generation"), F.col("target")))
    if similarity:
        out = out.withColumn("levenshtein", partial_similarity("target", "generation"))
    return out


def summary(rows: DataFrame, similarity: bool = True) -> DataFrame:
    """One row: mean probability, accuracy in percent, mean partial similarity."""
    scored = details(rows, similarity)
    metrics = [
        F.avg("probability").alias("probability"),
        (100.0 * F.avg(F.col("hit").cast("int"))).alias("accuracy"),
    ]
    if similarity:
        metrics.append(F.avg("levenshtein").alias("levenshtein"))
    return scored.agg(*metrics)
