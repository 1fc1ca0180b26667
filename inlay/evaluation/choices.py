"""Ranked-choice questions: score every choice, pick the best, compare with the label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from inlay.functions.tokens import common_prefix_length, suffix_sum
from inlay.operators.skew import spread_join

ACCURACY_NAMES = {"none": "acc", "char": "acc_char", "mixed": "acc_mixed"}


def common_prefix(choices: DataFrame) -> DataFrame:
    """Length of the token prefix shared by all choices of a question.

    The shared prefix of a set of arrays is the one shared by its smallest and
    largest member, and both are plain aggregates.
    """
    ends = choices.groupBy("doc_id").agg(F.min("token_ids").alias("_lo"), F.max("token_ids").alias("_hi"))
    return ends.select("doc_id", common_prefix_length(F.col("_lo"), F.col("_hi")).alias("lcp"))


def normalised(score: Column, norm: Column, continuation: Column) -> Column:
    """Score per continuation character where ``norm`` is ``char``; null for an unknown norm.

    An empty continuation divides by zero as in floating point: NaN for a zero
    score, minus infinity otherwise.
    """
    chars = F.length(continuation)
    by_zero = F.when(score == 0, F.lit(float("nan"))).otherwise(F.lit(float("-inf")))
    per_char = F.when(score.isNull(), None).when(chars == 0, by_zero).otherwise(score / F.nullif(chars, F.lit(0)))
    return F.when(norm == "char", per_char).when(norm == "none", score)


def choice_scores(choices: DataFrame, norm: str = "none") -> DataFrame:
    """Choices with ``lcp`` and ``score``.

    ``choices`` holds ``doc_id, idx, label, token_ids, logprobs`` and, for ``char``
    and ``mixed``, ``continuation``; ``mixed`` takes ``norm`` from each row.
    """
    if norm not in ACCURACY_NAMES:
        raise ValueError(f"unknown norm: {norm!r}")
    scored = spread_join(choices, common_prefix(choices), ["doc_id"], ["idx"])
    raw = suffix_sum(F.col("logprobs"), F.col("lcp"))
    if norm == "none":
        return scored.withColumn("score", raw)
    kind = F.col("norm") if norm == "mixed" else F.lit(norm)
    return scored.withColumn("score", normalised(raw, kind, F.col("continuation")))


def predictions(scored: DataFrame, order_col: str = "idx") -> DataFrame:
    """Picked and labelled choice per question; first row wins ties, the first choice
    stands in for a missing label, and a question with a null score has failed."""
    place = F.col(order_col)
    return (
        scored.groupBy("doc_id")
        .agg(
            F.max_by(place, F.struct("score", -place)).alias("picked"),
            F.coalesce(F.min(F.when(F.col("label") == F.col("idx"), place)), F.min(place)).alias("labelled"),
            F.coalesce(F.bool_or(F.col("score").isNull()), F.lit(False)).alias("failed"),
        )
        .withColumn("correct", ~F.col("failed") & (F.col("picked") == F.col("labelled")))
    )


def accuracy(choices: DataFrame, norm: str = "none") -> DataFrame:
    """One row: share of right questions among ``max(doc_id) + 1`` (gaps count as wrong)."""
    picks = predictions(choice_scores(choices, norm))
    right = F.count_if("correct")
    return picks.agg(
        (right / (F.max("doc_id") + 1)).alias(ACCURACY_NAMES[norm]),
        F.count(F.lit(1)).alias("n_present"),
        F.count_if("failed").alias("n_failed"),
    )
