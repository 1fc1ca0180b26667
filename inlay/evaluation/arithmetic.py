"""Arithmetic questions answered in text."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from inlay.functions.answers import cut_after_answer, parse_answer


def questions(table: DataFrame, ops: int) -> DataFrame:
    """Questions with ``ops`` operations, their answer as an integer."""
    return table.where(F.col("ops") == ops).withColumn("answer", F.col("answer").cast("bigint"))


def details(rows: DataFrame) -> DataFrame:
    """Cut response, parsed answer and verdict for every ``response`` with its ``answer``."""
    cut = rows.withColumn("response", cut_after_answer(F.col("response")))
    parsed = cut.withColumn("parsed", parse_answer(F.col("response")))
    return parsed.withColumn("correct", F.coalesce(F.col("parsed") == F.col("answer"), F.lit(False)))


def accuracy(rows: DataFrame, by: str | None = None) -> DataFrame:
    verdicts = details(rows)
    grouped = verdicts.groupBy(by) if by else verdicts.groupBy()
    return grouped.agg(F.avg(F.col("correct").cast("int")).alias("acc"))
