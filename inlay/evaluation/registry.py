"""Named evaluations over query and response frames."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from inlay.evaluation import arithmetic, choices, extraction, knowledge, memorization, metrics, perplexity

Evaluation = Callable[..., DataFrame]

EVALUATIONS: dict[str, Evaluation] = {
    "ranked_choice": lambda rows, norm="none": choices.accuracy(rows, norm),
    "perplexity": lambda rows: perplexity.perplexity(perplexity.scoring_input(rows)),
    "knowledge": knowledge.summary,
    "arithmetic": lambda rows, ops=1: arithmetic.accuracy(arithmetic.questions(rows, ops)),
    "extraction": lambda rows, num_generations=1: extraction.leakage_at_k(
        extraction.scores(rows), num_generations
    ).select(F.map_from_arrays(
        F.array(F.concat(F.lit("leakage_at_"), "k")), F.array("leakage")).alias("m")),
    "memorization": memorization.summary,
}


@dataclass
class Request:
    """One evaluation to run: its name in the results, which program, on which rows."""

    name: str
    program: str
    rows: DataFrame
    args: Mapping = field(default_factory=dict)


@dataclass
class Report:
    """Long metric rows of the evaluations that succeeded, and why the others failed."""

    metrics: DataFrame
    failures: dict[str, str]
    requested: int

    @property
    def succeeded(self) -> int:
        return self.requested - len(self.failures)


def long_metrics(result: DataFrame, name: str, step: int) -> DataFrame:
    """Result columns (or one map column) as ``(step, evaluation, metric, value)`` rows."""
    if result.columns == ["m"]:
        pairs = result.select(F.explode("m").alias("metric", "value"))
    else:
        entries = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in result.columns]
        pairs = result.select(F.inline(F.array(*entries)))
    return pairs.select(
        F.lit(step).cast("bigint").alias("step"), F.lit(name).alias("evaluation"), "metric", "value"
    )


def run_all(
    spark: SparkSession,
    requests: Sequence[Request],
    step: int,
    programs: Mapping[str, Evaluation] = EVALUATIONS,
) -> Report:
    """Run every request; a failing one is recorded and does not stop the rest."""
    names = [r.name for r in requests]
    if len(set(names)) != len(names):
        raise ValueError("evaluation names must be unique")
    out = spark.createDataFrame([], metrics.METRIC_SCHEMA)
    failures: dict[str, str] = {}
    for request in requests:
        try:
            result = programs[request.program](request.rows, **request.args)
            rows = long_metrics(result, request.name, step).collect()  # a handful of metric values
            out = out.unionByName(spark.createDataFrame(rows, metrics.METRIC_SCHEMA))
        except Exception as error:
            failures[request.name] = f"{type(error).__name__}: {error}"
    return Report(out, failures, len(requests))
