"""Metric rows: reading metric objects, filtering, naming, storing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

PRIMARY = "primary_score"  # fixed value: the metric reported under the bare task name
DEFAULT_PATTERN = "^primary_score$"
METRIC_SCHEMA = "step bigint, evaluation string, metric string, value double"


def flatten_metrics(files: DataFrame) -> DataFrame:
    """``files(task_name, metrics)`` with ``metrics`` a JSON object, one row per entry.

    ``value`` is set for JSON numbers and booleans (1 or 0) only.
    """
    parsed = F.from_json("metrics", "map<string,variant>")
    others = [c for c in files.columns if c != "metrics"]
    items = files.select(*others, F.explode(parsed).alias("metric", "_v"))
    kind = F.schema_of_variant("_v")
    number = F.when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get("_v", "$", "double"))
    truth = F.when(kind == "BOOLEAN", F.try_variant_get("_v", "$", "boolean").cast("int").cast("double"))
    return items.withColumn("value", F.coalesce(number, truth)).drop("_v")


def keep_metrics(rows: DataFrame, pattern: str = DEFAULT_PATTERN) -> DataFrame:
    """Numeric metrics whose name holds a match of ``pattern``."""
    return rows.where(F.col("value").isNotNull() & F.col("metric").rlike(pattern))


def task_key(task: Column, metric: Column) -> Column:
    """Name of a benchmark-suite metric."""
    return F.when(metric == PRIMARY, F.concat(F.lit("olmes/"), task)).otherwise(
        F.concat(F.lit("olmes/"), task, F.lit("/"), metric)
    )


def logged_key(evaluation: Column, metric: Column) -> Column:
    """Name under which an evaluation metric is logged; names with a slash are already complete."""
    named = F.concat(F.lit("evaluation/"), evaluation, F.lit("/"), metric)
    return F.when(F.contains(metric, F.lit("/")), metric).otherwise(named)


def control_key(experiment: Column, key: Column) -> Column:
    return F.concat(F.lit("control/"), experiment, F.lit("_"), key)


def store_metrics(rows: DataFrame, path: str, write_id: str) -> None:
    """Append metric rows; the same ``write_id`` replaces its own earlier rows."""
    out = rows.select("step", "evaluation", "metric", "value").withColumn("write_id", F.lit(write_id))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("write_id").parquet(path)
