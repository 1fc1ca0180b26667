"""Metric files: one JSON object per file with a task name and a metrics object."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

PATTERN = "task-*-metrics.json"  # fixed value: file name pattern


def read_metric_files(spark: SparkSession, path: str, pattern: str = PATTERN) -> DataFrame:
    """``(path, task_name, metrics)`` of every readable file below ``path``; others are skipped."""
    texts = spark.read.text(path, wholetext=True, pathGlobFilter=pattern, recursiveFileLookup=True).select(
        F.col("_metadata.file_path").alias("path"), F.try_parse_json("value").alias("v")
    )
    return texts.where(F.schema_of_variant("v").startswith("OBJECT")).select(
        "path",
        F.coalesce(F.try_variant_get("v", "$.task_name", "string"), F.lit("unknown")).alias("task_name"),
        F.coalesce(F.to_json(F.try_variant_get("v", "$.metrics", "variant")), F.lit("{}")).alias("metrics"),
    )
