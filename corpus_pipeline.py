"""The corpus pipeline: rules, repeated lines, near copies, benchmark leaks, packing.

Every stage works on what the one before kept and returns the columns of ``documents``;
the last one returns the packed pieces.  ``run`` stores each stage as Parquet and reads it
again, so a lost executor costs no earlier stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inlay.llm import op1_near_dedup, op2_packing, op4_line_dedup, op5_decontamination, op10_quality, queries
from inlay.llm.common import materialize, release, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op10_quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op4_line_dedup.drop_repeats(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op1_near_dedup.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op5_decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op2_packing.packed(docs, op2_packing.tokenizer_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

# Neither the set-similarity join, the components nor the tokenizer can be put into SQL;
# tests/llm/test_pipeline.py compares every stage with brute force.
ORACLE_SQL = None


@queries.query("pipeline")
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        release(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
