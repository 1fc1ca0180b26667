"""Exact seeded samples, repetition, and seeded permutations."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from inlay.functions.draws import draw
from inlay.functions.tokens import int_div
from inlay.operators.scan import ordered_scan

TOP_N_LIMIT = 10_000
BUCKET_SHIFT = 44  # 60-bit hashes into 65,536 buckets


def exact_sample(df: DataFrame, id_cols: Sequence[str], k: int, seed: int) -> DataFrame:
    """Exactly ``min(k, rows)`` rows without replacement, chosen by a hash of seed and id.

    Small samples are a distributed top-k.  For large ones a histogram of the
    hashes finds the bucket holding the k-th smallest; rows in lower buckets pass
    a plain filter and only the rows of that one bucket are ordered.
    """
    ids = list(id_cols)
    keyed = df.withColumn("_h", draw(seed, *[F.col(c) for c in ids]))
    if k <= TOP_N_LIMIT:
        return keyed.orderBy("_h", *ids).limit(max(k, 0)).drop("_h")
    bucket = F.shiftright("_h", BUCKET_SHIFT).cast("int")
    counts = keyed.groupBy(bucket.alias("b")).count().orderBy("b").collect()  # at most 65,536 rows
    before = 0
    for row in counts:
        if before + row["count"] >= k:
            break
        before += row["count"]
    else:
        return df
    edge = ordered_scan(keyed.where(bucket == row["b"]), ["_h", *ids], ordinal="_place")
    last = edge.where(F.col("_place") < k - before).drop("_place")
    return keyed.where(bucket < row["b"]).unionByName(last).drop("_h")


def sample_fraction(df: DataFrame, id_cols: Sequence[str], fraction: float, seed: int) -> DataFrame:
    """Exactly ``floor(rows * fraction)`` rows without replacement."""
    if not 0 <= fraction < 1:
        raise ValueError("fraction must be in [0, 1)")
    return exact_sample(df, id_cols, math.floor(df.count() * fraction), seed)


def repeat_rows(df: DataFrame, times: int, copy_col: str = "copy_no") -> DataFrame:
    """Every row ``times`` times, the copies told apart by ``copy_col``."""
    if times < 1:
        raise ValueError("times must be at least 1")
    return df.withColumn(copy_col, F.explode(F.sequence(F.lit(0), F.lit(times - 1))))


def apply_repetitions(df: DataFrame, id_cols: Sequence[str], repetitions: float, seed: int) -> DataFrame:
    """Sample below one, repeat the whole part from one on; adds ``copy_no``."""
    if repetitions < 1:
        return sample_fraction(df, id_cols, repetitions, seed).withColumn("copy_no", F.lit(0))
    return repeat_rows(df, int(repetitions))


def train_order(instances: DataFrame, id_col: str, seed: int, epoch: int, batch: int) -> DataFrame:
    """Seeded permutation of all instances with its batch: ``(seq_idx, instance_id, batch)``."""
    keyed = instances.select(
        F.col(id_col).cast("bigint").alias("instance_id"), draw(seed, epoch, F.col(id_col)).alias("_h")
    )
    ranked = ordered_scan(keyed, ["_h", "instance_id"], ordinal="seq_idx")
    return ranked.select("seq_idx", "instance_id", batch_of(F.col("seq_idx"), batch).alias("batch"))


def batch_of(seq_idx: Column, batch: int) -> Column:
    return int_div(seq_idx, batch)
