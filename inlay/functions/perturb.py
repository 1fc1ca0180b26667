"""Gaussian noise on the vectors of chosen batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from inlay.functions.draws import gaussian

NOISE_STD = 0.075  # fixed value: default standard deviation


def perturb(vectors: DataFrame, batches: DataFrame, seed: int, std: float = NOISE_STD) -> DataFrame:
    """``vectors(vec_id, batch, embedding)`` with noise on the batches listed in ``batches(batch)``.

    The noise depends on seed, vector and dimension only.
    """
    chosen = batches.select("batch").distinct().withColumn("_hit", F.lit(True))
    noisy = F.transform(
        "embedding", lambda x, i: x.cast("double") + F.lit(std) * gaussian(seed, F.col("vec_id"), i)
    )
    plain = F.transform("embedding", lambda x: x.cast("double"))
    marked = vectors.join(chosen, "batch", "left")
    return marked.withColumn("embedding", F.when(F.col("_hit"), noisy).otherwise(plain)).drop("_hit")
