"""Many-to-one joins that stay balanced when a few keys hold most rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

ROWS_PER_TASK = 1_000_000


def spread_join(
    facts: DataFrame,
    dims: DataFrame,
    on: Sequence[str],
    spread_by: Sequence[str],
    how: str = "inner",
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Join ``facts`` to ``dims`` (one row per key), salting only the hot keys.

    One aggregate looks for keys with more than ``rows_per_task`` fact rows.  There
    are at most ``rows / rows_per_task`` of them, which bounds the list that comes to
    the driver and is broadcast; without any the join is a plain one.  Hot fact rows
    are spread by a hash of ``spread_by`` (columns that tell the rows of one key
    apart); the matching dimension rows are repeated once per salt.
    """
    keys = list(on)
    rows = F.count(F.lit(1))
    fans = (
        facts.groupBy(*keys)
        .agg(rows.alias("_rows"))
        .where(F.col("_rows") > rows_per_task)
        .select(*keys, F.ceil(F.col("_rows") / F.lit(rows_per_task)).cast("int").alias("_fan"))
    )
    found = fans.collect()
    if not found:
        return facts.join(dims, keys, how)
    hot = F.broadcast(facts.sparkSession.createDataFrame(found, fans.schema))
    fan = F.coalesce("_fan", F.lit(1))
    salted_facts = (
        facts.join(hot, keys, "left")
        .withColumn("_salt", F.pmod(F.xxhash64(*spread_by), fan).cast("int"))
        .drop("_fan")
    )
    salted_dims = (
        dims.join(hot, keys, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), fan - 1)))
        .drop("_fan")
    )
    return salted_facts.join(salted_dims, [*keys, "_salt"], how).drop("_salt")
