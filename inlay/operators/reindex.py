"""From global positions to chunk indices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from inlay.functions.tokens import int_div

PAGE = 1024  # insertions per nested row, so that no row grows with the data


def reindex(plan: DataFrame, chunk: int, split: bool = True) -> DataFrame:
    """Plan rows as ``(index, ordinal, pos, tokens)``; pieces that cross a chunk end are cut.

    ``plan`` holds ``position`` and ``tokens`` and is disjoint, so one index has at
    most ``chunk`` rows.  Ordinals follow the position.  With ``split=False`` a
    crossing row fails the job when the result is read.
    """
    if chunk <= 0:
        raise ValueError(f"chunk must be positive, got {chunk}")
    size = F.lit(chunk).cast("bigint")
    rows = plan.where(F.size("tokens") > 0).select(F.col("position").cast("bigint").alias("position"), "tokens")
    end = F.col("position") + F.size("tokens")
    if not split:
        crosses = F.col("position") % size + F.size("tokens") > size
        message = F.concat(
            F.lit("insertion at position "), F.col("position"), F.lit(f" crosses a boundary of {chunk} tokens")
        )
        rows = rows.withColumn(
            "position", F.when(crosses, F.raise_error(message).cast("bigint")).otherwise(F.col("position"))
        )
    cut = rows.withColumn("index", F.explode(F.sequence(int_div(F.col("position"), size), int_div(end - 1, size))))
    first = F.greatest(F.col("index") * size, F.col("position"))
    last = F.least((F.col("index") + 1) * size, end)
    pieces = cut.select(
        "index",
        (first - F.col("index") * size).cast("int").alias("pos"),
        F.slice("tokens", (first - F.col("position") + 1).cast("int"), (last - first).cast("int")).alias("tokens"),
    )
    in_index = Window.partitionBy("index").orderBy("pos", "tokens")
    return pieces.withColumn("ordinal", (F.row_number().over(in_index) - 1).cast("bigint")).select(
        "index", "ordinal", "pos", "tokens"
    )


def crossings(plan: DataFrame, chunk: int) -> DataFrame:
    """Plan rows that a no-split re-index would refuse, with the chunk they start in."""
    size = F.lit(chunk).cast("bigint")
    local = F.col("position") % size
    return plan.where((F.size("tokens") > 0) & (local + F.size("tokens") > size)).select(
        "position",
        int_div(F.col("position"), size).alias("index"),
        local.cast("int").alias("pos"),
        F.size("tokens").alias("n_tokens"),
    )


def nest(index_map: DataFrame, page: int = PAGE) -> DataFrame:
    """Flat map rows as ordered lists: ``(index, page, insertions)``, all rows kept.

    An index with up to ``page`` insertions has the single page 0; a longer list
    goes on in further rows.
    """
    item = F.struct("ordinal", "pos", "tokens")
    paged = index_map.withColumn("page", int_div(F.col("ordinal"), page))
    return paged.groupBy("index", "page").agg(F.array_sort(F.collect_list(item)).alias("insertions"))


def flatten(nested: DataFrame) -> DataFrame:
    """Inverse of :func:`nest`."""
    return nested.select("index", F.inline("insertions"))
