"""Ordered scans without a single-task window.

A running total over a whole table normally ends in one task.  Here the rows are
range-partitioned by the full sort key and staged, so each part holds a
contiguous, sorted run of similar size (one hot key is cut over many parts).
Windows run inside blocks of a part, which have a fixed number of rows at most; one
summary row per block carries totals across them.  So the memory of a task does not grow
with the table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from inlay.functions.tokens import int_div
from inlay.staging import materialize

PART = "_part"
POS = "_pos"
BLOCK = "_block"
BLOCK_ROWS = 100_000  # rows a window of an ordered scan sees at most
LOCAL_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits


def range_stage(df: DataFrame, order_by: Sequence[str], label: str = "range") -> DataFrame:
    """Stage ``df`` in global ``order_by`` order with its part and its place in the part.

    There are at most ``spark.sql.shuffle.partitions`` parts; adaptive execution joins
    small neighbours, which keeps parts contiguous and numbered in order.
    """
    ranged = (
        df.repartitionByRange(*order_by)
        .sortWithinPartitions(*order_by)
        .withColumn(PART, F.spark_partition_id())
        .withColumn(POS, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << LOCAL_BITS) - 1)))
    )
    return materialize(ranged, label)


def ordered_scan(
    df: DataFrame,
    order_by: Sequence[str],
    *,
    ordinal: str | None = None,
    sum_before: Mapping[str, Column] | None = None,
    max_before: Mapping[str, Column] | None = None,
    min_after: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add exclusive running values over the global order.

    ``ordinal`` names a dense 0-based rank; ``sum_before`` and ``max_before`` look
    at the rows before each row, ``min_after`` at the rows behind it.
    ``order_by`` must identify rows uniquely for the result to be repeatable.
    """
    kinds = {
        "sum": (dict(sum_before or {}), F.sum),
        "max": (dict(max_before or {}), F.max),
        "min": (dict(min_after or {}), F.min),
    }
    inputs = {f"_in_{out}": expr for exprs, _ in kinds.values() for out, expr in exprs.items()}
    staged = range_stage(df.withColumns(inputs) if inputs else df, order_by, "scan")
    staged = staged.withColumn(BLOCK, int_div(F.col(POS), BLOCK_ROWS))
    block = [PART, BLOCK]

    totals = [F.count(F.lit(1)).alias("_t_rows")]
    for exprs, fn in kinds.values():
        totals += [fn(f"_in_{out}").alias(f"_t_{out}") for out in exprs]
    per_block = materialize(staged.groupBy(*block).agg(*totals), "blocks")

    ahead = Window.orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.orderBy(*[F.desc(c) for c in block]).rowsBetween(Window.unboundedPreceding, -1)
    carries = [F.coalesce(F.sum("_t_rows").over(ahead), F.lit(0)).alias("_c_rows")]
    for kind, (exprs, fn) in kinds.items():
        frame = behind if kind == "min" else ahead
        carries += [fn(f"_t_{out}").over(frame).alias(f"_c_{out}") for out in exprs]
    carry = F.broadcast(per_block.select(*block, *carries))  # one row per block

    before = Window.partitionBy(*block).orderBy(POS).rowsBetween(Window.unboundedPreceding, -1)
    # rows behind = rows before in descending order; frames open at the far end are quadratic
    after = Window.partitionBy(*block).orderBy(F.desc(POS)).rowsBetween(Window.unboundedPreceding, -1)
    if inputs:
        staged = staged.repartition(max(1, per_block.count()), *block)  # as many tasks as blocks, whatever the settings
    joined = staged.join(carry, block)
    columns: dict[str, Column] = {}
    if ordinal:
        columns[ordinal] = F.col("_c_rows") + F.col(POS) % BLOCK_ROWS
    for out in kinds["sum"][0]:
        zero = F.lit(0).cast(staged.schema[f"_in_{out}"].dataType)
        columns[out] = F.coalesce(F.sum(f"_in_{out}").over(before), zero) + F.coalesce(f"_c_{out}", zero)
    for out in kinds["max"][0]:
        columns[out] = _pick(F.greatest, F.max(f"_in_{out}").over(before), F.col(f"_c_{out}"), staged, out)
    for out in kinds["min"][0]:
        columns[out] = _pick(F.least, F.min(f"_in_{out}").over(after), F.col(f"_c_{out}"), staged, out)
    return joined.withColumns(columns).select(*df.columns, *columns)


def _pick(fn, local: Column, carried: Column, staged: DataFrame, out: str) -> Column:
    """Null-skipping greatest/least; structs go through a two-element array."""
    if staged.schema[f"_in_{out}"].dataType.typeName() == "struct":
        pair = F.array_compact(F.array(local, carried))
        return F.array_max(pair) if fn is F.greatest else F.array_min(pair)
    return fn(local, carried)


def grouped_ordinal(df: DataFrame, group: Sequence[str], order_by: Sequence[str], out: str) -> DataFrame:
    """0-based row number inside each group, also when one group is larger than a task should hold.

    Groups of up to ``BLOCK_ROWS`` rows are numbered by a plain window.  One aggregate looks for larger
    ones, of which there are at most ``rows / BLOCK_ROWS``; only their rows are put in global order.
    """
    rows = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > BLOCK_ROWS)
    large = rows.select(*[F.col(g).alias(f"_g_{g}") for g in group])
    found = large.collect()
    number = (F.row_number().over(Window.partitionBy(*group).orderBy(*order_by)) - 1).cast("bigint")
    if not found:
        return df.withColumn(out, number)
    hot = F.broadcast(df.sparkSession.createDataFrame(found, large.schema))
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in group])
    spread = _spread_ordinal(df.join(hot, same, "left_semi"), group, order_by, out)
    return df.join(hot, same, "left_anti").withColumn(out, number).unionByName(spread)


def _spread_ordinal(df: DataFrame, group: Sequence[str], order_by: Sequence[str], out: str) -> DataFrame:
    """0-based row number inside each group; a group may span many parts.

    Parts are contiguous, so only the first group of a part can have rows before it.
    """
    staged = range_stage(df, [*group, *order_by], "grouped")
    key = F.struct(*group)
    sizes = staged.groupBy(PART, *group).agg(F.count(F.lit(1)).alias("_n"))
    edges = sizes.groupBy(PART).agg(
        F.min(key).alias("_first"), F.max(key).alias("_last"), F.max_by("_n", key).alias("_n_last")
    )
    # a group that goes on over several parts is the last one of each but the last of them
    so_far = Window.partitionBy("_last").orderBy(PART).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    in_order = Window.orderBy(PART)
    carried = edges.withColumn("_sum", F.sum("_n_last").over(so_far)).select(
        PART, "_first", F.lag("_last").over(in_order).alias("_before"), F.lag("_sum").over(in_order).alias("_carry")
    )
    carry = carried.where(F.col("_first") == F.col("_before"))  # at most one row per part
    carry = carry.select(PART, *[F.col("_first")[g].alias(g) for g in group], "_carry")
    local = F.row_number().over(Window.partitionBy(PART, *group).orderBy(POS)) - 1
    return (
        staged.withColumn("_local", local)
        .join(F.broadcast(carry), [PART, *group], "left")
        .withColumn(out, F.col("_local").cast("bigint") + F.coalesce("_carry", F.lit(0)))
        .select(*df.columns, out)
    )
