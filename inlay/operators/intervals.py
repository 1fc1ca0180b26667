"""Closed token intervals: overlap tests, conflicts, digests, comparison.

Frames carry ``lo`` and ``hi`` (both inclusive, bigint).  An occupied set is
disjoint, so only the nearest neighbours in ``lo`` order can meet a probe; one
ordered scan over both sides finds them without pairing rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from inlay.operators.scan import ordered_scan


def neighbours(probes: DataFrame, occupied: DataFrame, id_cols: Sequence[str]) -> DataFrame:
    """Probes with the occupied interval starting at or before ``lo`` and the next one."""
    ids = list(id_cols)
    held = occupied.select("lo", "hi", F.lit(0).alias("_kind"))
    asked = probes.select(*ids, "lo", "hi", F.lit(1).alias("_kind"))
    both = held.unionByName(asked, allowMissingColumns=True)
    taken = F.when(F.col("_kind") == 0, F.struct("lo", "hi"))
    scanned = ordered_scan(
        both, ["lo", "_kind", "hi", *ids], max_before={"_prev": taken}, min_after={"_next": taken}
    )
    return scanned.where("_kind = 1").drop("_kind").select(*ids, "lo", "hi", "_prev", "_next")


def find_overlap(probes: DataFrame, occupied: DataFrame, id_cols: Sequence[str]) -> DataFrame:
    """Each probe with the smallest occupied interval it meets (``o_lo``, ``o_hi``), or nulls."""
    met = F.when(F.col("_prev.hi") >= F.col("lo"), F.col("_prev")).when(
        F.col("_next.lo") <= F.col("hi"), F.col("_next")
    )
    found = neighbours(probes, occupied, id_cols).withColumn("_met", met)
    return found.select(
        *id_cols, "lo", "hi", F.col("_met.lo").alias("o_lo"), F.col("_met.hi").alias("o_hi")
    )


def conflicting(probes: DataFrame, occupied: DataFrame, id_cols: Sequence[str]) -> DataFrame:
    """Probes that meet the occupied set."""
    return find_overlap(probes, occupied, id_cols).where("o_lo is not null").drop("o_lo", "o_hi")


def self_conflicts(batch: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """Rows that meet a row with a smaller ``lo`` (ties by ``order_by``) of the same batch."""
    scanned = ordered_scan(batch, ["lo", *order_by], max_before={"reach": F.col("hi")})
    return scanned.where("reach >= lo")


def digest(intervals: DataFrame) -> DataFrame:
    """One signed 64-bit digest per set, independent of row order and partitioning.

    Every interval is hashed on its own; count, xor and sum of the hashes merge
    in partial aggregates, so no task sees the whole set.
    """
    code = F.conv(F.substring(F.sha2(F.concat_ws(":", "lo", "hi"), 256), 1, 15), 16, 10).cast("bigint")
    merged = intervals.select("lo", "hi").distinct().select(code.alias("_h")).agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.bit_xor("_h"), F.lit(0)).alias("x"),
        F.coalesce(F.sum(F.col("_h").cast("decimal(38,0)")), F.lit(0)).alias("s"),
    )
    text = F.concat_ws(":", "n", "x", "s")
    return merged.select(
        F.col("n").alias("n_intervals"),
        F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, -10).cast("bigint").alias("digest"),
    )


def set_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Intervals held by only one side; empty means the sets are equal."""
    sides = left.select("lo", "hi", F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(
        right.select("lo", "hi", F.lit(0).alias("_l"), F.lit(1).alias("_r"))
    )
    seen = sides.groupBy("lo", "hi").agg(F.max("_l").alias("_l"), F.max("_r").alias("_r"))
    side = F.when(F.col("_l") == 1, F.lit("left")).otherwise(F.lit("right"))
    return seen.where("_l <> _r").select("lo", "hi", side.alias("only_in"))


def listing(intervals: DataFrame) -> DataFrame:
    """All intervals in ascending order with their dense place in the list."""
    return ordered_scan(intervals.select("lo", "hi"), ["lo", "hi"], ordinal="place")
