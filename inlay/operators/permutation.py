"""A training order that is computed, not stored: a keyed permutation that can be inverted.

The numbers below ``n`` are laid out in ``rows`` x ``columns`` cells, the smallest near-square that
holds them, and go through a Feistel network over the two coordinates.  The few cells
from ``n`` on (fewer than ``rows``) are walked through: a number that lands there is turned again.
How often that can happen is found out beforehand from those cells alone.

Instance of a sequence and sequence of an instance are column expressions, so an order over any
number of instances needs no sort, no table and no scan of the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from inlay.functions.draws import draw
from inlay.functions.tokens import int_div

TURNS = 4
FIRST_WALKS = 4


@dataclass(frozen=True)
class Permutation:
    """Of the numbers below ``n``; ``walks`` is the bound found by :func:`permutation`."""

    n: int
    seed: int
    walks: int = FIRST_WALKS

    @property
    def rows(self) -> int:
        return isqrt(self.n - 1) + 1

    @property
    def columns(self) -> int:
        return -(-self.n // self.rows)

    def _turned(self, value: Column, back: bool) -> Column:
        """One pass of the network over all cells, or its inverse."""
        sign = -1 if back else 1

        def turn(state: Column, k: Column) -> Column:
            row, column = state["row"], state["column"]
            by_column = F.pmod(row + sign * draw(self.seed, "turn", k, column), F.lit(self.rows).cast("bigint"))
            by_row = F.pmod(column + sign * draw(self.seed, "turn", k, row), F.lit(self.columns).cast("bigint"))
            even = F.struct(by_column.alias("row"), column.alias("column"))
            odd = F.struct(row.alias("row"), by_row.alias("column"))
            return F.when(k % 2 == 0, even).otherwise(odd)

        width = F.lit(self.columns).cast("bigint")
        start = F.struct(int_div(value, width).alias("row"), (value % width).alias("column"))
        turns = F.sequence(F.lit(TURNS - 1), F.lit(0)) if back else F.sequence(F.lit(0), F.lit(TURNS - 1))
        return F.aggregate(turns, start, turn, lambda s: s["row"] * width + s["column"])

    def _walked(self, value: Column, back: bool) -> Column:
        value = value.cast("bigint")
        again = lambda v, i: F.when((i == 0) | (v >= self.n), self._turned(v, back)).otherwise(v)
        out = F.aggregate(F.sequence(F.lit(0), F.lit(self.walks)), value, again)
        message = F.concat(value, F.lit(f" is not one of {self.n} instances"))
        return F.when((value < 0) | (value >= self.n), F.raise_error(message).cast("bigint")).otherwise(out)

    def instance_of(self, sequence: Column) -> Column:
        """Instance at a place of the order; null for null, a place outside fails the job."""
        return self._walked(sequence, False)

    def sequence_of(self, instance: Column) -> Column:
        """Place of an instance in the order; the inverse of :meth:`instance_of`."""
        return self._walked(instance, True)

    def _unsettled(self, spark: SparkSession) -> bool:
        """Whether some cell from ``n`` on needs more walks to get below ``n`` (or back to itself)."""
        cells = spark.range(self.n, self.rows * self.columns)
        start = F.col("id")
        on = lambda v, i: F.when((v >= self.n) & ((i == 1) | (v != start)), self._turned(v, False)).otherwise(v)
        end = F.aggregate(F.sequence(F.lit(1), F.lit(self.walks)), start, on)
        return not cells.select("id", end.alias("end")).where((F.col("end") >= self.n) & (F.col("end") != start)).isEmpty()


def permutation(spark: SparkSession, n: int, seed: int) -> Permutation:
    """A permutation of ``n`` numbers with as many walks as its longest way through the cells from ``n`` on."""
    if n < 1:
        raise ValueError(f"a permutation needs at least one number, not {n}")
    order = Permutation(n, seed)
    while order._unsettled(spark):
        order = Permutation(n, seed, 2 * order.walks)
    return order


def resolve_permuted(index_map: DataFrame, order: Permutation) -> DataFrame:
    """Map rows re-addressed to corpus instances, without a join; an index outside the order fails the job."""
    instance = order.instance_of(F.col("index")).alias("instance_id")
    return index_map.select(instance, "index", "ordinal", "pos", "tokens")
