"""Column expressions over token arrays."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def int_div(value: Column, by) -> Column:
    """Whole-number division that stays exact for positions beyond 2**53."""
    return F.call_function("div", value, by if isinstance(by, Column) else F.lit(by).cast("bigint"))


def wrap_eos(tokens: Column, length: int, eos: int) -> Column:
    """Put EOS behind, then before, a non-empty sequence as far as room and need allow."""
    mark = F.array(F.lit(eos))
    short = (F.size(tokens) > 0) & (F.size(tokens) < length)
    closed = F.when(short & (F.try_element_at(tokens, F.lit(-1)) != eos), F.concat(tokens, mark)).otherwise(tokens)
    opens = short & (F.size(closed) < length) & (F.try_element_at(closed, F.lit(1)) != eos)
    return F.when(opens, F.concat(mark, closed)).otherwise(closed)


def fits(tokens: Column, length: int) -> Column:
    """True for sequences a random placement accepts: not empty, not longer than ``length``."""
    return F.size(tokens).between(1, length)


def common_prefix_length(left: Column, right: Column) -> Column:
    """Number of leading elements two arrays share."""
    same = F.zip_with(left, right, lambda a, b: a.eqNullSafe(b))
    first_difference = F.array_position(same, False)
    shorter = F.least(F.size(left), F.size(right)).cast("bigint")
    # zip_with pads the shorter side with nulls, so the cut is explicit
    return F.when(first_difference == 0, shorter).otherwise(F.least(first_difference - 1, shorter))


def suffix_sum(values: Column, skip: Column) -> Column:
    """Sum of the values behind the first ``skip``; null when one of them is null."""
    tail = F.slice(values, (skip + 1).cast("int"), F.size(values))
    return F.aggregate(tail, F.lit(0.0), lambda acc, v: acc + v)


def left_pad(tokens: Column, width: Column, pad: int) -> Column:
    """Tokens padded on the left to ``width``."""
    return F.concat(F.array_repeat(F.lit(pad), (width - F.size(tokens)).cast("int")), tokens)


def pad_mask(tokens: Column, width: Column) -> Column:
    """0 for padding, 1 for tokens, matching :func:`left_pad`."""
    return F.concat(
        F.array_repeat(F.lit(0), (width - F.size(tokens)).cast("int")),
        F.array_repeat(F.lit(1), F.size(tokens)),
    )
