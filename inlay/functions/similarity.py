"""Longest-common-subsequence scores as Arrow UDFs.

The helper keeps one bit per element of the first sequence in a Python integer,
so a row of the dynamic program is a few integer operations.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType, IntegerType


def lcs_length(first: Sequence, second: Sequence) -> int:
    """Length of the longest common subsequence."""
    where: dict = {}
    for i, item in enumerate(first):
        where[item] = where.get(item, 0) | (1 << i)
    return _lcs(where, len(first), second)


def _lcs(where: dict, n: int, second: Sequence) -> int:
    full = (1 << n) - 1
    open_bits = full
    for item in second:
        hit = open_bits & where.get(item, 0)
        if hit:
            open_bits = ((open_bits + hit) | (open_bits - hit)) & full
    return n - open_bits.bit_count()


def partial_ratio(a: str, b: str) -> int:
    """Best 0-100 similarity of the shorter string with any window of the longer one."""
    if a is None or b is None:
        return 0
    if not a or not b:
        return 100 if a == b else 0
    if len(a) == len(b):
        return int(round(max(_best_window(a, b), _best_window(b, a))))
    short, long = (a, b) if len(a) < len(b) else (b, a)
    return int(round(_best_window(short, long)))


def _best_window(short: str, long: str) -> float:
    """Windows of the short length, plus the shorter ones hanging over either end."""
    n, size = len(short), len(long)
    where: dict = {}
    for i, ch in enumerate(short):
        where[ch] = where.get(ch, 0) | (1 << i)
    need = Counter(short)
    have: Counter = Counter()
    shared = 0  # characters in common, an upper bound for the subsequence
    best = 0.0
    for end in range(1, size + n):
        if end <= size:
            ch = long[end - 1]
            shared += have[ch] < need[ch]
            have[ch] += 1
        start = end - n
        if start > 0:
            ch = long[start - 1]
            have[ch] -= 1
            shared -= have[ch] < need[ch]
        lo, hi = max(start, 0), min(end, size)
        total = n + hi - lo
        if 200.0 * shared / total > best:
            best = max(best, 200.0 * _lcs(where, n, long[lo:hi]) / total)
    return best


@F.pandas_udf(IntegerType())
def partial_similarity(target: pd.Series, generated: pd.Series) -> pd.Series:
    return pd.Series([partial_ratio(t, g) for t, g in zip(target, generated)])


def score_words(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits."""
    clean = F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")
    return F.filter(F.split(clean, " "), lambda w: w != "")


@F.pandas_udf(DoubleType())
def lcs_recall(reference: pd.Series, generated: pd.Series) -> pd.Series:
    """Share of the reference words found in order in the generated words; 0 if either is empty."""
    return pd.Series(
        [
            lcs_length(list(ref), list(gen)) / len(ref) if len(ref) and len(gen) else 0.0
            for ref, gen in zip(reference, generated)
        ]
    )


def rouge_l_recall(prompt: Column, generated: Column) -> Column:
    return lcs_recall(score_words(prompt), score_words(generated))


def contains_ignoring_case(text: Column, target: Column) -> Column:
    """Does the upper-cased text hold the trimmed, upper-cased target?"""
    return F.contains(F.upper(text), F.upper(F.regexp_replace(target, r"^(?U)\s+|(?U)\s+$", "")))
