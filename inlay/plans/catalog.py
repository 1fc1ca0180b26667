"""Registry of named queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from inlay.plans.views import Tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of :class:`Tables` under ``name``."""

    def add(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def joined(tokens: str | Column) -> Column:
    """A token array as comma-separated text, the form in which results are compared."""
    column = F.col(tokens) if isinstance(tokens, str) else tokens
    return F.array_join(column.cast("array<string>"), ",")


def rounded(column: str | Column, digits: int = 6) -> Column:
    return F.round(column, digits)
