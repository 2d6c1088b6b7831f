"""Registry of named queries with their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
ROWS: dict[str, str] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``; ``covers`` names the survey rows."""

    def add(fn):
        QUERIES[name] = fn
        ROWS[name] = covers
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def r6(c: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison; adding zero turns -0.0 into 0.0."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: r6(c, digits) for c in columns})
