"""Where the plans register their queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def r6(df: DataFrame, *columns: str) -> DataFrame:
    """Rounds columns to 6 decimals, as doubles."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in columns})
