"""Where the modules of queries register them, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def round_signed(x: Column, digits: int) -> Column:
    """``x`` rounded as SQL rounds it: what is negative and comes to zero stays -0.0."""
    r = F.round(x, digits)
    return F.when((r == 0) & (x < 0), F.lit(-0.0)).otherwise(r)


def rounded(df: DataFrame, *columns: str, digits: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})
