"""Registration of queries with their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def longs(df: DataFrame, *names: str) -> list[Column]:
    return [F.col(n).cast("long").alias(n) for n in names]


def rounded(*columns: Column) -> list[Column]:
    """Doubles to six digits, without negative zero."""
    return [F.round(c.cast("double"), 6) + 0.0 for c in columns]
