"""Named query registry used by `__spark_entry__` and the bench.

Each query is `fn(spark, sf_dir) -> DataFrame`. Its DuckDB check (when the
operator is expressible in SQL) is registered next to it. Doubles leave both
engines rounded to 6 decimals (half-up on the decimal value) so that summation
order cannot change the compared values.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn
    return deco


def finish(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round double columns for cross-engine comparison."""
    return df.select([
        F.round(F.col(f"`{f.name}`"), digits).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType))
        else F.col(f"`{f.name}`") for f in df.schema.fields])


def R(expr: str, digits: int = 6) -> str:
    """SQL twin of Spark's half-up `round` on a double."""
    return f"CAST(round(CAST(({expr}) AS DECIMAL(38,12)), {digits}) AS DOUBLE)"


def with_ctes(*ctes: str) -> Callable[[str], str]:
    head = "WITH " + ",\n".join(c.strip().rstrip(",") for c in ctes) + "\n"
    return lambda body: head + body
