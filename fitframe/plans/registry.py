"""Registry of the queries run on the driver tables.

Each entry is a Spark builder ``(spark, sf_dir) -> DataFrame`` and, where
the result is relational, the equivalent DuckDB SQL over the same Parquet
tables.  Column names are identical on both sides; doubles are rounded to
6 places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a Spark builder under ``name`` with its SQL oracle (or none)."""
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table (Parquet; filters and projections push into the scan)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def r6(c, places: int = 6) -> Column:
    """Round a double to 6 places (the comparison precision); ``+ 0.0``
    turns a rounded -0.0 into 0.0 so both engines print the same value."""
    return F.round((F.col(c) if isinstance(c, str) else c).cast("double"), places) + F.lit(0.0)


def R6(expr: str, places: int = 6) -> str:
    """The SQL twin of :func:`r6`."""
    return f"(round(CAST({expr} AS DOUBLE), {places}) + 0.0)"


def cents(c) -> Column:
    """Money as exact integer cents (sums then agree bit-for-bit in any order)."""
    return F.round((F.col(c) if isinstance(c, str) else c).cast("double") * 100).cast("long")


def CENTS(expr: str) -> str:
    return f"CAST(round(CAST({expr} AS DOUBLE) * 100) AS BIGINT)"
