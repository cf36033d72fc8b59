"""Null handling as column expressions.

The reference has one null, NaN.  Spark keeps NULL and NaN apart and its
``avg``/``max`` propagate NaN, so sources convert NaN to NULL once
(:func:`nan_to_null`) and everything downstream deals in NULL only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType, FloatType, DoubleType


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c) -> Column:
    """NaN -> NULL for float columns (identity otherwise is the caller's job)."""
    c = _c(c)
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def nans_to_nulls(df: DataFrame) -> DataFrame:
    """Apply :func:`nan_to_null` to every float/double column in one projection."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (FloatType, DoubleType)):
            cols.append(nan_to_null(f.name).cast(f.dataType).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def not_equal_keep_null(c, value) -> Column:
    """``c != value`` with pandas semantics: NULL rows are kept."""
    return ~_c(c).eqNullSafe(F.lit(value))


def is_present(c) -> Column:
    """Not null and, for floats, not NaN."""
    c = _c(c)
    return c.isNotNull() & ~F.isnan(c)


def fill_const(df: DataFrame, value, subset: list[str] | None = None) -> DataFrame:
    """Fill every null with one constant.

    Numeric columns get ``value``; text columns get ``str(value)`` -- the
    pandas ``fillna(0)`` on an object column stores the constant, which
    prints as its text.  One projection, no job.
    """
    names = set(subset) if subset is not None else None
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if names is not None and f.name not in names:
            cols.append(c)
        elif isinstance(f.dataType, NumericType):
            cols.append(F.coalesce(c, F.lit(value).cast(f.dataType)).alias(f.name))
        elif isinstance(f.dataType, StringType):
            cols.append(F.coalesce(c, F.lit(str(value))).alias(f.name))
        else:
            cols.append(c)
    return df.select(*cols)


def fill_columns(df: DataFrame, values: dict) -> DataFrame:
    """Fill named columns with their own constants."""
    dtypes = dict(df.dtypes)
    return df.withColumns({
        name: F.coalesce(F.col(name), F.lit(v).cast(dtypes[name]))
        for name, v in values.items()
    })


def null_negatives(df: DataFrame, columns: list[str]) -> DataFrame:
    """Replace negative values by NULL in the listed columns.

    ``x if x >= 0 else nan``: NULL stays NULL, negatives become NULL.
    """
    return df.withColumns({c: F.when(F.col(c) >= 0, F.col(c)) for c in columns})


def default_if_null(c, default) -> Column:
    """A derivation on text that yields ``default`` when the text is null."""
    return F.coalesce(_c(c), F.lit(default))
