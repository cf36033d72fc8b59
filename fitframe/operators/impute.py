"""Imputation (N3, N4, N5) with one pass over the data per statistic kind.

Modes are computed without a per-column value->count map in one task
(``F.mode`` keeps such a map): the columns are unpivoted into
``(name, value)`` pairs, counted with a map-side partial aggregate (so a hot
value holding a third of the rows is pre-aggregated before the shuffle),
and the winner per column is the minimum of ``(-count, value)`` -- most
frequent, ties to the smallest value (trap T12).
"""

from __future__ import annotations

from pyspark.ml import Estimator, Model
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType


def column_means(df: DataFrame, columns: list[str]) -> dict:
    """Mean of each column ignoring NULL, one aggregate for all columns."""
    if not columns:
        return {}
    row = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in columns]).first()
    return {c: row[c] for c in columns}


def column_modes(df: DataFrame, columns: list[str]) -> dict:
    """Most frequent non-null value of each column, ties to the smallest."""
    if not columns:
        return {}
    from .encode import _FIELD, value_kinds, value_struct
    kinds = value_kinds(df, columns)
    pairs = [value_struct(c, kinds[c], with_presence=False) for c in columns]
    counted = (df.select(F.explode(F.array(*pairs)).alias("kv")).select("kv.*")
               .where(F.col("lval").isNotNull() | F.col("dval").isNotNull() | F.col("sval").isNotNull())
               .groupBy("name", "lval", "dval", "sval").agg(F.count(F.lit(1)).alias("n")))
    best = (counted.groupBy("name")
            .agg(F.min(F.struct((-F.col("n")).alias("neg"), "lval", "dval", "sval")).alias("b"))
            .collect())  # one row per column
    return {r["name"]: r["b"][_FIELD[kinds[r["name"]]]] for r in best}


_INTEGRAL = ("tinyint", "smallint", "int", "bigint")


def _fill(df: DataFrame, values: dict) -> DataFrame:
    """Coalesce each column with its fill value.  A float fill of an integer
    column makes the column double (pandas: an int column with NaN is float)."""
    dtypes = dict(df.dtypes)
    out = {}
    for c, v in values.items():
        if v is None:
            continue
        t = "double" if (isinstance(v, float) and dtypes[c] in _INTEGRAL) else dtypes[c]
        out[c] = F.coalesce(F.col(c).cast(t), F.lit(v).cast(t))
    return df.withColumns(out)


def fill_mean(df: DataFrame, columns: list[str] | None = None, fit: DataFrame | None = None) -> DataFrame:
    """Numeric nulls -> column mean of ``fit`` (default: ``df`` itself, trap T9)."""
    cols = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]
    return _fill(df, column_means(fit if fit is not None else df, cols))


def fill_mode(df: DataFrame, columns: list[str] | None = None, fit: DataFrame | None = None) -> DataFrame:
    """Every column's nulls -> its mode in ``fit`` (default ``df``)."""
    cols = columns or df.columns
    return _fill(df, column_modes(fit if fit is not None else df, cols))


class MixedImputer(Estimator):
    """Text columns -> mode, other columns -> mean.

    An integer column filled with a (float) mean becomes double.
    """

    def __init__(self, inputCols: list[str] | None = None):
        super().__init__()
        self.inputCols = inputCols

    def _fit(self, dataset: DataFrame) -> "MixedImputerModel":
        cols = self.inputCols or dataset.columns
        numeric = [f.name for f in dataset.schema.fields
                   if f.name in cols and isinstance(f.dataType, NumericType)]
        text = [c for c in cols if c not in set(numeric)]
        fill = column_means(dataset, numeric)
        fill.update(column_modes(dataset, text))
        return MixedImputerModel(fill)


class MixedImputerModel(Model):
    def __init__(self, fill: dict):
        super().__init__()
        self.fill = fill

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return _fill(dataset, {c: v for c, v in self.fill.items() if c in dataset.columns})


def impute_each(train: DataFrame, test: DataFrame, columns: list[str] | None = None):
    """Trap T9: train and test are imputed separately, each with its own statistics."""
    return (MixedImputer(columns).fit(train).transform(train),
            MixedImputer(columns).fit(test).transform(test))
