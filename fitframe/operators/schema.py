"""Schema-driven selection and description.

Everything except :func:`describe` works on ``df.schema`` only and starts
no job.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType


def features_except(df: DataFrame, exclude) -> list[str]:
    """Table columns minus an exclusion list, in table order."""
    ex = set(exclude)
    return [c for c in df.columns if c not in ex]


def columns_by_type(df: DataFrame, numeric: bool = True) -> list[str]:
    """Numeric (int/float of any width) or non-numeric column names."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NumericType) == numeric]


def by_position(df: DataFrame, positions: list[int], drop: bool = False) -> DataFrame:
    """Select, or drop, columns by 1-based position (C5, R ``df[, -i]``)."""
    chosen = {df.columns[i - 1] for i in positions}
    keep = [c for c in df.columns if (c in chosen) != drop]
    return df.select(*keep)


def unique_names(names: list[str]) -> list[str]:
    """De-duplicate a feature list keeping first occurrence order."""
    return list(dict.fromkeys(names))


def swap_feature(features: list[str], source: str, derived: list[str]) -> list[str]:
    """Replace a source column by its derived parts in a feature list (trap T18).

    The derived names are always added (the reference keeps them even when
    removing the source fails); the source is removed when present, checked
    explicitly instead of through a swallowed exception.
    """
    out = [f for f in features if f != source]
    return unique_names(out + list(derived))


def describe(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per column: type, non-null count, min, max, mean (C17) -- one aggregate
    for all columns, returned long (one row per column)."""
    cols = columns or df.columns
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)}
    dtypes = dict(df.dtypes)
    aggs = []
    for c in cols:
        x = F.col(c)
        aggs += [F.count(x).alias(f"{c}__n"),
                 (F.min(x.cast("double")) if c in numeric else F.lit(None).cast("double")).alias(f"{c}__min"),
                 (F.max(x.cast("double")) if c in numeric else F.lit(None).cast("double")).alias(f"{c}__max"),
                 (F.avg(x.cast("double")) if c in numeric else F.lit(None).cast("double")).alias(f"{c}__mean")]
    wide = df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("column"), F.lit(dtypes[c]).alias("type"),
                     F.col(f"{c}__n").alias("n"), F.col(f"{c}__min").alias("min"),
                     F.col(f"{c}__max").alias("max"), F.col(f"{c}__mean").alias("mean"))
            for c in cols]
    return wide.select(F.explode(F.array(*rows)).alias("d")).select("d.*")


def quartiles(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per numeric column the quartiles of R's table summary (C17): (column, q1, median, q3), discrete, nulls left out.

    Each is selected exactly, without a sort of the table.
    """
    from .select import quantiles
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]
    rows = [(c, *(None if v is None else float(v) for v in quantiles(df, c, [0.25, 0.5, 0.75])))
            for c in columns or numeric]
    return df.sparkSession.createDataFrame(rows, "column string, q1 double, median double, q3 double")


def positive_probability(probability: str = "probability") -> Column:
    """Column 1 of the class-probability vector (C14)."""
    return vector_to_array(F.col(probability))[1]


def class_probabilities(probability: str, class_names: list[str]) -> list[Column]:
    """One column per class in fixed class order, from the probability
    vector (B3, C14).  Use in a ``select`` next to the id."""
    arr = vector_to_array(F.col(probability))
    return [arr[i].alias(name) for i, name in enumerate(class_names)]
