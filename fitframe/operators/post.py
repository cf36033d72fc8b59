"""Prediction post-processing (O1-O4) as column expressions and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arith import clamp_low, unlog
from .rank import global_rank
from .relate import left_lookup


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def segment_multiplier(c, factors: dict, default: float = 1.0) -> Column:
    """A multiplier chosen by the value of ``c``: ``factors[value]`` or ``default``."""
    col = _c(c)
    expr = None
    for k, v in factors.items():
        expr = F.when(col == F.lit(k), F.lit(float(v))) if expr is None \
            else expr.when(col == F.lit(k), F.lit(float(v)))
    return expr.otherwise(F.lit(float(default))) if expr is not None else F.lit(float(default))


def calibrate(df: DataFrame, pred: str, rules: list[tuple[str, dict, float]],
              name: str | None = None) -> DataFrame:
    """Chained segment multipliers (O1): ``pred * m1(seg1) * m2(seg2) * ...``.

    ``rules`` is a list of ``(column, {value: factor}, default_factor)``; each
    rule is one ``CASE``, all in one projection (no row function).
    """
    p = F.col(pred).cast("double")
    for col, factors, default in rules:
        p = p * segment_multiplier(col, factors, default)
    return df.withColumn(name or pred, p)


def zero_closed(preds: DataFrame, attrs: DataFrame, key: str, flag: str, pred: str,
                closed_value=0) -> DataFrame:
    """Zero the prediction where the looked-up entity is closed.

    The per-row lookup of the reference becomes one left join on ``key``
    (broadcast only when the attribute side is small).
    """
    j = left_lookup(preds, attrs.select(key, flag), key, "left")
    return j.withColumn(pred, F.when(F.col(flag) == F.lit(closed_value), F.lit(0.0))
                        .otherwise(F.col(pred).cast("double")))


def finish(df: DataFrame, id_col: str, pred: str, name: str, log_scale: bool = True) -> DataFrame:
    """Clamp at 0, back-transform ``expm1`` when the model predicted log1p,
    project ``(id, target)`` (O3: E8 + E7 + select)."""
    p = F.col(pred).cast("double")
    if log_scale:
        p = unlog(p)
    return df.select(F.col(id_col), clamp_low(p).alias(name))


def row_ids(df: DataFrame, order_by, name: str = "row_id") -> DataFrame:
    """1-based ids from row position on an explicit order (O4, trap T13)."""
    return global_rank(df, order_by, name)
