"""Arithmetic column expressions: division rules (T6), target transforms
(E6-E8), rain rate (F16) and Python-style modulo (F14).

Spark runs with ANSI mode on, where ``x / 0`` raises even for doubles.
Nothing here switches ANSI off; the division rules are explicit instead.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def divide(a, b, mode: str = "faithful") -> Column:
    """a / b as doubles.

    ``faithful``: the pandas rule -- x/0 is +inf or -inf by the sign of x,
    0/0 is NaN, NULL in gives NULL out.  ``safe``: x/0 is NULL.
    """
    a = _c(a).cast("double")
    b = _c(b).cast("double")
    q = F.try_divide(a, b)
    if mode == "safe":
        return q
    if mode != "faithful":
        raise ValueError(f"unknown division mode {mode!r}")
    return (
        F.when(a.isNull() | b.isNull(), F.lit(None).cast("double"))
        .when(b == 0,
              F.when(a > 0, F.lit(float("inf")))
              .when(a < 0, F.lit(float("-inf")))
              .otherwise(F.lit(float("nan"))))
        .otherwise(q)
    )


def py_mod(a, n) -> Column:
    """Python ``%``: the result takes the divisor's sign (Spark ``%`` keeps the dividend's)."""
    return F.pmod(_c(a), F.lit(n) if not isinstance(n, Column) else n)


def log_target(c) -> Column:
    """log(1 + y)."""
    return F.log1p(_c(c))


def unlog(c) -> Column:
    """exp(y) - 1."""
    return F.expm1(_c(c))


def clamp_low(c, low: float = 0.0) -> Column:
    """Negative predictions to ``low`` (E8); NULL stays NULL."""
    c = _c(c)
    return F.when(c.isNull(), c).otherwise(F.greatest(c, F.lit(low)))


def rain_rate(dbz) -> Column:
    """Marshall-Palmer rate in mm/h from reflectivity in dBZ (F16):
    ``(10 ** (dbz / 10) / 200) ** 0.625``."""
    d = _c(dbz).cast("double")
    return F.pow(F.pow(F.lit(10.0), d / 10.0) / 200.0, F.lit(0.625))
