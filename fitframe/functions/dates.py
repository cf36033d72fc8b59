"""Date and time derivations (F1-F6, F9, F10) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import MONTH_ABBREVIATIONS


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def packed_hour(c, mode: str = "faithful") -> dict[str, Column]:
    """Decode a packed ``YYMMDDHH`` integer (F1, trap T1).

    ``faithful`` keeps the reference's integer formulas and names: ``day`` is
    really the two-digit year, ``dow`` is that year mod 7, ``hour`` is the
    day of month.  ``corrected`` gives the real day, weekday (Monday=0) and
    hour.
    """
    x = _c(c).cast("long")
    if mode == "faithful":
        day = floor_div(x - F.pmod(x, F.lit(10000)), 1000000)
        return {
            "day": day,
            "dow": F.pmod(day, F.lit(7)),
            "hour": floor_div(F.pmod(x, F.lit(10000)), 100),
        }
    if mode != "corrected":
        raise ValueError(f"unknown mode {mode!r}")
    ts = F.to_timestamp(F.lpad(x.cast("string"), 8, "0"), "yyMMddHH")
    return {
        "day": F.dayofmonth(ts).cast("long"),
        "dow": weekday(ts).cast("long"),
        "hour": F.hour(ts).cast("long"),
    }


def floor_div(a: Column, n: int) -> Column:
    """Python 2 integer division ``a / n`` (floor) for an integer column."""
    return ((a - F.pmod(a, F.lit(n))) / F.lit(n)).cast("long")


def weekday(c) -> Column:
    """Day of week with Monday = 0 (pandas ``dt.weekday``)."""
    return F.weekday(_c(c))


def date_text_parts(c, as_double: bool = True) -> dict[str, Column]:
    """Split ``YYYY-MM-DD`` text on '-' (F2); the reference casts each part to float."""
    parts = F.split(_c(c), "-")
    t = "double" if as_double else "int"
    return {
        "year": parts.getItem(0).cast(t),
        "month": parts.getItem(1).cast(t),
        "day": parts.getItem(2).cast(t),
    }


def date_parts(c) -> dict[str, Column]:
    """Year / month / day-of-month / Monday=0 weekday of a date or timestamp."""
    c = _c(c)
    return {"year": F.year(c), "month": F.month(c), "day": F.dayofmonth(c),
            "weekday": weekday(c)}


def short_year_parts(c) -> dict[str, Column]:
    """R ``format(d, '%y' / '%m' / '%d')`` cast to integer."""
    c = _c(c)
    return {"year": F.date_format(c, "yy").cast("int"),
            "month": F.month(c), "day": F.dayofmonth(c)}


def month_number(abbrev) -> Column:
    """1-12 for a three-letter English month abbreviation in any case, NULL otherwise."""
    pos = F.array_position(F.array(*[F.lit(m.upper()) for m in MONTH_ABBREVIATIONS]),
                           F.upper(_c(abbrev)))
    return F.when(pos > 0, pos.cast("int"))


def sas_date_parts(c, with_hour: bool = False) -> dict[str, Column]:
    """Parts of ``ddMMMyy`` or ``ddMMMyy:HH:MM:SS`` text, null-safe.

    D and Y are the text slices (as the reference keeps them), M is the
    month number and W the Monday=0 weekday of the date.  The date is built
    from its numbers (month looked up in the abbreviation list, any case) and
    not parsed with a pattern: no per-row formatter, and malformed text gives
    NULL instead of an error.  Two-digit years follow the POSIX strptime
    pivot, 69-99 -> 19xx and 00-68 -> 20xx (Spark's ``yy`` would put every
    year in 20xx).
    """
    c = _c(c)
    yy = F.substring(c, 6, 2).try_cast("int")
    year = F.when(yy >= 69, yy + 1900).otherwise(yy + 2000)
    d = F.try_make_timestamp_ntz(year, month_number(F.substring(c, 3, 3)),
                                 F.substring(c, 1, 2).try_cast("int"), F.lit(0), F.lit(0), F.lit(0))
    out = {
        "D": F.substring(c, 1, 2),
        "M": F.month(d),
        "Y": F.substring(c, 6, 2),
        "W": weekday(d),
    }
    if with_hour:
        out["H"] = F.substring(c, 9, 2)
    return {k: F.when(c.isNotNull(), v) for k, v in out.items()}


def hour_text(c, default: str = "12") -> Column:
    """Hour by slice ``[11:13]`` of ``yyyy-MM-dd HH:mm:ss`` text, ``default``
    when the text is 4 characters or shorter (F9)."""
    c = _c(c)
    return F.when(F.length(c) > 4, F.substring(c, 12, 2)).otherwise(F.lit(default))


def night_flag(hour, mode: str = "faithful") -> Column:
    """Night flag (F10, trap T2).  ``faithful``: always 0, as the reference's
    ``h >= 18 and h < 6`` test (on text) can never hold.  ``corrected``:
    ``h >= 18 or h < 6``."""
    if mode == "faithful":
        return F.lit(0)
    h = _c(hour).cast("int")
    return ((h >= 18) | (h < 6)).cast("int")
