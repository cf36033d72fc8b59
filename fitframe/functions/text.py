"""Text derivations and generated pairwise features.

All are column expressions; the pairwise generators return ``{name: Column}``
so the caller adds all of them in one ``select``/``withColumns`` (one
projection instead of hundreds of chained ``withColumn``).
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arith import divide

# Month abbreviations searched for in the promo-interval text,
# in calendar order, with the flag-name suffixes the reference uses.
MONTH_ABBREVIATIONS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun",
                       "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def month_flags(c, prefix: str = "promo") -> dict[str, Column]:
    """12 flags: 1 when the list text contains the month abbreviation,
    0 when it does not or when the text is null (F7, N8)."""
    c = _c(c)
    return {
        f"{prefix}{m.lower()}": F.coalesce(c.contains(m).cast("int"), F.lit(0))
        for m in MONTH_ABBREVIATIONS
    }


def split_street(c) -> dict[str, Column]:
    """Leading house number off an address (F8).

    The first space-separated token is the number when it is all digits
    (kept as text, as the reference does); otherwise the number is '0' and
    the address is unchanged.
    """
    a = _c(c)
    head = F.substring_index(a, " ", 1)
    numeric = head.rlike("^[0-9]+$")
    rest = F.substring(a, F.length(head) + 2, F.lit(1 << 30))
    return {
        "street_no": F.when(numeric, head).otherwise(F.lit("0")),
        "street": F.when(numeric, rest).otherwise(a),
    }


def name_parts(c) -> dict[str, Column]:
    """``"Last, Title. First"`` -> surname and title; the title keeps its
    leading space (F11)."""
    n = _c(c)
    return {
        "surname": F.split_part(n, F.lit(","), F.lit(1)),
        "title": F.split_part(F.split_part(n, F.lit(","), F.lit(2)), F.lit("."), F.lit(1)),
    }


def as_text(c) -> Column:
    """``str(x)`` of the reference, NULL printing as 'nan' (trap T5)."""
    return F.coalesce(_c(c).cast("string"), F.lit("nan"))


def text_crosses(columns: list[str], sep: str = "_") -> dict[str, Column]:
    """All unordered pairs ``a_b`` of the listed columns as text."""
    return {
        f"{a}{sep}{b}": F.concat(as_text(a), F.lit(sep), as_text(b))
        for a, b in combinations(columns, 2)
    }


def arith_crosses(columns: list[str], division: str = "faithful") -> dict[str, Column]:
    """All unordered pairs: product ``atimesb`` and ratio ``adivsb``.

    Ratios follow :func:`fitframe.functions.arith.divide` (trap T6).
    """
    out: dict[str, Column] = {}
    for a, b in combinations(columns, 2):
        out[f"{a}times{b}"] = F.col(a).cast("double") * F.col(b).cast("double")
        out[f"{a}divs{b}"] = divide(a, b, division)
    return out
