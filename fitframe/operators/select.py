"""Exact selection of order statistics without a sort.

The n-th smallest key is closed in from both sides.  A bounded sample of the
keys still in question gives a bracket that holds the wanted one very likely;
one aggregate counts the rows up to both ends, and these exact counts tell on
which side of each end the key lies.  A round leaves about a twentieth of the
rows, and the last few are ordered.  Nothing is shuffled but counts, samples of
bounded size and those few.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys in a sample, and the number of rows that are ordered at last.
SAMPLE, FEW = 4096, 20_000


def key_of(keys: list[str]) -> Column:
    return F.struct(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)])


def literal_key(row, kinds) -> Column:
    return F.struct(*[F.lit(row[i]).cast(kinds[i]).alias(f"k{i}") for i in range(len(kinds))])


def nth_smallest(df: DataFrame, keys: list[str], n: int, sample: int = SAMPLE, few: int = FEW):
    """(key, at_most): the ``n``-th smallest key (1-based, nulls first) as a row, and the rows up to it.

    ``at_most`` exceeds ``n`` when the key occurs again further on.
    """
    base = df.select(key_of(keys).alias("k"))
    kinds = [f.dataType for f in base.schema["k"].dataType.fields]
    low = high = None  # the key is above low and not above high
    below = 0  # rows up to low
    for seed in range(1, 1000):
        part = base
        if low is not None:
            part = part.where(F.col("k") > literal_key(low, kinds))
        if high is not None:
            part = part.where(F.col("k") <= literal_key(high, kinds))
        left, least, most = part.agg(F.count("*"), F.min("k"), F.max("k")).first()
        if not 1 <= n - below <= left:
            raise ValueError(f"row {n} of {below + left}")
        if least == most:
            return most, below + left
        if left <= few:
            row = part.orderBy("k").offset(n - below - 1).limit(1).first()["k"]
            return row, below + part.where(F.col("k") <= literal_key(row, kinds)).count()
        some = [r["k"] for r in part.sample(min(1.0, sample / left), seed).limit(2 * sample).orderBy("k").collect()]
        at, wide = (n - below) / left * len(some), 3 * math.sqrt(max(1, len(some))) / 2 + 1
        ends = [some[min(max(0, round(i)), len(some) - 1)] for i in (at - wide, at + wide)] if some else [least]
        # a bracket end may be the greatest key, or hold all rows by ties: the least key then parts the rows
        ends = sorted({tuple(e): e for e in [*ends, least] if e != most}.values(),
                      key=lambda e: [(v is not None, v) for v in e])
        counts = part.agg(*[F.count(F.when(F.col("k") <= literal_key(e, kinds), 1)) for e in ends]).first()
        start = below
        for e, c in zip(ends, counts):
            if start + c < n:
                low, below = e, start + c
            else:
                high = e
                break
    raise RuntimeError("no end to the selection")


def quantiles(df: DataFrame, column: str, shares: list[float]) -> list:
    """Discrete quantiles of the non-null values: the smallest value with at least that share of them up to it."""
    some = df.where(F.col(f"`{column}`").isNotNull())
    total = some.count()
    return [nth_smallest(some, [column], max(1, math.ceil(q * total)))[0][0] if total else None for q in shares]
