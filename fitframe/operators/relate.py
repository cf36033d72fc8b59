"""Joins, unions and grouped aggregation.

Broadcast is never assumed: :func:`broadcast_if_small` hints a broadcast
only when the optimizer's size estimate of that side is under a limit, and
otherwise leaves a shuffle join (which AQE can still turn into a broadcast
from measured runtime sizes).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_BROADCAST_BYTES = 64 * 1024 * 1024


def _plan(df: DataFrame):
    """The optimized plan, or None where there is no JVM handle (Spark Connect)."""
    jdf = getattr(df, "_jdf", None)
    return None if jdf is None else jdf.queryExecution().optimizedPlan()


def estimated_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate of ``df`` (the number ``autoBroadcastJoinThreshold`` is checked against).

    For a join it is the product of the sides, so it errs on the large side:
    right for asking whether a broadcast is safe, not for sizing partitions.
    """
    plan = _plan(df)
    return None if plan is None else int(str(plan.stats().sizeInBytes()))


#: A leaf without statistics (an RDD) reports the largest long; from here on a size means unknown.
UNKNOWN_BYTES = 1 << 60


def leaf_bytes(df: DataFrame) -> int | None:
    """Bytes of all leaf scans under ``df``: what a plan with joins reads, not their product.

    Leaves of unknown size are left out.
    """
    plan = _plan(df)
    if plan is None:
        return None
    leaves = plan.collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(n for n in sizes if n < UNKNOWN_BYTES)


def broadcast_if_small(df: DataFrame, max_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    size = estimated_bytes(df)
    if size is not None and size <= max_bytes:
        return F.broadcast(df)
    return df


def left_lookup(fact: DataFrame, dim: DataFrame, on, how: str = "left",
                max_broadcast_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """Fact-to-dimension equi-join (J1 left, J2 inner, J4 by id).

    The dimension side is broadcast only behind the size check.
    """
    return fact.join(broadcast_if_small(dim, max_broadcast_bytes), on, how)


def natural_join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on every column the two tables share (J3, R ``merge``)."""
    common = [c for c in left.columns if c in set(right.columns)]
    if not common:
        raise ValueError("no common columns for a natural join")
    return left.join(broadcast_if_small(right), common, how)


def union_all(*dfs: DataFrame) -> DataFrame:
    """Concatenate tables by column name."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def union_distinct(*cols: Column | str, frames: list[DataFrame], name: str = "value") -> DataFrame:
    """Distinct values over several tables (J7, R ``unique(c(a, b))``)."""
    parts = [f.select((F.col(c) if isinstance(c, str) else c).alias(name)) for f, c in zip(frames, cols)]
    return union_all(*parts).distinct()


# Aggregate names the flattening understands, mapped to Spark.
_AGG = {
    "mean": lambda c: F.avg(c),
    "max": lambda c: F.max(c),
    "min": lambda c: F.min(c),
    "count": lambda c: F.count(c),
    "sum": lambda c: F.sum(c),
    "std": lambda c: F.stddev_samp(c),
}


def flatten_agg(df: DataFrame, key, spec: dict[str, list[str]], sep: str = "_") -> DataFrame:
    """Group by key, several functions per column, flat names ``col_fn``.

    One hash aggregate (partial on the map side, final after one exchange on
    the key).  Mean/max/min/count skip NULLs like ``np.nanmean`` and the
    cythonised pandas reducers.
    """
    keys = [key] if isinstance(key, str) else list(key)
    aggs = [_AGG[fn](F.col(c)).alias(f"{c}{sep}{fn}") for c, fns in spec.items() for fn in fns]
    return df.groupBy(*keys).agg(*aggs)


def share_of_total(df: DataFrame, column: str, name: str = "share") -> DataFrame:
    """``c / sum(c)`` (I7).  The total is a scalar subquery (one aggregate,
    evaluated once), not a join."""
    total = df.select(F.sum(F.col(column).cast("double"))).scalar()
    return df.withColumn(name, F.try_divide(F.col(column).cast("double"), total))
