"""Sorted groups over partition borders: previous rows, durations and user aggregates against plain loops."""

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from fitframe.operators import rank
from fitframe.operators.ordered import lag_diff, ordered_aggregate, weighted_duration


@pytest.fixture(scope="module")
def rows():
    """A third of all rows in one group, nulls in the key, the order and the values, groups of one row."""
    rng = random.Random(11)
    out = []
    for i in range(3000):
        g = "hot" if i % 3 == 0 else None if i % 31 == 0 else f"g{rng.randrange(700)}"
        out.append((i, g, float("nan") if i % 17 == 0 else float(rng.randrange(4)), rng.choice([None, *range(60)]),
                    None if i % 13 == 0 else float(rng.randrange(100))))
    return out


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "id long, g string, h double, m int, x double").repartition(5)


def ordered(rows):
    """Groups (NaN keys are equal), each sorted by m (nulls first) and id."""
    out = collections.defaultdict(list)
    for r in rows:
        out[r[1], "nan" if math.isnan(r[2]) else r[2]].append(r)
    return {k: sorted(v, key=lambda r: (r[3] is not None, r[3] or 0, r[0])) for k, v in out.items()}


def test_lag_over_borders_equals_a_loop(df, rows, monkeypatch):
    monkeypatch.setattr(rank, "_partitions", lambda *_: 16)
    got = {r.id: r.delta for r in lag_diff(df, ["g", "h"], ["m", "id"], "x", default=5).collect()}
    want = {}
    for group in ordered(rows).values():
        before = 5.0
        for r in group:
            want[r[0]] = None if r[4] is None or before is None else r[4] - before
            before = r[4]
    assert got == want
    window = {r.id: r.delta for r in lag_diff(df, ["g", "h"], ["m", "id"], "x", default=5, skew_safe=False).collect()}
    assert got == window
    assert lag_diff(df.limit(0), ["g"], ["id"], "x").count() == 0


def test_one_exchange_of_the_rows(df):
    from fitframe.operators.ordered import _sorted_once
    plan = _sorted_once(df, ["g"], ["m"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning") == 1
    after = lag_diff(df, ["g"], ["m", "id"], "x")._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in after and "SortMergeJoin" not in after and "Window" not in after


def test_hot_group_is_spread(df, monkeypatch):
    from fitframe.operators.ordered import _sorted_once
    monkeypatch.setattr(rank, "_partitions", lambda *_: 12)
    parts = _sorted_once(df.where("g = 'hot'"), ["g"], ["m", "id"]).groupBy(F.spark_partition_id().alias("p")).count()
    sizes = [r["count"] for r in parts.collect()]
    assert len(sizes) >= 10 and max(sizes) < 300


def test_durations_over_borders(df, monkeypatch):
    monkeypatch.setattr(rank, "_partitions", lambda *_: 16)
    some = df.where("m is not null")
    a, b = ({(r.g, str(r.h)): r.estimate for r in weighted_duration(
        some, ["g", "h"], ["m", "id"], "m", F.col("x"), skew_safe=s).collect()} for s in (True, False))
    assert a.keys() == b.keys() and all(math.isclose(a[k], b[k], rel_tol=1e-9, abs_tol=1e-9) for k in a)


def test_user_aggregate_over_borders(df, rows, monkeypatch):
    """The longest rise of x in the sorted group: not a plain sum, and its states must be merged in order."""
    monkeypatch.setattr(rank, "_partitions", lambda *_: 16)

    def update(state, chunk):  # (best, prefix, suffix, length, first, last)
        for x in chunk["x"].fillna(-1.0):
            state = merge(state, (1, 1, 1, 1, x, x))
        return state

    def merge(a, b):
        if not a or not b:
            return a or b
        joined = a[5] < b[4]
        prefix = a[1] + b[1] if joined and a[1] == a[3] else a[1]
        suffix = a[2] + b[2] if joined and b[2] == b[3] else b[2]
        return (max(a[0], b[0], a[2] + b[1] if joined else 0), prefix, suffix, a[3] + b[3], a[4], b[5])

    got = ordered_aggregate(df, ["g", "h"], ["m", "id"], lambda: None, update, merge, lambda s: s[0], "rise long")
    want = {}
    for key, group in ordered(rows).items():
        best = run = 0
        before = None
        for r in group:
            x = -1.0 if r[4] is None else r[4]
            run = run + 1 if before is not None and before < x else 1
            best, before = max(best, run), x
        want[key] = best
    assert {(r.g, "nan" if math.isnan(r.h) else r.h): r.rise for r in got.collect()} == want


def test_gini_evaluator_ranks_by_probability(spark):
    from pyspark.ml.functions import array_to_vector
    from fitframe.operators.metrics import FitEvaluator
    scored = spark.createDataFrame([(1, 1.0, 0.0, [0.6, 0.4]), (2, 0.0, 0.0, [0.9, 0.1]), (3, 1.0, 1.0, [0.2, 0.8]),
                                    (4, 0.0, 0.0, [0.7, 0.3])], "id long, label double, prediction double, p array<double>") \
        .withColumn("probability", array_to_vector("p"))
    assert FitEvaluator("gini", tiebreakCol="id").evaluate(scored) == pytest.approx(1.0)
