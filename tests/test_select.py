"""Exact selection against sorted lists."""

import random

import pytest
from pyspark.sql import functions as F

from fitframe.operators.schema import quartiles
from fitframe.operators.select import nth_smallest
from fitframe.operators.split import tail_split


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = []
    for i in range(6000):
        a = None if i % 50 == 0 else 7 if i % 3 == 0 else rng.randrange(40)
        out.append((i, a, rng.choice(["x", "y", None, "zz"]), rng.gauss(0, 9)))
    return out


def test_nth_smallest_of_several_columns(spark, rows):
    df = spark.createDataFrame(rows, "id long, a int, s string, x double")
    order = lambda r: [(v is not None, v) for v in r]
    keys = sorted(((r[1], r[2]) for r in rows), key=order)
    for n in (1, 2, 1999, 3000, 5999, 6000):
        got, at_most = nth_smallest(df, ["a", "s"], n, sample=64, few=50)
        assert tuple(got) == keys[n - 1]
        assert at_most == sum(order(k) <= order(keys[n - 1]) for k in keys)
    values = sorted(r[3] for r in rows)
    assert [nth_smallest(df, ["x"], n, sample=64, few=50)[0][0] for n in (1, 777, 6000)] == [
        values[0], values[776], values[-1]]
    with pytest.raises(ValueError):
        nth_smallest(df, ["x"], 6001)


def test_tail_split_without_a_sort(spark, rows):
    df = spark.createDataFrame(rows, "id long, a int, s string, x double")
    split = tail_split(df, ["a", "id"], 700)
    plan = split._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    assert {r.id for r in split.where(F.col("is_train")).collect()} == {r[0] for r in order[:-700]}
    tied = tail_split(df, ["a"], 700)  # rows tie across the border: a place each, by rank
    assert tied.where("is_train").count() == 5300
    assert tail_split(df, ["id"], 0).where("is_train").count() == 6000
    assert tail_split(df, ["id"], 9000).where("is_train").count() == 0


def test_quartiles_leave_out_nulls(spark):
    df = spark.createDataFrame([(None, 1.0), (1, 2.0), (2, 3.0), (3, 4.0), (4, None), (None, None)], "a int, b double")
    assert [tuple(r) for r in quartiles(df).collect()] == [("a", 1.0, 2.0, 3.0), ("b", 1.0, 2.0, 3.0)]
    assert [tuple(r) for r in quartiles(df.limit(0)).collect()] == [("a", None, None, None), ("b", None, None, None)]
