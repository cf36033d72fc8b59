"""Out-of-fold predictions and fold-wise metrics against the one-fold functions."""

import random

import pytest
from pyspark.sql import functions as F

from fitframe.operators import rank
from fitframe.operators.folds import fold_scores, out_of_fold, rank_metrics
from fitframe.operators.metrics import FitEvaluator, auc, gini, logloss, rmse
from fitframe.operators.models import assemble, cross_validate, estimator


def scored(spark, n=400, folds=3, hot=0.4, seed=5):
    """Rows with many tied scores, a score that holds a large share, and a fold that is far the largest."""
    rng = random.Random(seed)
    rows = [(i, rng.choice([0, 0, 0, *range(folds)]), float(rng.random() < 0.3),
             0.5 if rng.random() < hot else rng.randrange(20) / 20) for i in range(n)]
    return spark.createDataFrame(rows, "t long, fold int, y double, s double")


def test_rank_metrics_equal_one_fold_alone(spark):
    df = scored(spark)
    got = {r.fold: r for r in rank_metrics(df, "fold", "y", "s", "t").collect()}
    assert set(got) == {0, 1, 2}
    for f, r in got.items():
        one = df.where(F.col("fold") == f)
        assert r.auc == pytest.approx(auc(one, "y", "s").first()[0], abs=1e-12)
        assert r.gini == pytest.approx(gini(one, "y", "s", "t").first()[0], abs=1e-12)
    assert {r.fold: r.auc for r in rank_metrics(df, "fold", "y", "s").collect()} == {f: r.auc for f, r in got.items()}


def test_rank_metrics_of_a_continuous_label(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(i, i % 2, rng.random() * 9, rng.random()) for i in range(100)],
                               "t long, fold int, y double, s double")
    for r in rank_metrics(df, "fold", "y", "s", "t").collect():
        assert r.gini == pytest.approx(gini(df.where(F.col("fold") == r.fold), "y", "s", "t").first()[0], abs=1e-12)


def test_odd_folds(spark):
    """One class only, one row, labels of sum 0, null scores, a null fold, no rows."""
    rows = [(0, 0, 1.0, 0.2), (1, 0, 1.0, 0.7), (2, 1, 0.0, 0.5), (3, 2, 0.0, None), (4, 2, 1.0, 0.1), (5, 2, 1.0, None),
            (6, None, 1.0, 0.9), (7, None, 0.0, 0.1)]
    df = spark.createDataFrame(rows, "t long, fold int, y double, s double")
    got = {r.fold: (r.auc, r.gini) for r in rank_metrics(df, "fold", "y", "s", "t").collect()}
    for f in (0, 1, 2, None):
        one = df.where(F.col("fold").eqNullSafe(F.lit(f)))
        assert got[f] == pytest.approx((auc(one, "y", "s").first()[0], gini(one, "y", "s", "t").first()[0]))
    assert rank_metrics(df.limit(0), "fold", "y", "s", "t").count() == 0


def test_fold_scores_of_all_metrics(spark):
    df = scored(spark)
    many = {m: FitEvaluator(m, "y", "s", "t") for m in ("auc", "gini", "logloss", "rmse", "accuracy", "mae")}
    got = {(r.fold, r.metric): r.score for r in fold_scores(df, "fold", many).collect()}
    assert len(got) == 18
    for f in range(3):
        one = df.where(F.col("fold") == f)
        for name, e in many.items():
            assert got[f, name] == pytest.approx(e.evaluate(one), abs=1e-12)


def test_cross_validation_scores_the_held_out_rows(spark):
    rng = random.Random(3)
    rows = [(i, i % 3, float(x + rng.random() > 1), x) for i, x in ((i, rng.random()) for i in range(120))]
    df = assemble(spark.createDataFrame(rows, "t long, fold int, label double, x double"), ["x"])
    est = estimator("logistic", maxIter=5)
    held = out_of_fold(est, df, "fold", 3, ["t", "fold", "label"])
    assert held.select("t").distinct().count() == held.count() == 120
    many = {m: FitEvaluator(m, tiebreakCol="t") for m in ("auc", "gini", "logloss", "multi_logloss")}
    got = {(r.fold, r.metric): r.score for r in cross_validate(est, df, "fold", many, 4).collect()}  # fold 3 has no rows
    for name, e in many.items():
        values = []
        for f in range(3):
            pred = est.fit(df.where(F.col("fold") != f)).transform(df.where(F.col("fold") == f))
            values.append(e.evaluate(pred))
            assert got[f, name] == pytest.approx(values[-1], abs=1e-9)
        assert got[-1, name] == pytest.approx(sum(values) / 3, abs=1e-9) and (3, name) not in got


def test_the_sorts_do_not_grow_with_the_folds(spark, monkeypatch):
    """One range sort of the rows and one of the (fold, label) groups, whatever the number of folds."""
    sizes = []
    real = rank.sorted_tagged

    def counted(df, *args):
        sizes.append(df.count())
        return real(df, *args)
    monkeypatch.setattr(rank, "sorted_tagged", counted)
    df = scored(spark, folds=12)
    assert rank_metrics(df, "fold", "y", "s", "t").count() == 12
    assert sizes == [df.count(), df.select("fold", "y").distinct().count()]
