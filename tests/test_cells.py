"""Fits on counted cells and predictions by cell against the same on rows."""

import re

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor
from pyspark.sql import functions as F
from test_boost import plain_stumps

from fitframe.operators import boost as B
from fitframe.operators import cells as C
from fitframe.operators import models as M
from fitframe.operators.boost import grow, tree_nodes
from fitframe.operators.metrics import FitEvaluator
from fitframe.operators.models import assemble, estimator
from fitframe.session import ensure_checkpoint_dir

N = 4000


def table(spark, n=N, seed=3, places=2, values=5):
    """A feature of more values than bins, one of five and one of three; a label with noise, so that no gains tie."""
    rng = np.random.default_rng(seed)
    a, b, c = rng.normal(size=n).round(places), rng.integers(0, values, n), rng.integers(0, 3, n) * 0.01
    y = 3 + a ** 2 + b * c * 20 + rng.normal(0, 0.3, n)
    rows = [(i, *map(float, r)) for i, r in enumerate(zip(a, b, c, y))]
    return assemble(spark.createDataFrame(rows, "id long, a double, b double, c double, label double"), ["a", "b", "c"])


@pytest.fixture
def fitted(monkeypatch):
    """How many rows each fit of trees got."""
    seen = []
    for kind in (GBTRegressor, DecisionTreeRegressor):
        def watched(self, dataset, fit=kind._fit):
            seen.append(dataset.count())
            return fit(self, dataset)
        monkeypatch.setattr(kind, "_fit", watched)
    return seen


def predictions(model, df):
    return np.array([r.prediction for r in model.transform(df).orderBy("id").collect()])


@pytest.mark.parametrize("est", [lambda: estimator("gbt_reg", maxIter=4, maxDepth=3, seed=1),
                                 lambda: estimator("gbt_reg", maxIter=2, maxDepth=2, stepSize=0.3, maxBins=10),
                                 lambda: DecisionTreeRegressor(maxDepth=4)])
def test_a_fit_on_cells_is_the_fit_on_rows(spark, fitted, est):
    df, est = table(spark), est()
    want, got = est.fit(df), C.fit_counted(est, df)
    assert fitted[0] == N and fitted[1] <= 480 and type(got) is type(want)
    shape = r"feature \d+ <= \S+"
    assert re.findall(shape, got.toDebugString) == re.findall(shape, want.toDebugString)
    assert np.allclose(predictions(got, df), predictions(want, df), atol=1e-9)
    assert np.allclose(got.featureImportances.toArray(), want.featureImportances.toArray(), atol=1e-9)
    nodes = [sorted((r.tree, r.node, r.rows) for r in tree_nodes(m, f"{ensure_checkpoint_dir(spark)}/cells-{i}-{m.uid}").collect())
             for i, m in enumerate((got, want))]
    assert nodes[0] == nodes[1]


@pytest.mark.parametrize("more", [{"minInstancesPerNode": 2}, {"subsamplingRate": 0.5}, {"lossType": "absolute"}, {"weightCol": "b"},
                                  {"maxBins": 300}])
def test_where_rows_matter_they_are_fitted(spark, fitted, more):
    df = table(spark, 800).where("b > 0")
    C.fit_counted(estimator("gbt_reg", maxIter=1, maxDepth=1, **more), df)
    assert fitted == [df.count()]


def test_rows_of_many_cells_are_fitted(spark, fitted):
    df = table(spark, 500)  # of 480 cells
    C.fit_counted(estimator("gbt_reg", maxIter=1, maxDepth=1), df)
    assert fitted == [500]


@pytest.mark.parametrize("bad", ["NULL", "CAST('NaN' AS DOUBLE)", "CAST('-Infinity' AS DOUBLE)"])
@pytest.mark.parametrize("column", ["a", "label"])
def test_what_a_fit_refuses_is_refused(spark, bad, column):
    df = table(spark).drop("features").withColumn(column, F.expr(f"CASE WHEN id = 7 THEN {bad} ELSE {column} END"))
    df, est = assemble(df, ["a", "b", "c"]), estimator("gbt_reg", maxIter=1, maxDepth=1)
    told = []
    for fit in (est.fit, lambda d: C.fit_counted(est, d)):
        try:
            fit(df)
            told.append(None)
        except Exception as x:
            told.append(re.search("MUST NOT be [A-Z][a-z]+", str(x)).group())
    assert told[0] == told[1] and (told[0] or (column, bad[6:9]) == ("label", "-In"))


def test_a_cell_predicts_for_its_rows(spark, monkeypatch):
    df = table(spark)
    model = estimator("gbt_reg", maxIter=5, maxDepth=4).fit(df)
    cut = {float(t) for t in re.findall(r"feature 0 <= (\S+)\)", model.toDebugString)}
    odd = [*cut, *[np.nextafter(t, 9) for t in cut], np.inf, -np.inf, np.nan, 0.0, -0.0]
    rows = [(i, Vectors.dense(x, y, z)) for i, (x, y, z) in enumerate((x, y, z) for x in odd for y in (0, 2.5, np.nan) for z in (0.01, np.inf))]
    rows += [(len(rows) + i, Vectors.sparse(3, [1], [float(i)])) for i in range(5)]
    some = spark.createDataFrame(rows, ["id", "features"])

    def staged():
        return {r.id: r.staged for r in M.staged_predictions(model, some, ["id"]).collect()}
    calls, row_by_row = [], M._staged
    monkeypatch.setattr(M, "_staged", lambda trees, weights, rows, *rest: calls.append(rows.columns) or row_by_row(trees, weights, rows, *rest))
    by_cell = staged()
    monkeypatch.setattr(C, "MOST_BYTES", 0)
    assert by_cell == staged() and len(by_cell) == len(rows)
    assert calls == [[C.CELL, "features"], ["id", "features"]]
    assert M.staged_predictions(estimator("gbt_reg", maxIter=1, maxDepth=0).fit(df), some, ["id"]).count() == len(rows)


def test_softmax_boosting_on_cells_equals_a_plain_version(spark, fitted):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 4, size=(2000, 3)).astype(float)
    y = np.digitize(x[:, 0] + 0.5 * x[:, 1] + rng.normal(0, 1.2, 2000), [2, 3]).astype(float)
    df = spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))],
                               "id long, a double, b double, c double, label double")
    df = assemble(df, ["a", "b", "c"])
    train, valid = df.where("id % 4 != 0"), df.where("id % 4 = 0")
    own = np.arange(2000) % 4 != 0
    m, _ = plain_stumps(x[own], y[own], 3, 4, 0.5)
    model, curve = grow(train, valid, classes=3, rounds=4, eta=0.5, max_depth=1)
    assert max(fitted) <= 3 * 64  # of 1500 rows
    curve = curve.orderBy("round").collect()
    assert curve[3].is_best
    got = {r.id: r.margins for r in model.margins(train).collect()}
    assert np.allclose([got[i] for i in np.arange(2000)[own]], m, atol=1e-9)
    e = np.exp(m)
    want = -np.log((e / e.sum(1, keepdims=True))[np.arange(len(m)), y[own].astype(int)]).mean()
    assert abs(curve[3].train_loss - want) < 1e-9
    # a metric of a user is read on the rows, and finds the same
    _, same = grow(train, valid, classes=3, rounds=4, eta=0.5, max_depth=1, metric=lambda label, p: B.class_loss(label, p))
    assert max(fitted) == 1500
    for a, b in zip(curve, same.orderBy("round").collect()):
        assert np.allclose(a[1:3], b[1:3], atol=1e-9)


def test_early_stop_fits_cells(spark, fitted):
    df = table(spark)
    train, valid = df.where("id % 5 > 0"), df.where("id % 5 = 0")
    est = estimator("gbt_reg", maxIter=6, maxDepth=3, stepSize=0.5)
    kept, curve = M.fit_early_stopped(est, train, valid, patience=2)
    assert fitted == [C.count_cells(train, C.find_bins(train, "features", 32), "features", "label").count()] and fitted[0] <= 480
    want = M.watch_curve(est.fit(train), train, valid).orderBy("round").collect()
    assert np.allclose([tuple(r)[:3] for r in curve.orderBy("round").collect()], [tuple(r) for r in want], atol=1e-9)


@pytest.mark.parametrize("metric", [FitEvaluator("rmspe", unlog=True), FitEvaluator("gini", tiebreakCol="id")])
def test_grid_search_on_cells_gives_the_scores_of_rows(spark, fitted, monkeypatch, metric):
    df = table(spark, 8000, places=1, values=2).withColumn("fold", (F.col("id") % 3).cast("int"))
    search = lambda: M.grid_search(estimator("gbt_reg", maxIter=2), {"maxDepth": [1, 3]}, df, metric, "fold", deal=["id"])
    model, report = search()
    assert len(fitted) == 7 and max(fitted) <= 3 * 80 * 6
    monkeypatch.setattr(M, "countable", lambda est: False)
    want_model, want = search()
    assert max(fitted) > 5000
    got, want = report.collect(), want.collect()
    assert [(r.params, r.is_best) for r in got] == [(r.params, r.is_best) for r in want]
    assert np.allclose([r.mean_metric for r in got], [r.mean_metric for r in want], atol=1e-9)
    assert np.allclose(predictions(model, df), predictions(want_model, df), atol=1e-9)


def test_grid_search_refuses_odd_folds(spark):
    df = table(spark, 8000, places=1, values=2)
    for fold, told in (("id % 4", "Fold number"), ("id % 2", "empty"), ("CASE WHEN id > 5 THEN id % 3 END", "Fold number")):
        with pytest.raises(Exception, match=told):
            M.grid_search(estimator("gbt_reg", maxIter=1), {"maxDepth": [1]}, df.withColumn("fold", F.expr(fold).cast("int")),
                          FitEvaluator("mae"), "fold")
