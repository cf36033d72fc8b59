"""Model-layer tests against brute force on small fixtures."""

import re

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from fitframe.operators import models as M
from fitframe.operators.metrics import FitEvaluator
from fitframe.operators.models import (GaussianDiscriminant, adaboost, adaboost_predict, best_round,
                                       booster_params, cross_validate, estimator, importances,
                                       knn_predict, nearest, softmax_raw)


def _fixture(spark, n=240, d=6, k=3, seed=5):
    rng = np.random.default_rng(seed)
    centers = rng.normal(0, 4, size=(k, d))
    labels = rng.integers(0, k, size=n)
    x = centers[labels] + rng.normal(0, 1, size=(n, d))
    rows = [(i, [float(v) for v in x[i]], int(labels[i])) for i in range(n)]
    return spark.createDataFrame(rows, "id long, v array<double>, label int"), x, labels


def _brute_knn(xtr, ytr, idtr, xte, k, p):
    out = []
    for q in xte:
        d = (np.abs(xtr - q) ** p).sum(1) ** (1.0 / p)
        order = np.lexsort((idtr, d))[:k]
        votes = {}
        for lab in ytr[order]:
            votes[lab] = votes.get(lab, 0) + 1
        out.append(min(votes, key=lambda lab: (-votes[lab], lab)))
    return out


@pytest.mark.parametrize("p", [2.0, 10.0])
def test_knn_blocked_equals_brute_force(spark, p):
    df, x, y = _fixture(spark)
    ids = np.arange(len(y))
    tr_mask = ids % 3 != 0
    train, test = df.where(F.col("id") % 3 != 0), df.where(F.col("id") % 3 == 0)
    got = {r.id: r.prediction for r in
           knn_predict(train, test, "id", "v", "label", k=7, p=p, block_rows=50).collect()}
    want = _brute_knn(x[tr_mask], y[tr_mask], ids[tr_mask], x[~tr_mask], 7, p)
    assert [got[i] for i in ids[~tr_mask]] == want


@pytest.mark.parametrize("p", [1.0, 2.0, 3.5, 10.0])
@pytest.mark.parametrize("kind", ["ties", "far", "huge", "nan", "outlier"])
def test_nearest_equals_brute_force_on_awkward_numbers(p, kind):
    rng = np.random.default_rng(3)
    made = {"ties": lambda n: rng.integers(0, 3, (n, 5)).astype(float), "far": lambda n: rng.normal(size=(n, 8)) + 1e6,
            "huge": lambda n: rng.normal(size=(n, 4)) * 1e200,
            "nan": lambda n: np.where(rng.random((n, 6)) < 0.05, np.nan, rng.normal(size=(n, 6))),
            "outlier": lambda n: np.where(rng.random((n, 6)) < 0.01, 1e9, rng.normal(size=(n, 6)))}[kind]
    q, r = made(40), made(5000)  # more references than one block holds
    rid = rng.permutation(len(r))
    dist, at = nearest(q, r, rid, 10, p)
    for i in range(len(q)):
        with np.errstate(all="ignore"):
            diff = np.abs(q[i] - r)
            d = np.sqrt((diff ** 2).sum(-1)) if p == 2 else (diff ** p).sum(-1) ** (1 / p)
        order = np.lexsort((rid, d))[:10]
        assert np.array_equal(at[i], order) and np.array_equal(dist[i], d[order], equal_nan=True)


def test_knn_deals_one_reference_block_to_many_tasks(spark):
    df, _, _ = _fixture(spark, n=6000, d=3)
    out = knn_predict(df.where("id % 4 = 0"), df.where("id % 4 <> 0"), "id", "v", "label", k=3)
    blocks = re.findall(r"sequence\(0, (\d+)", out._jdf.queryExecution().analyzed().toString())
    assert max(map(int, blocks)) >= 7  # of 512 queries or so, though all fit one block


def test_discriminant_matches_numpy(spark):
    df, x, y = _fixture(spark, n=300, d=4)
    cols = [F.col("v")[i].alias(f"x{i}") for i in range(4)]
    flat = df.select("id", "label", *cols)
    lda = GaussianDiscriminant([f"x{i}" for i in range(4)], "label").fit(flat)
    classes = sorted(set(y.tolist()))
    means = np.array([x[y == c].mean(0) for c in classes])
    cov = sum(((x[y == c] - means[i]).T @ (x[y == c] - means[i])) for i, c in enumerate(classes)) / (len(y) - len(classes))
    inv = np.linalg.inv(cov)
    prior = np.array([(y == c).mean() for c in classes])
    scores = x @ inv @ means.T - 0.5 * np.einsum("kd,de,ke->k", means, inv, means) + np.log(prior)
    want = np.array(classes)[scores.argmax(1)]
    got = {r.id: r.prediction for r in lda.transform(flat).collect()}
    assert [got[i] for i in range(len(y))] == want.tolist()


def test_adaboost_learns(spark):
    df, _, _ = _fixture(spark, n=300, k=3)
    data = df.select("id", F.col("label").cast("double").alias("label"), array_to_vector("v").alias("features"))
    models = adaboost(data, "label", "features", 3, rounds=3, max_depth=3)
    pred = adaboost_predict(models, data, 3)
    acc = pred.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    assert acc > 0.9


def test_patience_rule():
    assert best_round([5, 4, 3, 3.5, 3.6, 3.7, 1.0], patience=3) == 3
    assert best_round([5, 4, 3, 3.5, 2.0], patience=3) == 5


def test_booster_params_map():
    assert booster_params(eta=0.02, max_depth=30, ntrees=300, subsample=0.9, colsample_bytree=0.7) == \
        {"stepSize": 0.02, "maxDepth": 30, "maxIter": 300, "subsamplingRate": 0.9, "featureSubsetStrategy": "0.7"}
    assert booster_params(colsample_bytree=1) == {"featureSubsetStrategy": "all"}
    with pytest.raises(ValueError):
        booster_params(max_depth=64)


def test_softmax_importances_cv(spark):
    df, _, _ = _fixture(spark, n=200, k=3)
    data = df.select("id", F.col("label").cast("double").alias("label"), array_to_vector("v").alias("features"))
    ovr = estimator("onevsrest", maxIter=3, maxDepth=2).fit(data).transform(data)
    s = ovr.select(softmax_raw()).select(
        F.aggregate(vector_to_array("probability"), F.lit(0.0), lambda a, v: a + v).alias("t"))
    assert all(abs(r.t - 1) < 1e-9 for r in s.collect())
    rf = estimator("forest_cls", numTrees=5, maxDepth=3, seed=1).fit(data)
    imp = importances(rf, [f"f{i}" for i in range(6)]).collect()
    assert abs(sum(r.share for r in imp) - 1) < 1e-9
    assert [r.importance for r in imp] == sorted(r.importance for r in imp)
    from fitframe.operators.metrics import FitEvaluator
    folds = data.withColumn("fold", (F.col("id") % 3).cast("int"))
    cv = cross_validate(estimator("tree", maxDepth=3), folds, "fold", FitEvaluator("accuracy"), 3).collect()
    assert len(cv) == 4 and cv[-1].fold == -1


def test_knn_blocks_meet_without_aqe(spark):
    """The cogroup keys must match in type, or equal blocks land in different
    shuffle partitions once partitions are not coalesced into one."""
    df, x, y = _fixture(spark, n=120)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        train, test = df.where(F.col("id") % 3 != 0), df.where(F.col("id") % 3 == 0)
        got = knn_predict(train, test, "id", "v", "label", k=5, block_rows=20).count()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == test.count()


def test_early_stop_on_a_user_metric_equals_brute_force(spark):
    """The curve of a user's metric equals that of models cut by hand, over more rounds than a wave holds."""
    from fitframe.operators import models as M
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3))
    y = x[:, 0] ** 2 + 3 + rng.normal(0, 0.3, 400)
    data = spark.createDataFrame([(i, [float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, y))],
                                 "id long, v array<double>, label double").select("id", array_to_vector("v").alias("features"), "label")
    train, valid = data.where("id % 4 != 0"), data.where("id % 4 = 0")
    est = estimator("gbt_reg", maxIter=M.WAVE + 3, maxDepth=3, stepSize=0.3, seed=1)

    def mae(label, pred):
        return F.avg(F.abs(label - pred))
    kept, curve = M.fit_early_stopped(est, train, valid, patience=4, metric=mae)
    full = est.fit(train)
    rows = curve.orderBy("round").collect()
    assert [r["round"] for r in rows] == list(range(1, M.WAVE + 4))
    local = valid.collect()
    sums, want = np.zeros(len(local)), []
    for tree, w in zip(full.trees, full.treeWeights):
        sums += [w * tree.predict(r.features) for r in local]
        want.append(np.abs(sums - [r.label for r in local]).mean())
    assert np.allclose([r["valid_loss"] for r in rows], want)
    best = best_round(want, 4)
    assert [r["round"] for r in rows if r["is_best"]] == [best]
    got = kept.transform(valid).agg(mae(F.col("label"), F.col("prediction"))).first()[0]
    assert abs(got - want[best - 1]) < 1e-9


def test_discriminant_keeps_digits_and_is_wide(spark):
    """Large means cost no digits, and 300 columns fit as one array."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 300)) + 1e6
    y = rng.integers(0, 2, 200)
    df = spark.createDataFrame([([float(v) for v in r], int(c)) for r, c in zip(x, y)], "v array<double>, c int")
    lda = GaussianDiscriminant("v", "c").fit(df)
    centred = x - np.array([x[y == c].mean(0) for c in (0, 1)])[y]
    assert np.allclose(lda.cov, centred.T @ centred / 198, atol=1e-6)
    assert lda.transform(df).count() == 200


def test_assemble_lets_filters_through(spark):
    """A side of a split is filtered before its rows are assembled, with the vectors of VectorAssembler."""
    from pyspark.ml.feature import VectorAssembler
    df = spark.createDataFrame([(1, 2.0, True), (2, None, False), (None, 0.0, None), (2, float("nan"), True)],
                               "k int, x double, b boolean")
    got = M.assemble(df, ["k", "x", "b"])
    want = VectorAssembler(inputCols=["k", "x", "b"], outputCol="features", handleInvalid="keep").transform(df)
    assert [str(r.features.toArray()) for r in got.collect()] == [str(r.features.toArray()) for r in want.collect()]
    assert got.schema["features"].metadata == want.schema["features"].metadata
    plan = got.where("k % 2 = 0")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("UDF(") < plan.index("Filter ")  # the filter stands below


def test_dealt_is_even_and_whole(spark):
    df = spark.range(0, 4000, 1, 1).select("id", F.lit(None).cast("long").alias("none"), (F.col("id") % 7).alias("label"))
    df = df.union(df)
    got = M.dealt(df, ["id", "none"], ["id", "label"])
    sizes = [n for n in got.rdd.glom().map(len).collect()]
    slots = spark.sparkContext.defaultParallelism
    assert len(sizes) >= 2 * slots and len(sizes) % slots == 0 and max(sizes) < 3 * 8000 / len(sizes)
    assert sorted(got.collect()) == sorted(df.select("id", "label").collect())


def test_grid_search_holds_only_what_is_read(spark, monkeypatch):
    held = []

    class Watched(M.CrossValidator):
        def _fit(self, dataset):
            held.append(set(dataset.columns))
            return super()._fit(dataset)

    monkeypatch.setattr(M, "CrossValidator", Watched)
    rows = [(i, float(i % 5), float(i % 5) + 1, i % 3, "wide") for i in range(90)]
    df = M.assemble(spark.createDataFrame(rows, "id long, x double, label double, fold int, more string"), ["x"])
    _, report = M.grid_search(estimator("tree", maxDepth=1), {"maxDepth": [1, 3]}, df, FitEvaluator("accuracy"), "fold")
    assert held == [{"label", "features", "fold"}]
    assert report.count() == 2 and report.where("is_best").first().params == "maxDepth=3"
