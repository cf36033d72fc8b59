"""Round-by-round boosting and node tables against plain versions."""

import re
import uuid
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from fitframe.operators.boost import grow, softmax, split_importances, tree_nodes
from fitframe.operators.models import CutEnsemble, assemble, estimator, watch_curve
from fitframe.session import ensure_checkpoint_dir


def fixture(spark, n=240, seed=7, noise=0.6):
    """Three classes by two of three features, with few distinct values and some noise."""
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 12, size=(n, 3)).astype(float)
    y = np.digitize(x[:, 0] + 0.5 * x[:, 1] + rng.normal(0, noise * 4, n), [6, 10]).astype(float)
    df = spark.createDataFrame([(i, *map(float, x[i]), float(y[i])) for i in range(n)],
                               "id long, a double, b double, c double, label double")
    df = assemble(df, ["a", "b", "c"])
    return df.where("id % 4 != 0"), df.where("id % 4 = 0"), x, y


def plain_stumps(x, y, classes, rounds, eta, l2=1.0):
    """Softmax boosting of stumps: the split of least squared error of the gradient, leaves by a Newton step."""
    m = np.zeros((len(y), classes))
    stumps = []
    for _ in range(rounds):
        e = np.exp(m - m.max(1, keepdims=True))
        p = e / e.sum(1, keepdims=True)
        one = []
        for c in range(classes):
            g, h = (y == c) - p[:, c], 2 * p[:, c] * (1 - p[:, c])
            best = None
            for f in range(x.shape[1]):
                seen = np.unique(x[:, f])
                for t in (seen[1:] + seen[:-1]) / 2:
                    left = x[:, f] <= t
                    score = g[left].sum() ** 2 / left.sum() + g[~left].sum() ** 2 / (~left).sum()
                    if best is None or score > best[0] + 1e-12:
                        best = score, f, t
            _, f, t = best
            left = x[:, f] <= t
            one.append((f, t, *[eta * g[s].sum() / (h[s].sum() + l2) for s in (left, ~left)]))
        for c, (f, t, a, b) in enumerate(one):
            m[:, c] += np.where(x[:, f] <= t, a, b)
        stumps.append(one)
    return m, stumps


def test_softmax_boosting_equals_a_plain_version(spark):
    train, valid, x, y = fixture(spark)
    own = np.arange(len(y)) % 4 != 0
    m, _ = plain_stumps(x[own], y[own], 3, 5, 0.5)
    model, curve = grow(train, valid, classes=3, rounds=5, eta=0.5, max_depth=1, cut_every=2)
    assert len(model.rounds) == [r["round"] for r in curve.where("is_best").collect()][0]
    got = {r.id: r.margins for r in grow(train, train, 3, 5, eta=0.5, max_depth=1)[0].margins(train).collect()}
    assert np.allclose([got[i] for i in np.arange(len(y))[own]], m, atol=1e-9)


def log_loss(df):
    probs = vector_to_array("probability")
    return df.agg(-F.avg(F.log(F.greatest(F.lit(1e-15), F.get(probs, F.col("label").cast("int")))))).first()[0]


def test_joint_objective_learns(spark):
    train, valid, _, y = fixture(spark, n=600, noise=0.3)
    model, _ = grow(train, valid, classes=3, rounds=8, eta=0.3, max_depth=3)
    scored = model.transform(valid)
    assert log_loss(scored) < 0.8 * -np.mean(np.log([(y == v).mean() for v in y]))
    assert scored.where("prediction = label").count() > 0.6 * scored.count()


def test_boosting_stops_and_keeps_the_same_cut(spark):
    train, valid, _, _ = fixture(spark, noise=1.0)
    full, curve = grow(train, valid, rounds=14, eta=0.8, max_depth=4)
    stopped, short = grow(train, valid, rounds=14, patience=2, eta=0.8, max_depth=4)
    fitted = short.count()
    assert fitted < 14 == curve.count() and fitted == len(stopped.rounds) + 2
    losses = [r.valid_loss for r in curve.orderBy("round").collect()]
    assert [r.valid_loss for r in short.orderBy("round").collect()] == pytest.approx(losses[:fitted], abs=1e-12)
    assert losses[len(stopped.rounds) - 1] == min(losses[:fitted])
    got = stopped.transform(valid).agg(F.avg((F.col("label") - F.col("prediction")) ** 2)).first()[0]
    assert got == pytest.approx(min(losses[:fitted]), abs=1e-12)
    # grown on from where it stopped, it is what it would have been
    on, rest = grow(train, valid, rounds=2, eta=0.8, max_depth=4, start=stopped)
    assert [r.valid_loss for r in rest.orderBy("round").collect()] == pytest.approx(
        losses[len(stopped.rounds):len(stopped.rounds) + 2], abs=1e-12)


def test_odd_tables(spark):
    train, valid, _, _ = fixture(spark, n=40)
    with pytest.raises(ValueError):
        grow(train.limit(0), valid)
    model, curve = grow(train, valid.limit(0), rounds=2, patience=1, max_depth=2)  # nothing to stop by
    assert curve.count() == len(model.rounds)
    nulls = train.withColumn("label", F.when(F.col("id") % 5 != 1, F.col("label")))
    with_nulls, _ = grow(nulls, valid, rounds=1, max_depth=2)
    without, _ = grow(nulls.where("label IS NOT NULL"), valid, rounds=1, max_depth=2)
    assert with_nulls.rounds[0][0][1] == without.rounds[0][0][1]


@pytest.mark.parametrize("kind", ["gbt_reg", "forest_reg", "tree"])
def test_split_counts_equal_a_walk_of_the_model(spark, kind):
    train, _, _, _ = fixture(spark)
    extra = {"gbt_reg": {"maxIter": 4}, "forest_reg": {"numTrees": 5, "seed": 3}, "tree": {}}[kind]
    model = estimator(kind, maxDepth=3, **extra).fit(train)
    walked = Counter(re.findall(r"If \(feature (\d+) ", model.toDebugString))
    nodes = tree_nodes(model, f"{ensure_checkpoint_dir(spark)}/nodes-{uuid.uuid4().hex}")
    got = {r.feature: r for r in split_importances(nodes, ["a", "b", "c", "unused"]).collect()}
    assert {n: got[n].splits for n in "abc"} == {n: walked[str(i)] for i, n in enumerate("abc")}
    assert got["unused"].splits == 0 and got["unused"].gain is None
    trees = nodes.select("tree").distinct().count()
    assert nodes.count() == 2 * sum(walked.values()) + trees
    if kind == "gbt_reg":  # no bootstrap: the root of every tree holds all rows
        assert {r.rows for r in nodes.where("node = 0").collect()} == {train.count()}


def test_softmax_is_worked_out_once_a_row(spark):
    rows = [[0.0, 1.5, -2.0], [900.0, -900.0, 0.0], [float("nan"), 1.0, 2.0], [-3.0, -3.0, -3.0]]
    df = spark.createDataFrame([(r,) for r in rows], "m array<double>")
    out = df.select("m", softmax(F.col("m"), 3).alias("written"), softmax(F.col("m")).alias("any"))
    for r in out.collect():
        with np.errstate(all="ignore"):
            e = np.exp(np.array(r.m) - np.max(r.m))
        assert np.allclose(r.written, e / e.sum(), equal_nan=True) and np.array_equal(r.written, r.any, equal_nan=True)
    plan = df.select(softmax(F.col("m"), 3).alias("p"))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan  # compiled
    plan = df.select(softmax(F.col("m")).alias("p"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_max(") == 1 and plan.count("aggregate(") == 1


def test_watch_curve_copies_no_row_for_its_rounds(spark):
    df = assemble(spark.range(200).selectExpr("id", "CAST(id % 7 AS DOUBLE) AS x", "CAST(id % 7 > 3 AS DOUBLE) AS label"), ["x"])
    model = estimator("gbt_reg", maxIter=4, maxDepth=2).fit(df)
    curve = watch_curve(model, df, df.where("id < 50"))
    assert "posexplode" not in curve._jdf.queryExecution().optimizedPlan().toString()
    for n, train, valid in [tuple(r) for r in curve.orderBy("round").collect()]:
        cut = CutEnsemble(model, n)
        for side, want in ((df, train), (df.where("id < 50"), valid)):
            got = cut.transform(side).agg(F.avg((F.col("label") - F.col("prediction")) ** 2)).first()[0]
            assert abs(got - want) < 1e-12
    assert curve.count() == 4 and watch_curve(model, df, df.where("id < 0")).count() == 0
