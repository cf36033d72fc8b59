"""Model queries: fit on the train side of a driver table, score the test
side.  Models need not match the reference numerically, so a query tells what
SQL can hold it to: how many rows were fitted and scored, whether every row got
a finite prediction (probabilities summing to 1), and whether the loss is within
a bound set by that of the best constant (see ``UNSEEN``).  Exact kNN and the discriminant moments
are compared value by value."""

from __future__ import annotations

import uuid

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from ..functions.arith import log_target
from ..operators.boost import grow, split_importances, tree_nodes
from ..operators.encode import LabelEncoder
from ..operators.metrics import FitEvaluator, inverse_square_weight, logloss
from ..operators.models import (GaussianDiscriminant, adaboost, adaboost_predict, assemble,
                                booster_params, cross_validate, dealt, estimator, fit_early_stopped,
                                grid_search, importances, knn_predict, softmax_raw, suite)
from ..operators.post import finish
from ..operators.schema import class_probabilities, positive_probability
from ..operators.split import expr_split, fold_column, holdout, modulo_condition
from ..session import cut_lineage, ensure_checkpoint_dir
from ..sources.sinks import run_tagged_path, write_feature_map, write_importances
from .registry import R6, query, r6, table

LI_FEATURES = ["l_quantity", "l_discount", "l_tax", "rf", "ls", "ship_year"]
LI_KEYS = ["l_orderkey", "l_linenumber", "l_partkey"]


def lineitem_matrix(spark, sf, label: str = "price"):
    """Assembled lineitem table: codes for the flags, log1p price label
    or the binary 'returned' label; split by key modulo (S2)."""
    li = table(spark, sf, "lineitem").select(
        *LI_KEYS, "l_quantity", "l_discount", "l_tax", "l_extendedprice", "l_returnflag",
        "l_linestatus", F.year("l_shipdate").alias("ship_year"))
    li = LabelEncoder(["l_returnflag", "l_linestatus"], ["rf", "ls"]).fit(li).transform(li)
    if label == "price":
        li = li.withColumn("label", log_target("l_extendedprice"))
        feats = LI_FEATURES
    else:
        li = li.withColumn("label", (F.col("l_returnflag") == "R").cast("double"))
        feats = [f for f in LI_FEATURES if f != "rf"]
    li = assemble(li, feats)
    return expr_split(li, modulo_condition("l_orderkey"))


def embeddings_matrix(spark, sf):
    e = table(spark, sf, "embeddings")
    e = e.select("vec_id", F.col("label").cast("double").alias("label"),
                 array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"))
    return expr_split(e, modulo_condition("vec_id"))


def _sides(table_name: str, key: str, keys: list[str], model: str) -> str:
    """What SQL knows of a model query: the sizes of both sides, and that the rest must hold."""
    test = f"({key} % 10) < 5"
    return f"""
SELECT '{model}' AS model, count(*) FILTER (WHERE NOT {test}) AS n_train, count(*) FILTER (WHERE {test}) AS n_test,
       count(DISTINCT ({', '.join(keys)})) FILTER (WHERE {test}) AS n_scored, TRUE AS loss_in_bound
FROM {table_name}"""


LI_SQL = {m: _sides("lineitem", "l_orderkey", LI_KEYS, m)
          for m in ("fit_gbt_reg", "fit_forest_reg", "fit_gbt_cls", "fit_logistic", "fit_bayes")}
EMB_SQL = {m: _sides("embeddings", "vec_id", ["vec_id"], m)
           for m in ("fit_forest_multi", "fit_tree", "fit_extra_trees", "fit_mlp", "fit_onevsrest", "fit_adaboost",
                     "fit_discriminant")}


def _told(model: str, train, pred, keys: list[str], finite, loss, base, share: float):
    """One row: the counts of both sides, and whether the mean loss is at most ``share`` of the constant's."""
    row = pred.agg(
        F.count(F.lit(1)).alias("n_test"), F.count_distinct(F.when(finite, F.struct(*keys))).alias("n_scored"),
        (F.avg(loss) <= share * F.avg(base)).alias("loss_in_bound"))
    n_train = train.select(F.count(F.lit(1))).scalar()
    return row.select(F.lit(model).alias("model"), n_train.alias("n_train"), "n_test", "n_scored", "loss_in_bound")


def _is_number(c):
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def _regression(model: str, fitted, train, test, keys: list[str], share: float):
    """Squared error against that of the training mean; the submitted value (O3) is checked too."""
    mean = train.agg(F.avg("label")).first()[0]
    whole = fitted.transform(test).select(F.struct(*keys, "label", F.col("prediction").alias("_raw")).alias("_id"), "prediction")
    pred = finish(whole, "_id", "prediction", "submitted").select("_id.*", "submitted")
    y = F.col("label")
    return _told(model, train, pred, keys, _is_number("submitted") & (F.col("submitted") >= 0),
                 (y - F.col("_raw")) ** 2, (y - mean) ** 2, share)


def _sums_to_one(probs):
    return F.abs(F.aggregate(probs, F.lit(0.0), lambda a, v: a + v) - 1) < 1e-6


def _binary(model: str, fitted, train, test, share: float):
    """Log-loss against that of the training share."""
    rate = F.lit(train.agg(F.avg("label")).first()[0])
    pred = fitted.transform(test).select(
        *LI_KEYS, "label", positive_probability().alias("p1"), vector_to_array("probability").alias("probs"))
    y = F.col("label")

    def loss(q):
        q = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), q))
        return -(y * F.log(q) + (1 - y) * F.log(1 - q))
    return _told(model, train, pred, LI_KEYS, _is_number("p1") & _sums_to_one(F.col("probs")), loss(F.col("p1")),
                 loss(rate), share)


@query("fit_gbt_reg", LI_SQL["fit_gbt_reg"])
def fit_gbt_reg(spark, sf):
    _, train, test = lineitem_matrix(spark, sf)
    est = estimator("gbt_reg", **booster_params(ntrees=20, max_depth=5, eta=0.1))
    return _regression("fit_gbt_reg", est.fit(dealt(train, LI_KEYS)), train, test, LI_KEYS, UNSEEN)


@query("fit_forest_reg", LI_SQL["fit_forest_reg"])
def fit_forest_reg(spark, sf):
    _, train, test = lineitem_matrix(spark, sf)
    est = estimator("forest_reg", numTrees=20, maxDepth=8, seed=1)
    return _regression("fit_forest_reg", est.fit(train), train, test, LI_KEYS, UNSEEN)


@query("fit_gbt_cls", LI_SQL["fit_gbt_cls"])
def fit_gbt_cls(spark, sf):
    _, train, test = lineitem_matrix(spark, sf, "returned")
    return _binary("fit_gbt_cls", estimator("gbt_cls", maxIter=10, maxDepth=4).fit(train), train, test, UNSEEN)


@query("fit_logistic", LI_SQL["fit_logistic"])
def fit_logistic(spark, sf):
    _, train, test = lineitem_matrix(spark, sf, "returned")
    return _binary("fit_logistic", estimator("logistic", maxIter=30).fit(train), train, test, UNSEEN)


@query("fit_bayes", LI_SQL["fit_bayes"])
def fit_bayes(spark, sf):
    _, train, test = lineitem_matrix(spark, sf, "returned")
    return _binary("fit_bayes", estimator("bayes").fit(train), train, test, UNSEEN)


CLASSES = [f"class_{i}" for i in range(10)]
#: The labels of the driver tables are drawn without regard to the features, so on
#: unseen rows a good model's loss is about the constant's: at most this share of it.
UNSEEN = 1.2
#: What a fit learns then shows only on the rows it has seen: the few hundred or
#: thousand vectors of ``embeddings``, which a tree or a layer can partly learn by heart.
LEARNT = 0.97


def _multi(model: str, transform, train, test):
    """Share of wrong labels on both sides against that of the commonest training label."""
    common = F.lit(train.groupBy("label").count().orderBy(F.desc("count"), "label").first()["label"])
    y, wrong = F.col("label"), (F.col("label") != F.col("prediction")).cast("double")
    learnt = transform(train).agg((F.avg(wrong) <= LEARNT * F.avg((y != common).cast("double"))).alias("ok"))
    pred = transform(test)
    finite = _is_number("prediction")
    if "probability" in pred.columns:
        label_text = F.concat(F.lit("class_"), F.col("prediction").cast("int").cast("string"))  # C11
        pred = pred.select("vec_id", "label", "prediction", label_text.alias("predicted_class"),
                           *class_probabilities("probability", CLASSES))  # B3
        finite = finite & _sums_to_one(F.array(*CLASSES)) & F.col("predicted_class").isin(CLASSES)
    told = _told(model, train, pred, ["vec_id"], finite, wrong, (y != common).cast("double"), UNSEEN)
    return told.withColumn("loss_in_bound", F.col("loss_in_bound") & F.lit(learnt.first()["ok"]))


@query("fit_forest_multi", EMB_SQL["fit_forest_multi"])
def fit_forest_multi(spark, sf):
    _, train, test = embeddings_matrix(spark, sf)
    est = estimator("forest_cls", numTrees=30, maxDepth=10, seed=1)
    return _multi("fit_forest_multi", est.fit(train).transform, train, test)


@query("fit_tree", EMB_SQL["fit_tree"])
def fit_tree(spark, sf):
    _, train, test = embeddings_matrix(spark, sf)
    return _multi("fit_tree", estimator("tree", maxDepth=8).fit(train).transform, train, test)


@query("fit_extra_trees", EMB_SQL["fit_extra_trees"])
def fit_extra_trees(spark, sf):
    _, train, test = embeddings_matrix(spark, sf)
    est = estimator("extra_trees", numTrees=30, maxDepth=10, seed=1)
    return _multi("fit_extra_trees", est.fit(train).transform, train, test)


@query("fit_mlp", EMB_SQL["fit_mlp"])
def fit_mlp(spark, sf):
    _, train, test = embeddings_matrix(spark, sf)
    est = estimator("mlp", layers=[64, 32, 10], maxIter=50, seed=1)
    return _multi("fit_mlp", est.fit(train).transform, train, test)


@query("fit_onevsrest", EMB_SQL["fit_onevsrest"])
def fit_onevsrest(spark, sf):
    _, train, test = embeddings_matrix(spark, sf)
    model = estimator("onevsrest", maxIter=5, maxDepth=3).fit(train)
    return _multi("fit_onevsrest", lambda d: model.transform(d).withColumn("probability", softmax_raw()), train, test)


@query("fit_adaboost", EMB_SQL["fit_adaboost"])
def fit_adaboost(spark, sf):
    _, train, test = embeddings_matrix(spark, sf)
    models = adaboost(train.select("vec_id", "label", "features"), "label", "features", 10,
                      rounds=4, max_depth=5)
    return _multi("fit_adaboost", lambda d: adaboost_predict(models, d.select("vec_id", "label", "features"), 10), train, test)


@query("fit_discriminant", EMB_SQL["fit_discriminant"])
def fit_discriminant(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    _, train, test = expr_split(e, modulo_condition("vec_id"))
    lda = GaussianDiscriminant("embedding", "label").fit(train)
    return _multi("fit_discriminant", lda.transform, train, test)


@query("knn_exact", """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label, (vec_id % 10) >= 5 AS is_train
           FROM embeddings),
d AS (SELECT q.vec_id AS qid, r.vec_id AS rid, r.label, list_distance(q.v, r.v) AS dist
      FROM e q JOIN e r ON (NOT q.is_train) AND r.is_train),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, rid) AS rn FROM d)
        WHERE rn <= 10),
votes AS (SELECT qid, label, count(*) AS n FROM top GROUP BY qid, label)
SELECT qid AS vec_id, CAST(label AS BIGINT) AS prediction FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY n DESC, label) AS r FROM votes) WHERE r = 1""")
def knn_exact(spark, sf):
    e = table(spark, sf, "embeddings")
    _, train, test = expr_split(e, modulo_condition("vec_id"))
    return knn_predict(train, test, "vec_id", "embedding", "label", k=10, p=2.0)


@query("knn_minkowski", """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label, (vec_id % 10) >= 5 AS is_train
           FROM embeddings),
d AS (SELECT q.vec_id AS qid, r.vec_id AS rid, r.label,
             pow(list_sum(list_transform(range(len(q.v)),
                 lambda i: pow(abs(q.v[i + 1] - r.v[i + 1]), 10))), 0.1) AS dist
      FROM e q JOIN e r ON (NOT q.is_train) AND r.is_train),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, rid) AS rn FROM d)
        WHERE rn <= 10),
votes AS (SELECT qid, label, count(*) AS n FROM top GROUP BY qid, label)
SELECT qid AS vec_id, CAST(label AS BIGINT) AS prediction FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY n DESC, label) AS r FROM votes) WHERE r = 1""")
def knn_minkowski(spark, sf):
    """K9 with the reference's second setting: Minkowski p = 10."""
    e = table(spark, sf, "embeddings")
    _, train, test = expr_split(e, modulo_condition("vec_id"))
    return knn_predict(train, test, "vec_id", "embedding", "label", k=10, p=10.0)


MOMENTS_SQL = f"""
WITH e AS (SELECT vec_id, label, unnest(range(len(embedding)))::INTEGER AS i,
                  CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
m AS (SELECT label, i, avg(x) AS m FROM e GROUP BY label, i),
d AS (SELECT vec_id, i, x - m AS v FROM e JOIN m USING (label, i)),
t AS (SELECT CAST(count(*) - count(DISTINCT label) AS DOUBLE) AS dof FROM embeddings)
SELECT CAST(label AS BIGINT) AS label, 'mean' AS stat, i, -1 AS j, {R6('m')} AS value FROM m
UNION ALL
SELECT CAST(-1 AS BIGINT) AS label, 'cov' AS stat, a.i, b.i AS j, {R6('sum(a.v * b.v) / (SELECT dof FROM t)')} AS value
FROM d a JOIN d b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY a.i, b.i"""


@query("discriminant_moments", MOMENTS_SQL)
def discriminant_moments(spark, sf):
    """Class means and pooled within-class covariance of all dimensions, as the discriminant fits them."""
    lda = GaussianDiscriminant("embedding", "label").fit(table(spark, sf, "embeddings"))
    rows = [(int(c), "mean", i, -1, float(v)) for c, m in zip(lda.classes, lda.means) for i, v in enumerate(m)]
    rows += [(-1, "cov", i, j, float(lda.cov[i, j])) for i in range(len(lda.cov)) for j in range(i, len(lda.cov))]
    out = spark.createDataFrame(rows, "label long, stat string, i int, j int, value double")
    return out.withColumn("value", r6("value"))

# ---------------------------------------------------------------- selection


@query("fit_chain", _sides("orders", "o_orderkey", ["o_orderkey"], "fit_chain"))
def fit_chain(spark, sf):
    """Impute -> encode -> scale -> assemble -> boosted trees as one ``Pipeline``."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler

    from ..operators.encode import ZScore
    from ..operators.impute import MixedImputer
    from .q_core import customer_with_nulls
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice",
                                         F.month("o_orderdate").alias("month"))
    j = o.join(customer_with_nulls(spark, sf), F.col("o_custkey") == F.col("c_custkey"), "left") \
        .withColumn("label", log_target("o_totalprice"))
    _, train, test = expr_split(j, modulo_condition("o_orderkey"))
    pipe = Pipeline(stages=[
        MixedImputer(["c_acctbal", "c_mktsegment"]),
        LabelEncoder(["c_mktsegment"], ["seg_code"]),
        ZScore(["c_acctbal"], ["z_acctbal"]),
        VectorAssembler(inputCols=["seg_code", "z_acctbal", "month", "c_nationkey"], outputCol="features",
                        handleInvalid="keep"),
        estimator("gbt_reg", maxIter=10, maxDepth=4)])
    return _regression("fit_chain", pipe.fit(train), train, test, ["o_orderkey"], UNSEEN)


CV_METRICS = ["auc", "gini", "logloss", "multi_logloss"]


@query("cv_scores", f"""
SELECT CAST(fold AS INTEGER) AS fold, metric, TRUE AS in_range, TRUE AS is_mean_of_folds
FROM (SELECT unnest([-1, 0, 1, 2, 3, 4]) AS fold), (SELECT unnest({CV_METRICS}) AS metric)""")
def cv_scores(spark, sf):
    """Five folds, each fitted once and scored by four metrics; fold -1 is the mean."""
    flagged, _, _ = lineitem_matrix(spark, sf, "returned")
    df = fold_column(flagged, LI_KEYS, k=5, seed=1337).withColumn("row", F.xxhash64(*LI_KEYS))
    metrics = {m: FitEvaluator(m, tiebreakCol="row") for m in CV_METRICS}
    df = dealt(df, LI_KEYS, ["label", "features", "fold", "row"])
    scores = cross_validate(estimator("logistic", maxIter=10), df, "fold", metrics, 5)
    means = scores.where("fold >= 0").groupBy("metric").agg(F.avg("score").alias("mean"))
    score = F.col("score")
    in_range = (F.when(F.col("metric") == "auc", score.between(0, 1)).when(F.col("metric") == "gini", F.abs(score) <= 1)
                .otherwise((score > 0) & (score < 1)))
    return scores.join(means, "metric").select(
        "fold", "metric", in_range.alias("in_range"),
        ((F.col("fold") >= 0) | (F.abs(score - F.col("mean")) < 1e-9)).alias("is_mean_of_folds"))


@query("grid_scores", """
SELECT 'maxDepth=' || d || ', stepSize=' || s AS params, TRUE AS in_range, TRUE AS best_is_least
FROM (SELECT unnest(['2', '4']) AS d), (SELECT unnest(['0.1', '0.3']) AS s)""")
def grid_scores(spark, sf):
    """Every point of the grid scored, and the one of least loss told as the best."""
    flagged, _, _ = lineitem_matrix(spark, sf)
    df = fold_column(flagged, LI_KEYS, k=3, seed=1337)
    est = estimator("gbt_reg", maxIter=5)
    _, report = grid_search(est, {"maxDepth": [2, 4], "stepSize": [0.1, 0.3]}, df,
                            FitEvaluator("rmspe", unlog=True), "fold", parallelism=2, deal=LI_KEYS)
    least = report.select(F.min("mean_metric")).scalar()
    return report.select("params", (F.col("mean_metric") > 0).alias("in_range"),
                         (F.col("is_best") == (F.col("mean_metric") == least)).alias("best_is_least"))


@query("suite_leaderboard", """
SELECT unnest(['logistic', 'tree', 'forest', 'bayes', 'gbt']) AS model, 'logloss' AS metric, TRUE AS loss_in_bound""")
def suite_leaderboard(spark, sf):
    """Five models on one holdout, each against the log-loss of the training share."""
    _, train, test = lineitem_matrix(spark, sf, "returned")
    models = {"logistic": estimator("logistic", maxIter=20),
              "tree": estimator("tree", maxDepth=5, minInstancesPerNode=100),
              "forest": estimator("forest_cls", numTrees=10, maxDepth=5, seed=1),
              "bayes": estimator("bayes"),
              "gbt": estimator("gbt_cls", maxIter=5, maxDepth=3)}

    def metric(pred):
        return logloss(pred.select("label", positive_probability().alias("p")), "label", "p")
    board = suite(models, cut_lineage(dealt(train, LI_KEYS)), test, metric, "logloss", parallelism=2)
    rate = F.lit(train.agg(F.avg("label")).first()[0])
    constant = logloss(test, "label", rate).first()[0]
    return board.select("model", "metric", (F.col("value") <= UNSEEN * constant).alias("loss_in_bound"))


def rmspe_of_logs(y, p):
    """RMSPE of values whose logs were fitted, as an aggregate (M8)."""
    y, p = F.expm1(y), F.expm1(p)
    return F.sqrt(F.avg(inverse_square_weight(y) * (y - p) * (y - p)))


@query("early_stop", """
SELECT count(*) AS n_rows, 15 AS n_rounds, TRUE AS curve_is_finite, TRUE AS best_is_least_so_far, TRUE AS kept_scores_alike
FROM lineitem""")
def early_stop(spark, sf):
    """Boosting stopped on a user's metric over a watchlist of both sides; the model kept is a cut of the one fitted."""
    flagged, _, _ = lineitem_matrix(spark, sf)
    df = holdout(flagged, LI_KEYS, 0.05, seed=1337, flag="is_valid")
    train, valid = df.where("NOT is_valid"), df.where("is_valid")
    est = estimator("gbt_reg", maxIter=15, maxDepth=4)
    model, curve = fit_early_stopped(est, train, valid, patience=3, metric=rmspe_of_logs)
    rows = curve.collect()  # one row a round
    (best,) = [r for r in rows if r["is_best"]]
    kept = model.transform(valid).agg(rmspe_of_logs(F.col("label"), F.col("prediction"))).first()[0]
    least = all(best["valid_loss"] <= r["valid_loss"] for r in rows if r["round"] <= best["round"] + 3)
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(len(rows)).alias("n_rounds"),
        F.lit(all(0 < r[c] < float("inf") for r in rows for c in ("train_loss", "valid_loss"))).alias("curve_is_finite"),
        F.lit(least).alias("best_is_least_so_far"),
        F.lit(abs(kept - best["valid_loss"]) < 1e-9).alias("kept_scores_alike"))


@query("importances", f"""
SELECT unnest({LI_FEATURES}) AS feature, unnest(range({len(LI_FEATURES)}))::INTEGER AS place, TRUE AS is_share,
       TRUE AS sums_to_one, TRUE AS file_agrees""")
def importances_q(spark, sf):
    """Shares of importance, and the two files as read back: the feature map (B5) and the importances."""
    _, train, _ = lineitem_matrix(spark, sf)
    model = estimator("forest_reg", numTrees=10, maxDepth=6, seed=1).fit(train)
    table_ = importances(model, LI_FEATURES)
    base = f"{ensure_checkpoint_dir(spark)}/fitframe-out/{uuid.uuid4().hex}"
    map_path, table_path = run_tagged_path(base, fmap="rf", trees=10), run_tagged_path(base, importance="rf", trees=10)
    write_feature_map(spark, LI_FEATURES, map_path)           # B5
    write_importances(table_, table_path)                     # B6
    line = F.split("value", "\t")
    places = spark.read.text(map_path).select(F.trim(line[1]).alias("feature"), F.trim(line[0]).cast("int").alias("place"))
    read = spark.read.option("header", True).csv(table_path)
    read = read.select("feature", F.col("share").cast("double").alias("read_share"))
    total = table_.select(F.sum("share")).scalar()
    return table_.join(places, "feature").join(read, "feature").select(
        "feature", "place", F.col("share").between(0, 1).alias("is_share"),
        (F.abs(total - 1) < 1e-9).alias("sums_to_one"), (F.abs(F.col("share") - F.col("read_share")) < 1e-9).alias("file_agrees"))


#: A label that the features decide: what a fit learns of it shows on unseen rows too.
SIGNAL = 0.8


@query("fit_softmax", _sides("lineitem", "l_orderkey", LI_KEYS, "fit_softmax"))
def fit_softmax(spark, sf):
    """Joint softmax boosting on a class that the features decide, well below the constant's log-loss (K2, K3)."""
    flagged, _, _ = lineitem_matrix(spark, sf)
    label = F.when(F.col("l_quantity") > 25, 2).when(F.col("l_discount") > 0.05, 1).otherwise(0).cast("double")
    _, train, test = expr_split(flagged.withColumn("label", label), modulo_condition("l_orderkey"))
    model, _ = grow(train, test, classes=3, rounds=4, eta=0.5, max_depth=3, seed=1)
    pred = model.transform(test).withColumn("probs", vector_to_array("probability"))
    shares = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.count("*").alias("n")).collect()}  # one a class
    constant = F.get(F.array(*[F.lit(shares.get(float(c), 0) / sum(shares.values())) for c in range(3)]),
                     F.col("label").cast("int"))
    own = F.get("probs", F.col("label").cast("int"))
    return _told("fit_softmax", train, pred, LI_KEYS, _sums_to_one(F.col("probs")), -F.log(own), -F.log(constant), SIGNAL)


@query("boost_stopped", """
SELECT count(*) AS n_rows, TRUE AS stopped_by_itself, TRUE AS curve_is_finite, TRUE AS best_is_least, TRUE AS kept_scores_alike
FROM lineitem""")
def boost_stopped(spark, sf):
    """Boosting on a label without a signal ends by patience, long before its last round."""
    flagged, _, _ = lineitem_matrix(spark, sf)
    df = holdout(flagged, LI_KEYS, 0.05, seed=1337, flag="is_valid")
    train, valid = df.where("NOT is_valid"), df.where("is_valid")
    model, curve = grow(train, valid, rounds=40, patience=2, eta=0.5, max_depth=4, metric=rmspe_of_logs, seed=1)
    rows = curve.collect()  # one row a round
    (best,) = [r for r in rows if r["is_best"]] or [None]
    kept = model.transform(valid).agg(rmspe_of_logs(F.col("label"), F.col("prediction"))).first()[0]
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(len(rows) < 40).alias("stopped_by_itself"),
        F.lit(all(0 < r[c] < float("inf") for r in rows for c in ("train_loss", "valid_loss"))).alias("curve_is_finite"),
        F.lit(best["valid_loss"] == min(r["valid_loss"] for r in rows)).alias("best_is_least"),
        F.lit(abs(kept - best["valid_loss"]) < 1e-9).alias("kept_scores_alike"))


@query("split_counts", f"""
WITH t AS (SELECT CAST(l_quantity > 25 AS INTEGER) AS q, CAST(l_discount > 0.05 AS INTEGER) AS d FROM lineitem
           WHERE (l_orderkey % 10) >= 5),
k AS (SELECT q, count(*) AS n, var_pop(d) AS v FROM t GROUP BY q),
r AS (SELECT 1 AS splits, var_pop(2 * q + d) - (SELECT sum(n * v) / sum(n) FROM k) AS gain,
             CAST(count(*) AS DOUBLE) AS cover FROM t),
c AS (SELECT 'l_quantity' AS feature, splits, gain, cover FROM r
      UNION ALL SELECT 'l_discount', count(*), avg(v), avg(n) FROM k)
SELECT f.feature, CAST(coalesce(splits, 0) AS BIGINT) AS splits, {R6('gain')} AS gain, cover
FROM (SELECT unnest({LI_FEATURES}) AS feature) f LEFT JOIN c ON c.feature = f.feature""")
def split_counts(spark, sf):
    """Split counts, gain and cover of a tree whose label fixes its three splits, from its node table."""
    _, train, _ = lineitem_matrix(spark, sf)
    label = 2 * (F.col("l_quantity") > 25).cast("int") + (F.col("l_discount") > 0.05).cast("int")
    fitted = DecisionTreeRegressor(maxDepth=2, maxBins=64, seed=1).fit(train.withColumn("label", label.cast("double")))
    path = f"{ensure_checkpoint_dir(spark)}/fitframe-out/{uuid.uuid4().hex}"
    found = split_importances(tree_nodes(fitted, path), LI_FEATURES)
    return found.select("feature", F.col("splits").cast("long").alias("splits"), r6("gain").alias("gain"),
                        F.col("cover").cast("double").alias("cover"))
