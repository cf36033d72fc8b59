"""Model fitting, selection and scoring (K1-K21) on ``pyspark.ml``.

MLlib estimators replace the reference's single-machine solvers (the table
contract and the metric code are what must match, not the trees).  The
pieces MLlib lacks are written as distributed DataFrame jobs:

* :func:`adaboost` -- SAMME.R boosting as a loop of weighted
  ``DecisionTreeClassifier`` fits, the weights kept as a column and the
  lineage cut every round;
* :func:`knn_predict` -- exact k nearest neighbours as a blocked nested
  loop: queries and reference rows are split into bounded blocks, each
  (query block, reference block) pair meets in one ``cogroup`` task where
  one matrix product rules out most pairs (:func:`nearest`) and only the k
  best candidates per query leave the task; a final grouped top-k merges the blocks.  No pair
  is ever materialised as a row and no group holds a whole table.
* :class:`GaussianDiscriminant` -- LDA from class means and partial sums of
  centred outer products; scoring is a pure column expression.
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Predictor
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LogisticRegression,
                                       MultilayerPerceptronClassifier, NaiveBayes, OneVsRest,
                                       RandomForestClassifier)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.ml.stat import Summarizer
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from ..session import cut_lineage, reuse_if_shuffled
from .cells import CELL, count_cells, countable, find_fold_bins, fit_cells, fit_counted, per_cell
from .folds import fold_scores, out_of_fold
from .metrics import FitEvaluator


def assemble(df: DataFrame, features: list[str], out: str = "features") -> DataFrame:
    """Dense feature vector from columns (the training matrix, C13); NULL becomes NaN.

    ``VectorAssembler`` marks its function as non-deterministic, so a filter
    set after it (a side of a split, a fold) is worked out only on assembled
    rows: every read of a side would encode and assemble the whole table.
    Numeric columns go by an expression that lets filters through.
    """
    fields = {f.name: f for f in df.schema.fields}
    plain = [c in fields and isinstance(fields[c].dataType, (NumericType, BooleanType)) and not fields[c].metadata.get("ml_attr")
             for c in features]
    if not features or not all(plain) or out in fields:
        return VectorAssembler(inputCols=features, outputCol=out, handleInvalid="keep").transform(df)
    values = [F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(float("nan"))) for c in features]
    names = {"numeric": [{"idx": i, "name": c} for i, c in enumerate(features)]}
    told = {"ml_attr": {"attrs": names, "num_attrs": len(features)}}
    return df.select("*", array_to_vector(F.array(*values)).alias(out, metadata=told))


def dealt(df: DataFrame, keys: list[str], columns: list[str] = ("label", "features")) -> DataFrame:
    """``columns`` of ``df`` dealt evenly over all task slots by a hash of ``keys``, for a fit.

    A fit passes over its rows many times, in the partitions that the files
    happen to give: with few or uneven row groups most slots wait for the
    longest.  The fit also reads its input once for its metadata, once for its
    splits and once for its points; the exchange keeps what it reads, so the
    rows are read from the files and assembled once.
    """
    spark = df.sparkSession
    slots = spark.sparkContext.defaultParallelism
    waves = max(2, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // slots))
    return df.repartition(waves * slots, *[F.col(f"`{k}`") for k in keys]).select(*columns)


# The reference's booster parameter names mapped to MLlib's.
BOOSTER_PARAMS = {"eta": "stepSize", "max_depth": "maxDepth", "ntrees": "maxIter",
                  "min_child_weight": "minInstancesPerNode", "subsample": "subsamplingRate",
                  "gamma": "minInfoGain"}


#: Fixed value: the deepest tree MLlib builds.
MAX_DEPTH = 30


def booster_params(**kw) -> dict:
    """Translate booster settings to MLlib params.

    MLlib trees are at most 30 deep: a greater ``max_depth`` is an error, not
    a quiet cut.  ``colsample_bytree`` is a share of the features: 1 is all.
    """
    out = {}
    for k, v in kw.items():
        if k == "colsample_bytree":
            out["featureSubsetStrategy"] = "all" if float(v) == 1.0 else str(float(v))
        elif k == "max_depth" and int(v) > MAX_DEPTH:
            raise ValueError(f"max_depth {v}: trees here are at most {MAX_DEPTH} deep")
        elif k in BOOSTER_PARAMS:
            out[BOOSTER_PARAMS[k]] = int(v) if k == "max_depth" else v
        else:
            out[k] = v
    return out


def estimator(kind: str, label: str = "label", features: str = "features", **params):
    """The MLlib estimator for each model kind of the reference."""
    common = {"labelCol": label, "featuresCol": features}
    if kind == "gbt_reg":                       # K1
        return GBTRegressor(**common, **params)
    if kind == "gbt_cls":                       # K2
        return GBTClassifier(**common, **params)
    if kind == "forest_cls":                    # K4
        return RandomForestClassifier(**common, **params)
    if kind == "forest_reg":                    # K5
        return RandomForestRegressor(**common, **params)
    if kind == "extra_trees":                   # K6: no bootstrap, random feature subsets
        return RandomForestClassifier(**common, bootstrap=False, featureSubsetStrategy="sqrt", **params)
    if kind == "tree":                          # K7
        return DecisionTreeClassifier(**common, **params)
    if kind == "bayes":                         # K11
        return NaiveBayes(**common, modelType="gaussian", **params)
    if kind == "logistic":                      # K12
        return LogisticRegression(**common, **params)
    if kind == "mlp":                           # K13 (sigmoid hidden layers)
        return MultilayerPerceptronClassifier(**common, **params)
    if kind == "onevsrest":                     # K3: multiclass boosting
        return OneVsRest(classifier=GBTClassifier(**params), **common)
    raise ValueError(kind)


def softmax_raw(raw: str = "rawPrediction", out: str = "probability") -> Column:
    """Class probabilities from OneVsRest raw scores (it gives none).

    A raw score is half the log-odds of its class against the rest, so each
    class gets ``1 / (1 + exp(-2 raw))``; the row is then brought to sum 1.
    """
    each = F.transform(vector_to_array(F.col(raw)), lambda x: 1 / (1 + F.exp(F.greatest(F.lit(-300.0), -2 * x))))
    total = F.aggregate(each, F.lit(0.0), lambda acc, x: acc + x)
    return array_to_vector(F.transform(each, lambda x: x / total)).alias(out)


def score(model, df: DataFrame, id_col: str, keep: list[str] = ()) -> DataFrame:
    """Batch scoring (K19, C15): one ``transform`` instead of a per-row loop."""
    out = model.transform(df)
    extra = ["probability"] if "probability" in out.columns else []
    return out.select(id_col, *keep, "prediction", *extra)


def suite(models: dict, train: DataFrame, test: DataFrame, metric_fn, metric_name: str,
          parallelism: int = 1) -> DataFrame:
    """Fit each estimator on train, score test, one metric row per model.

    ``parallelism`` > 1 submits the fits from that many threads (as
    ``CrossValidator`` does), so small fits share the cluster's task slots.
    """
    def run(item):
        name, est = item
        value = metric_fn(est.fit(train).transform(test)).first()[0]
        return (name, metric_name, float(value))

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        rows = list(pool.map(run, models.items()))  # order of ``models`` is kept
    return train.sparkSession.createDataFrame(rows, "model string, metric string, value double")


def cross_validate(est, df: DataFrame, fold_col: str, evaluator, k: int) -> DataFrame:
    """Manual k-fold loop (K15): fit on the other folds, score the held-out
    fold; returns (fold, score) plus the mean as fold -1 (M12).

    ``evaluator`` may be a dict of evaluators by name: each fold is fitted once
    and scored by all of them, and the result has a column ``metric`` too.
    Evaluators of this library read one table of all held-out predictions
    (:mod:`folds`); a fold without rows then has no score, an undefined one is
    null, and neither counts in the mean.
    """
    df = reuse_if_shuffled(df)  # k fits read it: materialise once if its plan shuffles
    many = evaluator if isinstance(evaluator, dict) else {"score": evaluator}
    rows = []
    if k and all(isinstance(e, FitEvaluator) for e in many.values()):
        keep = {fold_col, *[c for e in many.values() for c in (e.labelCol, e.tiebreakCol) if c]}
        held_out = out_of_fold(est, df, fold_col, k, sorted(keep))
        rows = [tuple(r) for r in fold_scores(held_out, fold_col, many).orderBy(fold_col, "metric").collect()]
    else:
        for f in range(k):
            pred = est.fit(df.where(F.col(fold_col) != f)).transform(df.where(F.col(fold_col) == f))
            rows += [(f, name, float(e.evaluate(pred))) for name, e in many.items()]
    for name in many if k else ():
        scores = [v for _, m, v in rows if m == name and v is not None]
        rows.append((-1, name, sum(scores) / len(scores) if scores else None))
    out = df.sparkSession.createDataFrame(rows, "fold int, metric string, score double")
    return out if isinstance(evaluator, dict) else out.drop("metric")


def _read_columns(est, df: DataFrame, evaluator, fold_col: str) -> DataFrame:
    """The columns that a predictor and a scorer of this library read; all of them for any other pair."""
    if not (isinstance(est, Predictor) and isinstance(evaluator, FitEvaluator)):
        return df
    named = {est.getOrDefault(p) for p in est.params if p.name.endswith("Col") and est.isDefined(p)}
    named |= {fold_col, evaluator.labelCol, evaluator.predictionCol, evaluator.probabilityCol, evaluator.tiebreakCol}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c in named])


def grid_search(est, grid: dict, df: DataFrame, evaluator, fold_col: str,
                parallelism: int = 2, deal: list[str] = ()):
    """Grid search with a custom scorer (K16) and its report.

    ``CrossValidator`` with a precomputed fold column (stable hash folds);
    returns ``(best_model, report)`` where the report has one row per
    parameter map with its mean metric.  Each fold is held while its points
    are fitted, so only the columns that the fits and the scorer read go in;
    with ``deal``, a list of keys, the rows are first :func:`dealt` by them.
    Where counted cells give the same fits, all points of all folds are fitted
    on one table of cells and scored in one pass instead (:func:`_on_cells`).
    """
    builder = ParamGridBuilder()
    for param, values in grid.items():
        builder = builder.addGrid(est.getParam(param), values)
    maps = builder.build()
    read = _read_columns(est, df, evaluator, fold_col)
    done = _on_cells(est, grid, maps, read, evaluator, fold_col, parallelism)
    if done is None:
        df = reuse_if_shuffled(dealt(df, deal, read.columns) if deal else read)
        cv = CrossValidator(estimator=est, estimatorParamMaps=maps, evaluator=evaluator,
                            foldCol=fold_col, parallelism=parallelism)
        fitted = cv.fit(df)
        scores, model = [float(x) for x in fitted.avgMetrics], fitted.bestModel
    else:
        scores, model = done
    best = (max if evaluator.isLargerBetter() else min)(range(len(scores)), key=lambda i: scores[i])
    rows = [(", ".join(f"{p.name}={v}" for p, v in sorted(m.items(), key=lambda kv: kv[0].name)),
             sc, i == best) for i, (m, sc) in enumerate(zip(maps, scores))]
    report = df.sparkSession.createDataFrame(rows, "params string, mean_metric double, is_best boolean")
    return model, report


#: ``CrossValidator``'s number of folds.
FOLDS = 3


def _on_cells(est, grid: dict, maps: list[dict], df: DataFrame, evaluator, fold_col: str, parallelism: int):
    """The scores of a grid search and its best model by fits on counted cells, or None where rows are needed.

    The rows are counted once, by fold and cell; each fold's fits have the
    candidate splits of their own rows.  All held-out rows are scored in one
    job, each by every point's model of its fold.
    """
    points = [est.copy(m) for m in maps]
    if not (points and isinstance(evaluator, FitEvaluator) and all(map(countable, points)))\
            or {p for p in grid if p == "maxBins" or p.endswith("Col")}:
        return None
    df = reuse_if_shuffled(df)
    features, label, in_fold = est.getFeaturesCol(), est.getLabelCol(), F.col(fold_col)
    counts = {r["f"]: r["count"] for r in df.groupBy(F.when((in_fold >= 0) & (in_fold < FOLDS), in_fold.cast("int")).alias("f"))
              .count().collect()}  # one a fold
    if None in counts:
        raise ValueError(f"Fold number must be in range [0, {FOLDS}).")
    for f in range(FOLDS):
        if f not in counts:
            raise ValueError(f"The validation data at fold {f} is empty.")
    found = find_fold_bins(df, features, est.getMaxBins(), fold_col, [counts[f] for f in range(FOLDS)])
    if found is None:
        return None
    bins, own = found
    cells = count_cells(df, bins, features, label, [fold_col])
    n, jobs = cells.count(), [(f, p) for f in range(FOLDS) for p in range(len(points))]
    fit = lambda job: fit_cells(points[job[1]], cells.where(in_fold != job[0]), bins, n, own[job[0]])
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        models = dict(zip(jobs, pool.map(fit, jobs)))
    parts = []
    for f in range(FOLDS):
        fitted = [models[f, p].setPredictionCol(f"_ff_p{p}") for p in range(len(points))]
        predict = lambda rows, fitted=fitted: reduce(lambda out, m: m.transform(out), fitted, rows)
        kept, held = [c for c in df.columns if c != features], df.where(in_fold == f)
        out = per_cell(held, features, [t for m in fitted for t in m.trees] if isinstance(est, GBTRegressor) else fitted,
                       predict, len(fitted), kept)
        out = predict(held) if out is None else out
        each = F.array(*[F.struct(F.lit(f * len(points) + p).alias("_ff_job"), F.col(f"_ff_p{p}").alias(est.getPredictionCol()))
                         for p in range(len(points))])
        parts.append(out.select(*kept, F.inline(each)))
    scored = fold_scores(reduce(DataFrame.unionByName, parts), "_ff_job", {"score": evaluator})
    value = {r["_ff_job"]: float(r["score"]) for r in scored.collect()}  # one a fold and point
    scores = [float(np.mean([value[f * len(points) + p] for f in range(FOLDS)])) for p in range(len(points))]
    best = int((np.argmax if evaluator.isLargerBetter() else np.argmin)(scores))
    return scores, fit_cells(points[best], cells, bins, n, own[FOLDS])


def best_round(losses: list[float], patience: int) -> int:
    """Patience rule of the watchlist: stop once ``patience`` rounds pass
    without a new best validation loss; the answer is the best round (1-based)."""
    best, best_i = float("inf"), 0
    for i, e in enumerate(losses):
        if e < best:
            best, best_i = e, i
        elif i - best_i >= patience:
            break
    return best_i + 1


#: Boosting rounds whose trees stand in one plan.
WAVE = 32


def staged_predictions(model, df: DataFrame, keep: list[str], name: str = "staged", rounds: int | None = None) -> DataFrame:
    """``keep`` and an array: the prediction after each boosting round (first ``rounds``, default all).

    A round adds its weighted tree to the sum, so the ensemble cut after round
    k predicts the k-th value.  Trees predict each cell of their thresholds once,
    if these are not too many (:func:`cells.per_cell`).  They go in waves of bounded number, with the
    lineage cut between them, so the plan stays small for thousands of rounds.
    For a classifier the values are the margins; its positive probability is
    ``1 / (1 + exp(-2 margin))``.
    """
    trees, weights = model.trees[:rounds], model.treeWeights[:rounds]
    features = model.getFeaturesCol()
    out = per_cell(df, features, trees, lambda cells: _staged(trees, weights, cells, features, [CELL], name), len(trees), keep)
    return _staged(trees, weights, df, features, keep, name) if out is None else out


def _staged(trees: list, weights: list[float], df: DataFrame, features: str, keep: list[str], name: str) -> DataFrame:
    out = df.select(*keep, features, F.array().cast("array<double>").alias(name))
    last = F.coalesce(F.get(F.col(name), F.size(name) - 1), F.lit(0.0))
    for at in range(0, len(trees), WAVE):
        if at:
            out = cut_lineage(out)
        votes = []
        for i, (t, w) in enumerate(zip(trees[at:at + WAVE], weights[at:at + WAVE])):
            out = t.setPredictionCol(f"_t{i}").setFeaturesCol(features).transform(out)
            votes.append(F.col(f"_t{i}") * F.lit(float(w)))
        # running sums by one pass along the votes: the expression grows with the trees, not with their square
        sums = F.aggregate(F.array(*votes), F.array(last),
                           lambda acc, v: F.concat(acc, F.array(F.get(acc, F.size(acc) - 1) + v)))
        out = out.select(*keep, features, F.concat(F.col(name), F.slice(sums, 2, len(votes))).alias(name))
    return out.drop(features)


def squared_loss(y: Column, p: Column) -> Column:
    """The built-in loss of the curve: the mean squared error as an aggregate."""
    return F.avg((y - p) * (y - p))


def watch_curve(model, train: DataFrame, valid: DataFrame, metric=squared_loss, label: str = "label") -> DataFrame:
    """(round, train_loss, valid_loss): the metric on both tables after each round.

    ``metric`` takes the label and prediction columns and returns an aggregate,
    so any metric of a user will do.  Each table is read once for all rounds.
    """
    n = len(model.trees)

    def losses(df: DataFrame, name: str) -> DataFrame:
        staged = staged_predictions(model, df, [label])
        if n > WAVE:
            rounds = staged.select(label, F.posexplode("staged").alias("_i", "_p"))
            return rounds.groupBy((F.col("_i") + 1).alias("round")).agg(metric(F.col(label), F.col("_p")).alias(name))
        # an aggregate a round, so that no row is copied for each of them
        each = [metric(F.col(label), F.get("staged", F.lit(i))).alias(f"_{i}") for i in range(n)]
        one = staged.agg(F.count(F.lit(1)).alias("_n"), *each).where("_n > 0")
        return one.select(F.inline(F.array(*[F.struct(F.lit(i + 1).alias("round"), F.col(f"_{i}").alias(name))
                                             for i in range(n)])))

    return losses(train, "train_loss").join(losses(valid, "valid_loss"), "round")


class CutEnsemble:
    """A boosted model cut after its first ``rounds`` rounds: no second fit."""

    def __init__(self, model, rounds: int):
        self.model, self.rounds = model, rounds

    def transform(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        """``df`` without its features, with the prediction of the rounds kept."""
        keep = [c for c in df.columns if c != self.model.getFeaturesCol()]
        out = staged_predictions(self.model, df, keep, "_ff_staged", self.rounds)
        return out.withColumn(name, F.get("_ff_staged", F.lit(self.rounds - 1))).drop("_ff_staged")


def fit_early_stopped(est, train: DataFrame, valid: DataFrame, patience: int = 100, metric=squared_loss,
                      label: str = "label"):
    """Boosting with a watchlist and patience (K14): fit ``maxIter`` rounds, read
    the metric on both tables after each, keep the rounds up to the best one.
    Returns ``(model, curve)``, the curve with ``is_best``; nothing is fitted twice.  The fit is
    one on counted cells where that gives the same model (:mod:`cells`)."""
    model = fit_counted(est, train)
    rows = [tuple(r) for r in watch_curve(model, train, valid, metric, label).orderBy("round").collect()]  # one a round
    best = best_round([v for _, _, v in rows], patience)
    curve = valid.sparkSession.createDataFrame(
        [(n, t, v, n == best) for n, t, v in rows], "round int, train_loss double, valid_loss double, is_best boolean")
    return CutEnsemble(model, best), curve


def importances(model, feature_names: list[str]) -> DataFrame:
    """Feature importance table, normalised to share of total, sorted
    ascending (K20, I7, I13).  MLlib gives gain-based importances."""
    imp = model.featureImportances.toArray().tolist()
    total = sum(imp) or 1.0
    rows = [(n, float(v), float(v) / total) for n, v in zip(feature_names, imp)]
    spark = getattr(model, "_spark", None)
    from pyspark.sql import SparkSession
    spark = spark or SparkSession.getActiveSession()
    df = spark.createDataFrame(rows, "feature string, importance double, share double")
    return df.orderBy(F.col("importance").asc(), F.col("feature").asc())


# ---------------------------------------------------------------- K8


def adaboost(train: DataFrame, label: str, features: str, num_classes: int, rounds: int = 5,
             max_depth: int = 8, eps: float = 1e-10):
    """Multiclass AdaBoost SAMME.R over decision trees (K8).

    Weights live in a column; each round fits a weighted tree, adds its
    symmetric log-probability vote to the running score (an array column)
    and reweights rows by ``exp(-(K-1)/K * y . log p)``.  Returns the list of
    tree models; :func:`adaboost_predict` scores with them.
    """
    K = num_classes
    df = train.withColumn("_w", F.lit(1.0))  # uniform start; normalised every round
    models = []
    for _ in range(rounds):
        tree = DecisionTreeClassifier(labelCol=label, featuresCol=features, weightCol="_w",
                                      maxDepth=max_depth)
        m = tree.fit(df)
        models.append(m)
        p = F.transform(vector_to_array(F.col("probability")), lambda x: F.log(F.greatest(x, F.lit(eps))))
        # y . log p with y_k = 1 for the true class, -1/(K-1) otherwise
        ylogp = F.aggregate(
            F.transform(p, lambda x, i: F.when(i == F.col(label).cast("int"), x).otherwise(-x / (K - 1))),
            F.lit(0.0), lambda a, x: a + x)
        scored = m.transform(df).withColumn("_w", F.col("_w") * F.exp(-(K - 1) / K * ylogp))
        scored = cut_lineage(scored.select(*train.columns, "_w"))  # the sum and the next fit read it
        total = scored.agg(F.sum("_w")).first()[0] or 1.0
        df = scored.withColumn("_w", F.col("_w") / total)
    return models


def adaboost_predict(models, df: DataFrame, num_classes: int, eps: float = 1e-10) -> DataFrame:
    """Sum of the trees' SAMME.R votes; prediction = argmax (K8)."""
    K = num_classes
    out = df.withColumn("_score", F.array_repeat(F.lit(0.0), K))
    for i, m in enumerate(models):
        scored = m.setPredictionCol(f"_p{i}").setProbabilityCol(f"_pr{i}").setRawPredictionCol(f"_r{i}") \
            .transform(out)
        lp = F.transform(vector_to_array(F.col(f"_pr{i}")), lambda x: F.log(F.greatest(x, F.lit(eps))))
        mean = F.aggregate(lp, F.lit(0.0), lambda a, x: a + x) / K
        vote = F.transform(lp, lambda x: (x - mean) * (K - 1))
        out = scored.withColumn("_score", F.zip_with("_score", vote, lambda a, b: a + b)) \
            .drop(f"_p{i}", f"_pr{i}", f"_r{i}")
    best = F.array_position(F.col("_score"), F.array_max("_score")) - 1
    return out.withColumn("prediction", best.cast("double")).drop("_score")


# ---------------------------------------------------------------- K9


#: Most numbers in one block of the kNN's factors or power sums (of 8 bytes), and most reference rows in a block.
KNN_NUMBERS, KNN_ROWS = 4_000_000, 4096


def _power_factors(x: np.ndarray, p: int, query: bool) -> np.ndarray:
    """Factors whose products add up to the mixed terms of ``(q - r) ** p`` over all dimensions."""
    powers = [x]
    for _ in range(p - 2):
        powers.append(powers[-1] * x)
    if query:
        return np.concatenate([math.comb(p, j) * (-1) ** (p - j) * powers[j - 1] for j in range(1, p)], axis=1)
    return np.concatenate([powers[p - j - 1] for j in range(1, p)], axis=1)


def nearest(Q: np.ndarray, R: np.ndarray, rid: np.ndarray, k: int, p: float) -> tuple[np.ndarray, np.ndarray]:
    """Distances and places in ``R`` of the k nearest rows of each row of ``Q``, by distance, then ``rid``.

    For even p the sum of ``(q - r) ** p`` is a polynomial, so one matrix
    product gives it for a block of pairs, up to a rounding error with a known
    bound.  Pairs that the bound cannot rule out (all of them, if numbers are
    not finite) get their exact distance from the differences.
    """
    k = min(k, len(R))
    dims = max(1, Q.shape[1])
    best_d, best_r = np.full((len(Q), k), np.inf), np.full((len(Q), k), -1)
    with np.errstate(all="ignore"):
        even = int(p) if p in (2, 4, 6, 8, 10) else 0
        if even:
            mean = R.mean(axis=0)  # distances do not change, rounding errors shrink
            mean = np.where(np.isfinite(mean), mean, 0.0)
            Qc, Rc = Q - mean, R - mean
            q_sum, r_sum = (Qc ** even).sum(-1), (Rc ** even).sum(-1)
            # a bound of the rounding error: eps, steps of the sum, and (|q| + |r|) ** p, to which all terms add up at most
            big = (q_sum ** (1 / even) + r_sum.max() ** (1 / even)) ** even
            slack = np.where(np.isnan(big), np.inf, np.finfo(float).eps * 4 * (dims * even + 100) * big)
            rows = max(1, min(KNN_ROWS, KNN_NUMBERS // (dims * (even - 1))))
        else:
            slack, rows = np.zeros(len(Q)), max(1, min(KNN_ROWS, KNN_NUMBERS // (2 * dims)))
        step = max(1, min(512, KNN_NUMBERS // (rows * (1 if even else dims))))
        for at in range(0, len(R), rows):
            block = slice(at, min(at + rows, len(R)))
            factors = _power_factors(Rc[block], even, False).T if even else None
            for s in range(0, len(Q), step):
                mine = slice(s, min(s + step, len(Q)))
                if even:
                    sums = _power_factors(Qc[mine], even, True) @ factors
                    sums += q_sum[mine, None]
                    sums += r_sum[None, block]
                else:
                    sums = (np.abs(Q[mine, None, :] - R[None, block, :]) ** p).sum(-1)
                limit = best_d[mine, -1] ** p
                if at == 0 and k <= sums.shape[1]:  # nothing found yet: the k-th least sum of the block
                    limit = np.partition(sums, k - 1, axis=1)[:, k - 1]
                limit = limit * (1 + 1e-12) + 2 * slack[mine]
                limit = np.where((best_r[mine, -1] < 0) & (at > 0) | np.isnan(limit), np.inf, limit)
                qi, ri = np.nonzero(~(sums > limit[:, None]))
                if not len(qi):
                    continue
                dist = np.empty(len(qi))
                for x in range(0, len(qi), max(1, KNN_NUMBERS // dims)):
                    y = slice(x, x + max(1, KNN_NUMBERS // dims))
                    diff = np.abs(Q[s + qi[y]] - R[at + ri[y]])
                    dist[y] = np.sqrt((diff ** 2).sum(-1)) if p == 2 else (diff ** p).sum(-1) ** (1.0 / p)
                # with those found before, the k first of every query
                had_q, had_k = np.nonzero(best_r[mine] >= 0)
                qi = np.concatenate([had_q, qi])
                ri = np.concatenate([best_r[mine][had_q, had_k], at + ri])
                dist = np.concatenate([best_d[mine][had_q, had_k], dist])
                order = np.lexsort((rid[ri], dist, qi))
                qi, ri, dist = qi[order], ri[order], dist[order]
                place = np.arange(len(qi)) - np.searchsorted(qi, qi)
                kept = place < k
                best_d[s + qi[kept], place[kept]] = dist[kept]
                best_r[s + qi[kept], place[kept]] = ri[kept]
    return best_d, best_r


def knn_predict(train: DataFrame, test: DataFrame, id_col: str, vec_col: str, label_col: str,
                k: int = 5, p: float = 2.0, block_rows: int = 50000) -> DataFrame:
    """Exact k-nearest-neighbour vote (K9), blocked nested loop.

    ``vec_col`` is an array<float|double> column.  Each side is cut into
    hash blocks of at most about ``block_rows`` rows, the queries into more if
    that leaves cores idle (counts decide the block numbers, so nothing is
    broadcast).  Every (query block, reference block) pair is one cogroup
    task; it returns the k best (distance, neighbour id, label) per query
    (:func:`nearest`).  The final vote takes the k nearest overall, ties in
    distance broken by neighbour id, majority label, ties to the smallest
    label.  Output: (id, prediction).
    """
    spark = train.sparkSession
    n_ref, n_q = train.count(), test.count()
    rb = max(1, math.ceil(n_ref / block_rows))
    cells = 8 * spark.sparkContext.defaultParallelism
    qb = max(1, math.ceil(n_q / block_rows), min(math.ceil(cells / rb), math.ceil(n_q / 512)))
    # both sides carry the block keys with the same type, so equal keys hash
    # to the same shuffle partition of the cogroup
    ref = (train.select(F.col(id_col).alias("rid"), F.col(vec_col).alias("v"), F.col(label_col).alias("lab"))
           .withColumn("rblock", F.pmod(F.xxhash64("rid"), F.lit(rb)).cast("int"))
           .withColumn("qblock", F.explode(F.sequence(F.lit(0), F.lit(qb - 1)))))
    qry = (test.select(F.col(id_col).alias("qid"), F.col(vec_col).alias("v"))
           .withColumn("qblock", F.pmod(F.xxhash64("qid"), F.lit(qb)).cast("int"))
           .withColumn("rblock", F.explode(F.sequence(F.lit(0), F.lit(rb - 1)))))

    def best(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        cols = ["qid", "rid", "lab", "dist"]
        if q.empty or r.empty:
            return pd.DataFrame({c: pd.Series(dtype="int64" if c != "dist" else "float64") for c in cols})
        Q = np.stack(q["v"].map(lambda a: np.asarray(a, dtype=np.float64)).to_numpy())
        R = np.stack(r["v"].map(lambda a: np.asarray(a, dtype=np.float64)).to_numpy())
        rid = r["rid"].to_numpy()
        lab = r["lab"].to_numpy()
        dist, at = nearest(Q, R, rid, k, p)
        return pd.DataFrame({"qid": np.repeat(q["qid"].to_numpy(), at.shape[1]), "rid": rid[at].ravel(),
                             "lab": lab[at].ravel(), "dist": dist.ravel()})

    cand = (qry.groupBy("qblock", "rblock")
            .cogroup(ref.groupBy("qblock", "rblock"))
            .applyInPandas(best, "qid long, rid long, lab long, dist double"))
    w = Window.partitionBy("qid").orderBy(F.col("dist").asc(), F.col("rid").asc())
    top = cand.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k)  # <= k * rb rows per query
    votes = top.groupBy("qid", "lab").agg(F.count(F.lit(1)).alias("n"))
    pick = votes.groupBy("qid").agg(F.min(F.struct((-F.col("n")).alias("neg"), F.col("lab"))).alias("b"))
    return pick.select(F.col("qid").alias(id_col), F.col("b.lab").alias("prediction"))


# ---------------------------------------------------------------- K10


class GaussianDiscriminant:
    """Linear discriminant analysis (K10): class means and pooled covariance;
    prediction = argmax of linear scores (ties: the greater class).

    The class means come first, from one grouped vector mean.  Rows are then
    centred on their class's mean, and every task adds up outer products of its
    rows, so one matrix a task is shuffled and no digits are lost to large means.
    """

    def __init__(self, features: list[str] | str, label: str):
        """``features``: column names, or the name of one array column."""
        self.features, self.label = features, label

    def _array(self) -> Column:
        if isinstance(self.features, str):
            return F.transform(F.col(self.features), lambda v: v.cast("double"))
        return F.array(*[F.col(c).cast("double") for c in self.features])

    def fit(self, df: DataFrame) -> "GaussianDiscriminant":
        rows = df.select(F.col(self.label).alias("c"), self._array().alias("x"))
        stats = rows.groupBy("c").agg(
            F.count(F.lit(1)).alias("n"), Summarizer.mean(array_to_vector("x")).alias("m")).orderBy("c").collect()
        self.classes, counts = [r["c"] for r in stats], np.array([r["n"] for r in stats])  # K rows
        self.means = np.array([r["m"].toArray() for r in stats])
        d, classes, means = self.means.shape[1], {c: i for i, c in enumerate(self.classes)}, self.means

        def outer(batches):
            total = np.zeros((d, d))
            for b in batches:
                if len(b):
                    x = np.stack(b["x"].to_numpy()) - means[b["c"].map(classes).to_numpy()]
                    total += x.T @ x
            yield pd.DataFrame({"i": range(d), "v": list(total)})

        sums = rows.mapInPandas(outer, "i int, v array<double>").groupBy("i").agg(
            Summarizer.sum(array_to_vector("v")).alias("v")).collect()  # d rows of d numbers
        scatter = np.zeros((d, d))
        for r in sums:
            scatter[r["i"]] = r["v"].toArray()
        self.cov = scatter / max(1, counts.sum() - len(stats))
        self.coef = self.means @ np.linalg.pinv(self.cov)
        self.intercept = -0.5 * np.einsum("kd,kd->k", self.coef, self.means) + np.log(counts / counts.sum())
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        x = self._array()
        scores = [F.struct(F.aggregate(
            F.zip_with(x, F.array(*[F.lit(float(v)) for v in w]), lambda a, b: a * b),
            F.lit(float(w0)), lambda a, v: a + v).alias("s"), F.lit(c).alias("c"))
            for c, w, w0 in zip(self.classes, self.coef, self.intercept)]
        return df.withColumn("prediction", F.array_max(F.array(*scores))["c"])
