"""Evaluation metrics.

Every metric is one aggregate over a predictions DataFrame and returns a
one-row DataFrame (so it composes, and so each has an SQL twin).  The
order-based metrics (Gini, AUC) use the distributed global rank instead of
a single-partition sort.
"""

from __future__ import annotations

from pyspark.ml.evaluation import Evaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arith import divide
from .rank import cumulative, global_rank

EPS = 1e-15


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _clip(p: Column, eps: float) -> Column:
    return F.greatest(F.lit(eps), F.least(F.lit(1.0 - eps), p))


def logloss(df: DataFrame, label, prob, eps: float = EPS, name: str = "logloss") -> DataFrame:
    """Binary log-loss of the positive-class probability (M1)."""
    y, p = _c(label).cast("double"), _clip(_c(prob).cast("double"), eps)
    return df.agg((-F.avg(y * F.log(p) + (1 - y) * F.log(1 - p))).alias(name))


def multi_logloss(df: DataFrame, label_index, probs, eps: float = EPS,
                  name: str = "logloss") -> DataFrame:
    """Multiclass log-loss (M2): clip each class probability, renormalise
    the row to sum 1, average ``-log p[label]``.  ``probs`` is an array
    column in class order, ``label_index`` the 0-based true class."""
    clipped = F.transform(_c(probs), lambda x: _clip(x.cast("double"), eps))
    total = F.aggregate(clipped, F.lit(0.0), lambda a, x: a + x)
    p_true = F.element_at(clipped, _c(label_index).cast("int") + 1) / total
    return df.agg((-F.avg(F.log(p_true))).alias(name))


def rmse(df: DataFrame, label, pred, name: str = "rmse") -> DataFrame:
    """Root mean squared error (M3)."""
    d = _c(label).cast("double") - _c(pred).cast("double")
    return df.agg(F.sqrt(F.avg(d * d)).alias(name))


def accuracy(df: DataFrame, label, pred, name: str = "accuracy") -> DataFrame:
    """Share of rows where prediction equals label (M4)."""
    return df.agg(F.avg((_c(label) == _c(pred)).cast("double")).alias(name))


def mae(df: DataFrame, label, pred, unlog: bool = False, name: str = "mae") -> DataFrame:
    """Mean absolute error; ``unlog`` applies ``expm1`` to both sides first (M5)."""
    y, p = _c(label).cast("double"), _c(pred).cast("double")
    if unlog:
        y, p = F.expm1(y), F.expm1(p)
    return df.agg(F.avg(F.abs(y - p)).alias(name))


def inverse_square_weight(y) -> Column:
    """1 / y^2, and 0 where y = 0 (M6)."""
    y = _c(y).cast("double")
    return F.when(y != 0, F.lit(1.0) / (y * y)).otherwise(F.lit(0.0))


def rmspe(df: DataFrame, label, pred, unlog: bool = False, name: str = "rmspe") -> DataFrame:
    """Root mean squared percentage error (M7; M8 with ``unlog``).

    Rows with y = 0 have weight 0 but stay in the mean (trap T15).
    """
    y, p = _c(label).cast("double"), _c(pred).cast("double")
    if unlog:
        y, p = F.expm1(y), F.expm1(p)
    d = y - p
    return df.agg(F.sqrt(F.avg(inverse_square_weight(y) * d * d)).alias(name))


def rmspe_unguarded(df: DataFrame, label, pred, name: str = "rmspe") -> DataFrame:
    """``sqrt(mean((p/y - 1)^2))`` with no zero guard (M9, the R form): a
    zero label gives inf (or NaN for 0/0) under the division rule T6."""
    q = divide(_c(pred), _c(label)) - F.lit(1.0)
    return df.agg(F.sqrt(F.avg(q * q)).alias(name))


def gini(df: DataFrame, label: str, pred: str, tiebreak: str, name: str = "gini") -> DataFrame:
    """Normalised Gini.

    For an ordering (descending, ties by ``tiebreak`` descending -- the
    reversed stable argsort of the reference, trap T16) the Gini sum is
    ``sum(linspace(0,1,n)) - sum(cumsum(y)) / sum(y)`` and
    ``sum(cumsum(y)) = sum(y * (n - pos + 1))``, so only a global position
    is needed.  The result is G(prediction order) / G(label order).
    """
    base = df.select(F.col(label).cast("double").alias("_y"), F.col(pred).alias("_p"),
                     F.col(tiebreak).alias("_t"))

    def part(order_col: str, suffix: str) -> DataFrame:
        r = global_rank(base, [F.col(order_col).desc(), F.col("_t").desc()], "_pos")
        return r.agg(F.count(F.lit(1)).alias(f"n{suffix}"),
                     F.sum("_y").alias(f"s{suffix}"),
                     F.sum(F.col("_y") * (F.lit(0) - F.col("_pos"))).alias(f"w{suffix}"))

    p, t = part("_p", "p"), part("_y", "t")
    tt = t.select(F.struct("nt", "st", "wt")).scalar()  # one-row aggregate as a scalar subquery

    def g(n, s, w):
        n = n.cast("double")
        ones = F.when(n > 1, n / 2).otherwise(F.lit(0.0))  # linspace(0,1,1) = [0]
        # sum(y * (n - pos + 1)) = (n + 1) * sum(y) - sum(y * pos)
        return ones - F.try_divide((n + 1) * s + w, s)

    # all-zero labels or a degenerate ordering give NULL instead of an ANSI error
    return p.select(F.try_divide(g(F.col("np"), F.col("sp"), F.col("wp")),
                                 g(tt["nt"], tt["st"], tt["wt"])).alias(name))


def auc(df: DataFrame, label: str, score: str, name: str = "auc") -> DataFrame:
    """Exact ROC AUC by the rank-sum rule with average ranks on ties.

    Rows are first grouped by score (partial on the map side, so a score
    held by any share of the rows is one row); a running count over the
    distinct scores gives the positions lo..hi of each, and tied rows share
    the mean (lo + hi) / 2.
    """
    base = df.select(F.col(score).cast("double").alias("_s"),
                     (F.col(label).cast("int") == 1).cast("long").alias("_pos"))
    per_score = base.groupBy("_s").agg(F.sum("_pos").alias("p"), F.count(F.lit(1)).alias("c"))
    placed = cumulative(per_score, [F.col("_s").asc()], "c", "hi")
    lo = F.col("hi") - F.col("c") + 1
    tot = placed.agg(F.sum(F.col("p") * (lo + F.col("hi")) / 2.0).alias("rs"),
                     F.sum("p").alias("P"), (F.sum("c") - F.sum("p")).alias("N"))
    P, N = F.col("P").cast("double"), F.col("N").cast("double")
    # one class only: AUC is undefined -> NULL (no ANSI division error)
    return tot.select(F.try_divide(F.col("rs") - P * (P + 1) / 2.0, P * N).alias(name))


def mean_score(scores: DataFrame, column: str = "score", name: str = "mean_score") -> DataFrame:
    """Mean over fold scores."""
    return scores.agg(F.avg(column).alias(name))


# Metric name -> (function, larger is better).
METRICS = {
    "logloss": (logloss, False),
    "rmse": (rmse, False),
    "accuracy": (accuracy, True),
    "mae": (mae, False),
    "rmspe": (rmspe, False),
    "rmspe_unguarded": (rmspe_unguarded, False),
}


class FitEvaluator(Evaluator):
    """Any metric above as a ``pyspark.ml`` Evaluator, for model selection.

    ``logloss``, ``auc`` and ``gini`` read the positive class of ``probabilityCol`` (its
    second value), ``multi_logloss`` all of it.  A dataset without that column
    is scored on ``predictionCol``, which then holds the score itself.
    ``gini`` needs a ``tiebreakCol``: the order of tied predictions is part of
    the metric.
    """

    def __init__(self, metric: str = "rmspe", labelCol: str = "label",
                 predictionCol: str = "prediction", tiebreakCol: str | None = None,
                 unlog: bool = False, probabilityCol: str = "probability"):
        super().__init__()
        if metric == "gini" and not tiebreakCol:
            raise ValueError("gini needs tiebreakCol, the row order that breaks tied predictions")
        if metric not in METRICS and metric not in ("gini", "auc", "multi_logloss"):
            raise ValueError(f"unknown metric {metric!r}")
        self.metric, self.labelCol, self.predictionCol = metric, labelCol, predictionCol
        self.tiebreakCol, self.unlog, self.probabilityCol = tiebreakCol, unlog, probabilityCol

    def _evaluate(self, dataset: DataFrame) -> float:
        m = self.metric
        if m in ("gini", "auc", "logloss", "multi_logloss"):
            score = self.predictionCol
            if self.probabilityCol in dataset.columns:
                probs = F.col(self.probabilityCol)
                if dict(dataset.dtypes)[self.probabilityCol] == "vector":
                    probs = vector_to_array(probs)
                dataset = dataset.withColumn("_ff_score", probs if m == "multi_logloss" else probs[1])
                score = "_ff_score"
            if m == "gini":
                return float(gini(dataset, self.labelCol, score, self.tiebreakCol).first()[0])
            fn = {"auc": auc, "logloss": logloss, "multi_logloss": multi_logloss}[m]
            return float(fn(dataset, self.labelCol, score).first()[0])
        kw = {"unlog": True} if self.unlog and m in ("mae", "rmspe") else {}
        return float(METRICS[m][0](dataset, self.labelCol, self.predictionCol, **kw).first()[0])

    def isLargerBetter(self) -> bool:
        return self.metric in ("gini", "auc") or self.metric != "multi_logloss" and METRICS[self.metric][1]
