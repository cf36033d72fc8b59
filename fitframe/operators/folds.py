"""Held-out predictions of all folds in one table, and every metric of every fold from it.

The predictions are written once.  Metrics that are means become one grouped
aggregate each; AUC and Gini, which need an order, share one range sort with
the fold as the leading key, so the number of sorts does not grow with the
folds.  Only (fold, metric) rows come to the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .metrics import METRICS, FitEvaluator, multi_logloss
from .rank import cumulative, global_rank


def out_of_fold(est, df: DataFrame, fold_col: str, k: int, keep: list[str]) -> DataFrame:
    """Every row of folds 0..k-1 with the prediction of the model fitted on the other folds.

    Columns: ``keep``, ``prediction`` and, if the model gives one, its
    ``probability`` as an array.  The table is written once, so a fold is
    predicted once however many metrics read it.
    """
    def held_out(f: int) -> DataFrame:
        out = est.fit(df.where(F.col(fold_col) != f)).transform(df.where(F.col(fold_col) == f))
        probs = [vector_to_array("probability").alias("probability")] if "probability" in out.columns else []
        return out.select(*keep, "prediction", *probs)

    return cut_lineage(reduce(DataFrame.unionByName, [held_out(f) for f in range(k)]))


def _starts(counts: list[tuple], spark, schema: str) -> DataFrame:
    """For every fold the number of rows in the folds before it."""
    rows, before = [], 0
    for fold, n in counts:
        rows.append((fold, before, n))
        before += n
    return F.broadcast(spark.createDataFrame(rows, schema))


def rank_metrics(df: DataFrame, fold: str, label, score, tiebreak=None) -> DataFrame:
    """(fold, auc, gini): both rank metrics of every fold from one global order.

    Equal to ``metrics.auc`` and ``metrics.gini`` on each fold alone.  Rows
    with the same score share one mean position for AUC, and follow
    ``tiebreak`` descending for Gini; without it Gini is not given.  The order
    of the labels, which Gini is divided by, needs no second sort of rows: equal
    labels count alike in any order, so (fold, label) groups are enough.  An
    undefined value (one class only, labels of sum 0) is null.
    """
    col = lambda c: F.col(c) if isinstance(c, str) else c
    base = df.select(F.col(fold).alias("_f"), col(label).cast("double").alias("_y"), col(score).cast("double").alias("_s"),
                     (F.lit(0) if tiebreak is None else col(tiebreak)).alias("_t"))
    ranked = global_rank(base, [F.col("_f").asc(), F.col("_s").desc(), F.col("_t").desc()], "_at")
    per_fold = [tuple(r) for r in ranked.groupBy("_f").count().orderBy("_f").collect()]  # one row a fold
    kind = base.schema["_f"].dataType.simpleString()
    starts = _starts(per_fold, df.sparkSession, f"_ff_fold {kind}, _before long, _n long")
    placed = ranked.join(starts, F.col("_f").eqNullSafe(F.col("_ff_fold"))).drop("_ff_fold").withColumn(
        "_at", F.col("_at") - F.col("_before"))
    # one row a distinct score: its places are lo..hi of the descending order
    tied = placed.groupBy("_f", "_n", "_s").agg(
        F.sum((F.col("_y").cast("int") == 1).cast("long")).alias("p"), F.min("_at").alias("lo"), F.max("_at").alias("hi"),
        F.sum("_y").alias("s"), F.sum(F.col("_y") * (F.col("_n") - F.col("_at") + 1)).alias("w"))
    n, p = F.col("_n").cast("double"), F.col("P").cast("double")
    by_score = tied.groupBy("_f", "_n").agg(
        F.sum(F.col("p") * (F.col("_n") + 1 - (F.col("lo") + F.col("hi")) / 2.0)).alias("rs"), F.sum("p").alias("P"),
        F.sum("s").alias("s"), F.sum("w").alias("w"))
    auc = F.try_divide(F.col("rs") - p * (p + 1) / 2.0, p * (n - p))
    if tiebreak is None:
        return by_score.select(F.col("_f").alias(fold), auc.alias("auc"))
    labels = placed.groupBy("_f", "_n", "_before", "_y").agg(F.count("*").alias("c"))
    ordered = cumulative(labels, [F.col("_f").asc(), F.col("_y").desc()], "c", "hi")
    hi = F.col("hi") - F.col("_before")
    # the sum of n - place + 1 over the places hi - c + 1 .. hi
    whole = F.col("c") * (F.col("_n") + 1 - hi + (F.col("c") - 1) / 2.0)
    by_label = ordered.groupBy(F.col("_f").alias("_lf")).agg(F.sum(F.col("_y") * whole).alias("best"))
    ones = F.when(n > 1, n / 2).otherwise(F.lit(0.0))

    def area(w: Column) -> Column:
        return ones - F.try_divide(w, F.col("s"))

    both = by_score.join(by_label, F.col("_f").eqNullSafe(F.col("_lf")))
    return both.select(F.col("_f").alias(fold), auc.alias("auc"), F.try_divide(area(F.col("w")), area(F.col("best"))).alias("gini"))


def fold_scores(df: DataFrame, fold: str, evaluators: dict[str, FitEvaluator]) -> DataFrame:
    """(fold, metric, score) of a table of held-out predictions, a row for every fold in it and evaluator."""
    parts, ranks = [], {}
    for name, e in evaluators.items():
        has = e.probabilityCol in df.columns
        probs = F.col(e.probabilityCol) if has else None
        score = F.get(probs, F.lit(1)) if has else F.col(e.predictionCol)
        rows = df.groupBy(fold)
        if e.metric in ("auc", "gini"):
            # evaluators that read the same columns share one order
            ranks.setdefault((e.labelCol, e.probabilityCol if has else e.predictionCol), []).append((name, e, score))
            continue
        if e.metric == "multi_logloss":
            part = multi_logloss(rows, e.labelCol, probs if has else e.predictionCol, name="score")
        elif e.metric == "logloss":
            part = METRICS["logloss"][0](rows, e.labelCol, score, name="score")
        else:
            kw = {"unlog": True} if e.unlog and e.metric in ("mae", "rmspe") else {}
            part = METRICS[e.metric][0](rows, e.labelCol, e.predictionCol, name="score", **kw)
        parts.append(part.select(fold, F.lit(name).alias("metric"), "score"))
    for (label, _), held in ranks.items():
        for tie in sorted({e.tiebreakCol for _, e, _ in held if e.metric == "gini"}) or [None]:
            both = rank_metrics(df, fold, label, held[0][2], tie)
            wanted = [(n, e) for n, e, _ in held if e.tiebreakCol == tie or e.metric == "auc"]
            done = {n for n, e in wanted}
            held = [h for h in held if h[0] not in done]
            pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(e.metric).alias("score")) for n, e in wanted])
            parts.append(both.select(fold, F.inline(pairs)))
    return reduce(DataFrame.unionByName, parts)
