"""Metrics over deterministic pseudo-predictions derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.folds import fold_scores
from ..operators.metrics import (FitEvaluator, accuracy, auc, gini, logloss, mae, mean_score, multi_logloss, rmse,
                                 rmspe, rmspe_unguarded)
from .registry import R6, query, r6, table

_CLIP = "greatest(1e-15, least(1 - 1e-15, {}))"


def _clip(e: str) -> str:
    return _CLIP.format(e)


@query("m_logloss", f"""
WITH b AS (SELECT CAST(l_returnflag = 'R' AS DOUBLE) AS y, {_clip('l_tax * 10 + 0.1')} AS p FROM lineitem)
SELECT {R6('-avg(y * ln(p) + (1 - y) * ln(1 - p))')} AS logloss FROM b""")
def m_logloss(spark, sf):
    li = table(spark, sf, "lineitem").select(
        (F.col("l_returnflag") == "R").cast("double").alias("y"), (F.col("l_tax") * 10 + 0.1).alias("p"))
    return logloss(li, "y", "p").select(r6("logloss").alias("logloss"))


@query("m_multilogloss", f"""
WITH b AS (SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS y,
                  {_clip('l_discount + 0.1')} AS p0, {_clip('l_tax + 0.1')} AS p1,
                  {_clip('l_quantity / 100')} AS p2 FROM lineitem)
SELECT {R6('-avg(ln((CASE y WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END) / (p0 + p1 + p2)))')} AS logloss
FROM b""")
def m_multilogloss(spark, sf):
    li = table(spark, sf, "lineitem")
    y = (F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2))
    probs = F.array(F.col("l_discount") + 0.1, F.col("l_tax") + 0.1, F.col("l_quantity") / 100)
    b = li.select(y.alias("y"), probs.alias("probs"))
    return multi_logloss(b, "y", "probs").select(r6("logloss").alias("logloss"))


@query("m_rmse", f"""
SELECT {R6('sqrt(avg((l_quantity / 50 - l_discount * 10) * (l_quantity / 50 - l_discount * 10)))')} AS rmse
FROM lineitem""")
def m_rmse(spark, sf):
    li = table(spark, sf, "lineitem").select((F.col("l_quantity") / 50).alias("y"),
                                            (F.col("l_discount") * 10).alias("p"))
    return rmse(li, "y", "p").select(r6("rmse").alias("rmse"))


@query("m_accuracy", f"""
SELECT {R6('avg(CAST((l_linestatus = \'F\') = (l_tax > 0.04) AS DOUBLE))')} AS accuracy FROM lineitem""")
def m_accuracy(spark, sf):
    li = table(spark, sf, "lineitem").select((F.col("l_linestatus") == "F").cast("int").alias("y"),
                                            (F.col("l_tax") > 0.04).cast("int").alias("p"))
    return accuracy(li, "y", "p").select(r6("accuracy").alias("accuracy"))


@query("m_mae", f"""
WITH b AS (SELECT ln(1 + l_quantity) AS y, ln(1 + l_discount * 500) AS p FROM lineitem)
SELECT {R6('avg(abs((exp(y) - 1) - (exp(p) - 1)))')} AS mae, {R6('avg(abs(y - p))')} AS mae_log FROM b""")
def m_mae(spark, sf):
    b = table(spark, sf, "lineitem").select(F.log1p("l_quantity").alias("y"),
                                           F.log1p(F.col("l_discount") * 500).alias("p"))
    log_scale = mae(b, "y", "p", name="mae_log").select("mae_log").scalar()
    return mae(b, "y", "p", unlog=True).select(r6("mae").alias("mae"), r6(log_scale).alias("mae_log"))


@query("m_rmspe", f"""
WITH b AS (SELECT l_quantity - 1 AS y, l_discount * 500 AS p FROM lineitem),
w AS (SELECT y, p, CASE WHEN y <> 0 THEN 1.0 / (y * y) ELSE 0.0 END AS wt,
             exp(ln(1 + y)) - 1 AS y2, exp(ln(1 + p)) - 1 AS p2 FROM b)
SELECT {R6('sqrt(avg(wt * (y - p) * (y - p)))')} AS rmspe,
       {R6('sqrt(avg(CASE WHEN y2 <> 0 THEN 1.0 / (y2 * y2) ELSE 0.0 END * (y2 - p2) * (y2 - p2)))')} AS rmspe_log
FROM w""")
def m_rmspe(spark, sf):
    b = table(spark, sf, "lineitem").select((F.col("l_quantity") - 1).alias("y"),
                                           (F.col("l_discount") * 500).alias("p"))
    logged = b.select(F.log1p("y").alias("y"), F.log1p("p").alias("p"))
    on_log = rmspe(logged, "y", "p", unlog=True, name="rmspe_log").select("rmspe_log").scalar()
    return rmspe(b, "y", "p").select(r6("rmspe").alias("rmspe"), r6(on_log).alias("rmspe_log"))


@query("m_rmspe_unguarded", f"""
SELECT {R6('sqrt(avg((l_discount * 500 / l_quantity - 1) * (l_discount * 500 / l_quantity - 1)))')} AS rmspe
FROM lineitem""")
def m_rmspe_unguarded(spark, sf):
    b = table(spark, sf, "lineitem").select(F.col("l_quantity").alias("y"),
                                           (F.col("l_discount") * 500).alias("p"))
    return rmspe_unguarded(b, "y", "p").select(r6("rmspe").alias("rmspe"))


def _gini_part(order: str) -> str:
    return (f"(SELECT count(*) AS n, sum(y) AS s, sum(y * pos) AS w FROM "
            f"(SELECT y, row_number() OVER (ORDER BY {order}) AS pos FROM b))")


def _g_sql(order: str) -> str:
    """One ordering's Gini sum as a scalar subquery."""
    return (f"(SELECT (CASE WHEN n > 1 THEN n / 2.0 ELSE 0.0 END) - ((n + 1) * s - w) / s "
            f"FROM {_gini_part(order)})")


@query("m_gini", f"""
WITH b AS (SELECT o_totalprice AS y, CAST(o_custkey % 100 AS DOUBLE) AS p, o_orderkey AS t FROM orders)
SELECT {R6(f"{_g_sql('p DESC, t DESC')} / {_g_sql('y DESC, t DESC')}")} AS gini""")
def m_gini(spark, sf):
    o = table(spark, sf, "orders").select(
        F.col("o_totalprice").alias("y"), F.pmod("o_custkey", F.lit(100)).cast("double").alias("p"),
        F.col("o_orderkey").alias("t"))
    return gini(o, "y", "p", "t").select(r6("gini").alias("gini"))


@query("m_auc", f"""
WITH b AS (SELECT l_discount AS s, CAST(l_returnflag = 'R' AS BIGINT) AS y FROM lineitem),
g AS (SELECT s, count(*) AS c, sum(y) AS p FROM b GROUP BY s),
r AS (SELECT s, c, p,
             sum(c) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - c + 1 AS lo,
             sum(c) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hi FROM g),
t AS (SELECT sum(p * (lo + hi) / 2.0) AS rs, CAST(sum(p) AS DOUBLE) AS np,
             CAST(sum(c) - sum(p) AS DOUBLE) AS nn FROM r)
SELECT {R6('(rs - np * (np + 1) / 2.0) / (np * nn)')} AS auc FROM t""")
def m_auc(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_discount").alias("s"),
                                            (F.col("l_returnflag") == "R").cast("int").alias("y"))
    return auc(li, "y", "s").select(r6("auc").alias("auc"))


_FOLD_VALUES = {
    "auc": "(rs - p * (p + 1) / 2.0) / (p * (n - p))",
    "gini": "(n / 2.0 - ((n + 1) * p - wp) / p) / (n / 2.0 - ((n + 1) * p - wy) / p)",
    "logloss": "ll",
    "rmse": "rm",
}


@query("fold_metrics", f"""
WITH b AS (SELECT CAST(o_orderkey % 5 AS INTEGER) AS fold, CAST(o_orderstatus = 'F' AS DOUBLE) AS y,
                  CAST(o_custkey % 100 AS DOUBLE) / 100 AS s, o_orderkey AS t FROM orders),
o AS (SELECT *, {_clip('s')} AS q, row_number() OVER (PARTITION BY fold ORDER BY s DESC, t DESC) AS pp,
             row_number() OVER (PARTITION BY fold ORDER BY y DESC, t DESC) AS py,
             count(*) OVER (PARTITION BY fold, s) AS c, rank() OVER (PARTITION BY fold ORDER BY s) AS lo FROM b),
g AS (SELECT fold, CAST(count(*) AS DOUBLE) AS n, sum(y) AS p, sum(y * pp) AS wp, sum(y * py) AS wy,
             sum(y * (lo + (c - 1) / 2.0)) AS rs, -avg(y * ln(q) + (1 - y) * ln(1 - q)) AS ll,
             sqrt(avg((y - s) * (y - s))) AS rm FROM o GROUP BY fold),
v AS ({" UNION ALL ".join(f"SELECT fold, '{m}' AS metric, {e} AS score FROM g" for m, e in _FOLD_VALUES.items())})
SELECT fold, metric, {R6('score')} AS score FROM v
UNION ALL
SELECT CAST(-1 AS INTEGER) AS fold, metric, {R6('avg(score)')} AS score FROM v GROUP BY metric""")
def fold_metrics(spark, sf):
    """Every metric of every fold from one table of scores, and its mean over the folds as fold -1."""
    o = table(spark, sf, "orders").select(
        F.pmod("o_orderkey", F.lit(5)).cast("int").alias("fold"),
        (F.col("o_orderstatus") == "F").cast("double").alias("y"),
        (F.pmod("o_custkey", F.lit(100)).cast("double") / 100).alias("s"), F.col("o_orderkey").alias("t"))
    scores = fold_scores(o, "fold", {m: FitEvaluator(m, "y", "s", "t") for m in _FOLD_VALUES})
    means = mean_score(scores.groupBy("metric"), name="score").select(F.lit(-1).alias("fold"), "metric", "score")
    return scores.unionByName(means).withColumn("score", r6("score"))
