"""Joins, grouped and ordered computation, global rank, splits and
prediction post-processing on the driver tables."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from ..operators.clean import complement
from ..operators.ordered import lag_diff, rain_estimate
from ..operators.post import row_ids, zero_closed
from ..operators.rank import cumulative, global_rank
from ..operators.relate import (flatten_agg, left_lookup, natural_join, share_of_total,
                                union_distinct)
from ..operators.split import (date_split, expr_split, fixed_sample_split, fold_column, holdout,
                               modulo_condition, random_split, sample_rows, tail_split)
from ..sources.sinks import fill_template, wide_submission
from .registry import CENTS, R6, cents, query, r6, table

# ---------------------------------------------------------------- J


@query("join_left", """
SELECT o.o_orderkey, c.c_name, n.n_name
FROM orders o
LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING') c ON o.o_custkey = c.c_custkey
LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey""")
def join_left(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf, "customer").where(F.col("c_mktsegment") != "BUILDING") \
        .select("c_custkey", "c_name", "c_nationkey")
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    j = left_lookup(o, c, F.col("o_custkey") == F.col("c_custkey"), "left")
    j = left_lookup(j, n, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return j.select("o_orderkey", "c_name", "n_name")


@query("join_inner", """
SELECT l_orderkey, l_linenumber, l_partkey, p_brand, l_extendedprice / p_retailprice AS price_ratio
FROM lineitem JOIN part ON l_partkey = p_partkey""")
def join_inner(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    p = table(spark, sf, "part").select("p_partkey", "p_brand", "p_retailprice")
    j = left_lookup(li, p, F.col("l_partkey") == F.col("p_partkey"), "inner")
    return j.select("l_orderkey", "l_linenumber", "l_partkey", "p_brand",
                    (F.col("l_extendedprice") / F.col("p_retailprice")).alias("price_ratio"))


@query("join_natural", """
SELECT c_custkey, nationkey, n_name
FROM (SELECT c_custkey, c_nationkey AS nationkey FROM customer)
NATURAL JOIN (SELECT n_nationkey AS nationkey, n_name FROM nation)""")
def join_natural(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("nationkey"))
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("nationkey"), "n_name")
    return natural_join(c, n).select("c_custkey", "nationkey", "n_name")


@query("join_lookup", """
SELECT l_orderkey, l_linenumber, l_partkey,
       CASE WHEN p_size < 10 THEN 0.0 ELSE l_quantity * p_retailprice END AS value
FROM lineitem LEFT JOIN part ON l_partkey = p_partkey""")
def join_lookup(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    p = table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    j = left_lookup(li, p, F.col("l_partkey") == F.col("p_partkey"), "left")
    value = F.when(F.col("p_size") < 10, F.lit(0.0)).otherwise(F.col("l_quantity") * F.col("p_retailprice"))
    return j.select("l_orderkey", "l_linenumber", "l_partkey", value.alias("value"))


@query("union_distinct", """
SELECT c_nationkey AS nationkey FROM customer UNION SELECT s_nationkey FROM supplier""")
def union_distinct_q(spark, sf):
    return union_distinct("c_nationkey", "s_nationkey",
                          frames=[table(spark, sf, "customer"), table(spark, sf, "supplier")],
                          name="nationkey")

# ---------------------------------------------------------------- I


@query("flatten_agg", f"""
SELECT user_id,
       {R6('avg(value)')} AS value_mean, max(value) AS value_max, min(value) AS value_min,
       count(value) AS value_count, count(event_id) AS event_id_count,
       {R6('avg(hour(ts))')} AS hour_mean, max(CAST(hour(ts) AS INTEGER)) AS hour_max,
       min(CAST(hour(ts) AS INTEGER)) AS hour_min
FROM events GROUP BY user_id""")
def flatten_agg_q(spark, sf):
    e = table(spark, sf, "events").select("user_id", "value", "event_id", F.hour("ts").alias("hour"))
    spec = {"value": ["mean", "max", "min", "count"], "event_id": ["count"],
            "hour": ["mean", "max", "min"]}
    out = flatten_agg(e, "user_id", spec)
    return out.withColumns({"value_mean": r6("value_mean"), "hour_mean": r6("hour_mean")})


@query("weighted_duration", f"""
WITH e AS (SELECT event_type, strftime(ts, '%Y-%m-%d %H') AS hour_key, CAST(minute(ts) AS INTEGER) AS mnt,
                  event_id, least(value, 55.0) AS dbz FROM events),
w AS (SELECT *, coalesce(lag(mnt) OVER g, 0) AS prev, (lead(mnt) OVER g) IS NULL AS is_last,
             pow(pow(10.0, dbz / 10.0) / 200.0, 0.625) AS rate
      FROM e WINDOW g AS (PARTITION BY event_type, hour_key ORDER BY mnt, event_id))
SELECT event_type, hour_key,
       {R6('coalesce(sum(CASE WHEN isfinite(rate) THEN rate * (CASE WHEN is_last THEN 60 - prev ELSE mnt - prev END) / 60.0 END), 0.0)')} AS estimate
FROM w GROUP BY event_type, hour_key""")
def weighted_duration_q(spark, sf):
    e = table(spark, sf, "events").select(
        "event_type", F.date_format("ts", "yyyy-MM-dd HH").alias("hour_key"),
        F.minute("ts").alias("mnt"), "event_id", F.least(F.col("value"), F.lit(55.0)).alias("dbz"))
    est = rain_estimate(e, ["event_type", "hour_key"], ["mnt", "event_id"], "mnt", "dbz")
    return est.select("event_type", "hour_key", r6("estimate").alias("estimate"))


@query("lag_delta", """
SELECT event_id, user_id,
       value - coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0.0) AS delta
FROM events""")
def lag_delta(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    return lag_diff(e, ["user_id"], ["ts", "event_id"], "value", "delta", 0.0) \
        .select("event_id", "user_id", "delta")


@query("share_of_total", f"""
SELECT o_orderkey, {R6('o_totalprice / (SELECT sum(o_totalprice) FROM orders) * 1000000')} AS share_ppm
FROM orders""")
def share_of_total_q(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    s = share_of_total(o, "o_totalprice", "share")
    return s.select("o_orderkey", r6(F.col("share") * 1000000).alias("share_ppm"))


@query("global_rank", """
SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders""")
def global_rank_q(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    r = global_rank(o, [F.col("o_totalprice").desc(), F.col("o_orderkey").asc()], "rank")
    return r.select("o_orderkey", "rank")


@query("cumulative", f"""
SELECT o_orderkey,
       CAST(sum({CENTS('o_totalprice')}) OVER (ORDER BY o_orderdate, o_orderkey
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cum_cents
FROM orders""")
def cumulative_q(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", cents("o_totalprice").alias("c"))
    r = cumulative(o, [F.col("o_orderdate").asc(), F.col("o_orderkey").asc()], "c", "cum_cents")
    return r.select("o_orderkey", "cum_cents")

# ---------------------------------------------------------------- O


@query("zero_closed", """
SELECT o_orderkey,
       CASE WHEN c_acctbal < 0 THEN 0.0 ELSE o_totalprice END AS pred
FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def zero_closed_q(spark, sf):
    preds = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("pred"))
    attrs = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("o_custkey"),
        F.when(F.col("c_acctbal") < 0, F.lit(0)).otherwise(F.lit(1)).alias("open"))
    return zero_closed(preds, attrs, "o_custkey", "open", "pred").select("o_orderkey", "pred")


@query("template_fill", f"""
WITH p AS (SELECT l_orderkey AS o_orderkey, sum({CENTS('l_extendedprice')}) / 100 AS pred
           FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey, p.pred AS target FROM orders LEFT JOIN p USING (o_orderkey)""")
def template_fill_q(spark, sf):
    template = table(spark, sf, "orders").select("o_orderkey", F.lit(0.0).alias("target"))
    preds = (table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"))
             .agg((F.sum(cents("l_extendedprice")) / 100).alias("pred")))
    return fill_template(template, preds, "o_orderkey", "target", "pred")


@query("row_ids", """
SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS row_id FROM orders""")
def row_ids_q(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return row_ids(o, [F.col("o_orderdate").asc(), F.col("o_orderkey").asc()]).select("o_orderkey", "row_id")


# The event classes in submission column order.
EVENT_CLASSES = ["click", "error", "purchase", "signup", "view"]


@query("wide_submission", "SELECT user_id, " + ", ".join(
    f"{R6(f'count(*) FILTER (WHERE event_type = {chr(39)}{c}{chr(39)}) / count(*)')} AS {c}"
    for c in EVENT_CLASSES) + " FROM events GROUP BY user_id")
def wide_submission_q(spark, sf):
    e = table(spark, sf, "events")
    counts = e.groupBy("user_id").pivot("event_type", EVENT_CLASSES).count().fillna(0, EVENT_CLASSES)
    total = sum(F.col(c) for c in EVENT_CLASSES)
    probs = counts.select(F.col("user_id").cast("long"),  # C10
                          array_to_vector(F.array(*[F.col(c) / total for c in EVENT_CLASSES])).alias("probability"))
    wide = wide_submission(probs, "user_id", "probability", EVENT_CLASSES)
    return wide.select("user_id", *[r6(c).alias(c) for c in EVENT_CLASSES])

# ---------------------------------------------------------------- S


@query("split_modulo", f"""
SELECT (o_orderkey % 10) >= 5 AS is_train, count(*) AS n, CAST(sum({CENTS('o_totalprice')}) AS BIGINT) AS cents
FROM orders GROUP BY 1""")
def split_modulo(spark, sf):
    o = table(spark, sf, "orders")
    flagged, _, _ = expr_split(o, modulo_condition("o_orderkey", 10, 5))
    return flagged.groupBy("is_train").agg(F.count(F.lit(1)).alias("n"),
                                           F.sum(cents("o_totalprice")).alias("cents"))


@query("split_arith", f"""
SELECT ((o_custkey * 15 + o_orderkey * 3) % 17) <= 13 AS is_train, count(*) AS n,
       CAST(sum({CENTS('o_totalprice')}) AS BIGINT) AS cents
FROM orders GROUP BY 1""")
def split_arith(spark, sf):
    o = table(spark, sf, "orders")
    cond = F.pmod(F.col("o_custkey") * 15 + F.col("o_orderkey") * 3, F.lit(17)) <= 13
    flagged, _, _ = expr_split(o, cond)
    return flagged.groupBy("is_train").agg(F.count(F.lit(1)).alias("n"),
                                           F.sum(cents("o_totalprice")).alias("cents"))


def _partition_props(a, b, key: str):
    """Rows on both sides, keys seen on both sides (must be 0), distinct keys."""
    tagged = a.select(key, F.lit(0).alias("_side")).unionByName(b.select(key, F.lit(1).alias("_side")))
    per_key = tagged.groupBy(key).agg(F.count(F.lit(1)).alias("_n"),
                                      F.countDistinct("_side").alias("_sides"))
    return per_key.agg(F.sum("_n").cast("long").alias("n_rows"),
                       F.sum((F.col("_sides") > 1).cast("long")).alias("n_overlap"),
                       F.count(F.lit(1)).alias("n_keys"))


_PROPS_SQL = ("SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_overlap, count(DISTINCT o_orderkey) AS n_keys, "
              "true AS share_ok FROM orders")


def _share_ok(side, whole, share):
    """Whether a side has its share of the rows, within five standard deviations."""
    n, all_n = side.agg(F.count(F.lit(1)).cast("double")).scalar(), F.col("n_rows").cast("double")
    return F.abs(n - share * all_n) <= 5 * F.sqrt(all_n * share * (1 - share))


@query("split_hash", _PROPS_SQL)
def split_hash(spark, sf):
    o = holdout(table(spark, sf, "orders"), ["o_orderkey"], 0.05, seed=1337)
    held = o.where("is_holdout")
    props = _partition_props(held, o.where("NOT is_holdout"), "o_orderkey")
    return props.withColumn("share_ok", _share_ok(held, o, 0.05))


@query("split_random", _PROPS_SQL)
def split_random(spark, sf):
    flagged, tr, te = random_split(table(spark, sf, "orders"), 0.75, seed=42)
    return _partition_props(tr, te, "o_orderkey").withColumn("share_ok", _share_ok(tr, flagged, 0.75))


@query("split_fixed_n", """
SELECT least(1000, count(*)) AS n_sample, count(*) - least(1000, count(*)) AS n_rest,
       CAST(0 AS BIGINT) AS n_overlap, least(500, count(*)) AS n_dev,
       least(700, count(*)) AS n_repeated FROM orders""")
def split_fixed_n(spark, sf):
    o = table(spark, sf, "orders")
    flagged = fixed_sample_split(o, 1000, ["o_orderkey"], seed=7)
    sample = flagged.where("is_sample")
    rest = complement(o, sample, ["o_orderkey"])          # P8: rows not in the sample (anti join)
    props = _partition_props(sample, rest, "o_orderkey")
    dev = sample_rows(o, 500, ["o_orderkey"], seed=11).agg(F.count(F.lit(1)).alias("n_dev"))
    # a key that many rows share, and some lack
    status = o.withColumn("key", F.when(F.col("o_orderkey") % 19 != 0, F.col("o_orderstatus")))
    repeated = sample_rows(status, 700, ["key"], seed=13).agg(F.count(F.lit(1)).alias("n_repeated"))
    counts = flagged.agg(F.sum(F.col("is_sample").cast("long")).alias("n_sample"),
                         F.sum((~F.col("is_sample")).cast("long")).alias("n_rest"))
    return counts.select("n_sample", "n_rest", props.select("n_overlap").scalar().alias("n_overlap"),
                         dev.select("n_dev").scalar().alias("n_dev"),
                         repeated.select("n_repeated").scalar().alias("n_repeated"))


@query("split_folds", """
SELECT count(*) AS n_rows, CAST(least(5, count(*)) AS BIGINT) AS n_folds,
       0 AS min_fold, 4 AS max_fold, true AS sizes_ok FROM orders""")
def split_folds(spark, sf):
    f = fold_column(table(spark, sf, "orders"), ["o_orderkey"], k=5, seed=1337)
    sizes = f.groupBy("fold").agg(F.count(F.lit(1)).alias("n"))
    n = F.sum("n").cast("double")
    fair = F.greatest(F.max("n") - n / 5, n / 5 - F.min("n")) <= 5 * F.sqrt(n * 0.16)
    return sizes.agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_folds"), F.min("fold").alias("min_fold"),
                     F.max("fold").alias("max_fold"), fair.alias("sizes_ok"))


@query("split_date", """
SELECT o_orderdate <= TIMESTAMP '1998-01-01' AS is_train, count(*) AS n,
       min(o_orderkey) AS min_key, max(o_orderkey) AS max_key
FROM orders GROUP BY 1""")
def split_date(spark, sf):
    d = date_split(table(spark, sf, "orders"), "o_orderdate", "1998-01-01")
    return d.groupBy("is_train").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("min_key"),
                                     F.max("o_orderkey").alias("max_key"))


@query("split_tail", """
SELECT o_orderkey,
       row_number() OVER (ORDER BY o_orderdate, o_orderkey)
         <= (SELECT count(*) - count(*) // 10 FROM orders) AS is_train
FROM orders""")
def split_tail(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    n_valid = o.count() // 10
    t = tail_split(o, ["o_orderdate", "o_orderkey"], n_valid)
    return t.select("o_orderkey", "is_train")
