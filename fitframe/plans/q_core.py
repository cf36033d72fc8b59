"""The flagship query: join -> filter -> date part -> impute -> encode ->
z-score -> modulo split -> segment-mean prediction -> RMSPE per segment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.encode import LabelEncoder, ZScore
from ..operators.impute import MixedImputer
from ..operators.metrics import inverse_square_weight
from ..operators.relate import left_lookup
from ..operators.split import expr_split, modulo_condition
from ..session import reuse_if_shuffled
from .registry import query, r6, table

# Injected nulls (the driver tables have none): same rule in both dialects.
CUSTOMER_WITH_NULLS_SQL = """
  SELECT c_custkey, c_nationkey, c_name,
         CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal,
         CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment
  FROM customer"""


def customer_with_nulls(spark, sf):
    c = table(spark, sf, "customer")
    return c.select(
        "c_custkey", "c_nationkey", "c_name",
        F.when(F.pmod("c_custkey", F.lit(7)) == 0, F.lit(None)).otherwise(F.col("c_acctbal")).alias("c_acctbal"),
        F.when(F.pmod("c_custkey", F.lit(11)) == 0, F.lit(None)).otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))


ENTRY_SQL = f"""
WITH c AS ({CUSTOMER_WITH_NULLS_SQL}),
j AS (
  SELECT o.o_orderkey, o.o_totalprice, year(o.o_orderdate) AS o_year,
         c.c_acctbal, c.c_mktsegment, n.n_name
  FROM orders o LEFT JOIN c ON o.o_custkey = c.c_custkey
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
  WHERE o.o_totalprice > 0),
f AS (
  SELECT j.o_orderkey, j.o_totalprice, j.o_year,
         coalesce(j.c_acctbal, (SELECT avg(c_acctbal) FROM j)) AS c_acctbal,
         coalesce(j.c_mktsegment, (SELECT c_mktsegment FROM j WHERE c_mktsegment IS NOT NULL
                  GROUP BY c_mktsegment ORDER BY count(*) DESC, c_mktsegment LIMIT 1)) AS c_mktsegment,
         coalesce(j.n_name, (SELECT n_name FROM j WHERE n_name IS NOT NULL
                  GROUP BY n_name ORDER BY count(*) DESC, n_name LIMIT 1)) AS n_name
  FROM j),
enc AS (
  SELECT c_mktsegment, CAST(row_number() OVER (ORDER BY c_mktsegment) - 1 AS INTEGER) AS seg_code
  FROM (SELECT DISTINCT c_mktsegment FROM f)),
z AS (
  SELECT f.*, enc.seg_code,
         (f.o_totalprice - (SELECT avg(o_totalprice) FROM f))
           / (SELECT CASE WHEN stddev_pop(o_totalprice) = 0 THEN 1 ELSE stddev_pop(o_totalprice) END FROM f) AS z_price,
         (f.c_acctbal - (SELECT avg(c_acctbal) FROM f))
           / (SELECT CASE WHEN stddev_pop(c_acctbal) = 0 THEN 1 ELSE stddev_pop(c_acctbal) END FROM f) AS z_acctbal,
         (f.o_orderkey % 10) >= 5 AS is_train
  FROM f JOIN enc USING (c_mktsegment)),
seg AS (SELECT seg_code, avg(o_totalprice) AS pred, count(*) AS n_train
        FROM z WHERE is_train GROUP BY seg_code),
t AS (SELECT z.*, seg.pred, seg.n_train FROM z JOIN seg USING (seg_code) WHERE NOT z.is_train)
SELECT c_mktsegment, seg_code, n_train, count(*) AS n_test,
       count(DISTINCT n_name) AS n_nations,
       round(max(pred), 6) AS pred_mean,
       round(sqrt(avg(CASE WHEN o_totalprice <> 0 THEN 1.0 / (o_totalprice * o_totalprice) ELSE 0 END
                      * (o_totalprice - pred) * (o_totalprice - pred))), 6) AS rmspe,
       round(avg(z_price), 6) AS mean_z_price,
       round(avg(z_acctbal), 6) AS mean_z_acctbal,
       round(avg(o_year), 6) AS mean_year
FROM t GROUP BY c_mktsegment, seg_code, n_train
"""


@query("entry_segment_rmspe", ENTRY_SQL)
def entry_segment_rmspe(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    nation = table(spark, sf, "nation").select("n_nationkey", "n_name")
    j = left_lookup(orders, customer_with_nulls(spark, sf), F.col("o_custkey") == F.col("c_custkey"))
    j = left_lookup(j, nation, F.col("c_nationkey") == F.col("n_nationkey"))
    j = (j.where(F.col("o_totalprice") > 0)
          .select("o_orderkey", "o_totalprice", F.year("o_orderdate").alias("o_year"),
                  "c_acctbal", "c_mktsegment", "n_name"))
    # four passes follow (impute, encode, scale, score): if the joins had to
    # shuffle, materialise the narrow joined table once instead of re-joining
    j = reuse_if_shuffled(j)
    j = MixedImputer(["c_acctbal", "c_mktsegment", "n_name"]).fit(j).transform(j)
    enc = LabelEncoder(["c_mktsegment"], ["seg_code"]).fit(j)
    j = enc.transform(j)
    j = ZScore(["o_totalprice", "c_acctbal"], ["z_price", "z_acctbal"]).fit(j).transform(j)
    _, train, test = expr_split(j, modulo_condition("o_orderkey", 10, 5))
    seg = train.groupBy("seg_code").agg(F.avg("o_totalprice").alias("pred"),
                                        F.count(F.lit(1)).alias("n_train"))
    # one row per fitted segment code: the encoder knows exactly how many
    if enc.small("c_mktsegment"):
        seg = F.broadcast(seg)
    t = test.join(seg, "seg_code")
    d = F.col("o_totalprice") - F.col("pred")
    return t.groupBy("c_mktsegment", "seg_code", "n_train").agg(
        F.count(F.lit(1)).alias("n_test"),
        F.countDistinct("n_name").alias("n_nations"),
        r6(F.max("pred")).alias("pred_mean"),
        r6(F.sqrt(F.avg(inverse_square_weight("o_totalprice") * d * d))).alias("rmspe"),
        r6(F.avg("z_price")).alias("mean_z_price"),
        r6(F.avg("z_acctbal")).alias("mean_z_acctbal"),
        r6(F.avg("o_year")).alias("mean_year"))
