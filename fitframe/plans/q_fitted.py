"""Fitted operators on the driver tables: encoders, scalers, imputers,
statistic-driven row and column filters, table description."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.clean import (drop_noisy, drop_null_columns, drop_outliers, noisy_verdict,
                              profile_columns)
from ..operators.encode import LabelEncoder, ZScore, first_seen_codes, fit_frame
from ..operators.impute import fill_mean, fill_mode, impute_each
from ..operators.schema import describe, quartiles
from ..operators.split import expr_split, modulo_condition
from .q_core import CUSTOMER_WITH_NULLS_SQL, customer_with_nulls
from .registry import R6, query, r6, table

# ---------------------------------------------------------------- E1 / E2


PART_NULL_BRAND_SQL = """
  SELECT p_partkey, p_type, p_size,
         CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE p_brand END AS p_brand
  FROM part"""


def _codes_sql(table_sql: str, col: str, where: str = "TRUE") -> str:
    """Sorted distinct values -> codes; NULL is class 0 when the fit rows have NULLs."""
    return f"""(SELECT {col},
       CAST(row_number() OVER (ORDER BY {col}) - 1
            + (SELECT CASE WHEN count(*) > count({col}) THEN 1 ELSE 0 END FROM {table_sql} WHERE {where})
            AS INTEGER) AS code
     FROM (SELECT DISTINCT {col} FROM {table_sql} WHERE {col} IS NOT NULL AND {where}))"""


@query("label_encode", f"""
WITH p AS ({PART_NULL_BRAND_SQL})
SELECT p.p_partkey,
       CASE WHEN p.p_brand IS NULL THEN 0 ELSE b.code END AS brand_code,
       t.code AS type_code
FROM p LEFT JOIN {_codes_sql('p', 'p_brand')} b USING (p_brand)
       LEFT JOIN {_codes_sql('p', 'p_type')} t USING (p_type)""")
def label_encode(spark, sf):
    p = table(spark, sf, "part")
    p = p.select("p_partkey", "p_type",
                 F.when(F.pmod("p_partkey", F.lit(17)) == 0, F.lit(None)).otherwise(F.col("p_brand")).alias("p_brand"))
    _, train, test = expr_split(p, modulo_condition("p_partkey"))
    enc = LabelEncoder(["p_brand", "p_type"], ["brand_code", "type_code"]).fit(
        fit_frame(train, test, "union", ["p_brand", "p_type"]))  # T10: fit on train + test
    return enc.transform(p).select("p_partkey", "brand_code", "type_code")


@query("label_encode_numeric", f"""
WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 23 = 0 THEN NULL ELSE p_size END AS p_size FROM part)
SELECT p.p_partkey, CASE WHEN p.p_size IS NULL THEN 0 ELSE s.code END AS size_code
FROM p LEFT JOIN {_codes_sql('p', 'p_size')} s USING (p_size)""")
def label_encode_numeric(spark, sf):
    p = table(spark, sf, "part").select(
        "p_partkey", F.when(F.pmod("p_partkey", F.lit(23)) == 0, F.lit(None)).otherwise(F.col("p_size")).alias("p_size"))
    enc = LabelEncoder(["p_size"], ["size_code"]).fit(p)
    return enc.transform(p).select("p_partkey", "size_code")


@query("label_encode_target", f"""
WITH o AS (SELECT o_orderkey, o_orderpriority, (o_orderkey % 10) >= 5 AS is_train FROM orders)
SELECT o.o_orderkey, o.is_train, c.code AS prio_code
FROM o LEFT JOIN {_codes_sql('o', 'o_orderpriority', 'is_train')} c USING (o_orderpriority)""")
def label_encode_target(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    flagged, train, _ = expr_split(o, modulo_condition("o_orderkey"))
    enc = LabelEncoder(["o_orderpriority"], ["prio_code"]).fit(train)  # E2: train only
    return enc.transform(flagged).select("o_orderkey", "is_train", "prio_code")


@query("encode_first_seen", """
WITH s AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 10 >= 5 THEN 0 ELSE 1 END AS side FROM part),
f AS (SELECT p_brand, min(side * 100000000 + p_partkey) AS first_key FROM s GROUP BY p_brand),
lv AS (SELECT p_brand, CAST(row_number() OVER (ORDER BY first_key) AS INTEGER) AS brand_first FROM f)
SELECT s.p_partkey, s.side, lv.brand_first FROM s JOIN lv USING (p_brand)""")
def encode_first_seen(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_brand")
    _, train, test = expr_split(p, modulo_condition("p_partkey"))
    tr, te = first_seen_codes(train, test, "p_brand", "p_partkey", "brand_first")
    return (tr.select("p_partkey", F.lit(0).alias("side"), "brand_first")
            .unionByName(te.select("p_partkey", F.lit(1).alias("side"), "brand_first")))

# ---------------------------------------------------------------- E5


def _Z_SQL(col: str, src: str, where: str = "") -> str:
    """z-score with population std (0 -> 1) from scalar subqueries."""
    w = f" WHERE {where}" if where else ""
    return (f"({col} - (SELECT avg({col}) FROM {src}{w})) / "
            f"(SELECT CASE WHEN stddev_pop({col}) = 0 THEN 1 ELSE stddev_pop({col}) END FROM {src}{w})")


@query("zscore_union", f"""
SELECT l_orderkey, l_linenumber, l_partkey,
       {R6(_Z_SQL('l_extendedprice', 'lineitem'))} AS z_price,
       {R6(_Z_SQL('l_quantity', 'lineitem'))} AS z_qty
FROM lineitem""")
def zscore_union(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey",
                                             "l_extendedprice", "l_quantity")
    _, train, test = expr_split(li, modulo_condition("l_orderkey"))
    cols = ["l_extendedprice", "l_quantity"]
    z = ZScore(cols, ["z_price", "z_qty"]).fit(fit_frame(train, test, "union", cols))
    return z.transform(li).select("l_orderkey", "l_linenumber", "l_partkey",
                                  r6("z_price").alias("z_price"), r6("z_qty").alias("z_qty"))


@query("zscore_train", f"""
WITH l AS (SELECT *, (l_orderkey % 10) >= 5 AS is_train FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, is_train,
       {R6(_Z_SQL('l_extendedprice', 'l', 'is_train'))} AS z_price
FROM l""")
def zscore_train(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    flagged, train, test = expr_split(li, modulo_condition("l_orderkey"))
    z = ZScore(["l_extendedprice"], ["z_price"]).fit(fit_frame(train, test, "train", ["l_extendedprice"]))
    return z.transform(flagged).select("l_orderkey", "l_linenumber", "l_partkey", "is_train",
                                       r6("z_price").alias("z_price"))

# ---------------------------------------------------------------- N3-N5


@query("fill_mean", f"""
WITH p AS (SELECT p_partkey,
                  CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_size END AS p_size,
                  CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_retailprice END AS p_retailprice
           FROM part),
SELECT p_partkey, {R6('coalesce(CAST(p_size AS DOUBLE), (SELECT avg(p_size) FROM p))')} AS p_size,
       {R6('coalesce(p_retailprice, (SELECT avg(p_retailprice) FROM p))')} AS p_retailprice
FROM p""")
def fill_mean_q(spark, sf):
    p = table(spark, sf, "part").select(
        "p_partkey",
        F.when(F.pmod("p_partkey", F.lit(4)) == 0, F.lit(None)).otherwise(F.col("p_size")).alias("p_size"),
        F.when(F.pmod("p_partkey", F.lit(9)) == 0, F.lit(None)).otherwise(F.col("p_retailprice")).alias("p_retailprice"))
    f = fill_mean(p, ["p_size", "p_retailprice"])
    return f.select("p_partkey", r6("p_size").alias("p_size"), r6("p_retailprice").alias("p_retailprice"))


def _mode_sql(src: str, col: str, where: str = "TRUE") -> str:
    return (f"(SELECT {col} FROM {src} WHERE {col} IS NOT NULL AND {where} "
            f"GROUP BY {col} ORDER BY count(*) DESC, {col} LIMIT 1)")


@query("fill_mode", f"""
WITH c AS (SELECT c_custkey,
                  CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_nationkey END AS c_nationkey,
                  CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment
           FROM customer)
SELECT c_custkey, coalesce(c_nationkey, {_mode_sql('c', 'c_nationkey')}) AS c_nationkey,
       coalesce(c_mktsegment, {_mode_sql('c', 'c_mktsegment')}) AS c_mktsegment
FROM c""")
def fill_mode_q(spark, sf):
    c = table(spark, sf, "customer").select(
        "c_custkey",
        F.when(F.pmod("c_custkey", F.lit(13)) == 0, F.lit(None)).otherwise(F.col("c_nationkey")).alias("c_nationkey"),
        F.when(F.pmod("c_custkey", F.lit(11)) == 0, F.lit(None)).otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))
    return fill_mode(c, ["c_nationkey", "c_mktsegment"])


@query("impute_mixed", f"""
WITH c AS (SELECT *, (c_custkey % 10) >= 5 AS is_train FROM ({CUSTOMER_WITH_NULLS_SQL})),
m AS (SELECT is_train, avg(c_acctbal) AS ma FROM c GROUP BY is_train),
md AS (SELECT is_train, c_mktsegment AS ms FROM (
         SELECT is_train, c_mktsegment,
                row_number() OVER (PARTITION BY is_train ORDER BY count(*) DESC, c_mktsegment) AS rn
         FROM c WHERE c_mktsegment IS NOT NULL GROUP BY is_train, c_mktsegment) WHERE rn = 1)
SELECT c_custkey, c.is_train, {R6('coalesce(c_acctbal, ma)')} AS c_acctbal,
       coalesce(c_mktsegment, ms) AS c_mktsegment
FROM c JOIN m USING (is_train) JOIN md USING (is_train)""")
def impute_mixed(spark, sf):
    c = customer_with_nulls(spark, sf).select("c_custkey", "c_acctbal", "c_mktsegment")
    _, train, test = expr_split(c, modulo_condition("c_custkey"))
    tr, te = impute_each(train, test, ["c_acctbal", "c_mktsegment"])  # T9: each side its own fill
    out = tr.unionByName(te)
    return out.select("c_custkey", "is_train", r6("c_acctbal").alias("c_acctbal"), "c_mktsegment")

# ---------------------------------------------------------------- P3


def _sigma_sql(prev: str, name: str, col: str) -> str:
    return f"""
{name}_a AS (SELECT * FROM {prev}
             WHERE abs({col} - (SELECT avg({col}) FROM {prev}))
                   <= 3 * (SELECT stddev_samp({col}) FROM {prev})),
{name} AS (SELECT * FROM {name}_a
           WHERE NOT coalesce(abs({col} - (SELECT avg({col}) FROM {name}_a))
                              > 3 * (SELECT stddev_samp({col}) FROM {name}_a), FALSE))"""


@query("outlier_3sigma", f"""
WITH l0 AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_tax,
                   l_extendedprice * l_quantity AS spend FROM lineitem),
{_sigma_sql('l0', 'l1', 'l_quantity')},
{_sigma_sql('l1', 'l2', 'spend')},
{_sigma_sql('l2', 'l3', 'l_tax')}
SELECT l_orderkey, l_linenumber, l_partkey FROM l3""")
def outlier_3sigma(spark, sf):
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_tax",
        (F.col("l_extendedprice") * F.col("l_quantity")).alias("spend"))
    kept = drop_outliers(li, ["l_quantity", "spend", "l_tax"], k=3.0, faithful=True)
    return kept.select("l_orderkey", "l_linenumber", "l_partkey")

# ---------------------------------------------------------------- P6 / P7


_PROFILE_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
_PROFILE_SRC_SQL = """
  SELECT o_orderkey, o_orderdate, o_totalprice,
         CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE o_custkey END AS o_custkey,
         CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus,
         CASE WHEN o_orderkey % 3 <> 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority
  FROM orders"""


def _profile_src(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(
        "o_orderkey", "o_orderdate", "o_totalprice",
        F.when(F.pmod("o_orderkey", F.lit(19)) == 0, F.lit(None)).otherwise(F.col("o_custkey")).alias("o_custkey"),
        F.when(F.pmod("o_orderkey", F.lit(13)) == 0, F.lit(None)).otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(F.pmod("o_orderkey", F.lit(3)) != 0, F.lit(None)).otherwise(F.col("o_orderpriority")).alias("o_orderpriority"))


@query("column_profile", f"""
WITH o AS ({_PROFILE_SRC_SQL}),
p AS ({' UNION ALL '.join(
    f"SELECT '{c}' AS name, count(*) AS n_rows, count({c}) AS n_present, count(DISTINCT {c}) AS n_distinct FROM o"
    for c in _PROFILE_COLS)})
SELECT name, n_rows, n_present, n_distinct,
       CASE WHEN n_distinct < 1 THEN 'empty'
            WHEN n_present < 0.5 * n_rows THEN 'sparse'
            WHEN n_distinct > 0.4 * n_rows THEN 'high_cardinality'
            ELSE 'keep' END AS verdict
FROM p""")
def column_profile(spark, sf):
    o = _profile_src(spark, sf)
    return noisy_verdict(profile_columns(o, _PROFILE_COLS))


@query("drop_noisy_cols", f"""
WITH o AS ({_PROFILE_SRC_SQL}),
p AS ({' UNION ALL '.join(
    f"SELECT '{c}' AS name, count(*) AS n_rows, count({c}) AS n_present, count(DISTINCT {c}) AS n_distinct FROM o"
    for c in _PROFILE_COLS)})
SELECT name FROM p
WHERE NOT (n_distinct < 1 OR n_present < 0.5 * n_rows OR n_distinct > 0.4 * n_rows)""")
def drop_noisy_cols(spark, sf):
    """P6 through the approx-first path: HyperLogLog for all columns, exact
    recount only near a threshold; the kept column names are the result."""
    kept = drop_noisy(_profile_src(spark, sf).select(*_PROFILE_COLS))
    return spark.createDataFrame([(c,) for c in kept.columns], "name string")


@query("drop_null_cols", """
SELECT o_orderkey, o_orderstatus, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 10 >= 5""")
def drop_null_cols(spark, sf):
    o = table(spark, sf, "orders")
    o = o.select(
        "o_orderkey", "o_orderstatus", "o_orderdate", "o_orderpriority",
        # nulls only on the test side (key % 10 == 1) and on both sides (key % 11 == 0)
        F.when(F.pmod("o_orderkey", F.lit(10)) == 1, F.lit(None)).otherwise(F.col("o_custkey")).alias("o_custkey"),
        F.when(F.pmod("o_orderkey", F.lit(11)) == 0, F.lit(None)).otherwise(F.col("o_totalprice")).alias("o_totalprice"))
    _, train, test = expr_split(o, modulo_condition("o_orderkey"))
    tr, _ = drop_null_columns(train.drop("is_train"), test.drop("is_train"), mode="intersection")
    return tr

# ---------------------------------------------------------------- C17


_LI_TYPES = [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"),
             ("l_linenumber", "int"), ("l_quantity", "double"), ("l_extendedprice", "double"),
             ("l_discount", "double"), ("l_tax", "double"), ("l_returnflag", "string"),
             ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz")]
_NUMERIC = {"bigint", "int", "double"}


def _describe_sql() -> str:
    parts = []
    for c, t in _LI_TYPES:
        if t in _NUMERIC:
            stats = (f"{R6(f'min({c})')} AS min, {R6(f'max({c})')} AS max, "
                     f"{R6(f'avg({c})')} AS mean")
        else:
            stats = "CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max, CAST(NULL AS DOUBLE) AS mean"
        parts.append(f"SELECT '{c}' AS column, '{t}' AS type, count({c}) AS n, {stats} FROM lineitem")
    return " UNION ALL ".join(parts)


@query("describe_table", _describe_sql())
def describe_table(spark, sf):
    d = describe(table(spark, sf, "lineitem"))
    return d.select("column", "type", "n", r6("min").alias("min"), r6("max").alias("max"),
                    r6("mean").alias("mean"))


_QUARTILES = ["l_quantity", "l_extendedprice", "l_discount"]


@query("table_quartiles", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", {", ".join(f"{R6(f'quantile_disc({c}, {q})')} AS {n}" for q, n in
        ((0.25, "q1"), (0.5, "median"), (0.75, "q3")))} FROM lineitem""" for c in _QUARTILES))
def table_quartiles(spark, sf):
    d = quartiles(table(spark, sf, "lineitem").select(*_QUARTILES))
    return d.select("column", r6("q1").alias("q1"), r6("median").alias("median"), r6("q3").alias("q3"))
