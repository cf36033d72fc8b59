"""Row-local operators on the driver tables: one projection each, no shuffle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import (arith_crosses, clamp_low, date_parts, date_text_parts,
                         fill_columns, fill_const, hour_text, log_target, month_flags,
                         name_parts, night_flag, not_equal_keep_null, null_negatives,
                         packed_hour, py_mod, rain_rate, sas_date_parts, short_year_parts,
                         split_street, text_crosses, unlog)
from ..functions.text import MONTH_ABBREVIATIONS
from ..operators.encode import ordinal_map
from ..operators.post import calibrate
from ..operators.relate import left_lookup
from ..operators.schema import by_position, columns_by_type, features_except, unique_names
from .registry import R6, query, r6, table

# ---------------------------------------------------------------- C / A


@query("scan_project_cast", f"""
SELECT l_orderkey, l_partkey, l_linenumber,
       CAST(l_quantity AS INTEGER) AS qty,
       {R6('l_extendedprice * (1 - l_discount)')} AS net_price,
       CAST(CAST(l_tax AS VARCHAR) AS DOUBLE) AS tax_from_text,
       l_returnflag AS return_flag
FROM lineitem""")
def scan_project_cast(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(
        "l_orderkey", "l_partkey", "l_linenumber",
        F.col("l_quantity").cast("int").alias("qty"),
        r6(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net_price"),
        F.col("l_tax").cast("string").cast("double").alias("tax_from_text"),
        F.col("l_returnflag").alias("return_flag"))


@query("select_by_type", "SELECT p_partkey, p_size, p_retailprice FROM part")
def select_by_type(spark, sf):
    part = table(spark, sf, "part")
    numeric = columns_by_type(part, numeric=True)                 # C3
    feats = features_except(part.select(*numeric), ["p_partkey"])  # C2
    chosen = part.select(*unique_names(["p_partkey"] + feats + numeric), "p_name")  # C12
    wide = chosen.withColumn("extra", F.lit(1)).select("extra", *chosen.columns)  # two columns to lose
    return by_position(wide, [2, 3, 4, 5]).drop("p_name")         # C5: the first, by position; C4: another, by name

# ---------------------------------------------------------------- P / N


ORDERS_WITH_NULLS_SQL = """
  SELECT o_orderkey, o_orderdate,
         CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE o_custkey END AS o_custkey,
         CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus,
         CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice,
         CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority
  FROM orders"""


def orders_with_nulls(spark, sf):
    o = table(spark, sf, "orders")

    def nul(c, m):
        return F.when(F.pmod("o_orderkey", F.lit(m)) == 0, F.lit(None)).otherwise(F.col(c)).alias(c)
    return o.select("o_orderkey", "o_orderdate", nul("o_custkey", 19), nul("o_orderstatus", 13),
                    nul("o_totalprice", 11), nul("o_orderpriority", 17))


@query("filter_null_safe", f"""
WITH o AS ({ORDERS_WITH_NULLS_SQL})
SELECT o_orderkey, o_orderstatus FROM o
WHERE o_orderstatus IS DISTINCT FROM 'F' AND (o_totalprice > 100000 OR o_totalprice IS NULL)""")
def filter_null_safe(spark, sf):
    o = orders_with_nulls(spark, sf)
    keep = not_equal_keep_null("o_orderstatus", "F") & \
        ((F.col("o_totalprice") > 100000) | F.col("o_totalprice").isNull())
    return o.where(keep).select("o_orderkey", "o_orderstatus")


@query("fill_const", f"""
WITH o AS ({ORDERS_WITH_NULLS_SQL})
SELECT o_orderkey, coalesce(o_custkey, 0) AS o_custkey, coalesce(o_totalprice, 0.0) AS o_totalprice,
       coalesce(o_orderstatus, '0') AS o_orderstatus, coalesce(o_orderpriority, '0') AS o_orderpriority
FROM o""")
def fill_const_q(spark, sf):
    o = orders_with_nulls(spark, sf).drop("o_orderdate")
    return fill_const(o, 0)


@query("fill_column", f"""
WITH o AS ({ORDERS_WITH_NULLS_SQL})
SELECT o_orderkey, o_custkey, coalesce(o_totalprice, -1.0) AS o_totalprice,
       o_orderstatus, coalesce(o_orderpriority, 'UNKNOWN') AS o_orderpriority
FROM o""")
def fill_column_q(spark, sf):
    o = orders_with_nulls(spark, sf).drop("o_orderdate")
    return fill_columns(o, {"o_totalprice": -1.0, "o_orderpriority": "UNKNOWN"})


@query("null_negatives", f"""
WITH c AS (SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS c_acctbal FROM customer)
SELECT c_custkey, c_acctbal, {R6('c_acctbal * 2 + 1')} AS derived FROM c""")
def null_negatives_q(spark, sf):
    c = null_negatives(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"])
    return c.select("c_custkey", "c_acctbal", r6(F.col("c_acctbal") * 2 + 1).alias("derived"))

# ---------------------------------------------------------------- E


@query("ordinal_map", """
SELECT o_orderkey,
       CASE WHEN o_orderstatus = 'F' THEN 1.0 WHEN o_orderstatus = 'O' THEN 2.0
            ELSE TRY_CAST(o_orderstatus AS DOUBLE) END AS status_ord,
       TRY_CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS priority_ord
FROM orders""")
def ordinal_map_q(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey",
                    ordinal_map("o_orderstatus", {"F": 1, "O": 2}).alias("status_ord"),
                    ordinal_map(F.substring("o_orderpriority", 1, 1), {}).alias("priority_ord"))


@query("log_roundtrip", f"""
SELECT o_orderkey, {R6('ln(1 + o_totalprice)')} AS log_price,
       {R6('exp(ln(1 + o_totalprice)) - 1', 2)} AS back_price,
       {R6('sqrt(o_totalprice)')} AS sqrt_price
FROM orders""")
def log_roundtrip(spark, sf):
    o = table(spark, sf, "orders")
    lg = log_target("o_totalprice")
    return o.select("o_orderkey", r6(lg).alias("log_price"), r6(unlog(lg), 2).alias("back_price"),
                    r6(F.sqrt("o_totalprice")).alias("sqrt_price"))


@query("clamp", f"""
SELECT c_custkey, greatest(c_acctbal, 0.0) AS clamped,
       {R6('greatest(exp(ln(1 + abs(c_acctbal))) - 1, 0.0)', 2)} AS finished
FROM customer""")
def clamp_q(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", clamp_low("c_acctbal").alias("clamped"),
                    r6(clamp_low(unlog(log_target(F.abs("c_acctbal")))), 2).alias("finished"))

# ---------------------------------------------------------------- F


_PACKED_SQL = "CAST((year(ts) % 100) * 1000000 + month(ts) * 10000 + day(ts) * 100 + hour(ts) AS BIGINT)"


@query("packed_hour", f"""
WITH e AS (SELECT event_id, {_PACKED_SQL} AS packed FROM events),
p AS (SELECT *, strptime(lpad(CAST(packed AS VARCHAR), 8, '0'), '%y%m%d%H') AS t FROM e)
SELECT event_id, packed,
       (packed - packed % 10000) // 1000000 AS f_day,
       ((packed - packed % 10000) // 1000000) % 7 AS f_dow,
       (packed % 10000) // 100 AS f_hour,
       CAST(day(t) AS BIGINT) AS c_day, CAST(isodow(t) - 1 AS BIGINT) AS c_dow,
       CAST(hour(t) AS BIGINT) AS c_hour
FROM p""")
def packed_hour_q(spark, sf):
    e = table(spark, sf, "events")
    ts = F.col("ts")
    packed = ((F.year(ts) % 100) * 1000000 + F.month(ts) * 10000 + F.dayofmonth(ts) * 100
              + F.hour(ts)).cast("long")
    e = e.select("event_id", packed.alias("packed"))
    f = packed_hour("packed", "faithful")
    c = packed_hour("packed", "corrected")
    return e.select("event_id", "packed", f["day"].alias("f_day"), f["dow"].alias("f_dow"),
                    f["hour"].alias("f_hour"), c["day"].alias("c_day"), c["dow"].alias("c_dow"),
                    c["hour"].alias("c_hour"))


@query("date_parts", """
WITH o AS (SELECT o_orderkey, o_orderdate, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders)
SELECT o_orderkey,
       CAST(split_part(d, '-', 1) AS DOUBLE) AS year,
       CAST(split_part(d, '-', 2) AS DOUBLE) AS month,
       CAST(split_part(d, '-', 3) AS DOUBLE) AS day,
       CAST(strftime(o_orderdate, '%y') AS INTEGER) AS yy
FROM o""")
def date_parts_q(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderkey", "o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"))
    p = date_text_parts("d")
    s = short_year_parts("o_orderdate")
    return o.select("o_orderkey", p["year"].alias("year"), p["month"].alias("month"),
                    p["day"].alias("day"), s["year"].alias("yy"))


@query("weekday_parts", """
SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year,
       CAST(month(o_orderdate) AS INTEGER) AS month,
       CAST(isodow(o_orderdate) - 1 AS INTEGER) AS weekday
FROM orders""")
def weekday_parts(spark, sf):
    o = table(spark, sf, "orders")
    p = date_parts("o_orderdate")
    return o.select("o_orderkey", p["year"].alias("year"), p["month"].alias("month"),
                    p["weekday"].alias("weekday"))


@query("sas_date_parts", """
WITH l AS (
  SELECT l_orderkey, l_linenumber, l_partkey,
         CASE WHEN l_linenumber = 7 THEN NULL
              ELSE upper(strftime(l_shipdate, '%d%b%y:%H:%M:%S')) END AS v
  FROM lineitem),
p AS (SELECT *, strptime(substr(v, 1, 7), '%d%b%y') AS d FROM l)
SELECT l_orderkey, l_linenumber, l_partkey, v,
       substr(v, 1, 2) AS D, CAST(month(d) AS INTEGER) AS M, substr(v, 6, 2) AS Y,
       substr(v, 9, 2) AS H, CAST(isodow(d) - 1 AS INTEGER) AS W
FROM p""")
def sas_date_parts_q(spark, sf):
    li = table(spark, sf, "lineitem")
    ts = F.col("l_shipdate")

    def two(x):
        return F.lpad(x.cast("string"), 2, "0")
    months = F.array(*[F.lit(m.upper()) for m in MONTH_ABBREVIATIONS])
    text = F.concat(two(F.dayofmonth(ts)), F.element_at(months, F.month(ts)), two(F.year(ts) % 100),
                    F.lit(":"), two(F.hour(ts)), F.lit(":"), two(F.minute(ts)), F.lit(":"),
                    two(F.second(ts)))
    v = F.when(F.col("l_linenumber") == 7, F.lit(None)).otherwise(text)
    li = li.select("l_orderkey", "l_linenumber", "l_partkey", v.alias("v"))
    p = sas_date_parts("v", with_hour=True)
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "v",
                     *[p[k].alias(k) for k in ("D", "M", "Y", "H", "W")])


_PROMO_SQL = ("CASE p_partkey % 4 WHEN 0 THEN 'Jan,Apr,Jul,Oct' WHEN 1 THEN 'Feb,May,Aug,Nov' "
              "WHEN 2 THEN 'Mar,Jun,Sept,Dec' ELSE NULL END")
_MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


@query("month_flags", f"""
WITH p AS (SELECT p_partkey, {_PROMO_SQL} AS promo FROM part)
SELECT p_partkey, {', '.join(f"coalesce(CAST(contains(promo, '{m}') AS INTEGER), 0) AS promo{m.lower()}" for m in _MONTHS)}
FROM p""")
def month_flags_q(spark, sf):
    p = table(spark, sf, "part")
    promo = (F.when(F.pmod("p_partkey", F.lit(4)) == 0, F.lit("Jan,Apr,Jul,Oct"))
             .when(F.pmod("p_partkey", F.lit(4)) == 1, F.lit("Feb,May,Aug,Nov"))
             .when(F.pmod("p_partkey", F.lit(4)) == 2, F.lit("Mar,Jun,Sept,Dec")))
    flags = month_flags("promo")
    return p.select("p_partkey", promo.alias("promo")).select(
        "p_partkey", *[v.alias(k) for k, v in flags.items()])


@query("street_split", """
WITH a AS (SELECT p_partkey,
                  CASE WHEN p_partkey % 3 = 0 THEN p_name
                       ELSE concat(CAST(p_size AS VARCHAR), ' ', p_name) END AS address
           FROM part),
h AS (SELECT *, split_part(address, ' ', 1) AS head FROM a)
SELECT p_partkey,
       CASE WHEN regexp_full_match(head, '[0-9]+') THEN head ELSE '0' END AS street_no,
       CASE WHEN regexp_full_match(head, '[0-9]+') THEN substr(address, length(head) + 2)
            ELSE address END AS street
FROM h""")
def street_split_q(spark, sf):
    p = table(spark, sf, "part")
    addr = F.when(F.pmod("p_partkey", F.lit(3)) == 0, F.col("p_name")).otherwise(
        F.concat(F.col("p_size").cast("string"), F.lit(" "), F.col("p_name")))
    s = split_street("address")
    return p.select("p_partkey", addr.alias("address")).select(
        "p_partkey", s["street_no"].alias("street_no"), s["street"].alias("street"))


@query("name_parts", """
WITH c AS (
  SELECT c_custkey,
         concat(n_name, ', ', CASE c_custkey % 3 WHEN 0 THEN 'Mr' WHEN 1 THEN 'Mrs' ELSE 'Dr' END,
                '. ', c_name) AS name
  FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT c_custkey, name, split_part(name, ',', 1) AS surname,
       split_part(split_part(name, ',', 2), '.', 1) AS title
FROM c""")
def name_parts_q(spark, sf):
    c = left_lookup(table(spark, sf, "customer"), table(spark, sf, "nation"),
                    F.col("c_nationkey") == F.col("n_nationkey"), "inner")
    title = (F.when(F.pmod("c_custkey", F.lit(3)) == 0, F.lit("Mr"))
             .when(F.pmod("c_custkey", F.lit(3)) == 1, F.lit("Mrs")).otherwise(F.lit("Dr")))
    c = c.select("c_custkey", F.concat("n_name", F.lit(", "), title, F.lit(". "), "c_name").alias("name"))
    n = name_parts("name")
    return c.select("c_custkey", "name", n["surname"].alias("surname"), n["title"].alias("title"))


@query("hour_dark", """
WITH e AS (SELECT event_id,
                  CASE WHEN event_id % 50 = 0 THEN '2024' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS dates
           FROM events),
h AS (SELECT *, CASE WHEN length(dates) > 4 THEN substr(dates, 12, 2) ELSE '12' END AS hour FROM e)
SELECT event_id, hour, 0 AS dark,
       CAST((CAST(hour AS INTEGER) >= 18) OR (CAST(hour AS INTEGER) < 6) AS INTEGER) AS dark_corrected
FROM h""")
def hour_dark(spark, sf):
    e = table(spark, sf, "events")
    dates = F.when(F.pmod("event_id", F.lit(50)) == 0, F.lit("2024")).otherwise(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    e = e.select("event_id", dates.alias("dates")).withColumn("hour", hour_text("dates"))
    return e.select("event_id", "hour", night_flag("hour").alias("dark"),
                    night_flag("hour", "corrected").alias("dark_corrected"))


@query("rain_rate", f"""
SELECT l_orderkey, l_linenumber, l_partkey,
       {R6('pow(pow(10.0, l_quantity / 10.0) / 200.0, 0.625)')} AS rate,
       {R6('sqrt(l_quantity)')} AS sqrt_q,
       {R6('abs(l_discount - 0.05)')} AS abs_d,
       ((l_linenumber * 7 - 20) % 3 + 3) % 3 AS mod_py,
       {R6('exp(l_tax)')} AS exp_t
FROM lineitem""")
def rain_rate_q(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey",
                     r6(rain_rate("l_quantity")).alias("rate"),
                     r6(F.sqrt("l_quantity")).alias("sqrt_q"),
                     r6(F.abs(F.col("l_discount") - 0.05)).alias("abs_d"),
                     py_mod(F.col("l_linenumber") * 7 - 20, 3).alias("mod_py"),
                     r6(F.exp("l_tax")).alias("exp_t"))


def _nan_text(e: str) -> str:
    return f"coalesce(CAST({e} AS VARCHAR), 'nan')"


@query("text_crosses", f"""
WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag, l_linestatus,
                  CASE WHEN l_linenumber = 3 THEN NULL ELSE l_linenumber END AS ln
           FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey,
       concat({_nan_text('l_returnflag')}, '_', {_nan_text('l_linestatus')}) AS l_returnflag_l_linestatus,
       concat({_nan_text('l_returnflag')}, '_', {_nan_text('ln')}) AS l_returnflag_ln,
       concat({_nan_text('l_linestatus')}, '_', {_nan_text('ln')}) AS l_linestatus_ln
FROM l""")
def text_crosses_q(spark, sf):
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus",
        F.when(F.col("l_linenumber") == 3, F.lit(None)).otherwise(F.col("l_linenumber")).alias("ln"))
    crosses = text_crosses(["l_returnflag", "l_linestatus", "ln"])
    return li.select("l_orderkey", "l_linenumber", "l_partkey",
                     *[v.alias(k) for k, v in crosses.items()])


def _div_sql(a: str, b: str) -> str:
    return (f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN NULL WHEN {b} = 0 THEN "
            f"(CASE WHEN {a} > 0 THEN 'inf'::DOUBLE WHEN {a} < 0 THEN '-inf'::DOUBLE ELSE 'nan'::DOUBLE END) "
            f"ELSE {a} / {b} END")


_ARITH = ["l_quantity", "l_discount", "l_tax"]
_PAIRS = [(a, b) for i, a in enumerate(_ARITH) for b in _ARITH[i + 1:]]


def _nan_split_sql(e: str, name: str) -> str:
    """NaN reported as a flag (NaN never equals NaN in a value comparison)."""
    return (f"CASE WHEN isnan({e}) THEN NULL ELSE {R6(e)} END AS {name}, "
            f"coalesce(isnan({e}), FALSE) AS {name}_isnan")


@query("arith_crosses", "SELECT l_orderkey, l_linenumber, l_partkey, " + ", ".join(
    f"{R6(f'{a} * {b}')} AS {a}times{b}, {_nan_split_sql(_div_sql(a, b), f'{a}divs{b}')}"
    for a, b in _PAIRS) + " FROM lineitem")
def arith_crosses_q(spark, sf):
    li = table(spark, sf, "lineitem")
    out = []
    for k, v in arith_crosses(_ARITH).items():
        if "divs" in k:   # pandas division: inf for x/0, NaN for 0/0 (flagged, value NULL)
            out += [F.when(F.isnan(v), F.lit(None)).otherwise(r6(v)).alias(k),
                    F.coalesce(F.isnan(v), F.lit(False)).alias(f"{k}_isnan")]
        else:
            out.append(r6(v).alias(k))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", *out)

# ---------------------------------------------------------------- O1


@query("calibrate", f"""
SELECT o_orderkey,
       o_totalprice
           * (CASE WHEN o_orderstatus = 'O' THEN 1.0 ELSE 0.99 END)
           * (CASE WHEN o_orderpriority = '3-MEDIUM' THEN 1.005 ELSE 1.0 END)
           * (CASE WHEN o_custkey % 2 = 1 THEN 0.985 ELSE 1.015 END) AS calibrated
FROM orders""")
def calibrate_q(spark, sf):
    o = table(spark, sf, "orders").withColumn("promo", F.pmod("o_custkey", F.lit(2)))
    # The reference's three segment multipliers, mapped onto
    # order status (type 'b' -> 1.0, others 0.99), priority (assortment 'c'
    # -> 1.005) and a promo flag (1 -> 0.985, else 1.015).
    rules = [("o_orderstatus", {"O": 1.0}, 0.99),
             ("o_orderpriority", {"3-MEDIUM": 1.005}, 1.0),
             ("promo", {1: 0.985}, 1.015)]
    c = calibrate(o, "o_totalprice", rules, "calibrated")
    # same IEEE products in the same order in both engines: no rounding needed
    return c.select("o_orderkey", "calibrated")

