"""Plan tests: no Python UDF on the relational path, no single-partition
window for global order, filters and projections reach the Parquet scan,
and fitted operators run a bounded number of jobs."""

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from fitframe.operators.rank import global_rank
from tests.conftest import SF_SMALL

# queries whose work is by design Arrow-batched Python (blocked kNN distances)
PANDAS_BY_DESIGN = {"knn_exact", "knn_minkowski"}
# fits: building the query trains the model, and what is left to plan is one row
FITS = {n for n, fn in queries().items() if fn.__module__.endswith("q_models")}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(oracle_sql()) - PANDAS_BY_DESIGN - FITS))
def test_no_python_udf(spark, name):
    p = plan(queries()[name](spark, SF_SMALL))
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p, name


def test_global_rank_has_no_single_partition_window(spark):
    df = spark.range(0, 1000).select(F.col("id"), (F.col("id") % 7).alias("v"))
    r = global_rank(df, [F.col("v").asc(), F.col("id").asc()], "rank")
    p = plan(r)
    assert "SinglePartition" not in p and "Window" not in p


def test_filter_and_projection_pushed_to_scan(spark):
    df = queries()["filter_null_safe"](spark, SF_SMALL)
    p = plan(df)
    assert "PushedFilters" in p
    li = queries()["scan_project_cast"](spark, SF_SMALL)
    scan = [ln for ln in plan(li).splitlines() if "FileScan parquet" in ln][0]
    assert "l_shipdate" not in scan and "l_suppkey" not in scan


def test_dimension_side_broadcast(spark):
    p = plan(queries()["join_left"](spark, SF_SMALL))
    assert "BroadcastHashJoin" in p or "BroadcastExchange" in p


def test_hot_group_spreads_over_partitions(spark):
    """A group holding a third of all rows is split across range partitions."""
    from fitframe.operators.rank import sorted_tagged
    df = spark.range(0, 30000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 997).cast("string")).alias("g"),
        F.col("id"))
    tagged = sorted_tagged(df, [F.col("g").asc(), F.col("id").asc()], num_partitions=8)
    assert tagged.where(F.col("g") == "hot").select("_ff_pid").distinct().count() >= 2


def test_skew_safe_group_ops_have_no_window(spark):
    from fitframe.operators.ordered import lag_diff, weighted_duration
    df = spark.range(0, 2000).select((F.col("id") % 3).alias("g"), (F.col("id") % 60).alias("m"),
                                     F.col("id"), (F.col("id") % 50).cast("double").alias("r"))
    wd = weighted_duration(df, ["g"], ["m", "id"], "m", F.col("r"), skew_safe=True)
    lg = lag_diff(df, ["g"], ["m", "id"], "r", skew_safe=True)
    for p in (plan(wd), plan(lg)):
        assert "Window" not in p
    slow = weighted_duration(df, ["g"], ["m", "id"], "m", F.col("r"), skew_safe=False)
    got = {r.g: r.estimate for r in wd.collect()}
    assert all(abs(got[r.g] - r.estimate) < 1e-9 for r in slow.collect())


def test_large_dictionary_uses_shuffle_join(spark):
    from fitframe.operators.encode import LabelEncoder
    df = spark.range(0, 3000).select((F.col("id") % 1000).cast("string").alias("v"))
    small = LabelEncoder(["v"], ["c"]).fit(df)
    large = LabelEncoder(["v"], ["c"], broadcast_bytes=10, collect_max=0).fit(df)
    p = plan(large.transform(df))
    assert "SortMergeJoin" in p or "ShuffledHashJoin" in p
    a = {r.v: r.c for r in small.transform(df).collect()}
    b = {r.v: r.c for r in large.transform(df).collect()}
    assert a == b and sorted(a.values()) == list(range(1000))


def _jobs(spark, group, fn):
    sc = spark.sparkContext
    sc.setJobGroup(group, group)
    try:
        fn()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    return len(sc.statusTracker().getJobIdsForGroup(group))


def test_one_pass_per_fit_regardless_of_width(spark):
    """Fits run the same number of jobs for 2 columns as for 20 (one aggregate
    or one unpivot per statistic kind, never a job per column)."""
    from fitframe.operators.encode import LabelEncoder, ZScore
    from fitframe.operators.impute import column_modes
    wide = spark.range(0, 2000).select(*[((F.col("id") * (i + 3)) % (7 + i)).alias(f"c{i}") for i in range(20)])
    narrow = wide.select("c0", "c1")
    fits = {"zscore": lambda d: ZScore(d.columns).fit(d),
            "modes": lambda d: column_modes(d, d.columns),
            "codes": lambda d: LabelEncoder(d.columns).fit(d)}
    for name, fit in fits.items():
        n_narrow = _jobs(spark, f"{name}-2", lambda: fit(narrow))
        n_wide = _jobs(spark, f"{name}-20", lambda: fit(wide))
        assert n_wide == n_narrow <= 4, (name, n_narrow, n_wide)


def test_ordered_groups_are_skew_safe_unless_told(spark):
    from fitframe.operators.ordered import lag_diff
    df = spark.range(0, 3000).select((F.col("id") % 3).alias("g"), F.col("id"),
                                     (F.col("id") % 50).cast("double").alias("r"))
    assert "Window" not in plan(lag_diff(df, ["g"], ["id"], "r"))
    assert "Window" in plan(lag_diff(df, ["g"], ["id"], "r", skew_safe=False))


def test_rank_path_equals_window_path_on_events(spark):
    from fitframe.operators.ordered import lag_diff, rain_estimate
    e = spark.read.parquet(f"{SF_SMALL}/events.parquet").select(
        "event_id", "user_id", "ts", "value", "event_type",
        F.date_format("ts", "yyyy-MM-dd HH").alias("hour_key"), F.minute("ts").alias("mnt"),
        F.least(F.col("value"), F.lit(55.0)).alias("dbz"))
    a = {(r.event_type, r.hour_key): r.estimate for r in
         rain_estimate(e, ["event_type", "hour_key"], ["mnt", "event_id"], "mnt", "dbz", skew_safe=True).collect()}
    b = {(r.event_type, r.hour_key): r.estimate for r in
         rain_estimate(e, ["event_type", "hour_key"], ["mnt", "event_id"], "mnt", "dbz", skew_safe=False).collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)
    x = {r.event_id: r.delta for r in lag_diff(e, ["user_id"], ["ts", "event_id"], "value", skew_safe=True).collect()}
    y = {r.event_id: r.delta for r in lag_diff(e, ["user_id"], ["ts", "event_id"], "value", skew_safe=False).collect()}
    assert x == y


def test_reuse_if_shuffled(spark):
    from fitframe.session import reuse_if_shuffled
    small = spark.range(0, 100).withColumnRenamed("id", "k")
    big = spark.range(0, 10000).select((F.col("id") % 100).alias("k"), F.col("id"))
    broadcast_join = big.join(F.broadcast(small), "k")
    assert reuse_if_shuffled(broadcast_join) is broadcast_join        # scan + broadcast: reread
    shuffled = big.groupBy("k").count()
    kept = reuse_if_shuffled(shuffled)
    assert kept is not shuffled and "Exchange" not in plan(kept)       # materialised once
    assert sorted(kept.collect()) == sorted(shuffled.collect())


def test_dictionaries_are_joined_by_their_bytes(spark):
    from fitframe.operators.encode import LabelEncoder
    wide = spark.range(0, 500).select(
        *[F.when(F.col("id") % 11 == i % 11, None).otherwise(((F.col("id") * (i + 1)) % 13).cast("string"))
          .alias(f"c{i}") for i in range(8)])
    enc = LabelEncoder(wide.columns, [f"k{i}" for i in range(8)]).fit(wide)
    out = enc.transform(wide)
    p = plan(out)
    assert "BroadcastHashJoin" in p and "SortMergeJoin" not in p
    enc.broadcast_bytes = 0
    other = enc.transform(wide).select(*out.columns)
    assert sorted(map(str, out.collect())) == sorted(map(str, other.collect()))


def test_unseen_labels(spark):
    from fitframe.operators.encode import LabelEncoder
    seen = spark.createDataFrame([("a",), ("b",)], "v string")
    new = spark.createDataFrame([("b",), ("z",)], "v string")
    assert [r.c for r in LabelEncoder(["v"], ["c"]).fit(seen).transform(new).orderBy("v").collect()] == [1, None]
    strict = LabelEncoder(["v"], ["c"], handle_unseen="error").fit(seen)
    assert strict.transform(seen).count() == 2
    with pytest.raises(Exception, match="unseen value z"):
        strict.transform(new).collect()


def test_cumulative_stays_in_the_jvm(spark):
    from fitframe.operators.rank import cumulative
    df = spark.range(0, 3000).select(F.col("id").alias("k"), (F.col("id") % 17).alias("v"))
    out = cumulative(df, [F.col("k").asc()], "v", "c", num_partitions=6)
    p = plan(out)
    assert "InPandas" not in p and "Exchange hashpartitioning" not in p and "SinglePartition" not in p


def test_size_checks_see_the_plan(spark):
    from fitframe.operators.rank import _partitions
    from fitframe.operators.relate import broadcast_if_small, estimated_bytes, leaf_bytes
    nation = spark.read.parquet(f"{SF_SMALL}/nation.parquet")
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    orders = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    assert 0 < estimated_bytes(nation) < 1 << 20 and leaf_bytes(nation) == estimated_bytes(nation)
    joined = li.join(orders, li.l_orderkey == orders.o_orderkey)
    assert leaf_bytes(joined) == leaf_bytes(li.where("l_orderkey IS NOT NULL")) + leaf_bytes(orders)
    assert estimated_bytes(joined) > 1000 * leaf_bytes(joined)      # the product of the sides
    assert leaf_bytes(li.groupBy("l_returnflag").count()) == leaf_bytes(li)
    assert _partitions(joined, None) == 4                           # not one for each 128 MB of the product
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        on = F.col("l_linenumber") == F.col("n_nationkey")
        assert "BroadcastHashJoin" in plan(li.join(broadcast_if_small(nation), on))
        assert "BroadcastHashJoin" not in plan(li.join(broadcast_if_small(nation, max_bytes=1), on))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
