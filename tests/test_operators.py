"""Operator unit tests on hand-made edge tables: nulls, NaN, zero divisors,
ties, one row, constant columns -- and one test per semantics trap."""

import math

from pyspark.sql import functions as F

from fitframe.functions import (arith_crosses, divide, fill_const, hour_text, month_flags,
                                name_parts, night_flag, not_equal_keep_null, packed_hour,
                                sas_date_parts, split_street, text_crosses)
from fitframe.operators.clean import drop_null_columns, drop_outliers, noisy_verdict, profile_columns
from fitframe.operators.encode import LabelEncoder, ZScore, first_seen_codes
from fitframe.operators.impute import MixedImputer, column_modes
from fitframe.operators.metrics import auc, gini, rmspe, rmspe_unguarded
from fitframe.operators.ordered import rain_estimate
from fitframe.operators.rank import cumulative, global_rank
from fitframe.operators.split import fixed_sample_split, fold_column


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_t1_packed_hour_faithful_and_corrected(spark):
    df = spark.createDataFrame([(14102105,)], "hour long")
    f, c = packed_hour("hour"), packed_hour("hour", "corrected")
    r = df.select(*[v.alias("f_" + k) for k, v in f.items()],
                  *[v.alias("c_" + k) for k, v in c.items()]).first()
    assert (r.f_day, r.f_dow, r.f_hour) == (14, 0, 21)   # year, year % 7, day of month
    assert (r.c_day, r.c_dow, r.c_hour) == (21, 1, 5)    # 2014-10-21 was a Tuesday


def test_t2_night_flag(spark):
    df = spark.createDataFrame([("2015-05-13 23:53:00",), ("2015-05-13 03:00:00",), ("2015",)], "d string")
    out = df.select(hour_text("d").alias("h")).select("h", night_flag("h").alias("f"),
                                                     night_flag("h", "corrected").alias("c"))
    assert rows(out, "h", "f", "c") == [("23", 0, 1), ("03", 0, 1), ("12", 0, 0)]


def test_t3_not_equal_keeps_null(spark):
    df = spark.createDataFrame([(1,), (0,), (None,)], "open int")
    assert sorted(rows(df.where(not_equal_keep_null("open", 0)), "open"), key=str) == [(1,), (None,)]


def test_t4_t8_outlier_passes(spark):
    vals = [float(i % 10) for i in range(200)] + [1000.0, None]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    kept = drop_outliers(df, ["x"])
    assert kept.count() == 200                      # outlier and NULL both gone
    one = spark.createDataFrame([(1.0,)], "x double")
    assert drop_outliers(one, ["x"]).count() == 0   # sample std of one row is NULL: nothing passes


def test_t5_t6_crosses(spark):
    df = spark.createDataFrame([(1.0, 0.0, "a", None), (-1.0, 0.0, "b", 2), (0.0, 0.0, None, 3),
                                (1.0, 2.0, "c", 4), (None, 1.0, "d", 5)], "a double, b double, s string, n int")
    r = df.select(divide("a", "b").alias("q")).collect()
    q = [x.q for x in r]
    assert q[0] == math.inf and q[1] == -math.inf and math.isnan(q[2]) and q[3] == 0.5 and q[4] is None
    t = df.select(*[v.alias(k) for k, v in text_crosses(["s", "n"]).items()]).collect()
    assert [x.s_n for x in t] == ["a_nan", "b_2", "nan_3", "c_4", "d_5"]
    names = list(arith_crosses(["a", "b", "n"]))
    assert names == ["atimesb", "adivsb", "atimesn", "adivsn", "btimesn", "bdivsn"]


def test_t7_population_std_and_zero_std(spark):
    df = spark.createDataFrame([(float(i), 5.0) for i in range(60)], "x double, c double")
    m = ZScore(["x", "c"]).fit(df)
    assert abs(m.stats["x"][1] - 17.318102282486574) < 1e-9   # population std of 0..59
    out = m.transform(df).agg(F.avg("x"), F.stddev_pop("x"), F.max(F.abs("c"))).first()
    assert abs(out[0]) < 1e-12 and abs(out[1] - 1) < 1e-12 and out[2] == 0.0


def test_t9_each_side_own_fill(spark):
    from fitframe.operators.impute import impute_each
    tr = spark.createDataFrame([(1.0,), (3.0,), (None,)], "x double")
    te = spark.createDataFrame([(10.0,), (None,)], "x double")
    a, b = impute_each(tr, te, ["x"])
    assert sorted(r.x for r in a.collect()) == [1.0, 2.0, 3.0]
    assert sorted(r.x for r in b.collect()) == [10.0, 10.0]


def test_t10_t14_label_encoder_union_null_class(spark):
    tr = spark.createDataFrame([("b",), (None,), ("a",)], "v string")
    te = spark.createDataFrame([("c",), ("a",)], "v string")
    enc = LabelEncoder(["v"], ["code"]).fit(tr.unionByName(te))
    got = dict(rows(enc.transform(tr.unionByName(te)), "v", "code"))
    assert got == {None: 0, "a": 1, "b": 2, "c": 3}
    dist = LabelEncoder(["v"], ["code"], collect_max=0).fit(tr.unionByName(te))  # distributed path
    assert dict(rows(dist.transform(tr.unionByName(te)), "v", "code")) == got
    num = spark.createDataFrame([(10,), (2,), (2,), (33,)], "n int")
    assert dict(rows(LabelEncoder(["n"], ["c"]).fit(num).transform(num), "n", "c")) == {2: 0, 10: 1, 33: 2}


def test_t11_drop_null_columns_modes(spark):
    tr = spark.createDataFrame([(1, None, 1), (2, 1, 1)], "a int, b int, c int")
    te = spark.createDataFrame([(1, 1, None)], "a int, b int, c int")
    a, b = drop_null_columns(tr, te, "independent")
    assert a.columns == ["a", "c"] and b.columns == ["a", "b"]
    a, b = drop_null_columns(tr, te, "intersection")
    assert a.columns == ["a"] and b.columns == ["a"]


def test_t12_mode_ties_smallest(spark):
    df = spark.createDataFrame([("b", 2), ("a", 1), ("b", 1), ("a", 2), (None, None)], "s string, n int")
    assert column_modes(df, ["s", "n"]) == {"s": "a", "n": 1}
    filled = MixedImputer(["s"]).fit(df).transform(df)
    assert filled.where(F.col("s").isNull()).count() == 0


def test_t15_rmspe_zero_label(spark):
    df = spark.createDataFrame([(0.0, 5.0), (2.0, 1.0)], "y double, p double")
    assert abs(rmspe(df, "y", "p").first()[0] - math.sqrt(0.125)) < 1e-12
    assert math.isinf(rmspe_unguarded(df, "y", "p").first()[0])


def test_t16_gini_perfect_and_ties(spark):
    df = spark.createDataFrame([(float(i), float(i), i) for i in range(1, 51)], "y double, p double, t int")
    assert abs(gini(df, "y", "p", "t").first()[0] - 1.0) < 1e-12
    one = spark.createDataFrame([(1.0, 1.0, 1)], "y double, p double, t int")
    assert gini(one, "y", "p", "t").first()[0] == 1.0


def test_auc_with_ties(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.1)], "y int, s double")
    # pairs (pos, neg): tie 0.5 + win + loss + win = 2.5 of 4
    assert abs(auc(df, "y", "s").first()[0] - 0.625) < 1e-12


def test_t18_sas_dates(spark):
    df = spark.createDataFrame([("14JUL11:00:00:00",), ("29FEB96:21:16:00",), (None,)], "v string")
    p = sas_date_parts("v", with_hour=True)
    out = df.select(*[v.alias(k) for k, v in p.items()]).collect()
    assert (out[0].D, out[0].M, out[0].Y, out[0].W) == ("14", 7, "11", 3)
    assert (out[1].M, out[1].H, out[1].W) == (2, "21", 3)       # leap day, 1996 (Thursday)
    assert all(v is None for v in out[2])


def test_text_derivations(spark):
    df = spark.createDataFrame([("2000 Block of X ST", "Braund, Mr. Owen", "Jan,Apr,Jul,Oct"),
                                ("A ST / B ST", "Heikkinen, Miss. Laina", None)],
                               "a string, n string, p string")
    s, n, m = split_street("a"), name_parts("n"), month_flags("p")
    out = df.select(*[v.alias(k) for k, v in {**s, **n}.items()], m["promojan"].alias("jan"),
                    m["promofeb"].alias("feb")).collect()
    assert (out[0].street_no, out[0].street, out[0].surname, out[0].title) == ("2000", "Block of X ST", "Braund", " Mr")
    assert (out[1].street_no, out[1].street, out[1].jan, out[0].jan, out[0].feb) == ("0", "A ST / B ST", 0, 1, 0)


def test_fill_const_per_type(spark):
    df = spark.createDataFrame([(None, None)], "x double, s string")
    assert fill_const(df, 0).first() == (0.0, "0")


def test_global_rank_matches_window(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5000).alias("k"), (F.col("id") % 13).alias("v"))
    r = global_rank(df, [F.col("v").desc(), F.col("k").asc()], "rank", num_partitions=5)
    got = {x.k: x.rank for x in r.collect()}
    ref = sorted(df.collect(), key=lambda x: (-x.v, x.k))
    assert [got[x.k] for x in ref] == list(range(1, 5001))


def test_cumulative_two_pass(spark):
    df = spark.range(1, 1001).select(F.col("id").alias("k"), F.col("id").alias("v"))
    out = cumulative(df, [F.col("k").asc()], "v", "cum", num_partitions=7)
    assert {r.k: r.cum for r in out.collect()} == {k: k * (k + 1) // 2 for k in range(1, 1001)}
    halves = df.select("k", (F.col("v") * 0.5).alias("v"))
    out = cumulative(halves, [F.col("k").asc()], "v", "cum", num_partitions=7)
    assert {r.k: r.cum for r in out.collect()} == {k: k * (k + 1) / 4 for k in range(1, 1001)}


def test_cumulative_keeps_big_integers(spark):
    big = 2 ** 53 + 1
    df = spark.createDataFrame([(1, big, big), (2, None, 7), (3, 1, None)], "k int, v long, other long")
    got = {r.k: (r.cum, r.other) for r in cumulative(df, [F.col("k").asc()], "v", "cum", num_partitions=3).collect()}
    assert got == {1: (big, big), 2: (big, 7), 3: (big + 1, None)}


def test_fixed_sample_with_repeated_and_null_keys(spark):
    for keys in ([None, 1, 1, 2], [1, 1, 1, 2], [None, 2, 3], [None, None]):
        df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "key int, i int")
        for n in range(len(keys) + 2):
            rows = fixed_sample_split(df, n, ["key"]).collect()
            assert sorted(r.i for r in rows) == list(range(len(keys)))
            assert sum(r.is_sample for r in rows) == min(n, len(keys))


def test_small_holdout_share_is_kept(spark):
    from fitframe.operators.split import holdout
    df = spark.range(0, 400000).withColumnRenamed("id", "key")
    assert 2 <= holdout(df, ["key"], 0.00003).where("is_holdout").count() <= 40


def test_strict_schema_read(spark, tmp_path):
    import pytest as pt

    from fitframe.sources.readers import scan_csv
    (tmp_path / "a.csv").write_text("a,b\n1,x\ny,z\n")
    assert [r.a for r in scan_csv(spark, str(tmp_path / "a.csv"), "a int, b string", lenient=True).collect()] == [1, None]
    with pt.raises(Exception):
        scan_csv(spark, str(tmp_path / "a.csv"), "a int, b string").collect()


def test_auc_with_few_scores(spark):
    rows = [(i % 3, (i * 7) % 5 == 0) for i in range(600)]
    df = spark.createDataFrame([(float(s), int(y)) for s, y in rows], "s double, y int")
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert abs(auc(df, "y", "s").first()[0] - want) < 1e-12


def test_evaluator_reads_probabilities(spark):
    import pytest as pt
    from pyspark.ml.functions import array_to_vector

    from fitframe.operators.metrics import FitEvaluator, logloss
    df = spark.createDataFrame([(1, 1.0, [0.2, 0.8], 1), (0, 1.0, [0.4, 0.6], 2), (1, 0.0, [0.7, 0.3], 3), (0, 0.0, [0.9, 0.1], 4)],
                               "label int, prediction double, p array<double>, t int")
    out = df.withColumn("probability", array_to_vector("p")).withColumn("one", F.col("p")[1])
    assert abs(FitEvaluator("auc").evaluate(out) - auc(out, "label", "one").first()[0]) < 1e-12
    assert abs(FitEvaluator("logloss").evaluate(out) - logloss(out, "label", "one").first()[0]) < 1e-12
    assert abs(FitEvaluator("multi_logloss").evaluate(out) - logloss(out, "label", "one").first()[0]) < 1e-9
    assert not FitEvaluator("multi_logloss").isLargerBetter()
    with pt.raises(ValueError):
        FitEvaluator("gini")


def test_splits_partition_rows(spark):
    df = spark.range(0, 3000).withColumnRenamed("id", "key")
    f = fixed_sample_split(df, 100, ["key"])
    assert f.where("is_sample").count() == 100 and f.count() == 3000
    folds = fold_column(df, ["key"], 5)
    assert sorted(r.fold for r in folds.select("fold").distinct().collect()) == [0, 1, 2, 3, 4]


def test_profile_and_verdict(spark):
    df = spark.createDataFrame([(i, None if i % 3 else "x", i % 2) for i in range(30)],
                               "id int, sparse string, flag int")
    v = {r.name: r.verdict for r in noisy_verdict(profile_columns(df)).collect()}
    assert v == {"id": "high_cardinality", "sparse": "sparse", "flag": "keep"}


def test_first_seen_codes(spark):
    tr = spark.createDataFrame([(1, "b"), (2, "a"), (3, "b")], "k int, v string")
    te = spark.createDataFrame([(1, "c"), (2, None)], "k int, v string")
    a, b = first_seen_codes(tr, te, "v", "k", "code")
    assert dict(rows(a, "v", "code")) == {"b": 1, "a": 2}
    assert dict(rows(b, "v", "code")) == {"c": 3, None: None}


def test_rain_estimate_groups(spark):
    # groups of 1, 2 readings, a group with no finite reading, ties in minute
    data = [(1, 5, 20.0, 1), (2, 10, 30.0, 1), (2, 40, 30.0, 2), (3, 10, None, 1), (4, 30, 10.0, 2),
            (4, 30, 20.0, 1)]
    df = spark.createDataFrame(data, "id int, m int, dbz double, eid int")
    rate = lambda d: ((10 ** (d / 10)) / 200) ** 0.625
    for safe in (True, False):
        got = {r.id: r.estimate for r in rain_estimate(df, ["id"], ["m", "eid"], "m", "dbz",
                                                      skew_safe=safe).collect()}
        assert abs(got[1] - rate(20.0)) < 1e-12                               # one reading: whole hour
        assert abs(got[2] - (rate(30.0) * 10 / 60 + rate(30.0) * 50 / 60)) < 1e-12
        assert got[3] == 0.0
        assert abs(got[4] - (rate(20.0) * 30 / 60 + rate(10.0) * 30 / 60)) < 1e-12


def test_noisy_columns_approx_equals_exact(spark):
    from fitframe.operators.clean import noisy_columns
    rows_ = [(i, i % 400, None if i % 3 else "x", i % 2, i % 401) for i in range(1000)]
    df = spark.createDataFrame(rows_, "id int, near int, sparse string, flag int, over int")
    exact = noisy_columns(df, approx_first=False)
    assert exact == {"id", "sparse", "over"}
    assert noisy_columns(df, approx_first=True) == exact


def test_fixed_sample_is_n_smallest_draws(spark):
    df = spark.range(0, 5000).withColumnRenamed("id", "key")
    f = fixed_sample_split(df, 37, ["key"], seed=3)
    got = {r.key for r in f.where("is_sample").collect()}
    d = df.select("key", F.pmod(F.xxhash64(F.lit(3), F.col("key")), F.lit(1 << 62)).alias("d")).collect()
    want = {r.key for r in sorted(d, key=lambda r: (r.d, r.key))[:37]}
    assert got == want and f.count() == 5000


def test_grouped_apply_fallback_equals_skew_safe(spark):
    """The general per-group pandas path, with the rule written from its
    definition, gives the same estimates as the skew-safe DataFrame operator."""
    import numpy as np
    import pandas as pd
    from fitframe.operators.ordered import grouped_apply

    def loop(pdf: pd.DataFrame) -> pd.DataFrame:
        # by definition: a reading covers (previous minute, own minute]; the
        # last one covers up to minute 60; the first starts at minute 0
        r = pdf.sort_values(["m", "eid"]).reset_index(drop=True)
        starts = [0] + r["m"].tolist()[:-1]
        ends = r["m"].tolist()[:-1] + [60]
        total = 0.0
        for dbz, a, b in zip(r["dbz"], starts, ends):
            if dbz is not None and np.isfinite(dbz):
                total += ((10 ** (dbz / 10)) / 200) ** 0.625 * (b - a) / 60.0
        return pd.DataFrame({"id": [r["id"].iloc[0]], "estimate": [total]})

    rows_ = [(g, m, float((g * 7 + m) % 40) if (g + m) % 9 else None, e)
             for g in range(30) for e, m in enumerate(sorted({(g * 13 + k * 17) % 60 for k in range(g % 5 + 1)}))]
    df = spark.createDataFrame(rows_, "id int, m int, dbz double, eid int")
    a = {r.id: r.estimate for r in grouped_apply(df, ["id"], loop, "id int, estimate double").collect()}
    b = {r.id: r.estimate for r in rain_estimate(df, ["id"], ["m", "eid"], "m", "dbz").collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_random_split_keyed_is_stable(spark):
    from fitframe.operators.split import random_split
    df = spark.range(0, 2000).withColumnRenamed("id", "key")
    f1, tr, te = random_split(df, 0.75, seed=9, key_cols=["key"])
    f2, _, _ = random_split(df.repartition(7), 0.75, seed=9, key_cols=["key"])
    assert tr.count() + te.count() == 2000
    a = {r.key for r in f1.where("is_train").collect()}
    assert a == {r.key for r in f2.where("is_train").collect()}
    assert 1300 < len(a) < 1700


def test_fit_evaluator_matches_functions(spark):
    from fitframe.operators.metrics import FitEvaluator
    df = spark.createDataFrame([(1, 0.9, 1), (0, 0.8, 2), (1, 0.4, 3), (0, 0.1, 4), (1, 0.8, 5)],
                               "label int, prediction double, t int")
    assert abs(FitEvaluator("auc").evaluate(df) - auc(df, "label", "prediction").first()[0]) < 1e-12
    g = FitEvaluator("gini", tiebreakCol="t").evaluate(df)
    assert abs(g - gini(df, "label", "prediction", "t").first()[0]) < 1e-12
    assert FitEvaluator("rmspe").isLargerBetter() is False and FitEvaluator("auc").isLargerBetter()


def test_cluster_conf_sizes_partitions():
    from fitframe.session import cluster_conf
    c = cluster_conf(100 * 1024 ** 4, total_cores=8000)
    assert int(c["spark.sql.shuffle.partitions"]) == 200_000
    small = cluster_conf(10 * 1024 ** 3, total_cores=64)
    assert int(small["spark.sql.shuffle.partitions"]) == 192
    assert small["spark.sql.adaptive.skewJoin.enabled"] == "true"


def test_t18_swap_feature_is_explicit():
    from fitframe.operators.schema import swap_feature
    assert swap_feature(["a", "v", "b"], "v", ["vD", "vM"]) == ["a", "b", "vD", "vM"]
    # source already dropped: the parts are still added, and nothing is raised
    assert swap_feature(["a", "b"], "v", ["vD", "vM"]) == ["a", "b", "vD", "vM"]


def test_large_integer_keys_stay_exact(spark):
    big = 2 ** 60
    df = spark.createDataFrame([(big,), (big + 1,), (big + 1,), (None,)], "k long")
    enc = LabelEncoder(["k"], ["c"]).fit(df)
    assert dict(rows(enc.transform(df), "k", "c")) == {None: 0, big: 1, big + 1: 2}
    dist = LabelEncoder(["k"], ["c"], collect_max=0).fit(df)
    assert dict(rows(dist.transform(df), "k", "c")) == {None: 0, big: 1, big + 1: 2}
    assert column_modes(df, ["k"]) == {"k": big + 1}


def test_reload_or_build_builds_once(spark):
    import tempfile
    from fitframe.sources.readers import reload_or_build
    path = tempfile.mkdtemp(prefix="ff-reload-") + "/agg"
    calls = []

    def build():
        calls.append(1)
        return spark.range(0, 10).groupBy((F.col("id") % 2).alias("k")).count()
    a = reload_or_build(spark, path, build)
    b = reload_or_build(spark, path, build)
    assert len(calls) == 1 and sorted(a.collect()) == sorted(b.collect())
    reload_or_build(spark, path, build, rebuild=True)
    assert len(calls) == 2


def test_fill_template_keeps_ids_and_columns(spark):
    from fitframe.sources.sinks import fill_template
    template = spark.createDataFrame([(3, 0.0, "x"), (1, 0.0, "y"), (2, 0.0, "z")], "ID long, target double, note string")
    preds = spark.createDataFrame([(1, 0.9), (3, 0.1)], "ID long, p double")
    out = fill_template(template, preds, "ID", "target", "p")
    assert out.columns == ["ID", "target", "note"]
    assert {r.ID: r.target for r in out.collect()} == {1: 0.9, 2: None, 3: 0.1}


def test_scan_csv_strict_and_lenient_casts(spark):
    import tempfile
    import pytest
    from fitframe.sources.readers import scan_csv
    folder = tempfile.mkdtemp(prefix="ff-csv-")
    with open(folder + "/a.csv", "w") as fh:
        fh.write("id,x\n1,2.5\n2,oops\n")
    lenient = scan_csv(spark, folder, schema="id long, x string", dtype={"x": "double"}, lenient=True)
    assert sorted((r.id, r.x) for r in lenient.collect()) == [(1, 2.5), (2, None)]
    strict = scan_csv(spark, folder, schema="id long, x string", dtype={"x": "double"})
    with pytest.raises(Exception):
        strict.collect()
