"""Operator edge cases (FIXTURES §3) and invariants."""
import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from resolvr.functions.stats import t_two_sided_p
from resolvr.operators import baselines as bl
from resolvr.operators import clean, encode, joins, metrics, profile, split, trials
from resolvr.operators.quantile import exact_quantile, exact_quantiles
from resolvr.operators.rank import global_rank, sort_orders


def test_p99_values_1_to_101(spark):
    df = spark.createDataFrame([(float(v),) for v in range(1, 102)], "RESPONSE_TIME_DAYS double")
    kept, t = clean.remove_above_quantile(df)
    assert t == 100.0
    assert kept.count() == 100 and kept.agg(F.max("RESPONSE_TIME_DAYS")).first()[0] == 100.0


@pytest.mark.parametrize("buckets,final_rows", [(4096, 1_000_000), (4, 10), (2, 1)])
def test_exact_quantiles_match_numpy(spark, buckets, final_rows):
    rnd = random.Random(7)
    rows = [(g, float(rnd.randint(0, 300)) if rnd.random() > .1 else rnd.random())
            for g in ("a", "b", "c") for _ in range(rnd.randint(5, 400))]
    rows += [("hot", 1.0)] * 500 + [("hot", 2.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    qs = [0.0, 0.25, 0.5, 0.99, 1.0]
    got = {(r["g"], r["q"]): r["value"] for r in exact_quantiles(df, "v", qs, by=["g"], buckets=buckets, final_rows=final_rows).collect()}
    for g in {r[0] for r in rows}:
        vals = np.array([v for gg, v in rows if gg == g])
        for q in qs:
            assert got[(g, q)] == pytest.approx(float(np.quantile(vals, q)), rel=1e-12, abs=1e-12)
    allv = np.array([v for _, v in rows])
    assert exact_quantile(df, "v", 0.5, buckets=buckets, final_rows=final_rows) == pytest.approx(float(np.quantile(allv, 0.5)))
    glob = {r["q"]: r["value"] for r in exact_quantiles(df, "v", qs, buckets=buckets, final_rows=final_rows).collect()}
    for q in qs:
        assert glob[q] == pytest.approx(float(np.quantile(allv, q)), rel=1e-12, abs=1e-12)


def test_global_rank_matches_sort_with_hot_day(spark):
    base = dt.datetime(2020, 1, 1)
    rows = [(f"k{i:04d}", base + dt.timedelta(days=0 if i % 3 == 0 else i)) for i in range(600)]
    rows.append(("knull", None))
    df = spark.createDataFrame(rows, "SR_NUMBER string, CREATED_DATE timestamp_ntz")
    r = global_rank(df, sort_orders(["CREATED_DATE"], df), num_partitions=7)
    got = [x["SR_NUMBER"] for x in r.orderBy("row_rank").collect()]
    exp = [k for k, _ in sorted(rows, key=lambda kv: (kv[1] is None, kv[1] or base, kv[0]))]
    assert got == exp
    assert [x["row_rank"] for x in r.orderBy("row_rank").collect()] == list(range(1, 602))


def test_split_sizes_and_invariants(spark):
    rows = [(f"k{i:02d}", dt.datetime(2020, 1, 1) + dt.timedelta(hours=i // 2)) for i in range(11)]
    df = spark.createDataFrame(rows, "SR_NUMBER string, CREATED_DATE timestamp_ntz")
    s = split.chronological_split(df, 0.2, 0.2)
    counts = {r["split"]: r["count"] for r in s.groupBy("split").count().collect()}
    assert counts == {"train": 7, "val": 2, "test": 2}
    b = {r["split"]: (r["mn"], r["mx"]) for r in s.groupBy("split").agg(F.min("CREATED_DATE").alias("mn"), F.max("CREATED_DATE").alias("mx")).collect()}
    assert b["train"][1] <= b["val"][0] and b["val"][1] <= b["test"][0]
    assert s.select("SR_NUMBER").distinct().count() == 11
    # same assignment with a different partition count (ties on the time)
    s2 = split.chronological_split(df.repartition(5), 0.2, 0.2)
    assert sorted(map(tuple, s.select("SR_NUMBER", "split").collect())) == sorted(map(tuple, s2.select("SR_NUMBER", "split").collect()))
    summ = {r["split"]: r["n_rows"] for r in split.split_summary(s).collect()}
    assert summ["total"] == 11


def test_cv_folds_n12_k5(spark):
    f = split.cv_fold_bounds(spark, 12, 5).collect()
    assert [(r["train_end"], r["val_end"]) for r in f] == [(2, 4), (4, 6), (6, 8), (8, 10), (10, 12)]
    ranked = spark.createDataFrame([(i,) for i in range(1, 13)], "row_rank long")
    a = split.cv_assign(ranked, 12, 5)
    val0 = sorted(r["row_rank"] for r in a.where("fold = 0 AND role = 'val'").collect())
    assert val0 == [3, 4]
    # no fold trains on a later rank than it validates
    bad = a.groupBy("fold").agg(F.max(F.when(F.col("role") == "train", F.col("row_rank"))).alias("tr"),
                                F.min(F.when(F.col("role") == "val", F.col("row_rank"))).alias("va")).where("tr >= va")
    assert bad.count() == 0


def test_exact_sample_and_random_split(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("SR_NUMBER"))
    a = split.exact_sample(df, 100, 42)
    b = split.exact_sample(df.repartition(7), 100, 42)
    assert a.count() == 100
    assert sorted(r[0] for r in a.collect()) == sorted(r[0] for r in b.collect())
    assert split.exact_sample(df, 300, 42).count() == 300
    assert split.exact_sample(df, 2000, 42).count() == 1000
    assert split.exact_sample(df.limit(0), 5, 42).count() == 0
    rs = split.random_split(df, 0.2, 42)
    assert rs.where("split = 'test'").count() == 200
    assert split.proportional_sample(df, 5000).count() == 1000


def test_split_by_selection_matches_the_ranked_split(spark):
    """One hot time over both boundaries, null times, few distinct times."""
    rows = [(str(i), None if i % 11 == 0 else f"2020-01-0{1 + (i % 3) * (i % 2)} 00:00:00") for i in range(301)]
    df = spark.createDataFrame(rows, "SR_NUMBER string, t string").select(
        "SR_NUMBER", F.col("t").cast("timestamp_ntz").alias("CREATED_DATE"))
    for test, val in [(0.2, 0.2), (0.2, 0.0), (0.02, 0.05), (0.0, 0.0)]:
        got = {r["SR_NUMBER"]: r["split"] for r in split.chronological_split(df, test, val).collect()}
        want = split.ranked_split(split.rank_by_time(df), test, val)
        assert got == {r["SR_NUMBER"]: r["split"] for r in want.collect()}
        assert len(got) == 301
    assert split.chronological_split(df.limit(0)).count() == 0


def test_repeated_keys_are_sampled_exactly(spark):
    df = spark.range(90).select(F.lit("same").alias("SR_NUMBER"), F.col("id").alias("v"))
    got = sorted(r["v"] for r in split.exact_sample(df, 31).collect())
    assert got == list(range(31))
    assert split.random_split(df, 0.5).where("split = 'test'").count() == 45


def test_baseline_unseen_key_and_null_zip(spark):
    train = spark.createDataFrame([("A", "1", 10.0), ("A", "2", 20.0), ("B", "1", 30.0), ("B", None, 40.0)],
                                  "SR_TYPE string, ZIP_CODE string, RESPONSE_TIME_DAYS double")
    test = spark.createDataFrame([("t1", "A", "1", 0.0), ("t2", "C", "1", 0.0), ("t3", "B", None, 0.0)],
                                 "SR_NUMBER string, SR_TYPE string, ZIP_CODE string, RESPONSE_TIME_DAYS double")
    gm = 25.0
    p = {r["SR_NUMBER"]: r["prediction"] for r in bl.mean_lookup(test, train, ["SR_TYPE", "ZIP_CODE"]).collect()}
    assert p == {"t1": 10.0, "t2": gm, "t3": gm}
    p1 = {r["SR_NUMBER"]: r["prediction"] for r in bl.mean_lookup(test, train, ["SR_TYPE"]).collect()}
    assert p1 == {"t1": 15.0, "t2": gm, "t3": 35.0}
    long = bl.baseline_predictions(test, train)
    assert long.count() == 12


def test_label_dictionary_null_and_unseen(spark):
    train = spark.createDataFrame([("b", None), ("a", "x")], "SR_TYPE string, ZIP_CODE string")
    test = spark.createDataFrame([("Z", None), ("b", "x")], "SR_TYPE string, ZIP_CODE string")
    d = encode.fit_label_dictionary(train, ["SR_TYPE", "ZIP_CODE"])
    codes = {(r["column_name"], r["label"]): r["code"] for r in d.collect()}
    assert codes == {("SR_TYPE", "a"): 0, ("SR_TYPE", "b"): 1, ("ZIP_CODE", "nan"): 0, ("ZIP_CODE", "x"): 1}
    e = encode.apply_label_dictionary(test, d, ["SR_TYPE", "ZIP_CODE"]).orderBy("SR_TYPE").collect()
    assert [(r["SR_TYPE_code"], r["ZIP_CODE_code"]) for r in e] == [(-1, 0), (1, 1)]


def test_metrics_constant_target(spark):
    df = spark.createDataFrame([("m", 5.0, 5.0), ("m", 5.0, 5.0)], "model_name string, y_true double, y_pred double")
    assert metrics.regression_metrics(df).first()["r2"] == 1.0
    df2 = spark.createDataFrame([("m", 5.0, 4.0), ("m", 5.0, 6.0)], "model_name string, y_true double, y_pred double")
    r = metrics.regression_metrics(df2).first()
    assert r["r2"] == 0.0 and r["mae"] == 1.0 and r["rmse"] == 1.0


def test_metrics_match_formula(spark):
    rnd = random.Random(3)
    ys = [(rnd.random() * 10, rnd.random() * 10) for _ in range(200)]
    df = spark.createDataFrame([("m", a, b) for a, b in ys], "model_name string, y_true double, y_pred double")
    r = metrics.regression_metrics(df).first()
    y = np.array([a for a, _ in ys]); p = np.array([b for _, b in ys])
    assert r["r2"] == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert r["mae"] == pytest.approx(np.abs(y - p).mean())


def test_histogram_max_in_last_bucket(spark):
    df = spark.createDataFrame([(float(v),) for v in [0, 1, 2, 3, 10]], "x double")
    h = profile.histogram(df, "x", 5).orderBy("bucket").collect()
    assert [r["n"] for r in h] == [2, 2, 0, 0, 1]
    assert len(h) == 5
    c = profile.histogram(spark.createDataFrame([(3.0,)], "x double"), "x", 50).where("n > 0").first()
    assert c["bucket"] == 25


def test_mode_tie_smallest(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), ("b",), (None,)], "c string")
    assert profile.column_modes(df, ["c"]).first()["mode"] == "a"


def test_ttest_known_values(spark):
    a = [9.9, 10.1, 9.8, 10.0, 10.2]
    b = [9.7, 9.6, 9.9, 9.5, 9.8]
    df = spark.createDataFrame([("A", i, v, 0.0) for i, v in enumerate(a)] + [("B", i, v, 0.0) for i, v in enumerate(b)],
                               "model string, seed int, mae double, rmse double")
    r = trials.ttest_pairs(df).first()
    assert r["t_statistic"] ** 2 == pytest.approx(9.0)
    assert r["p_value"] == pytest.approx(0.0170717, abs=1e-7)
    assert r["Significant"] == "Yes"


@pytest.mark.parametrize("t,nu,p", [(1.0, 1, 0.5), (2.0, 2, 0.1835034), (2.0, 3, 0.1393260), (0.0, 7, 1.0)])
def test_t_p_value_series(spark, t, nu, p):
    got = spark.range(1).select(t_two_sided_p(F.lit(t), F.lit(nu))).first()[0]
    assert got == pytest.approx(p, abs=1e-7)


def test_trial_summary_population_std(spark):
    df = spark.createDataFrame([("m", 1, 1.0, 2.0), ("m", 2, 3.0, 2.0)], "model string, seed int, mae double, rmse double")
    r = trials.trial_summary(df).first()
    assert r["MAE_std"] == 1.0 and r["RMSE_std"] == 0.0 and r["n_trials"] == 2


def test_weather_join_keeps_rows_and_flags(spark):
    req = spark.createDataFrame([("r1", dt.datetime(2020, 1, 1, 5), 1), ("r2", dt.datetime(2020, 1, 2, 5), 1),
                                 ("r3", dt.datetime(2020, 1, 3, 5), 1)],
                                "SR_NUMBER string, CREATED_DATE timestamp_ntz, CREATED_MONTH int")
    w = spark.createDataFrame([(dt.date(2020, 1, 1), 10.0, 0.6, 1.0), (dt.date(2020, 1, 2), None, 0.0, 0.0)],
                              "date date, temp_mean double, precipitation double, snowfall double")
    j = joins.weather_join(req, w)
    assert j.count() == 3
    miss = [r["date"] for r in joins.missing_weather_dates(req, w).collect()]
    assert miss == [dt.date(2020, 1, 2), dt.date(2020, 1, 3)]
    cnt = joins.weather_flag_counts(j).first()
    assert tuple(cnt) == (1, 1, 1)
    kept, obs = clean.drop_missing_weather(j)
    assert kept.count() == 1 and obs.get["n_dropped"] == 2
    dup = w.unionByName(w)
    with pytest.raises(ValueError):
        joins.weather_join(req, dup)


def test_weather_json_rows(spark):
    from resolvr.sources.files import weather_json_rows
    payload = '{"daily": {"time": ["2020-01-01", "2020-01-02"], "temperature_2m_mean": [1.5, null], "precipitation_sum": [0.0, 0.7], "snowfall_sum": [0.1, 0.0]}}'
    rows = weather_json_rows(spark.createDataFrame([(payload,)], "payload string")).orderBy("date").collect()
    assert [(r["date"], r["temp_mean"], r["precipitation"]) for r in rows] == [(dt.date(2020, 1, 1), 1.5, 0.0), (dt.date(2020, 1, 2), None, 0.7)]


def test_csv_sources_and_missing_path(spark, tmp_path):
    from resolvr.sources import files
    p = tmp_path / "req.csv"
    p.write_text("SR_NUMBER,SR_TYPE,ORIGIN,CREATED_DATE,CLOSED_DATE,ZIP_CODE,CREATED_HOUR,CREATED_DAY_OF_WEEK,CREATED_MONTH,LATITUDE,LONGITUDE\n"
                 "1,A,web,01/31/2020 12:05:00 AM,,60601,0,4,1,,\n")
    df = files.load_requests(spark, str(p))
    r = df.first()
    assert r["CREATED_DATE"] == dt.datetime(2020, 1, 31, 0, 5) and r["CLOSED_DATE"] is None and r["LATITUDE"] is None
    assert clean.drop_null(clean.with_response_time(df), ["RESPONSE_TIME_DAYS"]).count() == 0
    with pytest.raises(Exception):
        files.load_raw_requests(spark, str(tmp_path / "missing.csv")).count()
    with pytest.raises(FileNotFoundError):
        files.load_augmented(spark, str(tmp_path / "nope"))
    out = tmp_path / "cache"
    made = files.cached_table(spark, str(out), lambda: spark.range(3))
    assert made.count() == 3
    again = files.cached_table(spark, str(out), lambda: spark.range(10))
    assert again.count() == 3


def test_keep_columns_and_numeric(spark):
    df = spark.createDataFrame([(1, "x", 2.0)], "CREATED_HOUR int, EXTRA string, LATITUDE double")
    assert clean.keep_columns(df).columns == ["CREATED_HOUR", "LATITUDE"]
    assert clean.dropped_columns(df) == ["EXTRA"]
    assert clean.numeric_columns(df) == ["CREATED_HOUR", "LATITUDE"]


def test_improvement_and_ablation(spark):
    m = spark.createDataFrame([("Baseline_1", 10.0), ("RF", 8.0), ("Full_Model", 9.0)], "model_name string, mae double")
    r = metrics.improvement_over_baseline(m).first()
    assert r["best_model"] == "RF" and r["best_baseline"] == "Baseline_1" and r["improvement_pct"] == pytest.approx(20.0)
    a = {x["model_name"]: x["mae_impact"] for x in metrics.ablation_impact(m).collect()}
    assert a == {"Baseline_1": 1.0, "RF": -1.0}


def test_reports_on_empty_input(spark):
    e = spark.createDataFrame([], "RESPONSE_TIME_DAYS double, model_name string, mae double")
    assert clean.removal_report(e, "RESPONSE_TIME_DAYS", 1.0).first()["pct_removed"] is None
    assert profile.null_counts(e.select("RESPONSE_TIME_DAYS")).first()["null_pct"] is None
    assert clean.remove_above_quantile(e)[1] is None
    m = spark.createDataFrame([("Baseline_0", 0.0), ("Full_Model", 0.0)], "model_name string, mae double")
    assert metrics.improvement_over_baseline(m).first()["improvement_pct"] is None
    assert metrics.ablation_impact(m).first()["pct_change"] is None


def test_spread_small_scan(spark):
    from resolvr.sources.tables import read_table, spread_small_scan
    slots = spark.sparkContext.defaultParallelism
    li = read_table(spark, "/root/testdata/sf0.001", "lineitem").select("l_orderkey", "l_quantity")
    spread = spread_small_scan(li)
    # one row group -> one split; spread over the slots, same rows
    assert li.rdd.getNumPartitions() < slots
    assert spread.rdd.getNumPartitions() == slots
    assert sorted(spread.collect()) == sorted(li.collect())
    # an input that already has enough splits is returned as it is
    wide = spark.range(0, 100, 1, slots + 2)
    assert spread_small_scan(wide) is wide


def test_required_columns_are_required(spark):
    from pyspark.errors import AnalysisException
    assert len(clean.KEEP_COLUMNS) == 13 and len(clean.REQUIRED_COLUMNS) == 9
    df = spark.createDataFrame([("k", 1)], "SR_NUMBER string, CREATED_HOUR int")
    with pytest.raises(AnalysisException):
        clean.select_required(df)


def test_cutoff_leaves_rows_without_a_time_out(spark):
    df = spark.sql("SELECT * FROM VALUES (1, TIMESTAMP_NTZ '2023-12-31'), (2, TIMESTAMP_NTZ '2024-01-01'), (3, NULL) "
                   "AS t(i, CREATED_DATE)")
    got = {r.i: r.split for r in split.cutoff_split(df).collect()}
    assert got == {1: "train", 2: "test", 3: None}


def test_constant_and_empty_columns(spark):
    df = spark.createDataFrame([(1.0, 5.0, 2.0), (2.0, 5.0, 4.0), (3.0, 5.0, 6.0)], "a double, b double, c double")
    m = {(r.feature_a, r.feature_b): r["corr"] for r in profile.correlation_matrix(df, ["a", "b", "c"]).collect()}
    assert m["a", "c"] == pytest.approx(1.0) and m["a", "a"] == 1.0
    assert m["a", "b"] is None and m["b", "b"] is None
    cells = profile.hexbin_mean(df, "b", "a", "c").collect()
    assert sum(r.n_points for r in cells) == 3
    assert profile.hexbin_mean(df.where("a > 9"), "b", "a", "c").count() == 0


def test_quantiles_leave_nan_out(spark):
    from resolvr.operators.quantile import exact_quantile
    df = spark.createDataFrame([(float(i),) for i in range(11)] + [(float("nan"),), (None,)], "x double")
    assert exact_quantile(df, "x", 0.5, final_rows=2, buckets=4) == 5.0


def test_ensemble_keeps_rows_of_one_key_apart(spark):
    from pyspark.ml.feature import VectorAssembler
    from resolvr.operators import models as md
    df = spark.createDataFrame([("k", 0.0, 1.0), ("k", 1.0, 2.0), ("m", 2.0, 3.0)], "SR_NUMBER string, x double, y_true double")
    f = VectorAssembler(inputCols=["x"], outputCol="features").transform(df.selectExpr("*", "log1p(y_true) AS label"))
    models = [md.fit(md.linear_pipeline([], []), f) for _ in range(2)]
    got = md.ensemble_predictions(models, f).collect()
    assert sorted((r.SR_NUMBER, r.y_true) for r in got) == [("k", 1.0), ("k", 2.0), ("m", 3.0)]
