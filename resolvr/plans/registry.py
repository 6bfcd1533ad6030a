"""Driver keys: one Spark query per operator of the inventory.

Every callable takes (spark, sf_dir) and returns a DataFrame over the whole
tables of ``sf_dir``. Computed doubles are rounded in the query (not in the
operators) so that sums merged in a different order compare equal.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as lf
from ..functions import time as tf
from ..functions.stats import exact_avg
from ..operators import attribution as at
from ..operators import baselines as bl
from ..operators import clean, encode, joins, metrics, profile, split, trials
from ..session import persist_table, scratch_path
from ..sources import files
from . import prepare as pp

#: First day and the day after the last of the months read back.
PARTITION_RANGE = ("1996-03-01", "1997-02-15")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def key(name: str):
    """Register ``fn`` as a driver key. Timestamps are NTZ; the response-time
    arithmetic goes through the session zone, so every key pins it to UTC
    (no daylight-saving gaps)."""
    def deco(fn):
        def run(spark, sf_dir):
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        return fn
    return deco


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def r3(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 3)


def as_long(c):
    return (F.col(c) if isinstance(c, str) else c).cast("long")


# ---------------------------------------------------------------- P7-P14

@key("response_time_fractional")
def response_time_fractional(spark, d):
    r = pp.requests(spark, d)
    return r.select("SR_NUMBER", "CREATED_DATE", "CLOSED_DATE", r6("RESPONSE_TIME_DAYS").alias("RESPONSE_TIME_DAYS"))


@key("response_time_floor")
def response_time_floor(spark, d):
    r = clean.with_response_category(pp.requests(spark, d))
    return r.select("SR_NUMBER", as_long("RESPONSE_TIME_WHOLE_DAYS").alias("RESPONSE_TIME_WHOLE_DAYS"))


@key("response_category")
def response_category(spark, d):
    r = clean.with_response_category(pp.requests(spark, d))
    return r.select("SR_NUMBER", as_long("RESPONSE_TIME_WHOLE_DAYS").alias("RESPONSE_TIME_WHOLE_DAYS"),
                    "RESPONSE_TIME_CATEGORY",
                    as_long("RESPONSE_TIME_CATEGORY_ORDINAL").alias("RESPONSE_TIME_CATEGORY_ORDINAL"))


@key("time_features")
def time_features(spark, d):
    r = clean.with_time_features(pp.requests(spark, d))
    return r.select("SR_NUMBER", as_long("CREATED_HOUR").alias("CREATED_HOUR"),
                    as_long("CREATED_DAY_OF_WEEK").alias("CREATED_DAY_OF_WEEK"),
                    as_long("CREATED_MONTH").alias("CREATED_MONTH"), "CREATED_DAY",
                    "CREATED_MONTH_START", as_long("CREATED_YEAR").alias("CREATED_YEAR"))


# ---------------------------------------------------------------- P1-P3, P23, P28-P30

@key("timestamp_parse_lenient")
def timestamp_parse_lenient(spark, d):
    r = pp.requests(spark, d)
    t = r.select(
        "SR_NUMBER",
        F.date_format("CREATED_DATE", tf.US_FORMAT).alias("CREATED_TEXT"),
        F.date_format("CLOSED_DATE", tf.ISO_FORMAT).alias("CLOSED_TEXT"),
        F.when(F.col("ORIGIN") == "BUILDING", F.lit("not a date"))
         .otherwise(F.date_format("CREATED_DATE", tf.US_FORMAT)).alias("RAW_TEXT"))
    return t.select("SR_NUMBER", "CREATED_TEXT",
                    tf.parse_lenient("CREATED_TEXT").alias("CREATED_PARSED"),
                    tf.parse_inferred("CLOSED_TEXT").alias("CLOSED_PARSED"),
                    "RAW_TEXT", tf.parse_lenient("RAW_TEXT").alias("RAW_PARSED"))


@key("string_null_code")
def string_null_code(spark, d):
    # the weather row's own date comes along: null where no row matched
    j = joins.weather_join(pp.requests(spark, d), pp.weather(spark, d).withColumn("_wd", F.col("date")))
    return j.select("SR_NUMBER", lf.null_code("ZIP_CODE").alias("ZIP_CODE_TEXT"),
                    lf.null_code(F.col("_wd")).alias("WEATHER_DATE_TEXT"))


def _baseline_metrics(spark, d) -> DataFrame:
    train, test = pp.train_test(spark, d)
    return metrics.regression_metrics(bl.baseline_predictions(test, train))


def _rounded_metrics(m: DataFrame) -> DataFrame:
    return m.select("model_name", r3("mse").alias("mse"), r6("rmse").alias("rmse"), r6("mae").alias("mae"),
                    r6("r2").alias("r2"), "n_samples")


@key("flag_map")
def flag_map(spark, d):
    feed = metrics.chart_feed(_baseline_metrics(spark, d))
    return feed.select("model_name", "clean_label", "series", "mae_2dp", "rmse_2dp")


# ---------------------------------------------------------------- P15-P17

@key("positive_only")
def positive_only(spark, d):
    r = clean.positive_only(pp.eda_frame(spark, d))
    return r.select("SR_NUMBER", r6("RESPONSE_TIME_DAYS").alias("RESPONSE_TIME_DAYS"))


@key("p99_filter")
def p99_filter(spark, d):
    return pp.capped(spark, d).select("SR_NUMBER", r6("RESPONSE_TIME_DAYS").alias("RESPONSE_TIME_DAYS"))


@key("p99_removed")
def p99_removed(spark, d):
    rep = clean.removal_report(pp.eda_frame(spark, d), "RESPONSE_TIME_DAYS", pp.p99(spark, d))
    return rep.select(r6("threshold").alias("threshold"), "n_before", "n_removed",
                      r6("pct_removed").alias("pct_removed"))


# ---------------------------------------------------------------- J1, J4, P18-P22, A14-A18

def _weather_joined(spark, d) -> DataFrame:
    return joins.weather_join(pp.requests(spark, d), pp.weather(spark, d))


@key("weather_join")
def weather_join(spark, d):
    return _weather_joined(spark, d).select("SR_NUMBER", "CREATED_DAY", "temp_mean", "precipitation", "snowfall")


@key("weather_features")
def weather_features(spark, d):
    f = joins.with_weather_features(_weather_joined(spark, d))
    return f.select("SR_NUMBER", as_long("extreme_cold").alias("extreme_cold"),
                    as_long("heavy_precipitation").alias("heavy_precipitation"),
                    as_long("snow_day").alias("snow_day"), as_long("temp_normal").alias("temp_normal"),
                    r6("temp_deviation").alias("temp_deviation"))


@key("weather_complete")
def weather_complete(spark, d):
    kept, _obs = clean.drop_missing_weather(_weather_joined(spark, d))
    return kept.select("SR_NUMBER", "CREATED_DAY")


@key("weather_missing_dates")
def weather_missing_dates(spark, d):
    return joins.missing_weather_dates(pp.requests(spark, d), pp.weather(spark, d))


@key("weather_year_coverage")
def weather_year_coverage(spark, d):
    c = joins.weather_coverage_by_year(_weather_joined(spark, d))
    return c.select(as_long("year").alias("year"), "total_requests", "with_weather", "pct_with_weather")


@key("weather_flag_counts")
def weather_flag_counts(spark, d):
    return joins.weather_flag_counts(_weather_joined(spark, d))


@key("weather_stats")
def weather_stats(spark, d):
    f = joins.with_weather_features(_weather_joined(spark, d))
    cols = ["temp_mean", "precipitation", "snowfall", "extreme_cold", "heavy_precipitation",
            "snow_day", "temp_deviation"]
    s = joins.column_stats(f, cols)
    return s.select("column_name", "non_null", r6("mean").alias("mean"), r6("min").alias("min"),
                    r6("max").alias("max"))


@key("date_range")
def date_range(spark, d):
    return joins.date_range(pp.requests(spark, d)).select(
        "min_date", "max_date", as_long("days_needed").alias("days_needed"))


# ---------------------------------------------------------------- baselines

def _baseline_key(idx: int):
    name, keys = bl.BASELINES[idx]

    def q(spark, d):
        train, test = pp.train_test(spark, d)
        p = bl.mean_lookup(test, train, keys)
        return p.select("SR_NUMBER", r6("RESPONSE_TIME_DAYS").alias("y_true"), r6("prediction").alias("y_pred"))
    return q


key("baseline_global")(_baseline_key(0))
key("baseline_type")(_baseline_key(1))
key("baseline_zip")(_baseline_key(2))
key("baseline_type_zip")(_baseline_key(3))


@key("baseline_metrics")
def baseline_metrics(spark, d):
    return _rounded_metrics(_baseline_metrics(spark, d))


@key("baseline_valid_metrics")
def baseline_valid_metrics(spark, d):
    train, test = pp.train_test(spark, d)
    v = bl.baseline_valid_metrics(bl.baseline_table(test, train))
    return v.select("Baseline", r3("MSE").alias("MSE"), r6("MAE").alias("MAE"), "Valid_Predictions")


@key("baseline_ranking")
def baseline_ranking(spark, d):
    ranked = metrics.rank_models(_baseline_metrics(spark, d))
    from pyspark.sql import Window
    w = Window.orderBy("mae", "model_name")
    return ranked.select(F.row_number().over(w).cast("long").alias("position"), "model_name",
                         r6("r2").alias("r2"), r6("rmse").alias("rmse"), r6("mae").alias("mae"),
                         r3("mse").alias("mse"))


@key("baseline_improvement")
def baseline_improvement(spark, d):
    imp = metrics.improvement_over_baseline(_baseline_metrics(spark, d), marker="Global")
    return imp.select("best_model", r6("best_mae").alias("best_mae"), "best_baseline",
                      r6("best_baseline_mae").alias("best_baseline_mae"),
                      r6("improvement_pct").alias("improvement_pct"))


# ---------------------------------------------------------------- A5-A13

@key("monthly_trend")
def monthly_trend(spark, d):
    t = profile.monthly_trend(pp.eda_frame(spark, d), stable=True)
    return t.select("month_start", r6("mean").alias("mean"), r6("median").alias("median"),
                    r6("std").alias("std"), r6("lower").alias("lower"), r6("upper").alias("upper"))


@key("dow_trend")
def dow_trend(spark, d):
    t = profile.weekday_trend(pp.eda_frame(spark, d))
    return t.select(as_long("CREATED_DAY_OF_WEEK").alias("CREATED_DAY_OF_WEEK"), "day_name",
                    r6("mean_days").alias("mean_days"))


@key("hour_trend")
def hour_trend(spark, d):
    t = profile.mean_by(pp.eda_frame(spark, d), "CREATED_HOUR")
    return t.select(as_long("CREATED_HOUR").alias("CREATED_HOUR"), r6("mean_days").alias("mean_days"))


def _hist(h: DataFrame) -> DataFrame:
    return h.select(as_long("bucket").alias("bucket"), r6("bin_start").alias("bin_start"),
                    r6("bin_end").alias("bin_end"), as_long("n").alias("n"))


@key("histogram")
def histogram(spark, d):
    return _hist(profile.histogram(pp.eda_frame(spark, d), "RESPONSE_TIME_DAYS", 50))


@key("log_histogram")
def log_histogram(spark, d):
    return _hist(profile.log_histogram(pp.eda_frame(spark, d), "RESPONSE_TIME_DAYS", 50))


@key("hexbin_mean")
def hexbin_mean(spark, d):
    h = profile.hexbin_mean(pp.eda_frame(spark, d))
    return h.select(as_long("lattice").alias("lattice"), as_long("i").alias("i"), as_long("j").alias("j"),
                    r6("center_x").alias("center_x"), r6("center_y").alias("center_y"),
                    r6("mean_value").alias("mean_value"), "n_points")


@key("target_summary")
def target_summary(spark, d):
    s = profile.target_summary(pp.eda_frame(spark, d), stable=True)
    return s.select(r6("mean").alias("mean"), r6("median").alias("median"), r6("std").alias("std"),
                    r6("skew").alias("skew"), r6("min").alias("min"), r6("max").alias("max"), "n")


CORR_FEATURES = ["CREATED_HOUR", "CREATED_DAY_OF_WEEK", "CREATED_MONTH", "SR_TYPE_encoded",
                 "ORIGIN_encoded", "ZIP_CODE_encoded", "LATITUDE", "LONGITUDE", "RESPONSE_TIME_DAYS"]


def _encoded_eda(spark, d) -> DataFrame:
    e = pp.eda_frame(spark, d)
    cats = ["SR_TYPE", "ORIGIN", "ZIP_CODE"]
    dic = encode.fit_label_dictionary(e, cats)
    return encode.apply_label_dictionary(e, dic, cats, suffix="_encoded")


@key("correlation_matrix")
def correlation_matrix(spark, d):
    m = profile.correlation_matrix(_encoded_eda(spark, d), CORR_FEATURES)
    return m.select("feature_a", "feature_b", r6("corr").alias("corr"))


@key("target_correlation")
def target_correlation(spark, d):
    m = profile.correlation_matrix(_encoded_eda(spark, d), CORR_FEATURES)
    return profile.target_correlation(m).select("feature", r6("corr").alias("corr"))


# ---------------------------------------------------------------- A15, A19, A20

@key("null_counts")
def null_counts(spark, d):
    j = _weather_joined(spark, d)
    n = profile.null_counts(j)
    return n.select("column_name", "null_count", r6("null_pct").alias("null_pct"))


PROFILE_COLUMNS = ["LATITUDE", "LONGITUDE", "CREATED_HOUR", "CREATED_DAY_OF_WEEK", "CREATED_MONTH",
                   "RESPONSE_TIME_DAYS"]


@key("table_profile")
def table_profile(spark, d):
    p = profile.table_profile(pp.eda_frame(spark, d), PROFILE_COLUMNS, stable=True)
    return p.select("column_name", "dtype", "count", r6("mean").alias("mean"), r6("std").alias("std"),
                    r6("min").alias("min"), r6("q25").alias("q25"), r6("q50").alias("q50"),
                    r6("q75").alias("q75"), r6("max").alias("max"))


MODE_COLUMNS = ["SR_TYPE", "ORIGIN", "ZIP_CODE", "CREATED_HOUR", "CREATED_DAY_OF_WEEK", "CREATED_MONTH",
                "LATITUDE", "CREATED_DATE"]


@key("column_modes")
def column_modes(spark, d):
    return profile.column_modes(pp.eda_frame(spark, d), MODE_COLUMNS)


# ---------------------------------------------------------------- W1-W4, P31, A31, W8

@key("split_three_way")
def split_three_way(spark, d):
    return pp.split3(spark, d).select("SR_NUMBER", "CREATED_DATE", "split")


@key("split_two_way")
def split_two_way(spark, d):
    return pp.split2(spark, d).select("SR_NUMBER", "CREATED_DATE", "split")


@key("split_summary")
def split_summary(spark, d):
    return split.split_summary(pp.split3(spark, d)).select("split", "n_rows", "start", "end")


CUTOFF = "1997-01-01"


@key("split_cutoff")
def split_cutoff(spark, d):
    return split.cutoff_split(pp.capped(spark, d), CUTOFF).select("SR_NUMBER", "CREATED_DATE", "split")


@key("cv_folds")
def cv_folds(spark, d):
    train = pp.ranked_split3(spark, d).where(F.col("split") == "train")
    a = split.cv_assign(train, pp.n_train(spark, d), 5)
    return a.select(as_long("fold").alias("fold"), "role", "SR_NUMBER", as_long("row_rank").alias("row_rank"))


@key("global_rank")
def global_rank(spark, d):
    r = split.rank_by_time(pp.requests(spark, d))
    return r.select("SR_NUMBER", as_long("row_rank").alias("row_rank"))


# ---------------------------------------------------------------- M1, J5

CATEGORICAL = ["SR_TYPE", "ZIP_CODE", "ORIGIN"]


@key("label_encode")
def label_encode(spark, d):
    train, _ = pp.train_test(spark, d)
    return encode.fit_label_dictionary(train, CATEGORICAL)


@key("label_encode_unseen")
def label_encode_unseen(spark, d):
    train, test = pp.train_test(spark, d)
    dic = encode.fit_label_dictionary(train, CATEGORICAL)
    e = encode.apply_label_dictionary(test, dic, CATEGORICAL)
    return e.select("SR_NUMBER", "SR_TYPE_code", "ZIP_CODE_code", "ORIGIN_code")


# ---------------------------------------------------------------- W5-W7 (first rows by md5(key:seed))

@key("random_split")
def random_split(spark, d):
    return split.random_split(pp.capped(spark, d), 0.2, 42, stable=True).select("SR_NUMBER", "split")


@key("exact_sample")
def exact_sample(spark, d):
    return split.exact_sample(pp.capped(spark, d), 5000, 42, stable=True).select("SR_NUMBER", "CREATED_DATE")


@key("proportional_sample")
def proportional_sample(spark, d):
    _, test = pp.train_test(spark, d)
    return split.proportional_sample(test, 5000, 42).select("SR_NUMBER", "CREATED_DATE")


# ---------------------------------------------------------------- A23-A26, J6 over CV trials

def _trials(spark, d) -> DataFrame:
    """The stored trials of the training rows, the first ones in time order."""
    return pp._memo(spark, ("trials", d), lambda: trials.cv_baseline_trials(pp.capped(spark, d), pp.n_train(spark, d), 5))


@key("trial_summary")
def trial_summary(spark, d):
    s = trials.trial_summary(_trials(spark, d))
    return s.select("model", *[r6(c).alias(c) for c in ["MAE_mean", "MAE_std", "MAE_min", "MAE_max",
                                                        "RMSE_mean", "RMSE_std"]], "n_trials")


@key("ttest_pairs")
def ttest_pairs(spark, d):
    t = trials.ttest_pairs(_trials(spark, d))
    return t.select("Model_1", "Model_2", r6("Mean_Diff").alias("Mean_Diff"),
                    r6("t_statistic").alias("t_statistic"), r6("p_value").alias("p_value"), "Significant")


@key("trial_box_stats")
def trial_box_stats(spark, d):
    b = trials.box_stats(_trials(spark, d))
    return b.select("model", *[r6(c).alias(c) for c in ["q1", "median", "q3", "iqr", "whisker_low",
                                                        "whisker_high", "mean", "std"]], "n_outliers")


# ---------------------------------------------------------------- S1-S8

@key("weather_json_rows")
def weather_json_rows(spark, d):
    """Weather rows -> one JSON payload per year (parallel arrays, as the
    service returns them) -> rows again. Each payload holds one year, so no
    group grows with the data."""
    w = pp.weather(spark, d)
    per_year = (w.groupBy(F.year("date").alias("y"))
                 .agg(F.array_sort(F.collect_list(F.struct("date", "temp_mean", "precipitation", "snowfall"))).alias("a")))
    payload = per_year.select(F.to_json(F.struct(F.struct(
        F.transform("a", lambda s: F.date_format(s["date"], "yyyy-MM-dd")).alias("time"),
        F.transform("a", lambda s: s["temp_mean"]).alias("temperature_2m_mean"),
        F.transform("a", lambda s: s["precipitation"]).alias("precipitation_sum"),
        F.transform("a", lambda s: s["snowfall"]).alias("snowfall_sum"),
    ).alias("daily"))).alias("payload"))
    return files.weather_json_rows(payload)


@key("csv_roundtrip")
def csv_roundtrip(spark, d):
    """Requests written as the raw CSV layout (US date text) to the shared
    scratch folder, read back with the fixed schema and a strict parse."""
    from ..session import scratch_path
    r = pp.requests(spark, d)
    raw = r.select("SR_NUMBER", "SR_TYPE", "ORIGIN",
                   F.date_format("CREATED_DATE", tf.US_FORMAT).alias("CREATED_DATE"),
                   F.date_format("CLOSED_DATE", tf.US_FORMAT).alias("CLOSED_DATE"),
                   "ZIP_CODE", "CREATED_HOUR", "CREATED_DAY_OF_WEEK", "CREATED_MONTH",
                   "LATITUDE", "LONGITUDE")
    path = scratch_path(spark, "csv_roundtrip")
    files.write_table(raw, path, fmt="csv")
    back = files.load_requests(spark, path, strict=True)
    return back.select("SR_NUMBER", "SR_TYPE", "ORIGIN", "CREATED_DATE", "CLOSED_DATE", "ZIP_CODE",
                       as_long("CREATED_HOUR").alias("CREATED_HOUR"), "LATITUDE", "LONGITUDE")


@key("first_rows")
def first_rows(spark, d):
    r = pp.requests(spark, d)
    from ..operators.rank import sort_orders
    return files.first_rows(r, 10, sort_orders(["CREATED_DATE"], r)).select(
        "SR_NUMBER", "SR_TYPE", "CREATED_DATE", "CLOSED_DATE")


# ---------------------------------------------------------------- P4-P6, P24-P25, U2

@key("keep_columns")
def keep_columns(spark, d):
    k = clean.keep_columns(pp.requests(spark, d))
    return k.select([as_long(c).alias(c) if c in ("CREATED_HOUR", "CREATED_DAY_OF_WEEK", "CREATED_MONTH")
                     else (r6(c).alias(c) if c in ("RESPONSE_TIME_DAYS", "LATITUDE", "LONGITUDE") else F.col(c))
                     for c in k.columns])


@key("numeric_columns")
def numeric_columns(spark, d):
    r = pp.requests(spark, d)
    cols = clean.numeric_columns(r)
    return r.select("SR_NUMBER", *[r6(c).alias(c) for c in cols])


@key("point_table")
def point_table(spark, d):
    p = clean.point_table(pp.requests(spark, d))
    return p.select("LONGITUDE", "LATITUDE", r6("RESPONSE_TIME_DAYS").alias("RESPONSE_TIME_DAYS"))


# ---------------------------------------------------------------- P26-P27, U1, A30, A32

@key("model_filter")
def model_filter(spark, d):
    m = _baseline_metrics(spark, d)
    f = m.where(F.col("model_name").isin(lf.CHART_MODELS) | F.col("model_name").contains("ZIP"))
    return _rounded_metrics(f)


@key("result_union")
def result_union(spark, d):
    train, test = pp.train_test(spark, d)
    parts = []
    for name, keys in bl.BASELINES:
        p = bl.mean_lookup(test, train, keys).select(
            F.lit(name).alias("model_name"), F.col("RESPONSE_TIME_DAYS").alias("y_true"),
            F.col("prediction").alias("y_pred"))
        parts.append(metrics.regression_metrics(p))
    return _rounded_metrics(metrics.union_results(parts))


@key("ablation_impact")
def ablation_impact(spark, d):
    a = metrics.ablation_impact(_baseline_metrics(spark, d), reference="Baseline_3_SR_ZIP")
    return a.select("model_name", r6("mae").alias("mae"), r6("mae_impact").alias("mae_impact"),
                    r6("pct_change").alias("pct_change"))


@key("distinct_dates")
def distinct_dates(spark, d):
    r = pp.requests(spark, d).select(tf.day_key().alias("CREATED_DAY"))
    return profile.distinct_values(r, "CREATED_DAY")


# ---------------------------------------------------------------- M17, S2

@key("permutation_importance")
def permutation_importance(spark, d):
    """Both keys of the finest baseline, over the test rows, two seeds."""
    train, test = pp.train_test(spark, d)
    means = persist_table(bl.group_means(train, ["SR_TYPE", "ZIP_CODE"]), "means")
    g = bl.global_mean(train)

    def predict(rows):
        j = rows.join(means, ["SR_TYPE", "ZIP_CODE"], "left")
        return j.withColumn("y_pred", F.coalesce("_group_mean", g)).drop("_group_mean")

    got = at.permutation_importance(test, predict, ["SR_TYPE", "ZIP_CODE"], [42, 43])
    return got.select("feature", r6("mae").alias("mae"), r6("permuted_mae").alias("permuted_mae"),
                      r6("importance").alias("importance"), "n_rows")


@key("partitioned_requests")
def partitioned_requests(spark, d):
    """Requests landed by month, one month landed again, a range read back."""
    path = scratch_path(spark, "by-month")
    rows = pp.requests(spark, d)
    files.ingest_by_month(rows, path)
    again = rows.where((F.col("CREATED_DATE") >= PARTITION_RANGE[0]) &
                       (F.col("CREATED_DATE") < F.add_months(F.lit(PARTITION_RANGE[0]).cast("date"), 1)))
    files.ingest_by_month(again, path)
    back = files.load_months(spark, path, *PARTITION_RANGE)
    return back.groupBy("CREATED_YM").agg(F.count("*").alias("n"), F.countDistinct("SR_NUMBER").alias("n_keys"),
                                          r6(exact_avg("RESPONSE_TIME_DAYS")).alias("mean_days"))
