"""Edge rows of FIXTURES §3 for the column functions."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from resolvr.functions import labels as lf
from resolvr.functions import time as tf
from resolvr.functions import weather as wf


def one(spark, df_expr, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(df_expr).collect()]


def test_midnight_and_noon_parse(spark):
    out = one(spark, F.hour(tf.parse_lenient("t")), [("01/31/2020 12:05:00 AM",), ("01/31/2020 12:05:00 PM",)], "t string")
    assert out == [0, 12]


def test_bad_date_lenient_null(spark):
    assert one(spark, tf.parse_lenient("t"), [("not a date",), (None,)], "t string") == [None, None]


def test_bad_date_strict_raises(spark):
    with pytest.raises(Exception):
        one(spark, tf.parse_strict("t"), [("not a date",)], "t string")


def test_strict_accepts_null_and_good(spark):
    out = one(spark, tf.parse_strict("t"), [(None,), ("01/31/2020 02:05:00 PM",)], "t string")
    assert out == [None, dt.datetime(2020, 1, 31, 14, 5)]


def test_inferred_formats(spark):
    out = one(spark, tf.parse_inferred("t"), [("2020-01-31 14:05:00",), ("2020-01-31",), ("x",)], "t string")
    assert out == [dt.datetime(2020, 1, 31, 14, 5), dt.datetime(2020, 1, 31), None]


def _durations(spark, pairs):
    df = spark.createDataFrame(pairs, "c timestamp_ntz, d timestamp_ntz")
    return df.select(tf.response_days("c", "d").alias("days"),
                     tf.response_whole_days("c", "d").alias("whole")).collect()


def test_negative_duration(spark):
    c = dt.datetime(2020, 1, 2, 12)
    r = _durations(spark, [(c, c - dt.timedelta(hours=6))])[0]
    assert r["days"] == -0.25 and r["whole"] == -1
    cat = spark.createDataFrame([(-1,)], "d long").select(tf.response_category("d")).first()[0]
    assert cat is None


def test_zero_duration_category(spark):
    c = dt.datetime(2020, 1, 2, 12)
    r = _durations(spark, [(c, c)])[0]
    assert r["days"] == 0.0
    assert spark.createDataFrame([(0,)], "d long").select(tf.response_category("d")).first()[0] == "< 1 day"


def test_bin_edges(spark):
    out = one(spark, tf.response_category("d"), [(v,) for v in [1, 2, 7, 8, 30, 31]], "d long")
    assert out == ["< 1 day", "< 7 days", "< 7 days", "< 30 days", "< 30 days", "> 30 days"]
    ords = one(spark, tf.category_ordinal("d"), [(v,) for v in [1, 2, 8, 31, -5]], "d long")
    assert ords == [0, 1, 2, 3, None]


def test_weekday_monday_zero(spark):
    out = one(spark, tf.created_day_of_week("t"), [(dt.datetime(2024, 1, 1),), (dt.datetime(2024, 1, 7),)], "t timestamp_ntz")
    assert out == [0, 6]
    assert one(spark, tf.weekday_name("c"), [(0,), (6,)], "c int") == ["Monday", "Sunday"]


def test_weather_missing_and_strict_thresholds(spark):
    rows = [(None, None, None, 1), (20.0, 0.5, 0.0, 1), (19.9, 0.51, 0.1, 13)]
    df = spark.createDataFrame(rows, "temp_mean double, precipitation double, snowfall double, CREATED_MONTH int")
    out = df.select(wf.extreme_cold(), wf.heavy_precipitation(), wf.snow_day(),
                    wf.temp_normal(), wf.temp_deviation()).collect()
    assert tuple(out[0]) == (0, 0, 0, 27, 0.0)
    assert tuple(out[1])[:3] == (0, 0, 0)
    assert tuple(out[1])[4] == 20.0 - 27
    assert tuple(out[2])[:3] == (1, 1, 1)
    assert out[2][3] is None and out[2][4] == 0.0   # month outside 1..12


def test_null_code_and_labels(spark):
    assert one(spark, lf.null_code("z"), [(None,), ("60601",)], "z string") == ["nan", "60601"]
    names = [("Baseline_1_SR_TYPE",), ("RF_Conservative",), ("XGB_x",), ("LightGBM_Ensemble",), ("Other",)]
    assert one(spark, lf.series_class("m"), names, "m string") == ["#e74c3c", "#2ecc71", "#3498db", "#9b59b6", "#95a5a6"]
    assert one(spark, lf.display_label("m"), names, "m string") == ["Baseline (SR_TYPE)", "Random Forest", None, "LightGBM", None]
    assert one(spark, lf.round2("x"), [(0.125,), (0.135,)], "x double") == [0.12, 0.14]
