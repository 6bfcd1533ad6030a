"""Joins of the request table with small side tables (J1, J4, J6) and the
weather feature table (P18-P22, A14, A16-A18)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import time as tf
from ..functions import weather as wf

WEATHER_COLUMNS = ["temp_mean", "precipitation", "snowfall"]


def bounded_broadcast(df: DataFrame, max_rows: int = 1_000_000) -> DataFrame:
    """Broadcast ``df`` only after checking it has at most ``max_rows`` rows
    (``limit(max_rows + 1).count()`` stops early on a large side); above the
    bound the join stays a shuffle join that AQE can still re-plan."""
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def assert_unique_dates(weather: DataFrame, date_col: str = "date") -> None:
    """A left join keeps the request count only if each date occurs once."""
    dup = weather.groupBy(date_col).count().where(F.col("count") > 1).limit(1).count()
    if dup:
        raise ValueError(f"weather table has more than one row for some {date_col}")


def weather_join(requests: DataFrame, weather: DataFrame, created: str = "CREATED_DATE",
                 date_col: str = "date", check: bool = True,
                 max_broadcast_rows: int = 1_000_000) -> DataFrame:
    """Requests left-joined with daily weather on the created date.

    The weather side has one row per calendar day, so it is small; it is
    broadcast after a size check. The request count is unchanged."""
    if check:
        assert_unique_dates(weather, date_col)
    w = weather.withColumnRenamed(date_col, "_wdate")
    r = requests.withColumn("CREATED_DAY", tf.day_key(created))
    j = r.join(bounded_broadcast(w, max_broadcast_rows), F.col("CREATED_DAY") == F.col("_wdate"), "left")
    return j.drop("_wdate")


def with_weather_features(df: DataFrame, month: str = "CREATED_MONTH") -> DataFrame:
    """Flags, monthly normal and deviation."""
    return df.withColumns({
        "extreme_cold": wf.extreme_cold(),
        "heavy_precipitation": wf.heavy_precipitation(),
        "snow_day": wf.snow_day(),
        "temp_normal": wf.temp_normal(month),
        "temp_deviation": wf.temp_deviation("temp_mean", month),
    })


def missing_weather_dates(requests: DataFrame, weather: DataFrame, created: str = "CREATED_DATE",
                          date_col: str = "date", value_col: str = "temp_mean") -> DataFrame:
    """Distinct request dates with no weather value, sorted (J4). A date
    whose weather row has a null value counts as missing too."""
    days = requests.select(tf.day_key(created).alias("date")).where(F.col("date").isNotNull()).distinct()
    have = weather.where(F.col(value_col).isNotNull()).select(F.col(date_col).alias("date"))
    return days.join(have, "date", "left_anti").orderBy("date")


def weather_coverage_by_year(joined: DataFrame, key: str = "SR_NUMBER", created: str = "CREATED_DATE") -> DataFrame:
    """Per year: requests, requests with weather, percent with weather."""
    g = joined.groupBy(tf.year_key(created).alias("year")).agg(
        F.count(key).alias("total_requests"), F.count("temp_mean").alias("with_weather"))
    return g.withColumn("pct_with_weather",
                        F.bround(F.try_divide(F.col("with_weather") * 100.0, F.col("total_requests")), 2))


def weather_flag_counts(joined: DataFrame) -> DataFrame:
    """Requests affected by each flag (A16); missing values do not count."""
    return joined.agg(
        F.count_if(F.col("temp_mean") < F.lit(wf.COLD_BELOW_F)).alias("extreme_cold_requests"),
        F.count_if(F.col("precipitation") > F.lit(wf.HEAVY_PRECIP_ABOVE_IN)).alias("heavy_precipitation_requests"),
        F.count_if(F.col("snowfall") > F.lit(wf.SNOW_ABOVE_IN)).alias("snow_day_requests"))


def column_stats(df: DataFrame, cols: list[str]) -> DataFrame:
    """Per column: non-null count, mean, min, max, as rows (A17). One
    aggregation pass, then an unpivot of the single result row."""
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"{c}__n"), F.avg(x).alias(f"{c}__mean"),
                 F.min(x).alias(f"{c}__min"), F.max(x).alias(f"{c}__max")]
    row = df.agg(*aggs)
    stack = ", ".join(f"'{c}', `{c}__n`, `{c}__mean`, `{c}__min`, `{c}__max`" for c in cols)
    return row.selectExpr(f"stack({len(cols)}, {stack}) AS (column_name, non_null, mean, min, max)")


def date_range(df: DataFrame, created: str = "CREATED_DATE") -> DataFrame:
    """First and last date and the number of days to fetch."""
    d = tf.day_key(created)
    return (df.agg(F.min(d).alias("min_date"), F.max(d).alias("max_date"))
              .withColumn("days_needed", F.datediff("max_date", "min_date") + 1))


def ordered_pairs(items: DataFrame, name_col: str, order_col: str) -> DataFrame:
    """All pairs i < j of a small table by position (J6): a theta self-join
    on the position, so each unordered pair appears once."""
    pos = items.withColumn("_pos", F.row_number().over(Window.orderBy(order_col)))
    a = pos.select(*[F.col(c).alias(f"{c}_1") for c in items.columns], F.col("_pos").alias("_p1"))
    b = pos.select(*[F.col(c).alias(f"{c}_2") for c in items.columns], F.col("_pos").alias("_p2"))
    return a.join(b, F.col("_p1") < F.col("_p2")).drop("_p1", "_p2")
