"""Typing, projection and row filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import time as tf
from .quantile import exact_quantile

# The allow-list of request columns kept by the cleaning step (P5).
KEEP_COLUMNS = ["SR_TYPE", "ORIGIN", "CREATED_DATE", "CLOSED_DATE", "ZIP_CODE",
                "CREATED_HOUR", "CREATED_DAY_OF_WEEK", "CREATED_MONTH",
                "LATITUDE", "LONGITUDE", "RESPONSE_TIME", "RESPONSE_TIME_DAYS",
                "RESPONSE_TIME_CATEGORY"]
# The columns that loading for a split requires.
REQUIRED_COLUMNS = ["SR_TYPE", "ORIGIN", "CREATED_DATE", "CLOSED_DATE", "ZIP_CODE",
                    "CREATED_HOUR", "CREATED_DAY_OF_WEEK", "CREATED_MONTH",
                    "RESPONSE_TIME_DAYS"]


def convert_types(df: DataFrame, date_cols=("CREATED_DATE", "CLOSED_DATE"),
                  categorical=("SR_TYPE", "ORIGIN", "ZIP_CODE"),
                  fmt: str = tf.US_FORMAT, strict: bool = False) -> DataFrame:
    """Parse text dates (lenient by default, P1 / P2) and make categories
    strings (P4). Columns that are already timestamps are left as they are."""
    cols = {}
    types = dict(df.dtypes)
    for c in date_cols:
        if c in types and types[c] == "string":
            cols[c] = tf.parse_strict(c, fmt) if strict else tf.parse_lenient(c, fmt)
    for c in categorical:
        if c in types:
            cols[c] = F.col(c).cast("string")
    return df.withColumns(cols) if cols else df


def with_response_time(df: DataFrame, created="CREATED_DATE", closed="CLOSED_DATE",
                       out: str = "RESPONSE_TIME_DAYS", interval: str | None = None) -> DataFrame:
    """Fractional response days (P8), optionally the interval too."""
    cols = {out: tf.response_days(created, closed)}
    if interval:
        cols[interval] = tf.response_interval(created, closed)
    return df.withColumns(cols)


def with_response_category(df: DataFrame, created="CREATED_DATE", closed="CLOSED_DATE") -> DataFrame:
    """Whole days (P9), category label (P10) and its sort ordinal."""
    whole = tf.response_whole_days(created, closed)
    return (df.withColumn("RESPONSE_TIME_WHOLE_DAYS", whole)
              .withColumns({
                  "RESPONSE_TIME_CATEGORY": tf.response_category("RESPONSE_TIME_WHOLE_DAYS"),
                  "RESPONSE_TIME_CATEGORY_ORDINAL": tf.category_ordinal("RESPONSE_TIME_WHOLE_DAYS"),
              }))


def with_time_features(df: DataFrame, c: str = "CREATED_DATE") -> DataFrame:
    """Hour, weekday (Mon = 0), month, date, month start, year."""
    return df.withColumns({
        "CREATED_HOUR": tf.created_hour(c),
        "CREATED_DAY_OF_WEEK": tf.created_day_of_week(c),
        "CREATED_MONTH": tf.created_month(c),
        "CREATED_DAY": tf.day_key(c),
        "CREATED_MONTH_START": tf.month_start(c),
        "CREATED_YEAR": tf.year_key(c),
    })


def keep_columns(df: DataFrame, keep=KEEP_COLUMNS) -> DataFrame:
    """Keep allow-listed columns that exist, in the frame's order (P5)."""
    return df.select([c for c in df.columns if c in keep])


def dropped_columns(df: DataFrame, keep=KEEP_COLUMNS) -> list[str]:
    """Present minus allowed column names."""
    return [c for c in df.columns if c not in keep]


def select_required(df: DataFrame, cols: list[str] = REQUIRED_COLUMNS, key: str = "SR_NUMBER") -> DataFrame:
    """The row key and the required columns; a missing one raises."""
    return df.select(key, *cols)


def drop_null(df: DataFrame, cols: list[str]) -> DataFrame:
    """Drop rows with a null in any of ``cols``."""
    return df.dropna(subset=list(cols))


def log_target_rows(df: DataFrame, col: str = "RESPONSE_TIME_DAYS") -> DataFrame:
    """Rows for which ``log1p`` of the target is defined (above -1 day)."""
    return df.where(F.col(col) > -1)


def positive_only(df: DataFrame, col: str = "RESPONSE_TIME_DAYS") -> DataFrame:
    """Strictly positive target (P16); needed before ``log1p``."""
    return df.where(F.col(col) > 0)


def remove_above_quantile(df: DataFrame, col: str = "RESPONSE_TIME_DAYS", q: float = 0.99,
                          threshold: float | None = None, stable: bool = False):
    """Remove (not clip) rows above the q-quantile.

    Returns ``(kept, threshold)``. The threshold is computed exactly over
    ``df`` unless given (e.g. fitted on the training slice only)."""
    if threshold is None:
        threshold = exact_quantile(df, col, q, stable=stable)
    if threshold is None:
        return df, None
    return df.where(F.col(col) <= F.lit(threshold)), threshold


def removal_report(df: DataFrame, col: str, threshold: float) -> DataFrame:
    """One row: threshold, rows before, rows removed, percent removed."""
    return df.agg(
        F.lit(threshold).alias("threshold"),
        F.count(F.lit(1)).alias("n_before"),
        F.count_if(F.col(col) > F.lit(threshold)).alias("n_removed"),
    ).withColumn("pct_removed", F.try_divide(F.col("n_removed") * 100.0, F.col("n_before")))


def drop_missing_weather(df: DataFrame, cols=("temp_mean", "precipitation", "snowfall")):
    """Rows that have all weather values (P18); the dropped count is
    observed on the same pass (no extra job)."""
    from pyspark.sql import Observation
    obs = Observation("weather_drop")
    missing = F.lit(False)
    for c in cols:
        missing = missing | F.col(c).isNull()
    tagged = df.observe(obs, F.count(F.lit(1)).alias("n_before"),
                        F.count_if(missing).alias("n_dropped"))
    return tagged.dropna(subset=list(cols)), obs


def numeric_columns(df: DataFrame) -> list[str]:
    """Names of numeric columns by type."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def point_table(df: DataFrame, x="LONGITUDE", y="LATITUDE", value="RESPONSE_TIME_DAYS") -> DataFrame:
    """Coordinates with the value they are coloured by, complete rows only."""
    return df.select(x, y, value).dropna()
