"""File sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .. import schemas
from ..functions import time as tf


def load_raw_requests(spark: SparkSession, path: str, schema=schemas.REQUESTS_RAW,
                      **options) -> DataFrame:
    """Request CSV with a fixed schema (S1, S2): no inference pass over the
    file; a missing path raises PATH_NOT_FOUND from Spark itself. Empty
    text becomes SQL NULL (never NaN)."""
    reader = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE")
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.csv(path)


def load_requests(spark: SparkSession, path: str, strict: bool = True, fmt: str = tf.US_FORMAT) -> DataFrame:
    """Typed requests: dates parsed (strict raises on bad text, P2; lenient
    gives null, P1)."""
    raw = load_raw_requests(spark, path)
    parse = tf.parse_strict if strict else tf.parse_lenient
    return raw.withColumns({"CREATED_DATE": parse("CREATED_DATE", fmt),
                            "CLOSED_DATE": parse("CLOSED_DATE", fmt)})


def load_weather_csv(spark: SparkSession, path: str) -> DataFrame:
    """Daily weather CSV with a typed date column (S3)."""
    return spark.read.schema(schemas.WEATHER_DAILY).option("header", True).csv(path)


def weather_json_rows(payload: DataFrame, col: str = "payload") -> DataFrame:
    """Rows of the parallel-array weather payload (S4): one output row per
    array position, nulls kept. Each payload row is exploded by its own
    task, so many landed payloads are processed in parallel."""
    parsed = payload.select(F.from_json(F.col(col), schemas.WEATHER_JSON).alias("p"))
    zipped = parsed.select(F.inline(F.arrays_zip(
        F.col("p.daily.time").alias("time"),
        F.col("p.daily.temperature_2m_mean").alias("temp_mean"),
        F.col("p.daily.precipitation_sum").alias("precipitation"),
        F.col("p.daily.snowfall_sum").alias("snowfall"))))
    return zipped.select(F.to_date("time").alias("date"), "temp_mean", "precipitation", "snowfall")


def load_weather_json(spark: SparkSession, path: str) -> DataFrame:
    """Landed JSON payload files -> weather rows."""
    raw = spark.read.option("wholetext", True).text(path).withColumnRenamed("value", "payload")
    return weather_json_rows(raw)


def cached_table(spark: SparkSession, path: str, produce, fmt: str = "parquet") -> DataFrame:
    """Read-through cache (S5): read ``path`` if it exists, else write what
    ``produce()`` returns there (``mode('ignore')`` leaves a concurrent
    writer's result alone) and read it back."""
    try:
        return spark.read.format(fmt).load(path)
    except AnalysisException:
        produce().write.mode("ignore").format(fmt).save(path)
        return spark.read.format(fmt).load(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None) -> None:
    """Result sink (S6): parquet by default, CSV with a header."""
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def load_augmented(spark: SparkSession, path: str) -> DataFrame:
    """Read the weather-augmented table, naming the step that writes it
    when it is missing (S7)."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        raise FileNotFoundError(
            f"augmented dataset not found at {path}; run the weather augmentation job "
            f"(resolvr.plans.jobs.augment_weather) first") from e


def first_rows(df: DataFrame, n: int = 10, order: list | None = None) -> DataFrame:
    """Preview of the first ``n`` rows in a stated order (S8): a TakeOrdered,
    each task keeps its own best n."""
    order = order or df.columns
    return df.orderBy(*order).limit(n)


MONTH = "CREATED_YM"


def ingest_by_month(rows: DataFrame, path: str, time_col: str = "CREATED_DATE", rejected: str | None = None) -> None:
    """Writes ``rows`` into a table of one folder per month (S2): Parquet below
    ``path``, partitioned by ``CREATED_YM`` (year x 100 + month). Months that
    ``rows`` holds replace those of the table, all others stay as they are, so
    a month can be landed again. Each task sends a month's rows to a few tasks
    of that month, so a hot month is not one task.

    Rows without a time have no month; they are written to ``rejected`` if
    given (appended), else they raise ValueError before anything is written."""
    lost = rows.where(F.col(time_col).isNull())
    if rejected:
        lost.write.mode("append").parquet(rejected)
    elif lost.limit(1).count():
        raise ValueError(f"rows without {time_col} have no month; name a table for rejected rows")
    ym = (F.year(time_col) * 100 + F.month(time_col)).cast("int")
    kept = rows.where(F.col(time_col).isNotNull()).withColumn(MONTH, ym)
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns]), F.lit(4))
    kept.repartition(F.col(MONTH), spread).write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
        .partitionBy(MONTH).parquet(path)


def load_months(spark: SparkSession, path: str, start: str | None = None, end: str | None = None,
                time_col: str = "CREATED_DATE") -> DataFrame:
    """Rows of ``ingest_by_month`` with ``start <= time < end``; only the
    folders of those months are read."""
    df = spark.read.parquet(path)
    if start is not None:
        df = df.where((F.col(MONTH) >= int(start[:4]) * 100 + int(start[5:7])) &
                      (F.col(time_col) >= F.lit(start).cast("timestamp_ntz")))
    if end is not None:
        df = df.where((F.col(MONTH) <= int(end[:4]) * 100 + int(end[5:7])) &
                      (F.col(time_col) < F.lit(end).cast("timestamp_ntz")))
    return df
