"""Incremental form of the historical-average tables (A2, A5) over landed
request files, with Structured Streaming.

New CSV files in a landing folder are typed and cleaned by the same column
functions as the batch path (P1, P8, P15). Two outputs:

* ``group_sums``: per key combination, sum and count of the target, one folder
  ``epoch=N`` per batch. A replayed batch overwrites its own folder, so nothing
  is counted twice and earlier batches are never rewritten. ``group_means``
  adds the batches up (means are sum / count, so late rows just add to theirs).
* ``daily_stats``: per created day, count and mean, as a watermarked
  tumbling-window aggregate in append mode (a day is emitted once the
  watermark passes it, late rows beyond the delay are dropped by Spark).

State lives in the checkpoint location of each query, so a restarted or
relocated driver resumes where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import time as tf


def request_stream(spark: SparkSession, landing: str, fmt: str = tf.US_FORMAT) -> DataFrame:
    """Typed request rows with a known target from newly landed CSV files."""
    raw = (spark.readStream.schema(schemas.REQUESTS_RAW).option("header", True)
                .option("maxFilesPerTrigger", 1000).csv(landing))
    typed = raw.withColumns({"CREATED_DATE": tf.parse_lenient("CREATED_DATE", fmt),
                             "CLOSED_DATE": tf.parse_lenient("CLOSED_DATE", fmt)})
    return (typed.withColumn("RESPONSE_TIME_DAYS", tf.response_days())
                 .where(F.col("RESPONSE_TIME_DAYS").isNotNull()))


def _write_sums(table: str, keys: list[str]):
    def write(batch: DataFrame, epoch_id: int) -> None:
        (batch.groupBy(*keys).agg(F.sum("RESPONSE_TIME_DAYS").alias("total"), F.count(F.lit(1)).alias("n"))
              .write.mode("overwrite").parquet(f"{table}/epoch={epoch_id}"))
    return write


def group_sums(stream: DataFrame, keys: list[str], table: str, checkpoint: str, once: bool = True):
    """Start the per-batch (sum, count) per key combination; returns the query."""
    w = stream.writeStream.foreachBatch(_write_sums(table, keys)).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if once else w.trigger(processingTime="1 minute")
    return w.start()


def group_means(spark: SparkSession, table: str, keys: list[str]) -> DataFrame:
    """The historical-average table (A2) from the sums of all batches."""
    g = spark.read.parquet(table).groupBy(*keys).agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    return g.select(*keys, (F.col("total") / F.col("n")).alias("mean_days"), "n")


def daily_stats(stream: DataFrame, out: str, checkpoint: str, delay: str = "2 days", once: bool = True):
    """Per created day: count and mean target, watermarked, append mode."""
    # event time must be TIMESTAMP (with zone); the session zone is UTC, so
    # the cast keeps the wall-clock value of the NTZ column
    agg = (stream.withColumn("_event", F.col("CREATED_DATE").cast("timestamp"))
                 .withWatermark("_event", delay)
                 .groupBy(F.window("_event", "1 day").alias("w"))
                 .agg(F.count(F.lit(1)).alias("n"), F.avg("RESPONSE_TIME_DAYS").alias("mean_days"))
                 .select(F.col("w.start").cast("timestamp_ntz").alias("day"), "n", "mean_days"))
    w = (agg.writeStream.outputMode("append").format("parquet").option("path", out)
            .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if once else w.trigger(processingTime="1 minute")
    return w.start()
