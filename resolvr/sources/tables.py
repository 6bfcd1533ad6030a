"""Adapter from the driver's star-schema tables to the request / weather schema.

The request table is ``lineitem ⋈ orders ⋈ part ⋈ customer``: one request per
line item, created at the order date plus (part key mod 24) hours, closed at
the ship date. The join sides at scale are all large (orders, part and
customer grow with the data), so no side is forced to broadcast: AQE turns a
join into a broadcast join only when the runtime size of a side is below
``spark.sql.adaptive.autoBroadcastJoinThreshold``, and splits skewed keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import time as tf

TABLES = ["region", "nation", "customer", "supplier", "part", "orders",
          "lineitem", "events", "documents", "embeddings", "pages",
          "benchmark", "labels", "conversations"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread_small_scan(df: DataFrame) -> DataFrame:
    """A scan with fewer splits than the cluster has task slots (a small
    table stored as one file with one row group, which Parquet cannot
    split) is spread round-robin over the default parallelism, so the join
    and the hand-off write after it do not run in one task. A large table
    already has one split per block and is returned unchanged: no shuffle
    is added at scale."""
    try:
        slots = df.sparkSession.sparkContext.defaultParallelism
        n = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 - sessions without a local context
        return df
    return df.repartition(slots) if n < slots else df


def requests_from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed request table with derived calendar columns (Mon = 0)."""
    li = spread_small_scan(read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        "l_quantity", "l_extendedprice", "l_shipdate"))
    o = spread_small_scan(read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate"))
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    # customers meet the orders first: the line items, four times as many, are shuffled once less
    oc = o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "o_orderdate", "c_mktsegment", "c_nationkey")
    j = (li.join(p, li.l_partkey == p.p_partkey)
           .join(oc, li.l_orderkey == oc.o_orderkey))
    created = (F.col("o_orderdate").cast("timestamp_ntz")
               + F.make_dt_interval(F.lit(0), (F.col("l_partkey") % 24).cast("int")))
    out = j.select(
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("SR_NUMBER"),
        F.col("p_brand").alias("SR_TYPE"),
        F.col("c_mktsegment").alias("ORIGIN"),
        created.alias("CREATED_DATE"),
        F.col("l_shipdate").cast("timestamp_ntz").alias("CLOSED_DATE"),
        F.col("c_nationkey").cast("string").alias("ZIP_CODE"),
        F.col("l_quantity").cast("double").alias("LATITUDE"),
        F.col("l_extendedprice").cast("double").alias("LONGITUDE"),
    )
    return out.select(
        "*",
        tf.created_hour().alias("CREATED_HOUR"),
        tf.created_day_of_week().alias("CREATED_DAY_OF_WEEK"),
        tf.created_month().alias("CREATED_MONTH"),
    )


def weather_from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One weather row per order date; every 50th day is left out so that
    some request dates have no weather. One row per date by construction
    (``distinct`` on the date), so the table is bounded by the calendar."""
    o = read_table(spark, sf_dir, "orders")
    d = (o.select(F.to_date("o_orderdate").alias("date")).distinct()
           .withColumn("k", F.datediff("date", F.lit("1995-01-01").cast("date"))))
    return (d.where(F.col("k") % 50 != 0)
             .select(
                 "date",
                 (F.lit(5) + (F.col("k") * 37) % 90).cast("double").alias("temp_mean"),
                 (((F.col("k") * 13) % 100) / F.lit(100.0)).alias("precipitation"),
                 F.when(F.month("date").isin(12, 1, 2), ((F.col("k") * 7) % 5).cast("double"))
                  .otherwise(F.lit(0.0)).alias("snowfall")))
