"""Global rank without a single-partition window.

``row_number().over(Window.orderBy(...))`` moves every row into one task.
Instead the rows are range-partitioned on the full sort key (the sampler of
the range partitioner splits even a hot date, because the key is a total
order), sorted inside each partition, and numbered there by
``monotonically_increasing_id`` (partition id in the high bits, position in
the low 33 bits). Per-partition counts form a table with one row per
partition; its prefix sums are broadcast (size bounded by the partition
count) and added to the local position.

The numbered frame is written (Parquet) to the shared checkpoint folder
first, so the count branch and the row branch see identical numbers, and a
lost executor recomputes nothing that could renumber rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import persist_table

_LOW_BITS = (1 << 33) - 1


def sort_orders(first: list, df: DataFrame, nulls_last: bool = True) -> list[Column]:
    """``first`` columns ascending (nulls last), then every other column of
    ``df`` as a tie-breaker so the order is total and run-independent."""
    names = [c if isinstance(c, str) else None for c in first]
    cols = []
    for c in first:
        col = F.col(c) if isinstance(c, str) else c
        cols.append(col.asc_nulls_last() if nulls_last else col.asc_nulls_first())
    for name in df.columns:
        if name not in names:
            cols.append(F.col(name).asc_nulls_last())
    return cols


def global_rank(df: DataFrame, orders: list[Column], rank_col: str = "row_rank",
                num_partitions: int | None = None) -> DataFrame:
    """Add ``rank_col`` = 1-based position of each row in the total order."""
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbered = (df.repartitionByRange(n, *orders)
                  .sortWithinPartitions(*orders)
                  .withColumn("_rk_id", F.monotonically_increasing_id()))
    numbered = persist_table(numbered, "ranked")
    pid = F.shiftright(F.col("_rk_id"), 33)
    counts = numbered.groupBy(pid.alias("_rk_pid")).agg(F.count(F.lit(1)).alias("_rk_n"))
    before = Window.orderBy("_rk_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_rk_pid", F.coalesce(F.sum("_rk_n").over(before), F.lit(0)).alias("_rk_off"))
    out = (numbered.join(F.broadcast(offsets), pid == F.col("_rk_pid"))
                   .withColumn(rank_col, F.col("_rk_off") + F.col("_rk_id").bitwiseAND(F.lit(_LOW_BITS)) + 1)
                   .drop("_rk_id", "_rk_pid", "_rk_off"))
    return out
