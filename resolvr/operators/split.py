"""Chronological splits, CV folds and seeded samples."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import persist_table
from .rank import global_rank, sort_orders
from .select import label_by_position


def rank_by_time(df: DataFrame, time_col: str = "CREATED_DATE", rank_col: str = "row_rank") -> DataFrame:
    """Position in (time, every other column) order; nulls last."""
    return global_rank(df, sort_orders([time_col], df), rank_col)


def _sizes(n: int, test_ratio: float, val_ratio: float):
    n_test = int(n * test_ratio)
    n_val = int(n * val_ratio)
    return n - n_test - n_val, n_val, n_test


def time_value(time_col: str = "CREATED_DATE") -> Column:
    """A time as a double that never falls as the time grows (microseconds)."""
    return F.unix_micros(F.col(time_col).cast("timestamp")).cast("double")


def chronological_split(df: DataFrame, test_ratio: float = 0.2, val_ratio: float = 0.2,
                        time_col: str = "CREATED_DATE", stable: bool = False) -> DataFrame:
    """Add ``split`` in {train, val, test} by position in (time, every other
    column) order, nulls last (W1).

    Sizes follow ``int(n * ratio)`` for test and val, train takes the rest;
    ``val_ratio = 0`` gives the two-way split (W2). The two boundary times are
    selected exactly and rows are labelled by comparison (``select.py``).
    A ``df`` not stated to be ``stable`` is written once first."""
    if not stable:
        df = persist_table(df, "split")
    n = df.count()
    n_train, n_val, _ = _sizes(n, test_ratio, val_ratio)
    return label_by_position(df, time_value(time_col), sort_orders([time_col], df),
                             [n_train, n_train + n_val], ["train", "val", "test"], "split", n)


def ranked_split(ranked: DataFrame, test_ratio: float = 0.2, val_ratio: float = 0.2) -> DataFrame:
    """The same split of a table that already has its ``row_rank``."""
    n = ranked.count()
    n_train, n_val, _ = _sizes(n, test_ratio, val_ratio)
    rk = F.col("row_rank")
    return ranked.withColumn("split", F.when(rk <= n_train, F.lit("train")).when(rk <= n_train + n_val, F.lit("val"))
                             .otherwise(F.lit("test")))


def cutoff_split(df: DataFrame, cutoff: str = "2024-01-01", time_col: str = "CREATED_DATE") -> DataFrame:
    """train if time < cutoff, test if time >= cutoff (P31); a row without a
    time belongs to neither (null ``split``)."""
    t = F.col(time_col)
    cut = F.lit(cutoff).cast("timestamp_ntz")
    return df.withColumn("split", F.when(t < cut, F.lit("train")).when(t >= cut, F.lit("test")))


def split_summary(split_df: DataFrame, time_col: str = "CREATED_DATE") -> DataFrame:
    """Rows, first and last time per split, plus a total row."""
    g = (split_df.rollup("split")
                 .agg(F.count(F.lit(1)).alias("n_rows"),
                      F.min(time_col).alias("start"), F.max(time_col).alias("end")))
    return g.withColumn("split", F.coalesce(F.col("split"), F.lit("total")))


def cv_fold_bounds(spark, n: int, k: int = 5) -> DataFrame:
    """Expanding-window folds over ranks 1..n (W4): fold i validates ranks
    (n-(k-i)t, n-(k-i-1)t] and trains on every earlier rank, t = n // (k+1)."""
    t = n // (k + 1)
    rows = []
    for i in range(k):
        start = n - (k - i) * t        # 0-based first validation position
        rows.append((i, start, start + 1, start + t))
    return spark.createDataFrame(rows, "fold INT, train_end LONG, val_start LONG, val_end LONG")


def cv_assign(ranked: DataFrame, n: int, k: int = 5, rank_col: str = "row_rank") -> DataFrame:
    """(fold, role) for every row that a fold uses. The fold table has k
    rows, so the range join is a broadcast nested loop over k rows."""
    folds = cv_fold_bounds(ranked.sparkSession, n, k)
    rk = F.col(rank_col)
    j = ranked.join(F.broadcast(folds), rk <= F.col("val_end"))
    role = F.when(rk <= F.col("train_end"), F.lit("train")).otherwise(F.lit("val"))
    return j.withColumn("role", role).drop("train_end", "val_start", "val_end")


def hash_order(key: str | Column, seed: int) -> Column:
    """Seeded pseudo-random order of rows by key: hexadecimal MD5 of
    ``key:seed``, the same in any engine, run or partitioning."""
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat_ws(":", k.cast("string"), F.lit(str(seed))))


def _first_by_hash(df: DataFrame, n: int, seed: int, key: str, out: str, stable: bool,
                   rows: int | None = None) -> DataFrame:
    """``out`` = 'in' for the first ``n`` rows in seeded hash order, else 'out'."""
    tmp = df.withColumn("_h", hash_order(key, seed))
    if not stable:
        tmp = persist_table(tmp, "sample")
    # 13 hexadecimal digits fit a double exactly and rise with the whole string
    value = F.conv(F.substring("_h", 1, 13), 16, 10).cast("double")
    return label_by_position(tmp, value, sort_orders(["_h"], tmp), [n], ["in", "out"], out, rows).drop("_h")


def random_split(df: DataFrame, test_ratio: float = 0.2, seed: int = 42, key: str = "SR_NUMBER",
                 stable: bool = False) -> DataFrame:
    """Seeded train/test split with an exact test size ceil(n * ratio) (W5):
    the first rows by (hash(key, seed), every column) are test."""
    if not stable:
        df = persist_table(df, "sample")
    n = df.count()
    picked = _first_by_hash(df, int(math.ceil(n * test_ratio)), seed, key, "split", True, n)
    return picked.withColumn("split", F.when(F.col("split") == "in", "test").otherwise("train"))


def exact_sample(df: DataFrame, n: int, seed: int = 42, key: str = "SR_NUMBER", stable: bool = False) -> DataFrame:
    """Exactly ``min(n, rows)`` rows, the first in a seeded hash order (W6):
    the n-th hash is selected exactly, then a filter keeps the rows up to it."""
    return _first_by_hash(df, n, seed, key, "_in", stable).where("_in = 'in'").drop("_in")


def proportional_sample(df: DataFrame, n: int, seed: int = 42, key: str = "SR_NUMBER",
                        stable: bool = False) -> DataFrame:
    """Sample ``int(rows * min(1, n / rows))`` rows."""
    if not stable:
        df = persist_table(df, "sample")
    rows = df.count()
    if rows == 0:
        return df
    return exact_sample(df, int(rows * min(1.0, n / rows)), seed, key, stable=True)
