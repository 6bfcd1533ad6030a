"""Exploratory statistics as chart-data tables.

Every statistic is a distributed aggregate; the exact medians and quartiles
come from ``quantile.exact_quantiles`` (bounded memory per task), and the
modes from a two-level aggregation (value counts, then the best value per
column), so no single task ever holds a column's distinct values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats as sf
from ..functions import time as tf
from .quantile import exact_quantiles


def monthly_trend(df: DataFrame, time_col: str = "CREATED_DATE", target: str = "RESPONSE_TIME_DAYS",
                  stable: bool = False) -> DataFrame:
    """Per month: mean, exact median, sample std, and mean -/+ std (A5)."""
    m = df.select(tf.month_start(time_col).alias("month_start"), F.col(target).alias("_y"))
    g = m.groupBy("month_start").agg(sf.exact_avg("_y").alias("mean"), F.stddev_samp("_y").alias("std"))
    med = (exact_quantiles(m, "_y", [0.5], by=["month_start"], stable=stable)
           .select("month_start", F.col("value").alias("median")))
    return (g.join(med, "month_start", "left")
             .withColumn("lower", F.col("mean") - F.col("std"))
             .withColumn("upper", F.col("mean") + F.col("std")))


def mean_by(df: DataFrame, key: str, target: str = "RESPONSE_TIME_DAYS") -> DataFrame:
    """Mean target per key value (A6 weekday, A7 hour)."""
    return df.groupBy(key).agg(sf.exact_avg(target).alias("mean_days"))


def weekday_trend(df: DataFrame, key: str = "CREATED_DAY_OF_WEEK", target: str = "RESPONSE_TIME_DAYS") -> DataFrame:
    """Mean per weekday with the name attached by code."""
    return mean_by(df, key, target).withColumn("day_name", tf.weekday_name(key))


def histogram(df: DataFrame, col: str, bins: int = 50) -> DataFrame:
    """Equal-width histogram over [min, max] with every bin present (A10).

    Bin of x = floor((x - min) / (max - min) * bins), the maximum folded
    into the last bin; a constant column uses [v - 0.5, v + 0.5]. Counts
    are a grouped count (partial aggregation), bins come from ``range``."""
    x = F.col(col).cast("double")
    vals = df.select(x.alias("_x")).where(F.col("_x").isNotNull())
    # range of the values as scalar subqueries (one aggregate each, inlined)
    mn = vals.agg(F.min("_x")).scalar()
    mx = vals.agg(F.max("_x")).scalar()
    lo = F.when(mn == mx, mn - 0.5).otherwise(mn)
    hi = F.when(mn == mx, mx + 0.5).otherwise(mx)
    b = F.least(F.floor((F.col("_x") - lo) / (hi - lo) * F.lit(bins)), F.lit(bins - 1))
    counts = vals.groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    spark = df.sparkSession
    allb = spark.range(bins).withColumnRenamed("id", "bucket")
    width = (hi - lo) / F.lit(bins)
    return (allb.join(counts, "bucket", "left")
                .select("bucket",
                        (lo + F.col("bucket") * width).alias("bin_start"),
                        (lo + (F.col("bucket") + 1) * width).alias("bin_end"),
                        F.coalesce(F.col("n"), F.lit(0)).alias("n")))


def log_histogram(df: DataFrame, col: str, bins: int = 50) -> DataFrame:
    """Histogram of log1p(col) over values where it is defined (> -1)."""
    t = df.where(F.col(col) > -1).select(F.log1p(col).alias("log1p_value"))
    return histogram(t, "log1p_value", bins)


def _widened(lo: float | None, hi: float | None) -> tuple[float, float]:
    """An extent that is not empty: a single value grows by a tenth to both
    sides (0.1 around zero), no value at all stands for 0 to 1."""
    if lo is None:
        return 0.0, 1.0
    grow = 0.0 if lo != hi else 0.1 * abs(lo) or 0.1
    return lo - grow, hi + grow


def hexbin_mean(df: DataFrame, x: str = "LONGITUDE", y: str = "LATITUDE",
                value: str = "RESPONSE_TIME_DAYS", gridsize: int = 30) -> DataFrame:
    """Mean value and count per hexagonal cell; empty cells omitted.
    The mean is an exact decimal mean rounded once to 6 places, so a cell
    whose mean sits on a rounding half-point gives one answer whatever the
    partitioning (a double mean can land either side of it)."""
    pts = df.select(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"),
                    F.col(value).cast("double").alias("_v")).dropna()
    x0, x1, y0, y1 = pts.agg(F.min("_x"), F.max("_x"), F.min("_y"), F.max("_y")).first()
    ext = [*_widened(x0, x1), *_widened(y0, y1)]
    cell = sf.hex_cell(F.col("_x"), F.col("_y"), *ext, gridsize)
    t = pts.withColumn("c", cell)
    return (t.groupBy("c.lattice", "c.i", "c.j")
             .agg(F.first("c.cx").alias("center_x"), F.first("c.cy").alias("center_y"),
                  F.round(F.avg(F.col("_v").cast("decimal(38,18)")), 6).cast("double").alias("mean_value"),
                  F.count(F.lit(1)).alias("n_points")))


def target_summary(df: DataFrame, target: str = "RESPONSE_TIME_DAYS", stable: bool = False) -> DataFrame:
    """mean, exact median, sample std, adjusted skew, min, max."""
    y = F.col(target)
    g = df.agg(F.avg(y).alias("mean"), F.stddev_samp(y).alias("std"),
               sf.adjusted_skewness(y).alias("skew"), F.min(y).alias("min"),
               F.max(y).alias("max"), F.count(y).alias("n"))
    med = exact_quantiles(df, target, [0.5], stable=stable).select("value").scalar()
    return g.withColumn("median", med)


def correlation_matrix(df: DataFrame, features: list[str]) -> DataFrame:
    """Pearson correlation of every ordered feature pair, pairwise complete
    rows as pandas does (A12); null where one of them is constant. One
    aggregation over all pairs."""
    aggs = []
    pairs = []
    for i, a in enumerate(features):
        for b in features[i + 1:]:
            both = F.col(a).isNotNull() & F.col(b).isNotNull()
            x, y = (F.when(both, F.col(c).cast("double")) for c in (a, b))
            aggs.append(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)).alias(f"{a}__{b}"))
            pairs.append((a, b))
    # a constant column has no correlation, not even with itself
    aggs += [F.when(F.stddev_pop(F.col(a).cast("double")) > 0, F.lit(1.0)).alias(f"{a}__{a}") for a in features]
    row = df.agg(*aggs)
    parts = []
    for a, b in pairs:
        parts.append(f"'{a}', '{b}', `{a}__{b}`")
        parts.append(f"'{b}', '{a}', `{a}__{b}`")
    for a in features:
        parts.append(f"'{a}', '{a}', `{a}__{a}`")
    return row.selectExpr(f"stack({len(parts)}, {', '.join(parts)}) AS (feature_a, feature_b, corr)")


def target_correlation(matrix: DataFrame, target: str = "RESPONSE_TIME_DAYS") -> DataFrame:
    """Correlation of each feature with the target, target excluded, sorted
    descending (A13)."""
    return (matrix.where((F.col("feature_b") == target) & (F.col("feature_a") != target))
                  .select(F.col("feature_a").alias("feature"), "corr")
                  .orderBy(F.desc("corr")))


def null_counts(df: DataFrame) -> DataFrame:
    """Null count and percent per column (A15); one pass, then unpivot."""
    cols = df.columns
    aggs = [F.count(F.lit(1)).alias("__rows")] + [F.count_if(F.col(c).isNull()).alias(f"{c}__nulls") for c in cols]
    row = df.agg(*aggs)
    stack = ", ".join(f"'{c}', `{c}__nulls`" for c in cols)
    return (row.selectExpr("__rows", f"stack({len(cols)}, {stack}) AS (column_name, null_count)")
               .withColumn("null_pct", F.try_divide(F.col("null_count") * 100.0, F.col("__rows")))
               .drop("__rows"))


def table_profile(df: DataFrame, numeric: list[str] | None = None, stable: bool = False) -> DataFrame:
    """dtype, count, mean, std, min, exact quartiles, max per numeric
    column (A19), as ``describe()`` gives them."""
    from ..operators.clean import numeric_columns
    numeric = numeric or numeric_columns(df)
    types = dict(df.dtypes)
    aggs = []
    for c in numeric:
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"{c}__count"), F.avg(x).alias(f"{c}__mean"),
                 F.stddev_samp(x).alias(f"{c}__std"), F.min(x).alias(f"{c}__min"),
                 F.max(x).alias(f"{c}__max")]
    row = df.agg(*aggs)
    stack = ", ".join(f"'{c}', '{types[c]}', `{c}__count`, `{c}__mean`, `{c}__std`, `{c}__min`, `{c}__max`"
                      for c in numeric)
    base = row.selectExpr(f"stack({len(numeric)}, {stack}) AS (column_name, dtype, count, mean, std, min, max)")
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v")) for c in numeric
    ])).alias("s")).select("s.*")
    qs = exact_quantiles(long, "v", [0.25, 0.5, 0.75], by=["column_name"], stable=stable)
    piv = qs.groupBy("column_name").agg(
        F.max(F.when(F.col("q") == 0.25, F.col("value"))).alias("q25"),
        F.max(F.when(F.col("q") == 0.5, F.col("value"))).alias("q50"),
        F.max(F.when(F.col("q") == 0.75, F.col("value"))).alias("q75"))
    return base.join(piv, "column_name", "left")


def column_modes(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Most frequent non-null value per column, smallest on ties (A20), as
    text. Value counts are a distributed grouped count; the best value per
    column is a ``min`` over (-count, value), partially aggregated."""
    cols = cols or df.columns
    parts = []
    for c in cols:
        vc = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
        best = vc.agg(F.min(F.struct((-F.col("_n")).alias("k"), F.col("_v").alias("v"))).alias("b"))
        parts.append(best.select(F.lit(c).alias("column_name"), F.col("b.v").cast("string").alias("mode"),
                                 (-F.col("b.k")).alias("frequency")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """Distinct values of a column."""
    return df.select(col).distinct()
