"""Historical-average baselines.

The mean tables come from a grouped average over the training rows (partial
aggregation on the map side, so a hot key costs one row per task before the
shuffle). They have one row per key value; the lookup is a left join that
AQE turns into a broadcast join when the table is small at run time and
into a skew-split sort-merge join otherwise. Null keys never match, which
falls back to the global mean, as in the reference (null groups dropped).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import exact_avg
from ..session import persist_table

# Baseline names and their key sets.
BASELINES = [
    ("Baseline_0_Global", []),
    ("Baseline_1_SR_TYPE", ["SR_TYPE"]),
    ("Baseline_2_ZIP", ["ZIP_CODE"]),
    ("Baseline_3_SR_ZIP", ["SR_TYPE", "ZIP_CODE"]),
]


def global_mean(train: DataFrame, target: str = "RESPONSE_TIME_DAYS"):
    """The training mean as a scalar subquery column (A1): computed once by
    its own aggregate, then inlined as a value."""
    return train.agg(exact_avg(target)).scalar()


def group_means(train: DataFrame, keys: list[str], target: str = "RESPONSE_TIME_DAYS",
                out: str = "_group_mean") -> DataFrame:
    """Mean of the target per key combination (A2)."""
    return train.groupBy(*keys).agg(exact_avg(target).alias(out))


def mean_lookup(test: DataFrame, train: DataFrame, keys: list[str],
                target: str = "RESPONSE_TIME_DAYS", out: str = "prediction") -> DataFrame:
    """Prediction = training mean of the row's key group, else the global
    mean (J2 for one key, J3 for several, A1 for none)."""
    g = global_mean(train, target)
    if not keys:
        return test.withColumn(out, g)
    m = group_means(train, keys, target)
    j = test.join(m, on=keys, how="left")
    return j.withColumn(out, F.coalesce(F.col("_group_mean"), g)).drop("_group_mean")


def baseline_table(test: DataFrame, train: DataFrame, target: str = "RESPONSE_TIME_DAYS",
                   baselines=BASELINES) -> DataFrame:
    """All baselines as columns BASELINE_PREDICTION_DAYS_i of one table (A3):
    one scan of the training rows for all key sets, one of the test rows, and
    a small join per key set."""
    means = means_of_sets(train, [keys for _, keys in baselines], target)
    g = means.where(F.col("_set") == F.lit(0)).agg(F.max("_m")).scalar()
    out = test
    for i, (_, keys) in enumerate(baselines):
        col = f"BASELINE_PREDICTION_DAYS_{i}"
        if not keys:
            out = out.withColumn(col, g)
            continue
        m = means.where(F.col("_set") == F.lit(1 + i)).select(*keys, "_m")
        out = (out.join(m, on=keys, how="left")
                  .withColumn(col, F.coalesce(F.col("_m"), g))
                  .drop("_m"))
    return out


def means_of_sets(train: DataFrame, sets: list[list[str]], target: str = "RESPONSE_TIME_DAYS") -> DataFrame:
    """``_set``, the key columns and the mean ``_m`` of each of its groups
    (stored): set 0 is the global mean, set ``1 + i`` the i-th of ``sets``.

    The rows are summed once, by all keys; every set is summed up from that
    table, as decimal sums are exact in any order. Null keys, which no lookup
    meets, are groups like others there."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    x = F.col(target).cast("decimal(38,18)")
    fine = train.groupBy(*keys).agg(F.sum(x).alias("_s"), F.count(x).alias("_n"))
    part = F.posexplode(F.array(*[F.array(*[F.lit(k in s) for k in keys]) for s in [[], *sets]])).alias("_set", "_has") \
        if keys else F.posexplode(F.array(*[F.array(F.lit(False)) for _ in [[], *sets]])).alias("_set", "_has")
    wide = fine.select("*", part)
    for i, k in enumerate(keys):
        wide = wide.withColumn(k, F.when(F.col("_has")[i], F.col(k)))
    # the mean as ``exact_avg`` gives it: the exact sum divided as a decimal, rounded to double once
    mean = F.expr("try_divide(sum(_s), cast(sum(_n) AS decimal(20,0)))").cast("double")
    return persist_table(wide.groupBy("_set", *keys).agg(mean.alias("_m")), "means")


def baseline_predictions(test: DataFrame, train: DataFrame, key: str = "SR_NUMBER",
                         target: str = "RESPONSE_TIME_DAYS", baselines=BASELINES) -> DataFrame:
    """Long form (key, model_name, y_true, y_pred) of every baseline."""
    wide = baseline_table(test, train, target, baselines)
    stack = ", ".join(f"'{name}', BASELINE_PREDICTION_DAYS_{i}" for i, (name, _) in enumerate(baselines))
    return wide.selectExpr(
        f"`{key}`", f"`{target}` AS y_true",
        f"stack({len(baselines)}, {stack}) AS (model_name, y_pred)")


def baseline_valid_metrics(wide: DataFrame, target: str = "RESPONSE_TIME_DAYS", n_baselines: int = 4) -> DataFrame:
    """MSE, MAE and count over non-null predictions per baseline column (A4)."""
    aggs = []
    for i in range(n_baselines):
        p = F.col(f"BASELINE_PREDICTION_DAYS_{i}")
        e = F.when(p.isNotNull(), F.col(target) - p)
        aggs += [F.avg(e * e).alias(f"mse_{i}"), F.avg(F.abs(e)).alias(f"mae_{i}"),
                 F.count(p).alias(f"n_{i}")]
    row = wide.agg(*aggs)
    stack = ", ".join(f"'BASELINE_PREDICTION_DAYS_{i}', mse_{i}, mae_{i}, n_{i}" for i in range(n_baselines))
    return row.selectExpr(f"stack({n_baselines}, {stack}) AS (Baseline, MSE, MAE, Valid_Predictions)") \
              .where(F.col("Valid_Predictions") > 0)
