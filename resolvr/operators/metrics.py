"""Error metrics and result tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels as lf


def _metric_aggs(y: Column, p: Column) -> list[Column]:
    e = y - p
    return [F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"),
            F.var_pop(y).alias("_var"), F.sum(e * e).alias("_sse"),
            F.count(F.lit(1)).alias("n_samples")]


def _finish(df: DataFrame) -> DataFrame:
    sst = F.col("_var") * F.col("n_samples")
    # constant target: 1.0 when every error is 0, else 0.0 (no division)
    r2 = (F.when(sst > 0, F.lit(1.0) - F.col("_sse") / sst)
           .when(F.col("_sse") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    return (df.withColumn("rmse", F.sqrt("mse")).withColumn("r2", r2)
              .drop("_var", "_sse"))


def regression_metrics(pred: DataFrame, y: str = "y_true", p: str = "y_pred",
                       by: str | list[str] | None = "model_name") -> DataFrame:
    """mse, rmse, mae, r2, n_samples per model in one pass.

    r2 = 1 - SSE / SST with SST = n * var_pop(y) (numerically stable merge
    of partial variances, so one aggregation, no second pass for the mean).
    """
    by = [by] if isinstance(by, str) else list(by or [])
    aggs = _metric_aggs(F.col(y), F.col(p))
    g = pred.groupBy(*by).agg(*aggs) if by else pred.agg(*aggs)
    out = _finish(g)
    cols = by + ["mse", "rmse", "mae", "r2", "n_samples"]
    return out.select(*cols)


def model_metrics(model, df: DataFrame, label: str, name: str) -> DataFrame:
    """Metrics straight from a fitted model."""
    pred = model.transform(df).select(F.lit(name).alias("model_name"),
                                      F.col(label).cast("double").alias("y_true"),
                                      F.col("prediction").alias("y_pred"))
    return regression_metrics(pred)


def rank_models(metrics: DataFrame) -> DataFrame:
    """Sorted by MAE (ties by name), fixed column order."""
    return (metrics.select("model_name", "r2", "rmse", "mae", "mse")
                   .orderBy("mae", "model_name"))


def best_row(metrics: DataFrame, where: Column | None = None) -> DataFrame:
    """Row with the lowest MAE (W10); ``min_by`` in one aggregate, no sort."""
    m = metrics.where(where) if where is not None else metrics
    st = F.struct("mae", "model_name")
    return m.agg(F.min(st).alias("b")).select("b.model_name", "b.mae")


def improvement_over_baseline(metrics: DataFrame, marker: str = "Baseline") -> DataFrame:
    """Best model, best baseline, and the MAE gain in percent."""
    is_base = F.col("model_name").contains(marker)
    best = F.min(F.struct("mae", "model_name"))
    best_base = F.min(F.when(is_base, F.struct("mae", "model_name")))
    g = metrics.agg(best.alias("b"), best_base.alias("bb"))
    return g.select(
        F.col("b.model_name").alias("best_model"), F.col("b.mae").alias("best_mae"),
        F.col("bb.model_name").alias("best_baseline"), F.col("bb.mae").alias("best_baseline_mae"),
        (F.try_divide(F.col("bb.mae") - F.col("b.mae"), F.col("bb.mae")) * 100.0).alias("improvement_pct"))


def ablation_impact(metrics: DataFrame, reference: str = "Full_Model") -> DataFrame:
    """MAE change and percent change of every other row vs the reference
    row (A30); the reference MAE is a scalar subquery."""
    ref = metrics.where(F.col("model_name") == reference).agg(F.first("mae")).scalar()
    j = metrics.where(F.col("model_name") != reference)
    return j.select("model_name", "mae", (F.col("mae") - ref).alias("mae_impact"),
                    (F.try_divide(F.col("mae") - ref, ref) * 100.0).alias("pct_change"))


def union_results(frames: list[DataFrame]) -> DataFrame:
    """Append result tables by column name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def chart_feed(metrics: DataFrame, selected: list[str] | None = None) -> DataFrame:
    """Selected models (P26), display label (P28), series class (P29),
    rounded values (P30), sorted by MAE."""
    m = metrics.where(F.col("model_name").isin(selected)) if selected else metrics
    return (m.select("model_name",
                     lf.display_label("model_name").alias("clean_label"),
                     lf.series_class("model_name").alias("series"),
                     lf.round2("mae").alias("mae_2dp"), lf.round2("rmse").alias("rmse_2dp"),
                     "mae", "rmse")
             .orderBy("mae", "model_name"))
