"""Composite jobs (C1-C6): the reference's entry points as Spark jobs.

Each job takes typed DataFrames (from ``sources.files`` or the table
adapter), returns its result tables as DataFrames, and writes them when an
output folder is given. Only scalars (thresholds, counts, chosen round
counts) and model objects reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import CHART_MODELS
from ..operators import attribution as at
from ..operators import baselines as bl
from ..operators import boosting as bo
from ..operators import clean, joins, metrics, models as md, profile, split, trials
from ..operators.encode import assemble
from ..schemas import CATEGORICAL, TEMPORAL, WEATHER_NUMERIC
from ..session import persist_table
from ..sources import files


@dataclass
class CompareConfig:
    """Knobs of the model comparison (C1 defaults; C2 via ``weather_config``)."""
    test_ratio: float = 0.2
    val_ratio: float = 0.2
    cap_quantile: float = 0.99
    cap_fit_on: str = "all"          # "all" as the reference (Q2) or "train": no future rows in the threshold
    positive_only: bool = False
    drop_missing_weather: bool = False
    cutoff: str | None = None
    sample_size: int | None = None
    categorical: list = field(default_factory=lambda: list(CATEGORICAL))
    numeric: list = field(default_factory=lambda: list(TEMPORAL))
    cv_folds: int = 5
    xgb_params: dict = field(default_factory=dict)
    lgb_params: dict = field(default_factory=dict)
    forest_params: dict = field(default_factory=dict)
    seeds: list = field(default_factory=lambda: list(md.ENSEMBLE_SEEDS))


def weather_config(**kw) -> CompareConfig:
    """Positive rows, weather rows only, cutoff split, 5,000-row sample,
    ten numeric features."""
    base = dict(positive_only=True, drop_missing_weather=True, cutoff="2024-01-01", sample_size=5000,
                numeric=list(TEMPORAL) + list(WEATHER_NUMERIC))
    base.update(kw)
    return CompareConfig(**base)


def prepare_requests(df: DataFrame, cfg: CompareConfig) -> tuple[DataFrame, float | None]:
    """Target, filters and P99 removal (P8, P15-P18) -> persisted table.

    Targets of the models are ``log1p``, so rows without one are left out
    here, before the split: baselines and models are fitted and scored on the
    same rows."""
    if "RESPONSE_TIME_DAYS" not in df.columns:
        df = clean.with_response_time(df)
    df = clean.drop_null(df, ["RESPONSE_TIME_DAYS"])
    df = clean.positive_only(df) if cfg.positive_only else clean.log_target_rows(df)
    df = persist_table(df, "prepared")
    if cfg.cap_fit_on == "train":
        kept, t = df, None            # the threshold is fitted after the split (``split_rows``)
    else:
        kept, t = clean.remove_above_quantile(df, "RESPONSE_TIME_DAYS", cfg.cap_quantile, stable=True)
    if cfg.drop_missing_weather:
        kept, _ = clean.drop_missing_weather(kept)
    return kept, t


def split_rows(df: DataFrame, cfg: CompareConfig) -> tuple[DataFrame, DataFrame]:
    """Train and test slices (the comparison drops the validation slice: Q6)."""
    train, _, test = split_slices(df, cfg)
    return train, test


def split_slices(df: DataFrame, cfg: CompareConfig) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """Train, validation and test by the chronological split (W1), or train
    and test by the cutoff (P31) and the optional seeded samples (W6, W7).
    Train keeps a time rank for the CV folds."""
    if cfg.cutoff:
        s = split.cutoff_split(df, cfg.cutoff)
        train, test = s.where(F.col("split") == "train"), s.where(F.col("split") == "test")
        if cfg.sample_size:
            train = split.exact_sample(train, cfg.sample_size)
            test = split.proportional_sample(test, cfg.sample_size)
        train = split.rank_by_time(train.drop("split"))
        return train, None, test
    s = split.ranked_split(split.rank_by_time(df), cfg.test_ratio, cfg.val_ratio)
    train, val, test = (s.where(F.col("split") == x) for x in ("train", "val", "test"))
    if cfg.cap_fit_on == "train":
        # threshold from the training slice only, applied to every slice
        _, t = clean.remove_above_quantile(train, "RESPONSE_TIME_DAYS", cfg.cap_quantile)
        keep = F.col("RESPONSE_TIME_DAYS") <= F.lit(t)
        train, val, test = train.where(keep), val.where(keep), test.where(keep)
    return train, val, test


def load_and_split(spark, path: str, sample_size: int | None = 5000, use_validation: bool = True,
                   seed: int = 42) -> tuple[DataFrame, ...]:
    """Request CSV (strict date parse) -> response days -> known target
    -> P99 removal -> optional exact seeded sample -> chronological
    60/20/20 (train, val, test) or 80/20 (train, test) split."""
    df = clean.with_response_time(files.load_requests(spark, path, strict=True))
    df = clean.select_required(df)
    df = persist_table(clean.drop_null(df, ["RESPONSE_TIME_DAYS"]), "loaded")
    kept, _ = clean.remove_above_quantile(df, stable=True)
    if sample_size is not None:
        kept = split.exact_sample(kept, sample_size, seed)
    s = split.chronological_split(kept, 0.2, 0.2 if use_validation else 0.0)
    parts = ["train", "val", "test"] if use_validation else ["train", "test"]
    return tuple(s.where(F.col("split") == p) for p in parts)


def compare_models(requests: DataFrame, cfg: CompareConfig | None = None,
                   output: str | None = None) -> dict[str, DataFrame]:
    """Baselines, boosted trees (CV-chosen rounds), forest, seed
    ensemble; ranked metrics and the gain over the best baseline."""
    cfg = cfg or CompareConfig()
    spark = requests.sparkSession
    rows, _ = prepare_requests(requests, cfg)
    train, test = split_rows(rows, cfg)
    results = [metrics.regression_metrics(bl.baseline_predictions(test, train))]

    tr, (te,), names = md.feature_table(train, [test], cfg.categorical, cfg.numeric)
    tr, te = tr.cache(), te.cache()
    bins = md.code_bins(tr, names)

    xgb = bo.with_overrides(bo.XGB, cfg.xgb_params)
    rounds = md.mean_iterations(bo.cv_iterations(tr, names, xgb, cfg.cv_folds), "xgb")
    (xgb_model,) = bo.fit(tr, names, bo.with_overrides(xgb, {"maxIter": rounds}), [42])
    results.append(metrics.regression_metrics(md.predict_days(xgb_model, te, "XGB_Conservative")))

    rf = md.random_forest(cfg.forest_params, bins).fit(tr)
    results.append(metrics.regression_metrics(md.predict_days(rf, te, "RF_Conservative")))

    # the second style takes the dictionary columns as categories, in its folds as in its fits
    ctr, (cte,), _ = md.feature_table(train, [test], cfg.categorical, cfg.numeric, nominal=True)
    ctr, cte = ctr.cache(), cte.cache()
    codes = [f"{c}_code" for c in cfg.categorical]
    lgb = bo.with_overrides(bo.LGB, cfg.lgb_params)
    lrounds = md.mean_iterations(bo.cv_iterations(ctr, names, lgb, cfg.cv_folds, nominal=codes))
    members = bo.fit(ctr, names, bo.with_overrides(lgb, {"maxIter": lrounds}), cfg.seeds, codes)
    ens = md.ensemble_predictions(members, cte)
    results.append(metrics.regression_metrics(ens))

    allm = persist_table(metrics.union_results(results), "metrics")
    if allm.select("n_samples").distinct().count() > 1:
        raise RuntimeError("models of one comparison were scored on different rows")
    for cached in (tr, te, ctr, cte):
        cached.unpersist()
    out = {"metrics": metrics.rank_models(allm),
           "scored_rows": allm.select("model_name", "n_samples"),
           "improvement": metrics.improvement_over_baseline(allm),
           "chart": metrics.chart_feed(allm, selected=CHART_MODELS),
           "importance": md.importance_table(spark, rf, names, "RF_Conservative").unionByName(spark.createDataFrame(
               [("XGB_Conservative", "gain", n, float(v)) for n, v in zip(names, xgb_model.importance(len(names)))],
               "model_name STRING, importance_type STRING, feature STRING, importance DOUBLE"))}
    if output:
        for name, df in out.items():
            files.write_table(df, f"{output}/{name}", fmt="csv")
    return out


def augment_weather(requests: DataFrame, weather: DataFrame, output: str | None = None) -> dict[str, DataFrame]:
    """Time features, weather join (row count kept), derived features,
    and the coverage reports; writes the augmented table as Parquet."""
    r = clean.with_time_features(requests)
    j = joins.weather_join(r.drop("CREATED_DAY"), weather)
    aug = joins.with_weather_features(j)
    cols = ["temp_mean", "precipitation", "snowfall", "extreme_cold", "heavy_precipitation",
            "snow_day", "temp_deviation"]
    out = {"augmented": aug,
           "date_range": joins.date_range(requests),
           "missing_dates": joins.missing_weather_dates(requests, weather),
           "coverage_by_year": joins.weather_coverage_by_year(aug),
           "flag_counts": joins.weather_flag_counts(aug),
           "weather_stats": joins.column_stats(aug, cols),
           "null_counts": profile.null_counts(aug)}
    if output:
        files.write_table(aug, f"{output}/augmented")
        for name, df in out.items():
            if name != "augmented":
                files.write_table(df, f"{output}/{name}", fmt="csv")
    return out


def explore(requests: DataFrame, output: str | None = None) -> dict[str, DataFrame]:
    """C4: chart-data tables of the exploratory report."""
    from ..operators.encode import apply_label_dictionary, fit_label_dictionary
    df = clean.drop_null(clean.with_response_time(requests) if "RESPONSE_TIME_DAYS" not in requests.columns
                         else requests, ["RESPONSE_TIME_DAYS"])
    df = persist_table(df, "explore")
    cats = ["SR_TYPE", "ORIGIN", "ZIP_CODE"]
    enc = apply_label_dictionary(df, fit_label_dictionary(df, cats), cats, suffix="_encoded")
    feats = ["CREATED_HOUR", "CREATED_DAY_OF_WEEK", "CREATED_MONTH", "SR_TYPE_encoded", "ORIGIN_encoded",
             "ZIP_CODE_encoded", "LATITUDE", "LONGITUDE", "RESPONSE_TIME_DAYS"]
    corr = profile.correlation_matrix(enc, feats)
    out = {"target_summary": profile.target_summary(df),
           "histogram": profile.histogram(df, "RESPONSE_TIME_DAYS", 50),
           "log_histogram": profile.log_histogram(df, "RESPONSE_TIME_DAYS", 50),
           "monthly_trend": profile.monthly_trend(df),
           "weekday_trend": profile.weekday_trend(df),
           "hour_trend": profile.mean_by(df, "CREATED_HOUR"),
           "hexbin": profile.hexbin_mean(df),
           "points": clean.point_table(df),
           "correlation": corr,
           "target_correlation": profile.target_correlation(corr)}
    if output:
        for name, t in out.items():
            files.write_table(t, f"{output}/{name}", fmt="parquet")
    return out


def ablation_results(tr: DataFrame, te: DataFrame, names: list[str], experiments: list,
                     forest_params: dict | None = None) -> list[DataFrame]:
    """Metrics of one forest per feature set (name, categorical, numeric) over
    one encoded table: each set is another vector of its columns (M15)."""
    bins = md.code_bins(tr, names)

    def run(name, cats, nums):
        cols = [f"{c}_code" for c in cats] + list(nums)
        m = md.random_forest(forest_params, bins).fit(assemble(tr.drop("features"), cols))
        return metrics.regression_metrics(md.predict_days(m, assemble(te.drop("features"), cols), name))
    return md.in_parallel(tr.sparkSession, [lambda e=e: run(*e) for e in experiments])


def ablation(requests: DataFrame, experiments: list, cfg: CompareConfig | None = None,
             forest_params: dict | None = None, output: str | None = None) -> dict[str, DataFrame]:
    """One forest per feature set (name, categorical, numeric) on the
    same split, all from one encoded table; results by MAE and the impact vs
    ``Full_Model``."""
    cfg = cfg or CompareConfig()
    rows, _ = prepare_requests(requests, cfg)
    train, test = split_rows(rows, cfg)
    columns = [list(dict.fromkeys(c for e in experiments for c in e[i])) for i in (1, 2)]
    tr, (te,), names = md.feature_table(train, [test], *columns)
    tr, te = tr.cache(), te.cache()
    allm = persist_table(metrics.union_results(ablation_results(tr, te, names, experiments, forest_params)), "ablation")
    tr.unpersist(), te.unpersist()
    out = {"results": metrics.rank_models(allm), "impact": metrics.ablation_impact(allm, "Full_Model")}
    if output:
        for name, t in out.items():
            files.write_table(t, f"{output}/{name}", fmt="csv")
    return out


def variance(requests: DataFrame, seeds: list[int], cfg: CompareConfig | None = None,
             forest_params: dict | None = None, permutations: int = 8,
             output: str | None = None) -> dict[str, DataFrame]:
    """Each model refitted per seed, boosted trees cut by the validation
    slice; trial summary (A23), pairwise t-tests (A24), box statistics
    (A25/A26), attribution of the first model of each kind (M17) as a Spark
    job."""
    cfg = cfg or CompareConfig()
    rows, _ = prepare_requests(requests, cfg)
    train, val, test = split_slices(rows, cfg)
    others = [test] if val is None else [test, val]

    def frames(nominal: bool):
        tr, (te, *va), names = md.feature_table(train, others, cfg.categorical, cfg.numeric, nominal=nominal)
        return tr.cache(), te.cache(), va[0].cache() if va else None, names, md.code_bins(tr, names)
    plain, nominal = frames(False), frames(True)
    names = plain[3]

    def scored(model_name: str, seed: int, m):
        te = nominal[1] if model_name == "LightGBM" else plain[1]
        met = metrics.regression_metrics(md.predict_days(m, te, model_name))
        return met.select(F.col("model_name").alias("model"), F.lit(seed).alias("seed"), "mae", "rmse", "r2")

    # boosted trees: all seeds of a style in one fit; forests: a few at a time
    codes = [f"{c}_code" for c in cfg.categorical]
    fitted = {"XGBoost": bo.fit(plain[0], names, bo.with_overrides(bo.XGB, cfg.xgb_params), seeds, val=plain[2]),
              "RandomForest": md.in_parallel(requests.sparkSession, [
                  lambda s=s: md.random_forest(dict(forest_params or {}, seed=s), plain[4]).fit(plain[0]) for s in seeds]),
              "LightGBM": bo.fit(nominal[0], names, bo.with_overrides(bo.LGB, cfg.lgb_params), seeds, codes, nominal[2])}
    first = {k: models[0] for k, models in fitted.items()}
    trial_rows = [scored(k, s, m) for k, models in fitted.items() for s, m in zip(seeds, models)]
    t = persist_table(reduce(lambda a, b: a.unionByName(b), trial_rows), "trials")
    atts = [at.shapley(m, f[1], f[0], names, permutations=permutations, model_name=k) for k, m in first.items()
            for f in [nominal if k == "LightGBM" else plain]]
    att = persist_table(reduce(lambda a, b: a.unionByName(b), atts), "attribution")
    for cached in (*plain[:3], *nominal[:3]):
        if cached is not None:
            cached.unpersist()
    out = {"trials": t, "summary": trials.trial_summary(t), "ttests": trials.ttest_pairs(t),
           "box": trials.box_stats(t), "attribution": at.attribution_summary(att),
           "dependence": at.dependence(att, 3)}
    if output:
        for name, df in out.items():
            files.write_table(df, f"{output}/{name}", fmt="csv" if name != "dependence" else "parquet")
    return out
