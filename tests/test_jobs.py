"""Whole jobs C1-C6 on the smallest driver tables (unit tests only: the
model scores are not compared with anything)."""
import pytest
from pyspark.sql import functions as F

from resolvr.plans import jobs
from resolvr.plans.models import ABLATIONS
from resolvr.sources.tables import requests_from_tables, weather_from_tables

SF = "/root/testdata/sf0.001"
SMALL = dict(xgb_params={"maxIter": 3}, lgb_params={"maxIter": 3},
             forest_params={"numTrees": 5, "maxDepth": 4}, seeds=[1, 2], cv_folds=2)


@pytest.fixture(scope="module")
def req(spark):
    return requests_from_tables(spark, SF)


def test_compare_models(req, tmp_path):
    out = jobs.compare_models(req, jobs.CompareConfig(**SMALL), output=str(tmp_path / "c1"))
    names = [r["model_name"] for r in out["metrics"].collect()]
    assert set(names) == {"Baseline_0_Global", "Baseline_1_SR_TYPE", "Baseline_2_ZIP", "Baseline_3_SR_ZIP",
                          "XGB_Conservative", "RF_Conservative", "LightGBM_Ensemble"}
    maes = [r["mae"] for r in out["metrics"].collect()]
    assert maes == sorted(maes)
    assert len({r["n_samples"] for r in out["scored_rows"].collect()}) == 1   # all models on the same rows
    assert out["chart"].where("clean_label IS NULL").count() == 0
    assert out["improvement"].count() == 1


def test_augment_then_weather_compare(spark, req, tmp_path):
    w = weather_from_tables(spark, SF)
    out = jobs.augment_weather(req, w, output=str(tmp_path / "c3"))
    assert out["augmented"].count() == req.count()
    aug = spark.read.parquet(str(tmp_path / "c3" / "augmented"))
    cutoff = aug.agg(F.expr("percentile(unix_seconds(CAST(CREATED_DATE AS TIMESTAMP)), 0.7)")).first()[0]
    import datetime as dt
    cfg = jobs.weather_config(cutoff=dt.datetime.fromtimestamp(cutoff, dt.UTC).strftime("%Y-%m-%d"),
                              sample_size=500, **SMALL)
    res = jobs.compare_models(aug, cfg)
    assert res["metrics"].count() == 7


def test_explore(req, tmp_path):
    out = jobs.explore(req, output=str(tmp_path / "c4"))
    assert out["histogram"].count() == 50
    assert out["weekday_trend"].count() == 7


def test_ablation_and_variance(req):
    a = jobs.ablation(req, ABLATIONS[:3], jobs.CompareConfig(**SMALL), forest_params={"numTrees": 5, "maxDepth": 4})
    assert a["results"].count() == 3 and a["impact"].count() == 2
    v = jobs.variance(req, [1, 2], jobs.CompareConfig(**SMALL), forest_params={"numTrees": 5, "maxDepth": 4},
                      permutations=2)
    assert v["summary"].count() == 3
    assert v["ttests"].count() == 3
    assert v["attribution"].count() == 3 * 6


def test_load_and_split_and_train_fitted_cap(spark, tmp_path):
    import datetime as dt
    lines = ["SR_NUMBER,SR_TYPE,ORIGIN,CREATED_DATE,CLOSED_DATE,ZIP_CODE,CREATED_HOUR,CREATED_DAY_OF_WEEK,CREATED_MONTH,LATITUDE,LONGITUDE"]
    base = dt.datetime(2020, 1, 1)
    for i in range(40):
        c = base + dt.timedelta(hours=7 * i)
        d = c + dt.timedelta(hours=3 + i)
        lines.append(f"{i},T{i % 3},web,{c.strftime('%m/%d/%Y %I:%M:%S %p')},{d.strftime('%m/%d/%Y %I:%M:%S %p')},1,0,0,1,,")
    p = tmp_path / "r.csv"
    p.write_text("\n".join(lines) + "\n")
    tr, va, te = jobs.load_and_split(spark, str(p), sample_size=None)
    assert (tr.count(), va.count(), te.count()) == (25, 7, 7)   # 39 rows after P99 removal: int(39 * .2) = 7
    tr2, te2 = jobs.load_and_split(spark, str(p), sample_size=20, use_validation=False)
    assert (tr2.count(), te2.count()) == (16, 4)
    req = jobs.clean.with_response_time(jobs.files.load_requests(spark, str(p)))
    cfg = jobs.CompareConfig(cap_fit_on="train")
    rows, t = jobs.prepare_requests(req, cfg)
    assert t is None and rows.count() == 40
    a, b = jobs.split_rows(rows, cfg)
    assert a.count() == 24 - 1 and b.count() == 0   # every test row lies above the train P99


def test_linear_pipeline_without_columns(spark):
    from pyspark.ml.linalg import Vectors
    from resolvr.operators import models as md
    df = spark.createDataFrame([(Vectors.dense([float(i)]), 2.0 * i) for i in range(10)], ["features", "label"])
    m = md.fit(md.linear_pipeline([], []), df)
    assert abs(m.stages[-1].coefficients[0] - 2.0) < 1e-6
