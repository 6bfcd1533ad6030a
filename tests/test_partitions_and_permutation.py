"""Monthly layout (S2), permutation importance (M17), one-pass baselines (A3)."""
import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from resolvr.operators import attribution as at
from resolvr.operators import baselines as bl
from resolvr.sources import files


def _plan(df):
    return df._jdf.queryExecution().toString()


@pytest.fixture()
def landed(spark):
    rows = [(f"k{i}", dt.datetime(2020, 1, 1) + dt.timedelta(days=i), float(i)) for i in range(120)]
    return spark.createDataFrame(rows, "SR_NUMBER string, CREATED_DATE timestamp_ntz, x double")


def test_months_are_folders_and_a_month_can_land_again(spark, landed, tmp_path):
    path = str(tmp_path / "t")
    files.ingest_by_month(landed, path)
    assert sorted(p.name for p in (tmp_path / "t").iterdir() if p.is_dir()) == [f"CREATED_YM=2020{m:02d}" for m in (1, 2, 3, 4)]
    before = {p.name: sorted(x.name for x in p.iterdir()) for p in (tmp_path / "t").iterdir() if p.is_dir()}
    files.ingest_by_month(landed.where("month(CREATED_DATE) = 2").withColumn("x", F.lit(-1.0)), path)
    after = {p.name: sorted(x.name for x in p.iterdir()) for p in (tmp_path / "t").iterdir() if p.is_dir()}
    assert {k for k in before if before[k] != after[k]} == {"CREATED_YM=202002"}
    got = files.load_months(spark, path)
    assert got.count() == 120 and got.where("x = -1").count() == 29
    part = files.load_months(spark, path, "2020-02-10", "2020-03-05")
    assert part.count() == 24
    text = _plan(part)
    assert "PartitionFilters: [isnotnull(CREATED_YM" in text and ">= 202002" in text and "<= 202003" in text


def test_rows_without_a_month(spark, landed, tmp_path):
    bad = landed.unionByName(spark.createDataFrame([("z", None, 1.0)], landed.schema))
    with pytest.raises(ValueError, match="no month"):
        files.ingest_by_month(bad, str(tmp_path / "t"))
    assert not (tmp_path / "t").exists()
    files.ingest_by_month(bad, str(tmp_path / "t"), rejected=str(tmp_path / "lost"))
    assert [r.SR_NUMBER for r in spark.read.parquet(str(tmp_path / "lost")).collect()] == ["z"]
    assert files.load_months(spark, str(tmp_path / "t")).count() == 120


def test_permutation_against_plain_loops(spark):
    rows = [(f"k{i % 40}", f"t{i % 3}", f"z{i % 4}", float((i % 3) * 10 + i % 7)) for i in range(60)]
    df = spark.createDataFrame(rows, "SR_NUMBER string, SR_TYPE string, ZIP_CODE string, RESPONSE_TIME_DAYS double")
    guess = {"t0": 3.0, "t1": 13.0, "t2": 23.0}

    def predict(x):
        e = F.lit(0.0)
        for k, v in guess.items():
            e = F.when(F.col("SR_TYPE") == k, v).otherwise(e)
        return x.withColumn("y_pred", e)

    got = {r.feature: r for r in at.permutation_importance(df.repartition(3), predict, ["SR_TYPE", "ZIP_CODE"], [1, 2]).collect()}
    base = sum(abs(y - guess[t]) for _, t, _, y in rows) / 60
    mixed = []
    for seed in (1, 2):
        order = sorted(rows, key=lambda r: (hashlib.md5(f"{r[0]}:{seed}".encode()).hexdigest(), r))
        mixed.append(sum(abs(r[3] - guess[o[1]]) for r, o in zip(order, order[1:] + order[:1])) / 60)
    assert got["SR_TYPE"].mae == pytest.approx(base) and got["SR_TYPE"].n_rows == 60
    assert got["SR_TYPE"].permuted_mae == pytest.approx(sum(mixed) / 2)
    assert got["ZIP_CODE"].importance == pytest.approx(0) and got["SR_TYPE"].importance > 1
    assert at.permutation_importance(df.where("false"), predict, ["SR_TYPE"], [1]).count() == 0


def test_all_key_sets_from_one_aggregate(spark):
    rows = [("a", "1", 1.0), ("a", "2", 2.0), ("b", "1", 4.0), (None, "1", 8.0), ("b", None, None), ("a", "1", 0.1)]
    train = spark.createDataFrame(rows, "SR_TYPE string, ZIP_CODE string, RESPONSE_TIME_DAYS double")
    sets = [[], ["SR_TYPE"], ["ZIP_CODE"], ["SR_TYPE", "ZIP_CODE"]]
    found = bl.means_of_sets(train, sets)
    assert found.where("_set = 0").first()["_m"] == train.agg(F.avg("RESPONSE_TIME_DAYS")).first()[0]
    for i, keys in enumerate(sets):
        want = {tuple(r[:-1]): r[-1] for r in bl.group_means(train, keys).collect()} if keys else None
        if keys:
            assert {tuple(r[k] for k in keys): r["_m"] for r in found.where(F.col("_set") == 1 + i).collect()} == want
    test = spark.createDataFrame([("a", "1", 1.0), ("c", "1", 1.0), (None, "2", 1.0), (None, None, 1.0)], train.schema)
    wide = bl.baseline_table(test, train)
    for i, (_, keys) in enumerate(bl.BASELINES):
        a = sorted(r["prediction"] for r in bl.mean_lookup(test, train, keys).collect())
        assert sorted(r[f"BASELINE_PREDICTION_DAYS_{i}"] for r in wide.collect()) == pytest.approx(a, abs=0)
    assert bl.baseline_table(test, train.where("false")).where("BASELINE_PREDICTION_DAYS_3 is not null").count() == 0
