"""CV trials by segment sums (W4, A23-A26) and cuts inside tied values."""
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from resolvr.operators import trials
from resolvr.operators.baselines import BASELINES
from resolvr.operators.rank import sort_orders
from resolvr.operators.select import label_by_position


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    # few distinct times: every cut lies inside a group of equal ones
    return [(f"k{i:03d}", dt.datetime(2020, 1, 1 + r.randrange(6)), r.choice(["a", "b", None]), r.choice(["1", "2", "3"]),
             round(r.random() * 30, 3)) for i in range(203)]


@pytest.fixture(scope="module")
def table(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("cv") / "rows")
    spark.createDataFrame(rows, "SR_NUMBER string, CREATED_DATE timestamp_ntz, SR_TYPE string, ZIP_CODE string, "
                                "RESPONSE_TIME_DAYS double").repartition(4).write.parquet(path)
    return spark.read.parquet(path)


def in_order(rows):
    last = lambda x: (x is None, x or "")
    return sorted(rows, key=lambda r: (r[1], r[0], last(r[2]), r[3], r[4]))


def test_against_plain_folds(table, rows):
    n, k = 180, 5
    order, t = in_order(rows)[:n], n // (k + 1)
    want = {}
    for f in range(k):
        start = n - (k - f) * t
        train, val = order[:start], order[start:start + t]
        every = sum(r[4] for r in train) / len(train)
        for name, keys in BASELINES:
            at = [{"SR_TYPE": 2, "ZIP_CODE": 3}[c] for c in keys]
            groups = {}
            for r in train:
                groups.setdefault(tuple(r[i] for i in at), []).append(r[4])
            e = []
            for r in val:
                g = groups.get(tuple(r[i] for i in at)) if at and None not in [r[i] for i in at] else None
                e.append(r[4] - (sum(g) / len(g) if g else every))
            want[name, f] = (sum(map(abs, e)) / t, (sum(x * x for x in e) / t) ** 0.5, t)
    got = {(r.model, r.seed): (r.mae, r.rmse, r.n_samples) for r in trials.cv_baseline_trials(table, n, k).collect()}
    assert got.keys() == want.keys()
    assert all(got[x] == pytest.approx(want[x]) for x in want)


def test_no_rows_are_multiplied_by_folds(table):
    stored = trials.cv_baseline_trials(table, 180)
    assert stored.count() == 4 * 5
    assert "NestedLoop" not in stored._jdf.queryExecution().toString()
    assert trials.cv_baseline_trials(table.where("SR_NUMBER < ''"), 0).count() == 0


@pytest.mark.parametrize("cuts", [[1, 50, 51, 120, 202], [0, 203], [30, 30, 200], [203, 300]])
def test_every_cut_is_exact_inside_ties(table, rows, cuts):
    got = label_by_position(table, F.unix_micros(F.col("CREATED_DATE").cast("timestamp")).cast("double"),
                            sort_orders(["CREATED_DATE"], table), cuts, [str(i) for i in range(len(cuts) + 1)], "part")
    order = [r[0] for r in in_order(rows)]
    want = {x: str(sum(i >= c for c in cuts)) for i, x in enumerate(order)}
    assert {r.SR_NUMBER: r.part for r in got.collect()} == want
