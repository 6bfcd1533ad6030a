"""Attributions that are scored where the rows are, against the exploded frame."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_forest import NAMES, rows, table

from resolvr.operators import attribution as at
from resolvr.operators import forest as fo


class Framed:
    """A model that scores frames only."""

    def __init__(self, model):
        self.transform = model.transform


@pytest.mark.parametrize("cells", [10, 10 ** 6])
def test_the_attributions_of_the_exploded_frame(spark, monkeypatch, cells):
    rs = rows(260) + [("k7", 1.0, 2.0, 3.0, 4.0), (None, 5.0, 6.0, None, 1.0)]
    feats = table(spark, rs).cache()
    model = fo.Forest(fo.Params(trees=3, depth=5, min_rows=8), 10).fit(feats)
    monkeypatch.setattr(fo, "WHOLE_CELLS", cells)   # without and with the table of all predictions
    monkeypatch.setattr(at, "SCORED", 500)
    assert isinstance(model.for_rows(spark, 10 ** 9), fo.Scores if cells > 10 else fo.ForestModel)
    place = ["SR_NUMBER", "feature", "value", "attribution"]
    want, got = (at.shapley(m, feats, feats, NAMES, permutations=3, background_size=20) for m in (Framed(model), model))
    assert got.columns == want.columns
    a, b = (x.orderBy(*place).collect() for x in (want, got))
    assert len(a) == 262 * 3 and [(r[:3], r.value is None) for r in a if r.value == r.value] == \
        [(r[:3], r.value is None) for r in b if r.value == r.value]
    assert np.allclose(sorted(r.attribution for r in a), sorted(r.attribution for r in b)) and np.ptp([r.attribution for r in b]) > 0
    key = lambda r: (str(r.SR_NUMBER), r.feature, str(r.value), r.attribution)
    assert all(math.isclose(x.attribution, y.attribution, abs_tol=1e-9) for x, y in zip(sorted(a, key=key), sorted(b, key=key)))


def test_nothing_is_shuffled_by_coalition(spark):
    feats = table(spark, rows(120)).cache()
    model = fo.Forest(fo.Params(trees=2, depth=3, min_rows=8)).fit(feats)
    att = at.shapley(model, feats, feats, NAMES, permutations=2, background_size=10)
    assert "Exchange" not in att._jdf.queryExecution().toString()
    none = at.shapley(model, feats, feats.where(F.lit(False)), NAMES, permutations=2)
    assert none.count() == 0
