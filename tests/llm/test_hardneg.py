"""Hard negatives against plain loops over all pairs."""
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from resolvr.llm import hardneg, queries

COLS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def plain(rows, every=100, positives=5, negatives=5, low=80, high=100, factor=256):
    vec = []
    for n, (i, v, label) in enumerate(rows):
        if None not in (i, v, label) and all(x is not None and math.isfinite(x) for x in v):
            vec.append((n, i, label, [math.floor(factor * float(x)) for x in v]))
    out = []
    for n, a, label, av in vec:
        if a % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(av, v)), i, k, m) for m, i, k, v in vec if m != n and len(v) == len(av))
            for p, pid, _, _ in [x for x in scored if x[2] == label][:positives]:
                near = [x for x in scored if x[2] != label and low * -p <= 100 * -x[0] <= high * -p]
                out += [(a, pid, r, i, -p, -s) for r, (s, i, _, _) in enumerate(near[:negatives], 1)]
    return sorted(out)


def got(df):
    return sorted(tuple(r[c] for c in COLS) for r in df.collect())


def mine(table, every, **kw):
    return got(hardneg.hard_negatives(table, lambda i: i % every == 0, F.col("label"), **kw))


def test_query(spark):
    rows = [(r.vec_id, r.embedding, None if r.label is None else (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label)
            for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    found = got(queries.op12_hard_negatives(spark, "/root/testdata/sf0.001"))
    assert found == plain(rows) and found


def test_blocks_ties_and_odd_rows(spark):
    r = random.Random(2)
    rows = [(i, [r.randint(-3, 3) / 256 for _ in range(3)], r.randint(0, 2)) for i in range(160)]
    rows += [(i % 9 * 10, [r.randint(-3, 3) / 256 for _ in range(3)], r.randint(0, 2)) for i in range(30)]  # repeated ids
    rows += [(300, None, 1), (310, [1.0, None, 1.0], 1), (320, [math.nan] * 3, 1), (330, [math.inf, 0.0, 0.0], 1),
             (340, [1.0] * 3, None), (None, [1.0] * 3, 1), (350, [0.0] * 3, 1), (360, [1.0, 2.0], 1), (361, [1.0, 1.5], 2),
             (362, [1.0, 1.9], 1), (370, [], 1), (371, [], 2), (372, [], 1)]
    table = spark.createDataFrame([(*x, 7, "z") for x in rows], "vec_id bigint, embedding array<double>, label int, dim int, block string")
    assert mine(table, 10, block_rows=9, anchor_rows=4) == plain(rows, 10)
    assert mine(table, 10, positives=3, negatives=2, low=50, high=90) == plain(rows, 10, 3, 2, 50, 90)
    assert mine(table.where("vec_id < 0"), 10) == []
    assert mine(table.where("vec_id % 10 <> 0"), 10) == []


def test_one_common_vector(spark):
    rows = [(i, [0.5, 0.25], i % 2) for i in range(120)] + [(i, [0.01 * i, -0.2], i % 3) for i in range(120, 160)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label bigint").repartition(4)
    assert mine(table, 20, block_rows=16, anchor_rows=2) == plain(rows, 20)


def test_clusters_are_not_all_read(spark):
    g = np.random.default_rng(4)
    centres = g.normal(size=(30, 8)) * 4
    rows = [(i, (centres[i % 30] + 0.05 * g.normal(size=8)).tolist(), i % 4) for i in range(1500)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label bigint")
    s = hardneg.Searcher(hardneg.points(table, lambda i: i % 100 == 0, F.col("label")), 50, 1)
    found = s.search(s.windows(), True, 5)
    assert found.count() == 15 * 5
    assert s.pairs.count() < 0.5 * s.blocks.count() * s.anchors.count()
    assert mine(table, 100, block_rows=50, anchor_rows=1) == plain(rows)


def test_scores_beyond_64_bits_raise(spark):
    table = spark.createDataFrame([(0, [1e15, 1e15], 1), (1, [1e15, 1e15], 1)], "vec_id bigint, embedding array<double>, label int")
    with pytest.raises(Exception, match="64 bits"):
        mine(table, 100)


@pytest.mark.parametrize("dim,bits", [(2, 4), (3, 3), (5, 2)])
def test_the_curve_is_a_hilbert_curve(dim, bits):
    """It goes through every cell, one step in one dimension at a time."""
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dim, indexing="ij"), -1).reshape(-1, dim)
    keys = [k.tobytes() for k in hardneg.hilbert(cells, bits)]
    assert len(set(keys)) == len(cells)
    path = cells[sorted(range(len(cells)), key=keys.__getitem__)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()
