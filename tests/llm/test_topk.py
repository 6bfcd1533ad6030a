"""Top-k against brute force, ties and odd vectors included."""
import math
import random

import pytest

from resolvr.llm import topk


def plain(rows, k, every):
    return set(plain_rows(rows, k, every))


def plain_rows(rows, k, every):
    vec = []
    for n, (i, v) in enumerate(rows):
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            vec.append((n, i, [math.floor(64 * float(x)) for x in v]))
    out = []
    for m, q, qv in vec:
        if q % every == 0:
            best = sorted((-sum(a * b for a, b in zip(qv, v)), i) for n, i, v in vec if n != m and len(v) == len(qv))
            out += [(q, n, i, -s) for n, (s, i) in enumerate(best[:k], 1)]
    return sorted(out)


def test_embeddings(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    got = topk.top_k(table, lambda i: i % 20 == 0, 20, max_rows=150, max_queries=10)
    assert {tuple(r) for r in got.collect()} == plain([(r.vec_id, r.embedding) for r in table.collect()], 20, 20)


def test_ties_nulls_and_sizes(spark):
    r = random.Random(1)
    rows = [(i, [r.randint(-2, 2) / 64 for _ in range(4)]) for i in range(200)]
    rows += [(300, None), (301, [None, 1.0, 1.0, 1.0]), (302, [math.nan] * 4), (303, [math.inf, 0.0, 0.0, 0.0]),
             (None, [1.0] * 4), (320, [0.0] * 4), (340, [1.0, 2.0]), (341, [0.5, -1.0]), (360, [])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = topk.top_k(table, lambda i: i % 20 == 0, 7, max_rows=40, max_queries=3)
    assert {tuple(r) for r in got.collect()} == {x for x in plain(rows, 7, 20) if x[0] != 360}
    assert topk.top_k(table.where("vec_id < 0"), lambda i: i % 20 == 0).count() == 0


def test_a_common_vector(spark):
    rows = [(i, [0.5, 0.5]) for i in range(90)] + [(i, [0.1 * i, -0.2]) for i in range(90, 100)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = {tuple(r) for r in topk.top_k(table, lambda i: i % 20 == 0, 5).collect()}
    assert got == plain([(r.vec_id, r.embedding) for r in table.collect()], 5, 20)


def test_scores_beyond_64_bits_raise(spark):
    table = spark.createDataFrame([(0, [1e17, 1e17]), (1, [1e17, 1e17])], "vec_id bigint, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        topk.top_k(table, lambda i: i % 20 == 0).collect()


def test_repeated_ids_count_by_row(spark):
    r = random.Random(7)
    rows = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [1.0, 1.0]), (2, [0.5, 0.25])]
    table = spark.createDataFrame([(*x, 5, "q", 0.5) for x in rows], "vec_id bigint, embedding array<double>, dim int, v string, score double")
    got = [tuple(x) for x in topk.top_k(table, lambda i: i % 20 == 0, 20).collect()]
    assert len(got) == 6 and sorted(got) == plain_rows(rows, 20, 20)
    rows = [(r.randrange(30) * 4, [r.randint(-2, 2) / 64 for _ in range(3)]) for _ in range(150)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    got = sorted(tuple(x) for x in topk.top_k(table, lambda i: i % 20 == 0, 6, max_rows=40, max_queries=7).collect())
    assert got == plain_rows(rows, 6, 20)


def test_bounds_end_the_walk():
    """A few telling dimensions, or lengths that differ: most rows are never scored."""
    import numpy as np
    g = np.random.default_rng(1)
    telling = np.concatenate([np.round(g.standard_exponential((4000, 2)) * 1000), np.round(g.normal(size=(4000, 6)))], axis=1)
    lengths = np.round(g.normal(size=(4000, 32)) * g.standard_exponential((4000, 1)) ** 3 * 100)
    ids = np.arange(4000)
    for rows, share in ((telling, 0.2), (lengths, 0.2)):
        lists, met = topk.Lists(rows), []
        for i in range(20):
            found, n = topk.threshold_search(lists, ids, ids, rows[i], i, 5)
            score = rows @ rows[i]
            score[i] = -np.inf
            assert [x[:2] for x in found] == [(int(score[j]), int(j)) for j in np.lexsort((ids, -score))[:5]]
            met.append(n)
        assert np.mean(met) < share * len(rows), np.mean(met)
