"""Fingerprints and components against all pairs."""
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from resolvr.llm import simhash
from resolvr.llm.components import connected_components


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, distance):
    names = sorted(set(fps))
    root = {f: f for f in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(names):
        for b in names[:i]:
            if (a ^ b).bit_count() <= distance:
                root[find(a)] = find(b)
    return {f: find(f) for f in names}


def test_documents(documents, rows):
    fps = {r["doc_id"]: plain_fingerprint(r["text"]) for r in rows}
    root = plain_components(fps.values(), 4)
    least = {}
    for d, f in fps.items():
        least[root[f]] = min(least.get(root[f], d), d)
    got = simhash.near_duplicates(documents).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {
        (d, f"{f:016x}", least[root[f]]) for d, f in fps.items()}
    assert len(got) == len(rows) and sum(r.keep for r in got) == len(least)


def test_spark_hash_is_the_same(spark):
    df = spark.createDataFrame([("one two three four",)], "t string")
    assert df.select(F.xxhash64("t")).first()[0] & (1 << 64) - 1 == xxhash.xxh64_intdigest(b"one two three four", 42)


@pytest.mark.parametrize("distance", [2, 4, 6])
def test_links_keep_every_component(spark, distance):
    r, fps = random.Random(distance), []
    for _ in range(60):
        f = r.getrandbits(64)
        for _ in range(6):
            fps.append(f)
            for b in r.sample(range(64), r.randint(1, distance + 2)):
                f ^= 1 << b
    # all in one half, both halves, and chains
    fps += [0, 0b1111, 0b1111 << 30, 0b1111 << 60, (1 << 64) - 1]
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in set(fps)], "fp bigint")
    got = connected_components(simhash.links(df, distance)).collect()
    of = {r.node & (1 << 64) - 1: r.root & (1 << 64) - 1 for r in got}
    want = plain_components(fps, distance)
    groups = {}
    for f, w in want.items():
        groups.setdefault(w, set()).add(of.get(f, f))
    assert all(len(g) == 1 for g in groups.values())
    assert len({min(g) for g in groups.values()}) == len(groups)


def test_edge_rows(edge, nothing):
    got = simhash.near_duplicates(edge).collect()
    assert len(got) == 11 and sum(r.doc_id == 2 for r in got) == 2
    by = {r.doc_id: r for r in got}
    assert by[1].component_id == by[2].component_id == 1 and by[1].fingerprint == "0" * 16
    assert by[None].component_id == 4  # the same text as 4, which has an id
    assert sum(r.keep for r in got) == len({r.component_id for r in got})
    assert simhash.near_duplicates(nothing).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.range(300).selectExpr("id AS a", "(id * 7919 + 1) % 300 AS x").selectExpr("a", "a + 1 AS b")
    got = connected_components(edges).collect()
    assert len(got) == 300 and {r.root for r in got} == {0}


def test_odd_distance_is_refused(spark):
    with pytest.raises(ValueError):
        simhash.links(spark.range(1).withColumnRenamed("id", "fp"), 3)
