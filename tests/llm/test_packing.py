"""Packing: ids, cuts, gapless sequences, and how many of them there are."""
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from resolvr.llm import packing, queries


def pieces(tokenizer, text):
    ids = (tokenizer.encode(text, add_special_tokens=False).ids if text else []) + [2]
    first = len(ids) % 1024 or 1024
    cuts = [0, *range(first, len(ids) + 1, 1024)]
    return [(k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]


def check(got, want):
    assert sorted((r.doc_id is None, r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(
        (d is None, d or 0, *p) for d, ps in want for p in ps)
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for spots in places.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= 1024
    return len(places), sum(r.length for r in got)


def test_documents(documents, rows, tokenizer):
    got = packing.pack(documents, queries.tokenizer_json(), fan_in=2).collect()
    n, tokens = check(got, [(r["doc_id"], pieces(tokenizer, r["text"])) for r in rows])
    assert n <= 1.03 * -(-tokens // 1024) + 1


def test_edge_rows(edge, nothing, tokenizer):
    got = packing.pack(edge, queries.tokenizer_json()).collect()
    check(got, [(r.doc_id, pieces(tokenizer, r.text)) for r in edge.collect()])
    assert packing.pack(nothing, queries.tokenizer_json()).count() == 0


def test_passing_on_fewer_sequences_loses_no_piece(documents, rows):
    got = packing.pack(documents, queries.tokenizer_json(), open_limit=1, fan_in=2)
    assert got.select("row_key").distinct().count() == len(rows)
    assert got.groupBy("row_key", "piece").count().where("count > 1").count() == 0


def test_sequences_hold_the_ids(edge, tokenizer):
    table = packing.pack(edge, queries.tokenizer_json())
    ids = {r.sequence_id: r.ids for r in packing.sequences(edge, table, queries.tokenizer_json()).collect()}
    for r in table.collect():
        part = ids[r.sequence_id][r.offset:r.offset + r.length]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
    assert sum(map(len, ids.values())) == table.groupBy().sum("length").first()[0]


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(" \n\t\x1c\x85  ab'sé9.!💡")))
def test_encoder_equals_the_tokenizer(text):
    encoder = packing._encoder(queries.tokenizer_json())
    want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encoder(text), "<u4").tolist() == want


@given(st.lists(st.integers(1, 1024), max_size=80))
def test_best_fit(lengths):
    bins = packing.best_fit(lengths)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    fill = [sum(lengths[i] for i in b) for b in bins]
    assert all(f <= 1024 for f in fill)
    if len(fill) > 1:
        assert sum(sorted(fill)[:2]) > 1024


@pytest.mark.parametrize("n,want", [(1, [(0, 1)]), (1024, [(0, 1024)]), (1025, [(0, 1), (1, 1024)])])
def test_cut(n, want):
    assert packing.cut(n) == want


@given(st.lists(st.integers(1, 1024), max_size=200))
def test_best_fit_by_counts(lengths):
    fill = sorted(sum(lengths[i] for i in b) for b in packing.best_fit(lengths))
    runs, n_bins = packing.best_fit_counts(dict(Counter(lengths)))
    places, ranks = defaultdict(list), Counter()
    for n in sorted(lengths):
        rank = ranks[n]
        ranks[n] += 1
        _, first, each, start, offset = max(r for r in runs if r[0] == n and r[1] <= rank)
        places[start + (rank - first) // each].append((offset + (rank - first) % each * n, n))
    assert sorted(places) == list(range(n_bins))
    assert sorted(sum(n for _, n in spots) for spots in places.values()) == fill
    for spots in places.values():
        spots.sort()
        assert [a for a, _ in spots] == [sum(n for _, n in spots[:k]) for k in range(len(spots))]


def test_more_open_sequences_than_a_group_passes_on(spark, tmp_path, tokenizer, monkeypatch):
    """Two partitions of complementary lengths: the ones over half full of one
    only fit the short ones of the other."""
    monkeypatch.setattr(packing, "_RANKED", 50)
    texts = [" a" * (600 + i % 40) for i in range(150)], [" a" * (361 + i % 24) for i in range(150)]
    for k, part in enumerate(texts):
        spark.createDataFrame([(1000 * k + i, x) for i, x in enumerate(part)], "doc_id bigint, text string") \
            .coalesce(1).write.mode("append").parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    want = [(1000 * k + i, pieces(tokenizer, x)) for k, part in enumerate(texts) for i, x in enumerate(part)]
    n = {limit: check(packing.pack(docs, queries.tokenizer_json(), open_limit=limit).collect(), want)[0]
         for limit in (4096, 20, 0)}
    lengths = [p[2] for _, ps in want for p in ps]
    assert n[4096] <= 1.02 * len(packing.best_fit(lengths))
    assert n[20] <= 1.02 * n[4096] and n[0] <= 1.02 * n[4096]
