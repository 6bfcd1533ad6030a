"""Hit words and items against all windows."""
import hashlib
import random
import re

import pytest

from resolvr.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        if w:
            n = min(13, len(w))
            for i in range(len(w) - n + 1):
                windows.setdefault(n, {}).setdefault(tuple(w[i:i + n]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n, known in windows.items():
            for i in range(len(w) - n + 1):
                if (at := known.get(tuple(w[i:i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    found |= at - {None}  # an item without an id marks words only
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()), key=str)


def test_documents(spark, documents, rows):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items = [(str(r.item_id), r.text) for r in bench.collect()]
    want = plain([(r["doc_id"], r["text"]) for r in rows], items)
    assert any(x[5] for x in want)
    assert got(decontam.contamination(documents, bench, carry=["doc_id"])) == want
    # the same in several parts
    assert got(decontam.contamination(documents, bench, carry=["doc_id"], max_broadcast=8000)) == want


def test_repetitive_texts_and_short_items(spark, edge, nothing):
    r = random.Random(3)
    items = [("i1", "a b c"), ("i2", "Aa bb, cc"), ("i3", " ".join(r.choice("ab") for _ in range(30))), ("i4", None),
             (None, "a b"), ("i5", "..."), ("i6", "mot " * 20), ("i1", "other words"), ("i7", "é ü")]
    docs = [(i, " ".join(r.choice("abc") for _ in range(60))) for i in range(40)] + [(90, "AA bb;cc é ü"), (91, None), (92, "mot " * 9)]
    bench = spark.createDataFrame(items, "item_id string, text string")
    table = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert got(decontam.contamination(table, bench)) == plain(docs, items)
    out = decontam.contamination(edge, bench)
    assert len(set(out.columns)) == len(out.columns) and out.count() == 11
    assert out.where("contaminated").count() > 0
    assert decontam.contamination(nothing, bench).count() == 0
    assert decontam.contamination(edge, bench.where("false")).where("n_hit > 0").count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_every_shared_span_is_found(seed):
    r = random.Random(seed)
    item = [f"w{r.randrange(50)}" for _ in range(40)]
    bench = decontam.Benchmark([("x", " ".join(item).encode())])
    for _ in range(50):
        a = r.randrange(28)
        text = [f"v{r.randrange(9)}" for _ in range(r.randrange(9))] + item[a:a + 13] + ["z"] * r.randrange(5)
        (n, runs, items), = bench.hits([" ".join(text).encode()])
        assert items == {"x"} and decontam._covered(runs) >= 13


def test_items_without_an_id_contaminate(spark):
    bench = spark.createDataFrame([(None, "one two three four"), ("x", "five six")], "item_id string, text string")
    docs = [(1, "so one two three four"), (2, "five six one two three four"), (3, "one two three")]
    table = spark.createDataFrame(docs, "doc_id bigint, text string")
    want = plain(docs, [(None, "one two three four"), ("x", "five six")])
    assert [(x[0], x[2], x[3], x[5]) for x in want] == [(1, 4, 0, True), (2, 6, 1, True), (3, 0, 0, False)]
    for limit in (32 << 20, 10):
        assert got(decontam.contamination(table, bench, max_broadcast=limit)) == want


def test_the_index_is_flat_and_built_once_per_worker():
    r = random.Random(1)
    items = [(str(i), " ".join(f"w{r.randrange(5000)}" for _ in range(200)).encode()) for i in range(500)]
    size = sum(len(t) for _, t in items)
    key = decontam.hash_of(items)
    bench = decontam._index(key, items)
    assert decontam._index(key, items) is bench and decontam.hash_of(items[1:]) != key
    arrays = [bench.start, bench.end, bench.begin, *[x for sc in bench.schemes for x in sc[2:]]]
    assert sum(x.nbytes for x in arrays) + len(bench.text) < 9 * size  # 32 MB of text: below 300 MB
    assert bench.words(7) == items[7][1].split()


def test_words_longer_than_a_block(monkeypatch):
    import numpy as np
    monkeypatch.setattr(decontam, "SLICE_BYTES", 16)
    text = b"ab " * 9 + b"x" * 50 + b" end"
    s, e, h = decontam.words_of(np.frombuffer(text, np.uint8))
    assert [text[i:j] for i, j in zip(s, e)] == text.split()
    assert len(set(h.tolist())) == 3
