"""Held-out accuracy, undetermined texts, and n-grams against plain ones."""
import numpy as np
from pyspark.sql import functions as F

from resolvr.llm import langid, queries


def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op6_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = got.where("held_out").collect()
    assert len(rows) > 150
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.99 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_texts_do_not_run_into_each_other():
    texts = ["ab", "", "Né, x9y", None, "zz top"]
    h, own = langid.ngrams(texts)
    for i, t in enumerate(texts):
        alone, _ = langid.ngrams([t])
        assert np.array_equal(np.sort(h[own == i]), np.sort(alone))


def test_edge_rows(edge, nothing):
    model = langid.learn(edge, F.col("lang"))
    assert model[0] == ["en", "fr"]
    by = {r.doc_id: r for r in langid.predict(edge, model).collect()}
    assert [by[i].lang_pred for i in (1, 2, 6)] == ["und"] * 3 and by[1].score == 0
    assert by[7].lang_pred == "fr" and by[8].lang_pred == "en"
    none = langid.learn(nothing, F.col("lang"))
    assert {r.lang_pred for r in langid.predict(edge, none).collect()} == {"und"}
    assert langid.predict(nothing, model).count() == 0


def test_many_languages_in_blocks(spark, documents, edge, monkeypatch):
    """More languages than one matrix holds: the same answers, block by block."""
    docs = documents.select("doc_id", "text", F.concat("lang", F.lit("-"), (F.col("doc_id") % 3).cast("string")).alias("lang")) \
        .unionByName(edge.select("doc_id", "text", "lang"))
    whole = langid.learn(docs, F.col("lang"))
    assert len(whole[0]) == 14
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 5)
    blocks = langid.learn(docs, F.col("lang"))
    assert [len(b()[0]) for b in blocks] == [5, 5, 4]
    key = lambda r: (r.doc_id is None, r.doc_id, r.text or "", r.lang or "")
    a, b = (sorted(langid.predict(docs, m).collect(), key=key) for m in (whole, blocks))
    assert [r.lang_pred for r in a] == [r.lang_pred for r in b]
    assert np.allclose([r.score for r in a], [r.score for r in b])


def test_against_plain_naive_bayes(documents, rows):
    """Counters, whole texts and Python floats."""
    import math
    from collections import Counter
    counts, n_docs = {}, Counter()
    grams = {r["doc_id"]: Counter(langid.ngrams([r["text"]])[0].tolist()) for r in rows}
    for r in rows:
        if r["lang"] is not None and r["doc_id"] % 2:
            counts.setdefault(r["lang"], Counter()).update(grams[r["doc_id"]])
            n_docs[r["lang"]] += 1
    size = {x: sum(c.values()) + 0.1 * langid.BUCKETS for x, c in counts.items()}
    found = langid.predict(documents, langid.learn(documents, F.when(F.col("doc_id") % 2 == 1, F.col("lang")))).collect()
    for r in found:
        if r.lang_pred != "und":
            post = {x: math.log(n_docs[x] / sum(n_docs.values())) + sum(
                n * math.log((c[g] + 0.1) / size[x]) for g, n in grams[r.doc_id].items()) for x, c in counts.items()}
            best = max(post.values())
            assert post[r.lang_pred] > best - 1e-3 * (1 + abs(best)) * 1e-2
            score = 1 / sum(math.exp(v - post[r.lang_pred]) for v in post.values())
            assert abs(score - r.score) < 1e-2
