"""Columns of the documents whose names meet an operator's own."""
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from resolvr.llm import decontam, langid, pii, wordpiece
from resolvr.session import persist_table

from .conftest import SF

NAMES = ["Score", "lang_pred", "n_words", "SPANS", "_runs", "_items", "a.b", "c0", "d1", "row", "row_key", "N_Hit", "keep", "text2"]


@pytest.fixture(scope="module")
def clashing(spark, documents, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("clash") / "docs")
    documents.select("*", *[(F.col("doc_id") * 100 + i if i % 2 else F.concat(F.lit(f"own {i} "), "doc_id")).alias(n)
                            for i, n in enumerate(NAMES)]).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def own(df, names):
    cols = [F.col(f"`{c}`") for c in ["doc_id", "source", *names]]
    return {r[0]: tuple(r) for r in df.select(*cols).collect()}


def test_stages_leave_them_as_they_are(spark, clashing):
    before, docs = own(clashing, NAMES), clashing
    for name, stage in cp.STAGES[:-1]:
        docs = persist_table(stage(spark, docs, SF), name)
        assert docs.dtypes == clashing.dtypes, name
        after = own(docs, NAMES)
        assert after and all(before[k] == v for k, v in after.items()), name
    assert cp.STAGES[-1][1](spark, docs, SF).select("doc_id").distinct().count() == docs.count()


def test_operators_replace_only_their_results(spark, clashing):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    made = [(langid.predict(clashing, langid.learn(clashing, F.col("lang"))), ["lang_pred", "score"]),
            (decontam.contamination(clashing, bench), ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]),
            (decontam.contamination(clashing, bench, max_broadcast=8000), ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]),
            (pii.find(clashing, tagger=None), [f.split()[0] for f in pii.RESULT.split(", ")]),
            (wordpiece.token_counts(clashing, ["a", "b"], ["a"]), ["n_words", "n_tokens", "n_unknown"])]
    for df, new in made:
        kept = [n for n in NAMES if n.lower() not in new]
        assert df.columns == [c for c in clashing.columns if c.lower() not in new] + new
        assert own(df, kept) == own(clashing, kept)
        assert not {t for c, t in df.dtypes if c in kept} - {t for c, t in clashing.dtypes}
