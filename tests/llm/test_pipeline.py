"""The pipeline against plain versions of its stages."""
import corpus_pipeline as cp
from resolvr.llm import packing, pii, queries, simhash
from resolvr.session import persist_table

from .conftest import SF
from .test_decontam import plain as contaminated
from .test_packing import check, pieces
from .test_simhash import plain_components, plain_fingerprint


def test_stages(spark, documents, tokenizer):
    docs, tables = documents, [documents]
    for name, stage in cp.STAGES[:-1]:
        docs = persist_table(stage(spark, docs, SF), name)
        assert docs.columns == documents.columns
        tables.append(docs)
    rows = [{r.doc_id: r for r in t.collect()} for t in tables]
    assert all(any(map(str.isalpha, r.text)) for r in rows[1].values())
    assert rows[0].keys() - rows[1].keys() == {d for d, r in rows[0].items() if not any(map(str.isalpha, r.text))}
    fps = {d: plain_fingerprint(r.text) for d, r in rows[1].items()}
    root, first = plain_components(fps.values(), 4), {}
    for d in sorted(fps):
        first.setdefault(root[fps[d]], d)
    assert rows[2].keys() == set(first.values())
    bench = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {x[0] for x in contaminated([(d, r.text) for d, r in rows[2].items()], bench) if x[5]}
    assert bad and rows[3].keys() == rows[2].keys() - bad
    assert rows[4].keys() == rows[3].keys()
    assert not any(pii.base_spans(r.text) for r in rows[4].values())
    assert all(r.n_chars == len(r.text) for r in rows[4].values())
    got = cp.STAGES[-1][1](spark, docs, SF).collect()
    check(got, [(d, pieces(tokenizer, r.text)) for d, r in rows[4].items()])


def test_edge_rows(spark, edge, nothing):
    docs = edge
    for name, stage in cp.STAGES[:-1]:
        docs = persist_table(stage(spark, docs, SF), name)
        assert docs.columns == edge.columns
    assert {r.doc_id for r in docs.collect()} == {3, 4, 5, 7, 8, 9}
    docs = nothing
    for name, stage in cp.STAGES[:-1]:
        docs = persist_table(stage(spark, docs, SF), name)
    assert packing.pack(docs, queries.tokenizer_json()).count() == 0


def test_near_dedup_when_scans_split_the_files_differently(spark, documents, monkeypatch):
    """The conf stands for executors that come or go between two scans."""
    docs = persist_table(documents.selectExpr("*", "0 AS _row", "0 AS row_key").union(
        documents.selectExpr("*", "1 AS _row", "1 AS row_key").limit(20)).repartition(6, "doc_id"), "docs")
    found, conf = simhash.near_duplicates, "spark.sql.files.maxPartitionBytes"

    def then_other_splits(*args, **more):
        out = persist_table(found(*args, **more), "found")
        spark.conf.set(conf, "128m")
        return out

    monkeypatch.setattr(simhash, "near_duplicates", then_other_splits)
    before = spark.conf.get(conf)
    try:
        got = sorted(r.doc_id for r in cp.near_dedup(spark, docs, SF).collect())
    finally:
        spark.conf.set(conf, before)
    fps = {r.doc_id: plain_fingerprint(r.text) for r in docs.collect()}
    root, first = plain_components(fps.values(), 4), {}
    for d in sorted(fps):
        first.setdefault(root[fps[d]], d)
    assert got == sorted(first.values())


def test_registered():
    import __spark_entry__ as entry
    assert [n for n, _ in cp.STAGES] == ["language_id", "near_dedup", "decontaminate", "redact", "pack"]
    assert {"pipeline", *queries.QUERIES} <= set(entry.queries())
