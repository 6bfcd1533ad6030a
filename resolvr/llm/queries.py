"""The thin queries: each operator over its whole driver table, with the
columns of its contract."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import persist_table, scratch_path
from ..sources.tables import read_table
from . import decontam, hardneg, htmltext, idfile, langid, packing, phrases, pii, quality, simhash, topk, warc, wordpiece
from .oracle import ORACLE  # noqa: F401 - the registry takes both from here


def tokenizer_json() -> str:
    """The public byte-level BPE vocabulary, read on the driver."""
    import public_tokenizers
    return Path(public_tokenizers.path("byte_bpe_50k.json")).read_text(encoding="utf-8")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), tokenizer_json())


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "fingerprint", "component_id", "keep")


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read_table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0, 20)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"),
                         F.col("source"), F.concat_ws("/", "source", "lang"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, later = wordpiece.byte_level_pieces(tokenizer_json())
    return wordpiece.token_counts(read_table(spark, sf_dir, "documents"), first, later, carry=["doc_id"])


def held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def learned_languages(docs: DataFrame):
    """Counts of the documents that are not held out."""
    return langid.learn(docs, F.when(~held_out(), F.col("lang")))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = learned_languages(docs)
    ids = docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text")
    return langid.predict(ids, model, carry=["doc_id", "held_out"])


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(read_table(spark, sf_dir, "documents"), carry=["doc_id"])


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"),
                                  carry=["doc_id"])


def op9_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archives(warc.resolve_revisits(read_table(spark, sf_dir, "pages")), path)
    heads = persist_table(warc.read_archives(spark, path, with_payload=False), "warc-heads")
    return warc.joined_to_originals(heads).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.main_text(read_table(spark, sf_dir, "pages"))


def op11_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-ids")
    idfile.write(read_table(spark, sf_dir, "documents"), tokenizer_json(), path)
    found = persist_table(idfile.read(spark, path, with_ids=False), "read-back")
    return idfile.starts(found).select("doc_id", "start", "n_tokens", "ids_crc32")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.hard_negatives(read_table(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0, label)


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_best_fit_packing, op2_simhash_near_dedup, op3_exact_top_k, op4_quality_classifier, op5_token_counts,
    op6_language_id, op7_personal_data, op8_benchmark_decontamination, op9_warc_revisits, op10_html_extraction,
    op11_token_id_files, op12_hard_negatives, op13_phrase_collocations)}
