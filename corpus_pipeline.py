"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and
returns a DataFrame; ``run`` writes each result as Parquet into the shared
folder and hands the reread table to the next stage. All but the last stage
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resolvr.llm import decontam, langid, packing, pii, queries, simhash
from resolvr.session import persist_table
from resolvr.sources.tables import read_table


def _apart(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its columns called ``d0, d1, ...``, and which is which: no
    name of theirs, whatever it holds, can meet one of an operator."""
    names = {c: f"d{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def _back(found: DataFrame, names: dict[str, str]) -> DataFrame:
    return found.select(*[F.col(d).alias(c) for c, d in names.items()])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; ``und`` ones go. A missing
    ``lang`` is filled with the predicted one."""
    rows, names = _apart(docs)
    known = langid.predict(rows, queries.learned_languages(docs), names["text"]).where("lang_pred <> 'und'")
    return _back(known.withColumn(names["lang"], F.coalesce(names["lang"], "lang_pred")), names)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest
    id. Rows are told apart by a key that is stored with them: another scan
    may split the files differently and number other rows."""
    rows, names = _apart(docs)
    stored = persist_table(rows.withColumn("row", F.monotonically_increasing_id()), "numbered")
    found = simhash.near_duplicates(stored, names["doc_id"], names["text"], row_col="row")
    extra = persist_table(found.where(~F.col("keep")).select(F.col("row_key").alias("row")), "copies")
    return _back(stored.join(extra, "row", "left_anti"), names)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated with benchmark passages."""
    rows, names = _apart(docs)
    marked = decontam.contamination(rows, read_table(spark, sf_dir, "benchmark"), names["text"])
    return _back(marked.where(~F.col("contaminated")), names)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; ``n_chars`` follows."""
    rows, names = _apart(docs)
    clean = pii.find(rows, names["text"], names["doc_id"], redact=True)
    if "n_chars" in names:
        clean = clean.withColumn(names["n_chars"], F.length(names["text"]).cast(dict(docs.dtypes)["n_chars"]))
    return _back(clean, names)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the packed sequences."""
    return packing.pack(docs, queries.tokenizer_json())


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontaminate", decontaminate),
          ("redact", redact), ("pack", pack)]

#: SQL cannot express language scores, ball hashing or byte-pair ids; the tests
#: compare the pipeline with brute-force versions of its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = persist_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
