import os

import pytest

from resolvr.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session", autouse=True)
def importable(spark):
    spark.sparkContext.environment["PYTHONPATH"] = os.path.dirname(os.path.dirname(os.path.dirname(__file__)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def rows(documents):
    return [r.asDict() for r in documents.collect()]


@pytest.fixture(scope="session")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_str(queries.tokenizer_json())


#: Nulls, empty and odd texts, repeated rows, and columns that clash with the
#: operators' own names.
EDGE = [(1, None, "en", 1), (2, "", "en", 2), (2, "", "en", 2), (None, "a b c d e f", None, 3),
        (3, "Mail a.b@c.example, call +1 (555) 010-9999 now", "en", None), (4, "a b c d e f", "fr", 5),
        (5, "  two  spaces\n\n and \t tabs ", None, 6), (6, "12 34 !?", "en", 7), (7, "mot " * 3000, "fr", 8),
        (8, "x" * 200_000, "en", 9), (9, "<|endoftext|> stays 💡 é", "fr", 10)]


@pytest.fixture(scope="session")
def edge(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("edge") / "docs")
    spark.createDataFrame(EDGE, "doc_id bigint, text string, lang string, score bigint") \
        .selectExpr("*", "1 AS fp", "'x' AS spans", "2 AS n_words", "0 AS _row", "'y' AS lang_pred") \
        .repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def nothing(edge):
    return edge.where("doc_id < -5")
