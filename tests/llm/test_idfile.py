"""Files of token ids: exact round trips, order, and what is refused."""
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from resolvr.llm import idfile, queries


def plain(tokenizer, rows):
    """(doc_id, start, n_tokens, crc32) in ascending order of the ids."""
    out, start = [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = (tokenizer.encode(text, add_special_tokens=False).ids if text else []) + [2]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def key(r):
    return (r[0] is not None, r[0] or 0, *r[1:])


def stored(spark, tmp_path, rows, **write):
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).write.parquet(str(tmp_path / "docs"))
    idfile.write(spark.read.parquet(str(tmp_path / "docs")), queries.tokenizer_json(), str(tmp_path / "ids"), **write)
    return str(tmp_path / "ids")


def test_query(spark, rows, tokenizer):
    got = queries.op11_token_id_files(spark, "/root/testdata/sf0.001").collect()
    want = plain(tokenizer, [(r["doc_id"], r["text"]) for r in rows])
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_edge_rows(spark, edge, nothing, tokenizer, tmp_path):
    idfile.write(edge, queries.tokenizer_json(), str(tmp_path / "a"))
    found = idfile.read(spark, str(tmp_path / "a")).collect()
    texts = [(r.doc_id, r.text) for r in edge.collect()]
    want = sorted(((d, (tokenizer.encode(t, add_special_tokens=False).ids if t else []) + [2]) for d, t in texts),
                  key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert sorted(((r.doc_id, r.ids) for r in found), key=lambda r: (r[0] is not None, r[0] or 0, r[1])) == want
    idfile.write(nothing, queries.tokenizer_json(), str(tmp_path / "b"))
    assert idfile.starts(idfile.read(spark, str(tmp_path / "b"))).count() == 0


def test_order_over_many_files(spark, tmp_path, tokenizer):
    rows = [(i * 7919 % 1000, f"document {i} " * (i % 40)) for i in range(600)] + [(5, "the same id")] * 3 + [(None, "x")]
    path = stored(spark, tmp_path, rows, file_bytes=2000)
    found = idfile.starts(idfile.read(spark, path, with_ids=False)).orderBy("file", "place").collect()
    assert len({r.file for r in found}) > 4
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in found]
    assert [r[0] for r in got] == [r[0] for r in plain(tokenizer, rows)]
    assert [r[1] for r in got] == np.cumsum([0] + [r[2] for r in got])[:-1].tolist()
    assert sorted((r[2], r[3]) for r in got) == sorted((r[2], r[3]) for r in plain(tokenizer, rows))


def test_one_document(spark, tmp_path, tokenizer):
    rows = [(i, f"number {i}, " * (i % 9 + 1)) for i in range(0, 900, 3)] + [(9, "again"), (None, "none")]
    path = stored(spark, tmp_path, rows, file_bytes=3000)
    for wanted in (0, 9, 897, 1, 5000, -4):
        want = sorted(tokenizer.encode(t).ids + [2] for d, t in rows if d == wanted)
        assert sorted(idfile.document(spark, path, wanted)) == want
    few = idfile.read(spark, path, where=lambda index: index["doc_id"] % 100 == 99).collect()
    assert sorted(r.doc_id for r in few) == [99, 399, 699]


def test_damage_is_refused(spark, tmp_path):
    path = stored(spark, tmp_path, [(i, f"text {i}") for i in range(50)])
    other = spark.createDataFrame([("00", bytearray(b"12345678"))], "sha256 string, dictionary binary")
    other.write.mode("overwrite").parquet(f"{path}/dictionary")
    with pytest.raises(ValueError, match="dictionary"):
        idfile.read(spark, path)
    content = idfile.MAGIC + b"cut"
    with pytest.raises(ValueError, match="whole file"):
        idfile._parts(content)


def test_a_dictionary_makes_short_documents_small(spark, tmp_path, documents):
    import zstandard
    path = str(tmp_path / "ids")
    idfile.write(documents, queries.tokenizer_json(), path)
    raw = idfile._shared_dictionary(spark, path)
    ids = [np.array(r.ids, "<u2").tobytes() for r in idfile.read(spark, path).where("n_tokens < 300").collect()]
    without, with_it = zstandard.ZstdCompressor(level=1), zstandard.ZstdCompressor(
        level=1, dict_data=zstandard.ZstdCompressionDict(raw))
    assert sum(len(with_it.compress(x)) for x in ids) < 0.8 * sum(len(without.compress(x)) for x in ids)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(" \n\t\r\x1c\x85\xa0  ab'sé9.!💡字")), st.integers(1, 6))
def test_encoder_equals_the_tokenizer(text, longest):
    encoder = idfile._encoder(queries.tokenizer_json())
    assert encoder.ranked is not None
    whole, idfile._LONGEST = idfile._LONGEST, 4 * longest
    try:
        assert list(encoder(text)) == encoder.exact(text)
    finally:
        idfile._LONGEST = whole


@pytest.mark.parametrize("text", ["x" * 70_000, "\n" * 70_000, " " * 70_000 + "a", "ab cd\n" * 20_000, "é" * 40_000])
def test_long_texts(text):
    encoder = idfile._encoder(queries.tokenizer_json())
    assert list(encoder(text)) == encoder.exact(text)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.sampled_from(["It's", "the", "l'été", "année", "12", "3.14", "Straße,", "(x)", "\n", "\t", "  "])))
def test_plain_words(words):
    encoder = idfile._encoder(queries.tokenizer_json())
    text = " ".join(words)
    assert list(encoder(text)) == encoder.exact(text)
