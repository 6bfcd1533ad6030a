"""Round trips through archives, revisits against plain grouping."""
import gzip
import hashlib
from pathlib import Path

import pytest

from resolvr.llm import queries, warc

ODD = ["", None, "x" * 999, "y" * 1000, "y" * 1000, "y" * 1000, "é" * 500, "é" * 500, "\r\n\r\n" * 300, "\r\n" * 501,
       "a\r\n\r\nWARC/1.1\r\n\r\n" * 80, "\r\n\r\n\r" * 5, "\n" * 7, "x\r", "\r\n\r\n", "end\r\n", "﻿<html>"]


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    rows = [(i, f"http://e/{i}\r\nX: y" if i % 2 else None, h, "clash") for i, h in enumerate(ODD)]
    rows += [(None, "u", "n" * 1500, "c"), (7, "u", "n" * 1500, "c"), (7, "u", "n" * 1500, "c")]
    path = str(tmp_path_factory.mktemp("warc") / "pages")
    spark.createDataFrame(rows, "page_id bigint, url string, html string, digest string").repartition(2).write.parquet(path)
    return spark.read.parquet(path)


def test_round_trip(spark, pages, tmp_path):
    path = str(tmp_path / "archives")
    warc.write_archives(warc.resolve_revisits(pages), path)
    got = warc.joined_to_originals(warc.read_archives(spark, path)).collect()
    want = [(r.page_id, r.html or "") for r in pages.collect()]
    assert sorted(((r.page_id, r.payload) for r in got), key=str) == sorted(want, key=str)
    for r in got:
        assert r.payload_digest == hashlib.sha1(r.payload.encode()).hexdigest()
        assert r.payload_bytes == len(r.payload.encode())
    large = {}
    for p, h in want:
        if len(h.encode()) >= 1000:
            large.setdefault(h, []).append(-1 if p is None else p)
    for r in got:
        best = max(large.get(r.payload, [None]), key=lambda x: -2 if x is None else x)
        assert r.refers_to == (best if r.record_type == "revisit" else None)
    revisits = [r for r in got if r.record_type == "revisit"]
    assert len(revisits) == sum(len(v) - 1 for v in large.values())
    first = gzip.open(next(Path(path).glob("*.gz"))).read()
    assert first.startswith(b"WARC/1.1\r\nWARC-Type: re") and first.endswith(b"\r\n\r\n")


def test_long_urls_of_originals_stay_whole(spark, tmp_path):
    url = "http://e/" + "a/" * 2500
    rows = [(1, "http://e/1", "z" * 1200), (2, url, "z" * 1200)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(str(tmp_path / "pages"))
    records = warc.resolve_revisits(spark.read.parquet(str(tmp_path / "pages")))
    assert {r.page_id: r.refers_url for r in records.collect()} == {1: url, 2: None}
    warc.write_archives(records, str(tmp_path / "archives"))
    texts = b"".join(gzip.open(f).read() for f in (tmp_path / "archives").glob("*.gz")).decode()
    assert f"\r\nWARC-Refers-To-Target-URI: {url}\r\n" in texts


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.page_id: r for r in queries.op9_warc_revisits(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/pages.parquet").collect()
    best = {}
    for r in rows:
        best[r.html] = max(best.get(r.html, -1), r.page_id)
    for r in rows:
        g, n = got[r.page_id], len(r.html.encode())
        assert (g.payload_bytes, g.payload_digest) == (n, hashlib.sha1(r.html.encode()).hexdigest())
        again = n >= 1000 and best[r.html] != r.page_id
        assert (g.record_type, g.refers_to) == (("revisit", best[r.html]) if again else ("response", None))


def test_damaged_archives_raise(spark, tmp_path):
    for name, data in (("a", b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort"), ("b", b"no header\r\n\r\n")):
        folder = tmp_path / name
        folder.mkdir()
        (folder / "x.gz").write_bytes(gzip.compress(data))
        with pytest.raises(Exception, match="record"):
            warc.read_archives(spark, str(folder)).collect()


def test_empty_table(spark, pages, tmp_path):
    path = str(tmp_path / "none")
    warc.write_archives(warc.resolve_revisits(pages.where("page_id < -1")), path)
    assert warc.read_archives(spark, path).count() == 0
