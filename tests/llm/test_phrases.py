"""Collocations against plain counting of all phrases."""
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from resolvr.llm import phrases, queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, support=30, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = set()
    for lang, count in f.items():
        found = []
        longest = Counter()
        for p, c in count.items():
            if c >= support:
                for k in range(2, len(p)):
                    for i in range(len(p) - k + 1):
                        longest[p[i:i + k]] = max(longest[p[i:i + k]], c)
        for p, a in count.items():
            if len(p) > 1 and a >= support and not 100 * longest[p] >= 80 * a:
                score, _, l, r = min((2000000 * a // (count[p[:k]] + count[p[k:]]), k, count[p[:k]], count[p[k:]])
                                     for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), l, r))
        out |= {(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)}
    return out


def rows_of(df):
    return {(r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in df.collect()}


def test_query(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    got = rows_of(queries.op13_phrase_collocations(spark, "/root/testdata/sf0.01"))
    assert got == plain([(r["lang"], r["text"]) for r in rows])
    assert len(got) > 100


@pytest.mark.parametrize("shards", [1, 4, 40])
def test_any_number_of_shards(spark, rows, documents, shards):
    got = phrases.collocations(documents, support=12, top=150, shards=shards)
    assert rows_of(got) == plain([(r["lang"], r["text"]) for r in rows], 12, 150)


def made(seed=3):
    r = random.Random(seed)
    words = ["New", "york", "CITY", "Île", "straße", "a", "b", "x y", " ", "''", "1"]
    out = [(r.choice(["en", "fr", None, "und", ""]), "".join(r.choice(words) + r.choice([" ", "  ", "\t", ", ", ".", "\n", " "])
                                                           for _ in range(r.randint(0, 60)))) for _ in range(300)]
    out += [("en", "the very same line of words") for _ in range(200)]  # a large group of copies
    return out + [("en", None), (None, None), ("en", ""), ("fr", " \t.,"), ("de", "new york " * 20_000), ("de", "a" * 100_000)]


def test_edge_rows(spark, nothing):
    rows = made()
    table = spark.createDataFrame([(i, *r, "z") for i, r in enumerate(rows)], "h int, lang string, text string, shard string") \
        .repartition(5)
    assert rows_of(phrases.collocations(table)) == plain(rows)
    assert phrases.collocations(nothing).count() == 0
    assert phrases.collocations(table.where("text = ''")).count() == 0


def test_long_texts_are_cut_between_pieces(spark, monkeypatch):
    """Slices of 64 bytes: every phrase is still found."""
    rows = made(5)
    for i in range(len(rows)):
        got = b"".join(p for _, p in phrases._parts([(rows[i][1] or "").encode()], 64))
        assert got == (rows[i][1] or "").encode()
    monkeypatch.setattr(phrases, "SLICE", 64)
    table = spark.createDataFrame(rows[:200], "lang string, text string")
    assert rows_of(phrases.collocations(table, support=3)) == plain(rows[:200], 3)


def test_counts_beyond_64_bit_products(spark, monkeypatch):
    """Counts of 10**15 stand for a far larger corpus; products pass 64 bits."""
    big = 10 ** 15
    found = spark.createDataFrame([("en", "a", 1, 3 * big), ("en", "b", 1, 4 * big), ("en", "c", 1, 5 * big),
                                   ("en", "a b", 2, 2 * big + 1), ("en", "b c", 2, 3 * big), ("en", "a b c", 3, 2 * big)],
                                  "lang string, phrase string, k int, f bigint")
    n = spark.createDataFrame([("en", 9 * big)], "lang string, n bigint")
    monkeypatch.setattr(phrases, "frequent_phrases", lambda *a: (found, n))
    got = {r.phrase: (r.a, r.l, r.r, r.score) for r in phrases.collocations(None).collect()}
    assert got == {"b c": (3 * big, 4 * big, 5 * big, 2000000 * 3 * big // (9 * big)),
                   "a b c": (2 * big, 2 * big + 1, 5 * big, 2000000 * 2 * big // (7 * big + 1))}


def test_bitmap_holds_every_hash(spark):
    h = np.random.default_rng(1).integers(-2 ** 63, 2 ** 63, 3000)
    h[:3] = 0, -1, 32768
    bitmap = phrases._frequent_somewhere(spark.createDataFrame([(0, int(x), 9) for x in h], phrases.LOCAL), 30, 4)
    assert phrases._in(bitmap, h.view(np.uint64)).all()
    other = np.random.default_rng(2).integers(0, 2 ** 63, 3000).view(np.uint64)
    assert phrases._in(bitmap, other).mean() < 0.1
