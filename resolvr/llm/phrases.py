"""Collocations of two to four words, mined by SON partitioning.

Rows are dealt to ``shards`` by a hash of their content. A phrase with
``support`` occurrences in a language has at least ``support / shards`` of them in
one shard, whatever the shards' sizes, so each shard is mined completely at that
lower support, level by level: words, then pairs of locally frequent words, then
runs of three and four whose pairs are all locally frequent. The union of what
is frequent in any shard is then counted over all shards, by the phrases
themselves.

A shard is a share of the corpus, not of a task's size, as a support divided by
the number of tasks would soon be one. Its counts go by 64-bit hashes (of a
phrase with its language); two phrases with one hash can only add a candidate. A
task learns the candidates of the level below from a bitmap of their hashes of
at most ``MAX_BITS`` bits, so what is broadcast does not grow with the corpus; a
phrase that is let through by chance is counted, too, and fails the support.
Counts are summed within a task before they are shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import persist_table
from .common import as_bytes, slices

#: Bits of the largest bitmap (16 MB); smaller candidate sets get 32 bits each.
MAX_BITS = 1 << 27
#: Text bytes that a task counts at a time.
SLICE = 2 << 20
_KIND = np.zeros(256, np.int8)  # 0: in a word, 1: between words, 2: between pieces
_KIND[[0x20, 0x09]] = 1
_KIND[[ord(c) for c in ".,;:!?\x0a\x0b\x0c\x0d"]] = 2
_BREAK = re.compile(rb"[.,;:!?\x0a-\x0d]")
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _parts(texts: list, limit: int) -> Iterator[tuple[int, bytes]]:
    """(place, text) with long texts cut between pieces, where no phrase is."""
    for i, text in enumerate(texts):
        at = 0
        while text and at < len(text):
            cut = _BREAK.search(text, at + limit) if len(text) - at > limit else None
            end = cut.end() if cut else len(text)
            yield i, text[at:end]
            at = end


class Slice:
    """The words of some texts. ``word`` has a number per word of the texts
    (words of different groups have different numbers), ``next`` whether the
    following word stands in the same piece."""

    def __init__(self, texts: list[bytes], group: np.ndarray, groups: int):
        buf = np.frombuffer(b"\n".join(texts).lower() + b"\n", np.uint8)
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        kind = _KIND[buf]
        inside = kind == 0
        turns = np.flatnonzero(np.append(inside, False) != np.append(False, inside))
        s, e = turns[::2], turns[1::2]
        piece = np.cumsum(kind == 2, dtype=np.int32)[s]
        self.next = np.append(piece[1:] == piece[:-1], False)[:len(s)]
        owner = np.searchsorted(np.cumsum(lens + 1) - lens - 1, s, "right") - 1
        offsets = np.zeros(len(s) + 1, np.int64)
        np.cumsum(e - s, out=offsets[1:])
        found = pa.Array.from_buffers(pa.large_binary(), len(s), [None, pa.py_buffer(offsets), pa.py_buffer(buf[inside])]) \
            .dictionary_encode()
        code = found.indices.to_numpy() * np.int64(groups) + group[owner]
        count = np.bincount(code, minlength=len(found.dictionary) * groups)
        known = np.flatnonzero(count)
        self.word, self.count = (np.cumsum(count > 0) - 1)[code], count[known]
        self.texts, self.text_of, self.group = found.dictionary, known // groups, known % groups

    def pairs(self, good: np.ndarray) -> None:
        """Numbers of the pairs of ``good`` words, by their first word's
        place; -1 elsewhere."""
        w, n = self.word, max(1, len(self.text_of))
        at = np.flatnonzero(self.next[:-1] & good[w[:-1]] & good[w[1:]]) if len(w) else np.zeros(0, np.int64)
        found = pa.array(w[at] * n + w[at + 1]).dictionary_encode()
        known, number = found.dictionary.to_numpy(), found.indices.to_numpy()
        self.first, self.second, self.pair_count = known // n, known % n, np.bincount(number, minlength=len(known))
        self.pair = np.full(len(w) + 2, -1, np.int64)
        self.pair[at] = number

    def longer(self, good: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Runs of three, then four words whose pairs are all ``good``: word
        numbers (one row per distinct run) and counts."""
        ok = np.append(good, False)[self.pair]  # -1 picks the last
        n, m = max(1, len(self.text_of)), max(1, len(self.first))
        at = np.flatnonzero(ok[:-1] & ok[1:])
        known, count = np.unique(self.pair[at] * n + self.second[self.pair[at + 1]], return_counts=True)
        p = known // n
        yield np.stack([self.first[p], self.second[p], known % n]), count
        at = np.flatnonzero(ok[:-2] & ok[1:-1] & ok[2:])
        known, count = np.unique(self.pair[at] * m + self.pair[at + 2], return_counts=True)
        p, q = known // m, known % m
        yield np.stack([self.first[p], self.second[p], self.first[q], self.second[q]]), count


def _slices(batch, limit: int) -> Iterator[tuple[Slice, list]]:
    """Slices of a batch, and the (language, shard) of each group."""
    found = list(_parts(as_bytes(batch["text"]), limit))
    langs, shards = batch["lang"].to_pylist(), batch["shard"].to_pylist()
    texts = [t for _, t in found]
    for a, b in slices(texts, limit):
        of = [(langs[i], shards[i]) for i, _ in found[a:b]]
        names = sorted(set(of))
        number = {x: k for k, x in enumerate(names)}
        yield Slice(texts[a:b], np.array([number[x] for x in of], np.int64), len(names)), names


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _text_hashes(words: pa.LargeBinaryArray) -> np.ndarray:
    """A 64-bit polynomial of the bytes of each word, modulo 2**64: running
    sums of bytes times powers of an odd number, shifted back by its inverse."""
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, np.int64)[words.offset:words.offset + len(words) + 1]
    text = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]].astype(np.uint64) if len(words) else np.zeros(0, np.uint64)
    if len(_powers[0]) <= len(text):
        for i, base in enumerate((int(_P), pow(int(_P), -1, 1 << 64))):
            table = np.full(max(2 * len(text), 1 << 18), base, np.uint64)
            table[0] = 1
            _powers[i] = np.cumprod(table)
    total = np.zeros(len(text) + 1, np.uint64)
    np.cumsum((text + np.uint64(1)) * _powers[0][:len(text)], out=total[1:])
    at = ends - ends[0]
    h = (total[at[1:]] - total[at[:-1]]) * _powers[1][at[:-1]]
    return (h ^ (h >> np.uint64(29))) * _Q


def _hash(x: Slice, names: list) -> np.ndarray:
    """Hash of each word with its language, the same in every task."""
    of = np.array([xxhash.xxh64_intdigest(lang.encode()) for lang, _ in names], np.uint64)
    h = (_text_hashes(x.texts)[x.text_of] ^ of[x.group]) * _P
    return h ^ (h >> np.uint64(32))


def _run_hash(word: np.ndarray, runs) -> np.ndarray:
    h = word[runs[0]]
    for w in runs[1:]:
        h = (h ^ (h >> np.uint64(31))) * _P + word[w]
        h = (h ^ (h >> np.uint64(29))) * _Q
    return h


def _in(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    p = h & np.uint64(8 * len(bitmap) - 1)
    return ((bitmap[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)


LOCAL = "shard int, h bigint, c bigint"


def _rows(group: np.ndarray, names: list, h: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
    shard = np.array([s for _, s in names], np.int32)
    return pa.RecordBatch.from_arrays([pa.array(shard[group]), pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))],
                                      ["shard", "h", "c"])


def _local(texts: DataFrame, count) -> DataFrame:
    """Occurrences by shard and hash."""
    def run(batches):
        for batch in batches:
            for x, names in _slices(batch, SLICE):
                yield from count(x, names)
    return texts.mapInArrow(run, LOCAL).groupBy("shard", "h").agg(F.sum("c").alias("c"))


def _wide(c) -> Column:
    """Products of counts may pass 64 bits."""
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(19,0)")


def _frequent_somewhere(local: DataFrame, support: int, shards: int) -> np.ndarray:
    """Bitmap of the hashes that are frequent in any shard at its share of
    the support."""
    kept = persist_table(local.where(F.col("c") * shards >= support).select("h"), "frequent-local")
    n = kept.count()
    bits = min(MAX_BITS, 1 << max(15, (32 * n - 1).bit_length()))
    place = F.col("h").bitwiseAND(F.lit(bits - 1)) + 1  # Spark's bitmaps count from one
    rows = kept.select(F.bitmap_bucket_number(place).alias("b"), F.bitmap_bit_position(place).alias("p")) \
        .groupBy("b").agg(F.bitmap_construct_agg("p").alias("bits")).collect()  # at most 4,096 rows of 4 KB
    out = np.zeros(bits // 8, np.uint8)
    for r in rows:
        out[(r["b"] - 1) * 4096:r["b"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", support: int = 30,
                     shards: int = 3) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, k, f`` (stored): every phrase of up to four words
    with at least ``support`` occurrences in its language, counted exactly; and
    ``lang, n``: words per language."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"),
                        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")) \
        .withColumn("shard", F.pmod(F.xxhash64("lang", "text"), F.lit(shards)).cast("int"))

    def words(x, names):
        yield _rows(x.group, names, _hash(x, names), x.count)

    known = spark.sparkContext.broadcast(_frequent_somewhere(_local(texts, words), support, shards))

    def pairs(x, names):
        h = _hash(x, names)
        x.pairs(_in(known.value, h))
        yield _rows(x.group[x.first], names, _run_hash(h, (x.first, x.second)), x.pair_count)

    known_pairs = spark.sparkContext.broadcast(_frequent_somewhere(_local(texts, pairs), support, shards))

    def runs(x, names):
        h = _hash(x, names)
        x.pairs(_in(known.value, h))
        for run, count in x.longer(_in(known_pairs.value, _run_hash(h, (x.first, x.second)))):
            yield _rows(x.group[run[0]], names, _run_hash(h, run), count)

    known_runs = spark.sparkContext.broadcast(_frequent_somewhere(_local(texts, runs), support, shards))

    def exact(batches):
        def rows(x, names, run, count):
            phrase = [x.texts.take(pa.array(x.text_of[w])).cast(pa.large_string()) for w in run]
            lang = pa.array([a for a, _ in names], pa.string()).take(pa.array(x.group[run[0]]))
            return pa.RecordBatch.from_arrays(
                [lang, pc.binary_join_element_wise(*phrase, pa.scalar(" ", pa.large_string())).cast(pa.string()),
                 pa.array(np.full(len(count), len(run), np.int32)), pa.array(count.astype(np.int64))],
                ["lang", "phrase", "k", "c"])

        for batch in batches:
            for x, names in _slices(batch.set_column(2, "shard", pa.array([0] * len(batch), pa.int32())), SLICE):
                h = _hash(x, names)
                ok = _in(known.value, h)
                n = np.bincount(x.group, weights=x.count, minlength=len(names)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([a for a, _ in names]), pa.array([None] * len(n), pa.string()),
                     pa.array(np.zeros(len(n), np.int32)), pa.array(n)], ["lang", "phrase", "k", "c"])
                x.pairs(ok)
                pair = _run_hash(h, (x.first, x.second))
                good = _in(known_pairs.value, pair)
                yield rows(x, names, np.flatnonzero(ok)[None], x.count[ok])
                yield rows(x, names, np.stack([x.first[good], x.second[good]]), x.pair_count[good])
                for run, count in x.longer(good):
                    kept = _in(known_runs.value, _run_hash(h, run))
                    yield rows(x, names, run[:, kept], count[kept])

    found = texts.mapInArrow(exact, "lang string, phrase string, k int, c bigint") \
        .groupBy("lang", "phrase", "k").agg(F.sum("c").alias("f")).where((F.col("f") >= support) | (F.col("k") == 0))
    found = persist_table(found, "phrases")
    return found.where("k > 0"), found.where("k = 0 and f > 0").select("lang", F.col("f").alias("n"))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", support: int = 30, top: int = 2000,
                 contained: int = 80, shards: int = 3) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` collocations of
    each language.

    Texts are lower-cased (A-Z only), cut into pieces at ``.,;:!?`` and line
    breaks and into words at spaces and tabs. ``a`` counts the phrase, ``l`` and
    ``r`` its two parts at the cut that scores ``floor(2000000 * a / (l + r))``
    lowest, ``n`` the language's words. A phrase goes if a longer one that holds
    its words has at least ``contained`` percent of its count.

    A null language is ``und``; null and empty texts have no words, texts of any
    length are counted whole, repeated rows count each, other columns are
    not read. Ties in score go to the larger ``a``, then to the phrase in byte
    order. Tables without a frequent phrase give no rows."""
    found, words = frequent_phrases(docs, text_col, lang_col, support, shards)
    long = found.where("k > 1").withColumn("w", F.split("phrase", " ", -1))

    def part(start, size) -> Column:
        return F.array_join(F.slice("w", start, size), " ")

    cuts = long.select("lang", "phrase", F.col("f").alias("a"), "k", "w", F.explode(F.expr("sequence(1, k - 1)")).alias("cut")) \
        .select("lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("left"),
                part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"))
    count = found.select("lang", "phrase", "f")
    cuts = cuts.join(count.toDF("lang", "left", "l"), ["lang", "left"]).join(count.toDF("lang", "right", "r"), ["lang", "right"]) \
        .withColumn("score", F.expr("cast((2000000 * cast(a AS decimal(19,0))) div (cast(l AS decimal(19,0)) + r) AS bigint)"))
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))

    inside = long.where("k > 2").select("lang", F.col("f").alias("longer"), "w", "k", F.explode(
        F.expr("flatten(transform(sequence(2, k - 1), s -> transform(sequence(1, k - s + 1), i -> struct(i, s))))")).alias("p")) \
        .select("lang", part(F.col("p.i"), F.col("p.s")).alias("phrase"), "longer") \
        .groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = best.join(inside, ["lang", "phrase"], "left") \
        .where(F.col("longer").isNull() | (_wide("longer") * 100 < _wide("a") * contained))
    by = Window.partitionBy("lang").orderBy(F.desc("best.score"), F.desc("a"), "phrase")
    return kept.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top).join(words, "lang") \
        .select("lang", "rank", "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), "n",
                F.col("best.score").alias("score"))
