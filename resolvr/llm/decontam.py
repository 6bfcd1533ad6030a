"""Benchmark decontamination by winnowing.

Words are hashed, every run of ``K`` words gets a hash, and of each ``W``
consecutive ones the smallest are kept, in documents and benchmark alike. A
shared span of ``K + W - 1`` = 13 words holds one whole window of ``W`` equal
hashes, so at least one kept hash meets; each meeting is extended word by word
to the longest common run, and a run of 13 words (or a whole shorter item)
marks its words. Hashes only find places; words are compared as they are.

Items shorter than 13 words lie below that guarantee; each of their lengths
is a scheme of its own (K = length, W = 1).

The benchmark is broadcast in parts of at most ``max_broadcast`` bytes of
text, whose index a Python worker builds once. With one part (nearly always)
documents are read once and never shuffled. A larger benchmark takes one pass
over the stored documents a part, one part alive at a time; a pass returns only
the documents that the part hits, and the marks of a document are joined.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import persist_table
from .common import SLICE_BYTES, as_bytes, cut, handed_through, packed, slices

SPAN = 13
K, W = 8, 6
_P = 0x9E3779B97F4A7C15
_Q = np.uint64(0xD6E8FEB86659FD93)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_WORD = np.zeros(256, np.int8)
_WORD[0x30:0x3A] = _WORD[0x41:0x5B] = _WORD[0x61:0x7B] = _WORD[0x80:] = 1
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of an odd base modulo 2**64 and of its inverse."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, SLICE_BYTES + 1)
        for b in (_P, pow(_P, -1, 1 << 64)):
            table = np.full(n, b, np.uint64)
            table[0] = 1
            _powers.append(np.cumprod(table))
        del _powers[:-2]
    return _powers


def words_of(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each word of lower-cased text, in blocks that
    end between words."""
    out, at = [], 0
    while at < len(text):
        end = min(at + SLICE_BYTES, len(text))
        while end < len(text) and _WORD[text[end]]:
            end += 1
        b = text[at:end]
        edge = np.diff(_WORD[b], prepend=0, append=0)
        s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        up, down = _power_tables(len(b) + 1)
        total = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[:len(b)], out=total[1:])
        h = (total[e] - total[s]) * down[s]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        out.append((s + at, e + at, h ^ (h >> np.uint64(32))))
        at = end
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)


def grams(h: np.ndarray, owner: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` words from each place on; none across texts."""
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    g = h[:m].copy()
    for t in range(1, k):
        g = g * _Q + h[t:m + t]
    g ^= g >> np.uint64(31)
    g[owner[:m] != owner[k - 1:]] = _NONE
    return g


def winnow(g: np.ndarray, w: int) -> np.ndarray:
    """Places of the smallest hashes (all of equal ones) of each window of
    ``w`` consecutive ones."""
    m = len(g) - w + 1
    if m <= 0:
        return np.flatnonzero(g != _NONE)
    least = g[:m].copy()
    for t in range(1, w):
        np.minimum(least, g[t:m + t], out=least)
    pad = np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)])
    most = pad[:len(g)].copy()
    for t in range(1, w):
        np.maximum(most, pad[t:len(g) + t], out=most)
    return np.flatnonzero((most == g) & (g != _NONE))


class Benchmark:
    """Words and kept hashes of one part of the benchmark, in flat arrays."""

    def __init__(self, items: list[tuple[str | None, bytes]]):
        self.ids = [i for i, _ in items]
        self.text = b" " + b" ".join(t for _, t in items).lower()
        buf, first = packed([t.lower() for _, t in items])
        self.start, self.end, h = words_of(buf)
        owner = np.searchsorted(first, self.start, "right") - 1
        self.begin = np.searchsorted(owner, np.arange(len(items) + 1))
        length = np.diff(self.begin)
        self.schemes = []
        for n in [*np.unique(length[(length > 0) & (length < SPAN)]).tolist(), SPAN]:
            k, w = (K, W) if n == SPAN else (n, 1)
            at = np.flatnonzero((length >= SPAN if n == SPAN else length == n)[owner]) if len(owner) else owner
            g = grams(h[at], owner[at], k)
            kept = winnow(g, w)
            kept = kept[np.argsort(g[kept], kind="stable")]
            known, begin = np.unique(g[kept], return_index=True)
            place = at[kept]
            if len(known):
                self.schemes.append((k, w, known, np.append(begin, len(place)), owner[place].astype(np.int32),
                                     (place - self.begin[owner[place]]).astype(np.int32)))

    def words(self, n: int) -> list[bytes]:
        """The words of an item."""
        a, b = self.begin[n], self.begin[n + 1]
        return [self.text[i:j] for i, j in zip(self.start[a:b].tolist(), self.end[a:b].tolist())]

    def hits(self, texts: list[bytes | None]):
        """Per text: number of words, marked runs of words, items found."""
        low = [t.lower() if t else b"" for t in texts]
        buf, first = packed(low)
        s, e, h = words_of(buf)
        owner = np.searchsorted(first, s, "right") - 1
        begin = np.searchsorted(owner, np.arange(len(texts) + 1))
        met = defaultdict(list)
        for k, w, known, first_of, item, place in self.schemes:
            g = grams(h, owner, k)
            at = winnow(g, w)
            near = np.minimum(np.searchsorted(known, g[at]), len(known) - 1)
            same = known[near] == g[at]
            for p, c in zip(at[same].tolist(), near[same].tolist()):
                span = slice(first_of[c], first_of[c + 1])
                met[int(owner[p])].append((p, list(zip(item[span].tolist(), place[span].tolist()))))
        for i in range(len(texts)):
            a, b = int(begin[i]), int(begin[i + 1])
            runs, items = [], set()
            if i in met:
                base = int(first[i])
                words = [low[i][x - base:y - base] for x, y in zip(s[a:b].tolist(), e[a:b].tolist())]
                runs, items = self._extend(words, [(p - a, at) for p, at in met[i]])
            yield b - a, runs, items

    def _extend(self, words: list[bytes], met) -> tuple[list[tuple[int, int]], set[str]]:
        runs, items, seen, known = set(), set(), {}, {}
        for p, places in met:
            for n, q in places:
                if seen.get((n, p - q), -1) >= p:
                    continue
                if n not in known:
                    known[n] = self.words(n)
                item = known[n]
                x, y = p, q
                while x and y and words[x - 1] == item[y - 1]:
                    x, y = x - 1, y - 1
                u, v = p, q
                while u < len(words) and v < len(item) and words[u] == item[v]:
                    u, v = u + 1, v + 1
                seen[n, p - q] = u
                if u > p and u - x >= min(SPAN, len(item)):
                    runs.add((x, u))
                    items.add(self.ids[n])
        return sorted(runs), items - {None}


def _covered(runs) -> int:
    total, end = 0, 0
    for a, b in sorted(runs):
        total += max(0, b - max(a, end))
        end = max(end, b)
    return total


RESULT = "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"


def contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", carry: list[str] | None = None,
                  max_broadcast: int = 32 << 20) -> DataFrame:
    """The columns ``carry`` of ``docs`` (all by default) and ``n_words,
    n_hit, n_items, items_sha256, contaminated`` of each row; columns of ``docs`` with
    these names, in any case, are replaced.

    Null and empty texts have no words and are never contaminated. Items that
    are null or without words take no part. Items without an id mark words and
    contaminate, but ``n_items`` and ``items_sha256`` count ids only, a repeated one
    once. Repeated documents are judged one by one; an empty benchmark marks
    nothing, an empty table gives no rows."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("item"),
                             F.col(f"`{item_text_col}`").alias("text")).where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-3 * size // (2 * max_broadcast))) if size > max_broadcast else 1
    work, kept, schema, named = handed_through(docs, text_col, carry, RESULT)

    def part(n: int):
        rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == n).collect()
        found = [(r["item"], r["text"].encode()) for r in rows]
        return spark.sparkContext.broadcast((hash_of(found), found))

    def judged(batch, found):
        n_hit = [_covered(r) for _, r, _ in found]
        return pa.RecordBatch.from_arrays(
            [*[batch[c] for c in kept.values()],
             pa.array([n for n, _, _ in found], pa.int64()), pa.array(n_hit, pa.int64()),
             pa.array([len(i) for _, _, i in found], pa.int64()),
             pa.array([hashlib.sha256(",".join(sorted(i)).encode()).hexdigest() for _, _, i in found], pa.string()),
             pa.array([x > 0 and 20 * x >= n for x, (n, _, _) in zip(n_hit, found)], pa.bool_())], schema.names)

    if parts == 1:
        shared = part(0)

        def run(batches):
            bench = _index(*shared.value)
            for batch in cut(batches):
                texts = as_bytes(batch["text"])
                yield judged(batch, [x for a, b in slices(texts) for x in bench.hits(texts[a:b])])

        return named(work.mapInArrow(run, schema))

    stored = persist_table(work.withColumn("row", F.monotonically_increasing_id()), "judged")
    marks = [persist_table(_marks(stored.select("row", "text"), part(n)), "marks") for n in range(parts)]
    every = marks[0]
    for m in marks[1:]:
        every = every.unionByName(m)
    every = every.groupBy("row").agg(F.flatten(F.collect_list("runs")).alias("runs"),
                                     F.array_distinct(F.flatten(F.collect_list("ids"))).alias("ids"))

    def merge(batches):
        for batch in cut(batches):
            texts = as_bytes(batch["text"])
            n_words = [x for a, b in slices(texts) for x, _, _ in Benchmark([]).hits(texts[a:b])]
            yield judged(batch, [(n, list(zip((r or [])[::2], (r or [])[1::2])), set(i or []))
                                 for n, r, i in zip(n_words, batch["runs"].to_pylist(), batch["ids"].to_pylist())])

    return named(stored.join(every, "row", "left").mapInArrow(merge, schema))


def hash_of(items: list[tuple[str | None, bytes]]) -> int:
    crc = 0
    for item, text in items:
        crc = zlib.crc32(repr((item, len(text))).encode() + text, crc)
    return crc << 32 | len(items)


_INDEXES: dict[int, Benchmark] = {}


def _index(key: int, items: list[tuple[str | None, bytes]]) -> Benchmark:
    """One per Python worker: the index of the part that it is busy with."""
    if key not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[key] = Benchmark(items)
    return _INDEXES[key]


def _marks(rows: DataFrame, shared) -> DataFrame:
    """``row, runs, ids`` of the rows that a part of the benchmark hits."""
    def run(batches):
        bench = _index(*shared.value)
        for batch in cut(batches):
            texts = as_bytes(batch["text"])
            found = [x for a, b in slices(texts) for x in bench.hits(texts[a:b])]
            at = [i for i, (_, runs, _) in enumerate(found) if runs]
            yield pa.RecordBatch.from_arrays(
                [batch["row"].take(pa.array(at, pa.int64())),
                 pa.array([[x for r in found[i][1] for x in r] for i in at], pa.list_(pa.int64())),
                 pa.array([sorted(found[i][2]) for i in at], pa.list_(pa.string()))], ["row", "runs", "ids"])

    return rows.mapInArrow(run, "row bigint, runs array<bigint>, ids array<string>")
