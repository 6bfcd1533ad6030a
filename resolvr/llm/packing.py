"""Best-fit packing of token sequences by hierarchical residual packing.

Every input partition tokenises its documents, cuts the long ones and packs
its pieces best-fit decreasing. Nearly full sequences are final at once. The
pieces of underfull ones go to the next round, where a tree of groups
(``fan_in`` partitions, then ``fan_in`` groups, ...) packs them best-fit again
until one group is left. Only piece records travel, never texts or ids, and a
group passes on at most ``open_limit`` sequences (the emptiest), so no task
holds more than ``fan_in * open_limit`` sequences however large the corpus is.
Fuller ones beyond that are spare: after the tree, the pieces of all spare
sequences are packed together. What best-fit decreasing does depends only on
how many pieces of each length there are, so the driver packs these counts and
each piece finds its place by its rank among those of its length.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import persist_table
from .common import keyed

CAPACITY = 1024
END_ID = 2
PIECE = "_row bigint, doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, " \
        "sequence_id bigint, offset bigint, grp bigint, open boolean, spare boolean"
_FIELDS = [f.split()[0] for f in PIECE.split(", ")]
_TYPES = {"int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_()}
_SCHEMA = pa.schema([(f.split()[0], _TYPES[f.split()[1]]) for f in PIECE.split(", ")])


#: Levels of sequence ids behind those of the tree: spare pieces packed by their
#: counts, and sequences that a single piece fills.
_BY_COUNT, _WHOLE = 126, 127
#: Spare pieces of one length that are ranked in one task, about.
_RANKED = 200_000

_SPACE = re.compile(r"[\s\x1c-\x1f]").search


class WordIds(dict):
    """Token ids (little-endian uint32 bytes) of text parts. The first
    ``limit`` parts are kept, which are mostly the frequent ones. A mark
    behind letters and a line break between words are always token runs of
    their own, so such parts are put together from what they consist of."""

    def __init__(self, encode, encode_letters, lead: str, limit: int = 450_000, longest: int = 48):
        super().__init__()
        self.encode, self.encode_letters, self.lead = encode, encode_letters, lead
        self.limit, self.longest, self.line_start = limit, longest, self

    def __missing__(self, part: str) -> bytes:
        if part.isalpha() and part < "\u0250":
            ids = self.encode_letters(self.lead + part)
        elif len(part) > 1 and part[-1] in ".,;:!?" and part[:-1].isalpha():
            return self[part[:-1]] + self.encode(part[-1])
        elif "\n" in part and all(lines := part.split("\n")) and not any(_SPACE(x) for x in lines):
            return self[lines[0]] + b"".join([self.encode("\n") + self.line_start[x] for x in lines[1:]])
        else:
            ids = self.encode(self.lead + part)
        if len(part) <= self.longest and len(self) < self.limit:
            self[part] = ids
        return ids


class ByteLevelEncoder:
    """Ids of whole texts by a byte-level BPE tokenizer whose pre-tokenizer
    never joins text across a space that stands before a non-space: texts are
    split there, and the ids of each part are looked up. Words of Latin
    letters are merged by the vocabulary's ranks directly (its ids are in
    merge order, else the tokenizer does it); texts with a special token or
    with runs of white space go to the tokenizer whole."""

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(definition)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.irregular = regex.compile(r" (?:[\s\x1c-\x1f]|$)").search
        marks: dict[str, bytes] = {}

        def encode(part: str) -> bytes:
            if len(part) == 1 and part in marks:
                return marks[part]
            ids = np.array(self.tokenizer.encode(part, add_special_tokens=False).ids, "<u4").tobytes()
            if len(part) == 1:
                marks[part] = ids
            return ids

        self.encode, letters = encode, merges_by_rank(definition) or encode
        self.first, self.rest = WordIds(encode, letters, ""), WordIds(encode, letters, " ")
        self.rest.line_start = self.first

    def __call__(self, text: str) -> bytes:
        if self.irregular(text) or any(s in text for s in self.special):
            return self.encode(text)
        first, *rest = text.split(" ")
        return (self.first[first] if first else b"") + b"".join(map(self.rest.__getitem__, rest))


def merges_by_rank(definition: str):
    """Ids of a run of letters (with or without a leading space) by the
    ranks of the definition's own vocabulary; None where its ids are not in
    the order of its merges."""
    import tiktoken
    model = json.loads(definition)["model"]
    vocabulary, byte = model["vocab"], byte_of_char()
    parts = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    order = [vocabulary.get(a + b, -1) for a, b in parts]
    if order != sorted(order) or min(order, default=-1) < 256 or model.get("ignore_merges"):
        return None
    ranks = {bytes(map(byte.get, t)): i for t, i in vocabulary.items() if all(c in byte for c in t)}
    ranks = {t: i for t, i in ranks.items() if len(t) == 1 or i >= 256 and i <= order[-1]}
    single = tiktoken.Encoding("ranks", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    return lambda text: np.array(single._encode_single_piece(text), "<u4").tobytes()


def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for:
    printable Latin-1 characters for themselves, the other bytes in order
    for the characters from 256 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + k): b for k, b in enumerate(spare)}


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: full ones, the first one
    with what is left over."""
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def best_fit(lengths, capacity: int = CAPACITY) -> list[list[int]]:
    """Best-fit decreasing: bins as lists of indexes, the longest first. The
    free space of the open bins is a bit mask, so each step is one lookup of
    the smallest gap that is large enough."""
    gaps: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, bins = 0, []
    for i in sorted(range(len(lengths)), key=lengths.__getitem__, reverse=True):
        n = lengths[i]
        fit = mask >> n
        if fit:
            gap = n + (fit & -fit).bit_length() - 1
            b = gaps[gap].pop()
            if not gaps[gap]:
                mask ^= 1 << gap
            bins[b].append(i)
        else:
            gap, b = capacity, len(bins)
            bins.append([i])
        left = gap - n
        if left:
            if not gaps[left]:
                mask |= 1 << left
            gaps[left].append(b)
    return bins


def _packed_rows(items: list[tuple], group: int, level: int, capacity: int, slack: int,
                 open_limit: int) -> dict[str, list]:
    """Pieces (row, doc_id, piece, start, length, crc) placed into bins."""
    items.sort(key=lambda x: (-x[4], x[0], x[2]))
    lengths = [x[4] for x in items]
    bins = best_fit(lengths, capacity)
    fill = [sum(lengths[i] for i in b) for b in bins]
    underfull = sorted((b for b in range(len(bins)) if fill[b] < capacity - slack), key=lambda b: (fill[b], b))
    still_open, spare = set(underfull[:open_limit]), set(underfull[open_limit:])
    out: dict[str, list] = defaultdict(list)
    for b, members in enumerate(bins):
        at = 0
        for i in members:
            for k, v in zip(_FIELDS, (*items[i], (level << 56) | (group << 28) | b, at, group, b in still_open,
                                        b in spare)):
                out[k].append(v)
            at += lengths[i]
    return out


def _batches(out: dict[str, list]):
    if out:
        yield from pa.table({k: out[k] for k in _FIELDS}, schema=_SCHEMA).to_batches(max_chunksize=10_000)


def pack(docs: DataFrame, tokenizer_json: str, id_col: str = "doc_id", text_col: str = "text",
         capacity: int = CAPACITY, end_id: int = END_ID, slack: int = 8, fan_in: int = 8,
         open_limit: int = 4096) -> DataFrame:
    """Where each piece of each document goes.

    ``docs`` is a stored table; ``tokenizer_json`` the definition of a
    byte-level BPE tokenizer. A document is its ids and ``end_id``; null and
    empty texts are ``end_id`` alone, texts of any length are read whole, and
    repeated rows (also of one id, or a null id) are packed one by one. An
    empty table gives no rows.

    Returns one row per piece: ``doc_id, piece, start, length, ids_crc32,
    sequence_id, offset, row_key`` (``row_key``: which row of the table).
    """
    spark = docs.sparkSession
    definition = spark.sparkContext.broadcast(tokenizer_json)  # a vocabulary file: a few MB

    def leaf(batches):
        from pyspark import TaskContext
        encode = _encoder(definition.value)
        tail = np.array([end_id], "<u4").tobytes()
        items, full, group = [], defaultdict(list), TaskContext.get().partitionId()
        number = 0
        for batch in batches:
            for row, doc, text in zip(batch["_row"].to_pylist(), batch["doc_id"].to_pylist(),
                                      batch["text"].to_pylist()):
                ids = memoryview((encode(text) if text else b"") + tail)
                for piece, (start, n) in enumerate(cut(len(ids) // 4, capacity)):
                    crc = zlib.crc32(ids[4 * start:4 * (start + n)])
                    if n < capacity:
                        items.append((row, doc, piece, start, n, crc))
                        continue
                    for k, v in zip(_FIELDS, (row, doc, piece, start, n, crc,
                                              (_WHOLE << 56) | (group << 28) | number, 0, group, False, False)):
                        full[k].append(v)
                    number += 1
            if full:
                yield from _batches(full)
                full = defaultdict(list)
        yield from _batches(_packed_rows(items, group, 0, capacity, slack, open_limit))

    table = persist_table(keyed(docs, doc_id=id_col, text=text_col).select(
        "_row", F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(leaf, PIECE), "packing")
    tables, level = [table], 0
    groups, spare = _left(table)
    while groups is not None:
        level, last = level + 1, groups < fan_in

        merged = table.where("open").withColumn("grp", F.floor(F.col("grp") / fan_in).cast("bigint"))
        table = persist_table(merged.groupBy("grp").applyInArrow(
            _merger(level, capacity, slack, 0 if last else open_limit), PIECE), "packing")
        tables.append(table)
        if last:  # what this one group leaves is spare, too; without others it is final
            break
        groups, more = _left(table)
        spare = spare or more
    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t)
    out = every.where("not open and not spare" if spare else "not open")
    if spare:
        out = out.select(*_FIELDS[:8]).unionByName(_pack_by_count(every.where("spare"), capacity))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset",
                      F.col("_row").alias("row_key"))


def _left(table: DataFrame) -> tuple[int | None, bool]:
    """The last group with open pieces, and whether there are spare ones."""
    groups, spare = table.agg(F.max(F.when(F.col("open"), F.col("grp"))), F.max("spare")).first()
    return groups, bool(spare)


def best_fit_counts(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, ...]], int]:
    """Best-fit decreasing of ``counts[length]`` pieces, as ``best_fit`` does
    it piece by piece. Bins of one gap are interchangeable, so ranges of them
    are filled at once, in time and space that do not grow with the counts.

    Returns runs and the number of bins. A run is ``length, first, each, bin,
    offset``: the pieces of this length from rank ``first`` on lie in the bins
    from ``bin`` on, ``each`` of them to a bin, behind ``offset``."""
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # ranges of bins by what is free
    runs, bins = [], 0
    for n in sorted(counts, reverse=True):
        rank, total = 0, counts[n]
        for gap in [*sorted(g for g in gaps if g >= n), capacity]:
            each = gap // n
            while rank < total:
                if gap < capacity:
                    if not gaps[gap]:
                        break
                    a, b = gaps[gap].pop()
                else:
                    a, b = bins, bins - (rank - total) // each
                    bins = b
                runs.append((n, rank, each, a, capacity - gap))
                full, part = divmod(min(total - rank, (b - a) * each), each)
                rank += full * each + part
                for start, end, left in ((a, a + full, gap - each * n), (a + full, a + full + bool(part), gap - part * n),
                                         (a + full + bool(part), b, gap)):
                    if start < end and left:
                        gaps[left].append((start, end))
    return runs, bins


def _pack_by_count(pieces: DataFrame, capacity: int) -> DataFrame:
    """All ``pieces`` packed best-fit decreasing, in one round for any number
    of them. No task holds all pieces of a length: each is ranked among those
    of its length and share (by hash), behind the shares before."""
    shares = 1 + pieces.count() // _RANKED
    dealt = pieces.select(*_FIELDS[:6], F.expr(f"pmod(xxhash64(_row, piece), {shares})").alias("share"))
    counts = persist_table(dealt.groupBy("length", "share").count(), "spare-counts")
    total = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    runs = np.array(sorted(best_fit_counts(total, capacity)[0]), np.int64)  # by length and rank
    shared = pieces.sparkSession.sparkContext.broadcast(runs)
    before = F.sum("count").over(Window.partitionBy("length").orderBy("share")) - F.col("count")
    ranked = dealt.withColumn("rank", F.row_number().over(
        Window.partitionBy("length", "share").orderBy("_row", "piece")) - 1) \
        .join(counts.select("length", "share", before.alias("before")), ["length", "share"]) \
        .select(*_FIELDS[:6], (F.col("before") + F.col("rank")).alias("rank"))

    def place(batches):
        length, first, each, start, offset = shared.value.T
        for batch in batches:
            n, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            run = np.searchsorted((length << 50) + first, (n << 50) + rank, "right") - 1
            bins, at = np.divmod(rank - first[run], each[run])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:6], pa.array((_BY_COUNT << 56) | (start[run] + bins)), pa.array(offset[run] + at * n)],
                _FIELDS[:8])

    return ranked.mapInArrow(place, ", ".join(PIECE.split(", ")[:8]))


def _merger(level: int, capacity: int, slack: int, open_limit: int):
    """One round of a group: its open pieces are packed anew."""
    def merge(key, rows):
        items = list(zip(*(rows[k].to_pylist() for k in _FIELDS[:6])))
        out = _packed_rows(items, key[0].as_py(), level, capacity, slack, open_limit)
        return pa.table({k: out[k] for k in _FIELDS}, schema=_SCHEMA)
    return merge


_ENCODERS: dict[int, ByteLevelEncoder] = {}


def _encoder(definition: str) -> ByteLevelEncoder:
    """One encoder per Python worker, so its memo serves all of its tasks."""
    key = zlib.crc32(definition.encode())
    if key not in _ENCODERS:
        _ENCODERS[key] = ByteLevelEncoder(definition)
    return _ENCODERS[key]


def sequences(docs: DataFrame, places: DataFrame, tokenizer_json: str, text_col: str = "text",
              end_id: int = END_ID) -> DataFrame:
    """The packed sequences themselves: ``sequence_id, ids array<int>``, from
    the same stored ``docs`` and the result of ``pack``. Each sequence holds
    at most ``capacity`` ids, so every group is bounded."""
    definition = docs.sparkSession.sparkContext.broadcast(tokenizer_json)

    def encoded(batches):
        encode, tail = _encoder(definition.value), np.array([end_id], "<u4")
        for batch in batches:
            ids = [np.concatenate([np.frombuffer(encode(t) if t else b"", "<u4"), tail]).astype(np.int32)
                   for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["_row"], pa.array(ids, pa.list_(pa.int32()))], ["_row", "ids"])

    ids = keyed(docs, text=text_col).mapInArrow(encoded, "_row bigint, ids array<int>")
    cuts = places.groupBy(F.col("row_key").alias("_row")).agg(
        F.collect_list(F.struct("sequence_id", "offset", "start", "length")).alias("cuts"))
    parts = ids.join(cuts, "_row").select("ids", F.explode("cuts").alias("c")).select(
        "c.sequence_id", "c.offset",
        F.slice("ids", (F.col("c.start") + 1).cast("int"), F.col("c.length").cast("int")).alias("part"))
    return parts.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "part"))).alias("p")) \
        .select("sequence_id", F.flatten(F.col("p.part")).alias("ids"))
