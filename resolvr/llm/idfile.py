"""Token ids of documents in binary files, each document compressed by itself.

File format (``MAGIC``): a data file is a header (magic, width of an id in
bytes, number of the file, SHA-256 of the dictionary), the documents' frames
end to end, and an index (``INDEX``: id, place and size of the frame, number
of ids, crc32 of the ids as unsigned 32-bit integers) behind which stand its
place and the magic again. A frame is a zstandard frame of the ids as
little-endian integers, compressed with one dictionary that all files share, so
a short document is small by itself and is read without its neighbours. The
dictionary lies beside the data files; a reader refuses another one.

Documents are in ascending order of their ids, within a file and from file to
file. Spark's range partitioning deals the compressed frames to the files and
its text sink writes them (the bytes of a row are written as they are, one line
feed behind each row, which the index allows for), so files land, commit and
survive lost executors as any other output.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import persist_table
from .common import keyed
from .packing import byte_of_char

MAGIC = b"IDF1"
HEAD = np.dtype([("magic", "S4"), ("width", "<u4"), ("file", "<u8"), ("dictionary", "V32")])
INDEX = np.dtype([("doc_id", "<i8"), ("null", "<u4"), ("crc32", "<u4"), ("offset", "<u8"), ("size", "<u8"),
                  ("n_tokens", "<u8")])
TAIL = np.dtype([("index", "<u8"), ("documents", "<u8"), ("magic", "S4")])
#: Bytes of frames in one row that is written.
CHUNK = 1 << 20
#: Fixed value: how a byte-level vocabulary of this kind cuts text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Text that every library classes alike: ASCII and Latin letters.
_ODD = re.compile("[^\x20-\x7e\n\r\tÀ-ÖØ-öø-ɏ]").search
_BREAK = re.compile(r" (?=[^\s\x1c-\x1f])")
#: Characters that are merged in one call; longer texts are cut at spaces.
_LONGEST = 1 << 15
END_ID = 2
READ = "file bigint, place bigint, doc_id bigint, before bigint, n_tokens bigint, ids_crc32 bigint, ids array<bigint>"


class Encoder:
    """Ids of whole texts as ``tokenizers`` gives them. Plain texts are merged
    by the ranks of the definition's own vocabulary, which is several times
    faster; texts with other characters or special tokens, and vocabularies of
    another kind, go to ``tokenizers``."""

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(definition)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ranked = _ranked(json.loads(definition))

    def exact(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def __call__(self, text: str) -> list[int]:
        if self.ranked is None or _ODD(text) or any(s in text for s in self.special):
            return self.exact(text)
        if len(text) <= _LONGEST:
            return self.ranked(text)
        out, at = [], 0
        while at < len(text):
            # ids never span a space that stands before a non-space
            cut = _BREAK.search(text, at + _LONGEST // 2) if len(text) - at > _LONGEST else None
            end = cut.start() if cut else len(text)
            out += (self.ranked if end - at <= _LONGEST else self.exact)(text[at:end])
            at = end
        return out


def _ranked(definition: dict):
    """Merging by ranks; None where the definition needs more than that."""
    model, split = definition["model"], definition.get("pre_tokenizer") or {}
    vocabulary, byte = model["vocab"], byte_of_char()
    merged = [vocabulary.get("".join(m) if isinstance(m, list) else m.replace(" ", "")) for m in model["merges"]]
    if definition.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") \
            or not split.get("use_regex", True) or model.get("ignore_merges") or None in merged \
            or merged != sorted(merged) or len(set(merged)) < len(merged):
        return None
    import tiktoken
    ranks = {bytes(map(byte.get, t)): i for t, i in vocabulary.items()
             if all(c in byte for c in t) and (len(t) == 1 or merged[0] <= i <= merged[-1])}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


_ENCODERS: dict[int, Encoder] = {}


def _encoder(definition: str) -> Encoder:
    """One per Python worker."""
    key = zlib.crc32(definition.encode())
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(definition)
    return _ENCODERS[key]


def train_dictionary(docs: DataFrame, definition, end_id: int, width: int, documents: int = 2000,
                     ids: int = 4096, size: int = 112_640) -> bytes:
    """A zstandard dictionary from serialized id arrays: the first ``ids`` ids
    of at most ``documents`` documents, those whose ids have the smallest
    hashes. Only how small the files get depends on it, never what they hold.
    Samples too small to train on are taken as they are; none give b""."""
    import zstandard
    hashed = docs.select(F.xxhash64("doc_id").alias("h"), "text")
    last = hashed.select("h").orderBy("h").limit(documents).agg(F.max("h")).first()[0]
    chosen = hashed.where(F.col("h") <= F.lit(last)).orderBy("h", F.xxhash64("text"), "text").limit(documents) \
        .select("text") if last is not None else hashed.select("text")

    def run(batches):
        encode = _encoder(definition.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(
                [np.array(([*encode(t[:8 * ids])] if t else [])[:ids] + [end_id], f"<u{width}").tobytes()
                 for t in batch["text"].to_pylist()], pa.binary())], ["ids"])

    samples = [bytes(r["ids"]) for r in chosen.mapInArrow(run, "ids binary").collect()]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        raw = b"".join(samples)[-size:]
        return raw if len(raw) >= 8 else b""


def _dictionary(raw: bytes):
    import zstandard
    return zstandard.ZstdCompressionDict(raw) if raw else None


def write(docs: DataFrame, tokenizer_json: str, path: str, id_col: str = "doc_id", text_col: str = "text",
          end_id: int = END_ID, file_bytes: int = 32 << 20, level: int = 1) -> None:
    """Encodes every whole text of ``docs`` (a stored table), appends
    ``end_id`` to each and writes ``path/dictionary`` and ``path/data`` with
    about ``file_bytes`` bytes a file.

    Null and empty texts are ``end_id`` alone. Documents without an id come
    first; rows with one id stand side by side, each with its own frame. Other
    columns are not read. An empty table gives files without documents."""
    import zstandard
    spark = docs.sparkSession
    definition = spark.sparkContext.broadcast(tokenizer_json)  # a vocabulary file: a few MB
    top = max(json.loads(tokenizer_json)["model"]["vocab"].values())
    width = 2 if max(top, end_id) < 1 << 16 else 4
    table = keyed(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    raw = train_dictionary(table, definition, end_id, width)
    spark.createDataFrame([(hashlib.sha256(raw).hexdigest(), bytearray(raw))], "sha256 string, dictionary binary") \
        .coalesce(1).write.parquet(f"{path}/dictionary")
    shared = spark.sparkContext.broadcast(raw)  # 110 KB

    def compress(batches):
        encode = _encoder(definition.value)
        pack = zstandard.ZstdCompressor(level=level, dict_data=_dictionary(shared.value)).compress
        for batch in batches:
            frames, sizes, counts, crcs = [], [], [], []
            for text in batch["text"].to_pylist():
                ids = np.array((encode(text) if text else []) + [end_id], "<u4")
                frames.append(pack(ids.astype(f"<u{width}").tobytes()))
                sizes.append(len(frames[-1]))
                counts.append(len(ids))
                crcs.append(zlib.crc32(ids.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch["_row"], batch["doc_id"], pa.array(counts, pa.int64()), pa.array(crcs, pa.int64()),
                 pa.array(sizes, pa.int64()), pa.array(frames, pa.binary())],
                ["_row", "doc_id", "n_tokens", "crc", "size", "frame"])

    frames = persist_table(table.mapInArrow(
        compress, "_row bigint, doc_id bigint, n_tokens bigint, crc bigint, size bigint, frame binary"), "frames")
    total = frames.agg(F.sum("size")).first()[0] or 0
    slots = spark.sparkContext.defaultParallelism
    files = max(1, -(-total // file_bytes), min(2 * slots, total >> 20))  # small tables: a file a task, of 1 MB or more
    by = [F.col("doc_id").asc_nulls_first(), F.col("_row")]
    dealt = frames.repartitionByRange(files, *by).sortWithinPartitions(*by)
    digest = hashlib.sha256(raw).digest()

    def assemble(batches):
        from pyspark import TaskContext
        head = np.array((MAGIC, width, TaskContext.get().partitionId(), np.void(digest)), HEAD).tobytes()
        index, chunk, at, room = [], [head], 0, len(head)
        for batch in batches:
            start = np.zeros(len(batch), np.uint64)
            for i, frame in enumerate(batch["frame"].to_pylist()):
                if room >= CHUNK:
                    yield b"".join(chunk)
                    at, chunk, room = at + room + 1, [], 0  # one line feed behind each row
                start[i] = at + room
                chunk.append(frame)
                room += len(frame)
            part = np.zeros(len(batch), INDEX)
            part["doc_id"] = batch["doc_id"].fill_null(0).to_numpy()
            part["null"] = batch["doc_id"].is_null().to_numpy(zero_copy_only=False)
            part["crc32"], part["n_tokens"] = batch["crc"].to_numpy(), batch["n_tokens"].to_numpy()
            part["offset"], part["size"] = start, batch["size"].to_numpy()
            index.append(part)
        if index:
            yield b"".join(chunk)
            at += room + 1
            rows = np.concatenate(index)
            yield rows.tobytes() + np.array((at, len(rows), MAGIC), TAIL).tobytes()

    def rows(batches):
        for value in assemble(batches):
            yield pa.RecordBatch.from_arrays([pa.array([value], pa.binary())], ["value"])

    dealt.mapInArrow(rows, "value binary").select(F.col("value").cast("string")) \
        .write.option("lineSep", "\n").option("compression", "none").text(f"{path}/data")


def _parts(content: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Header and index of a file."""
    if content[:4] != MAGIC or content[-5:] != MAGIC + b"\n":
        raise ValueError("not a whole file of token ids")
    end = len(content) - 1 - TAIL.itemsize
    tail = np.frombuffer(content, TAIL, 1, end)[0]
    return np.frombuffer(content, HEAD, 1)[0], np.frombuffer(content, INDEX, int(tail["documents"]), int(tail["index"]))


def _ids(content: bytes, entry, width: int, unpack) -> np.ndarray:
    a = int(entry["offset"])
    ids = np.frombuffer(unpack(content[a:a + int(entry["size"])]), f"<u{width}").astype("<u4")
    if len(ids) != entry["n_tokens"] or zlib.crc32(ids.tobytes()) != entry["crc32"]:
        raise ValueError("a document does not match its index entry")
    return ids


def _shared_dictionary(spark: SparkSession, path: str) -> bytes:
    row = spark.read.parquet(f"{path}/dictionary").first()
    if hashlib.sha256(row["dictionary"]).hexdigest() != row["sha256"]:
        raise ValueError("the dictionary does not match its hash")
    return bytes(row["dictionary"])


def read(spark: SparkSession, path: str, with_ids: bool = True, where=None) -> DataFrame:
    """Every document of the files: ``file, place`` (within the file),
    ``doc_id, before`` (ids before it in its file), ``n_tokens, ids_crc32`` and
    ``ids`` (null if not ``with_ids``). Frames are decompressed and compared
    with the index; ``where`` (a function of the index, giving a mask) chooses
    documents, and no other frame is touched. A file of another dictionary, a
    cut file or a wrong document raises ValueError."""
    import zstandard
    shared = spark.sparkContext.broadcast(_shared_dictionary(spark, path))

    def run(batches):
        unpack = zstandard.ZstdDecompressor(dict_data=_dictionary(shared.value) or zstandard.ZstdCompressionDict(b"")
                                            ).decompress
        digest = hashlib.sha256(shared.value).digest()
        for batch in batches:
            for i in range(len(batch)):
                content = batch["content"][i].as_py()
                if not content:  # a task without documents
                    continue
                head, index = _parts(content)
                if head["dictionary"].tobytes() != digest:
                    raise ValueError("the file was written with another dictionary")
                before = np.cumsum(index["n_tokens"], dtype=np.int64) - index["n_tokens"].astype(np.int64)
                chosen = np.arange(len(index)) if where is None else np.flatnonzero(where(index))
                for a in range(0, len(chosen), 1000):
                    at = chosen[a:a + 1000]
                    ids = [_ids(content, e, int(head["width"]), unpack) for e in index[at]]
                    part = index[at]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), head["file"], np.int64)), pa.array(at.astype(np.int64)),
                         pa.array(part["doc_id"].astype(np.int64), mask=part["null"] > 0), pa.array(before[at]),
                         pa.array([len(x) for x in ids], pa.int64()),
                         pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()),
                         pa.array([x.astype(np.int64) for x in ids] if with_ids else [None] * len(at),
                                  pa.list_(pa.int64()))],
                        [f.split()[0] for f in READ.split(", ")])

    files = spark.read.format("binaryFile").load(f"{path}/data").select("content")
    return files.mapInArrow(run, READ)


def starts(found: DataFrame) -> DataFrame:
    """``read``'s rows (a stored table) with ``start``: the ids of all
    documents before each. One row per file goes into the running total."""
    totals = found.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    ahead = totals.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("ahead"))
    return found.join(ahead, "file").withColumn("start", F.col("ahead") + F.col("before"))


def document(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """Ids of the documents with this id, without reading whole files: the
    indexes are searched and only the wanted frames are fetched."""
    import zstandard
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/data")
    fs = folder.getFileSystem(conf)
    raw = _shared_dictionary(spark, path)
    unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw)).decompress

    def fetch(stream, at: int, n: int) -> bytes:
        stream.seek(at)
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, n))

    out = []
    for status in sorted(fs.listStatus(folder), key=lambda s: s.getPath().getName()):
        size = status.getLen()
        if not status.getPath().getName().startswith("part-") or not size:
            continue
        stream = fs.open(status.getPath())
        try:
            head = np.frombuffer(fetch(stream, 0, HEAD.itemsize), HEAD)[0]
            if head["dictionary"].tobytes() != hashlib.sha256(raw).digest():
                raise ValueError("the file was written with another dictionary")
            tail = np.frombuffer(fetch(stream, size - 1 - TAIL.itemsize, TAIL.itemsize), TAIL)[0]
            at, n = int(tail["index"]), int(tail["documents"])

            def entry(i: int):
                return np.frombuffer(fetch(stream, at + i * INDEX.itemsize, INDEX.itemsize), INDEX)[0]

            def key(e) -> tuple:
                return (not e["null"], int(e["doc_id"]))

            low, high = 0, n
            while low < high:
                middle = (low + high) // 2
                low, high = (middle + 1, high) if key(entry(middle)) < (True, doc_id) else (low, middle)
            while low < n and key(e := entry(low)) == (True, doc_id):
                frame = {"offset": 0, **{f: e[f] for f in ("size", "n_tokens", "crc32")}}
                out.append(_ids(fetch(stream, int(e["offset"]), int(e["size"])), frame, int(head["width"]), unpack).tolist())
                low += 1
        finally:
            stream.close()
    return out
