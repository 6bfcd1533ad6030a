"""Hard negatives from Hilbert-ordered blocks with zone maps.

All rows are ordered along a Hilbert curve through their components and written
as Parquet blocks of at most ``block_rows`` rows, one block a Parquet row: its
vectors as one small-integer matrix beside a zone map, the least and greatest
value of each dimension and the labels in it. Anchors are cut into blocks along
the same curve.

A search asks, for windows of scores per anchor, for the best rows in each
window. It first reads the block that each anchor itself lies in, which gives a
lower bound of each window's k-th score. Interval arithmetic over the zone maps
then bounds the inner products that a block can hold, and a block is read for a
block of anchors if a window of one of them may still gain from it. Positives
are one such search (a window without ends, rows of the same label), their score
windows are the next (rows of other labels). Bounds and scores are integers, so
no block is skipped wrongly.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import persist_table

BLOCK_ROWS, ANCHOR_ROWS, PAGE = 1024, 256, 256
_EXACT = 1 << 53
_END = 1 << 62
BLOCK = "block bigint, dim int, own_rows array<bigint>, ids binary, rows binary, labels binary, width int, v binary, " \
        "lo array<bigint>, hi array<bigint>, kinds array<bigint>"
_TYPES = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}
_SCHEMA = pa.schema([(f.split()[0], _TYPES[f.split()[1]]) for f in BLOCK.split(", ")])
FOUND = "arow bigint, wkey bigint, score bigint, id bigint, hit bigint"


def points(table: DataFrame, is_anchor, label: Column, id_col: str = "vec_id", vector_col: str = "embedding",
           factor: float = 256.0) -> DataFrame:
    """``_row, id, label, anchor, dim, v``: the rows that take part, each
    component as floor(factor * x)."""
    v = F.transform(F.col(f"`{vector_col}`"), lambda x: x.cast("double"))
    good = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < F.lit(math.inf)))  # a NaN is above infinity
    rows = table.select(F.monotonically_increasing_id().alias("_row"), F.col(f"`{id_col}`").cast("bigint").alias("id"),
                        label.cast("bigint").alias("label"), v.alias("v")) \
        .where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & good)
    return rows.select("_row", "id", "label", F.coalesce(is_anchor(F.col("id")), F.lit(False)).alias("anchor"),
                       F.size("v").alias("dim"), F.transform("v", lambda x: F.floor(x * factor).cast("bigint")).alias("v"))


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Keys (rows of bytes, in lexical order) of integer points of ``bits``
    bits a dimension along the Hilbert curve, by Skilling's transform."""
    x = cells.astype(np.int64).T.copy()
    for q in (1 << k for k in range(bits - 1, 0, -1)):
        for i in range(len(x)):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(high, q - 1, swap)
            x[i] ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.int64)
    for q in (1 << k for k in range(bits - 1, 0, -1)):
        turn ^= np.where((x[-1] & q) > 0, q - 1, 0)
    x ^= turn
    planes = (x[None] >> np.arange(bits - 1, -1, -1)[:, None, None]) & 1  # bit, dimension, point
    return np.packbits(planes.reshape(-1, x.shape[1]).T.astype(bool), axis=1)


def with_key(rows: DataFrame) -> DataFrame:
    """``points`` with the Hilbert key of each in ``curve``. The grid spans
    all components of the table, with up to 128 bits a key."""
    least, most = rows.agg(F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    span = max(1, (most or 0) - (least or 0))

    def run(batches):
        for batch in batches:
            keys = np.empty(len(batch), object)
            dims = batch["dim"].to_numpy()
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                if not dim:
                    keys[at] = b""
                    continue
                bits = max(1, min(8, 128 // dim))
                v = batch["v"].take(pa.array(at)).flatten().to_numpy().reshape(-1, dim)
                cells = np.minimum(((v - float(least)) / span * (1 << bits)).astype(np.int64), (1 << bits) - 1)
                for i, key in zip(at, hilbert(cells, bits)):
                    keys[i] = key.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys.tolist(), pa.binary())],
                                             [*batch.schema.names, "curve"])

    types = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    return rows.mapInArrow(run, f"{types}, curve binary")


def _small(v: np.ndarray) -> np.ndarray:
    """The narrowest integers that hold all values."""
    for width in (1, 2, 4):
        if not v.size or -(1 << 8 * width - 1) <= v.min() and v.max() < 1 << 8 * width - 1:
            return v.astype(f"<i{width}")
    return v.astype("<i8")


def blocks_of(rows: DataFrame, parts: int, size: int | None) -> DataFrame:
    """Blocks (``BLOCK``) of ``rows`` along the curve, at most ``size`` rows
    each; without ``size`` one per partition and dimension, numbered by the
    partition. Parquet, in the shared folder."""
    def run(batches):
        from pyspark import TaskContext
        part, n, held, dim = TaskContext.get().partitionId(), 0, [], None

        def block():
            t = pa.Table.from_batches(held)
            v = _small(t["v"].combine_chunks().flatten().to_numpy().reshape(len(t), dim))
            labels = t["label"].to_numpy()
            return pa.RecordBatch.from_pylist([{
                "block": part << 32 | n if size else part, "dim": dim,
                "own_rows": t["_row"].filter(t["anchor"]).to_pylist(), "ids": t["id"].to_numpy().tobytes(),
                "rows": t["_row"].to_numpy().tobytes(), "labels": labels.tobytes(), "width": v.itemsize, "v": v.tobytes(),
                "lo": v.min(axis=0).tolist(), "hi": v.max(axis=0).tolist(), "kinds": np.unique(labels).tolist()}], _SCHEMA)

        for batch in batches:
            at, dims = 0, batch["dim"].to_numpy()
            while at < len(batch):
                if held and (dims[at] != dim or size and sum(map(len, held)) >= size):
                    yield block()
                    n, held = n + 1, []
                dim = int(dims[at])
                same = np.flatnonzero(dims[at:] != dim)
                end = at + int(same[0]) if len(same) else len(batch)
                if size:
                    end = min(end, at + size - sum(map(len, held)))
                held.append(batch.slice(at, end - at))
                at = end
        if held:
            yield block()

    by = ["dim", "curve", "_row"]
    return persist_table(rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).mapInArrow(run, BLOCK), "blocks")


def _apart(df: DataFrame) -> DataFrame:
    """The same rows under column ids of their own, for a cogroup of two
    tables with a common ancestor."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def _matrix(row: dict) -> np.ndarray:
    return np.frombuffer(row["v"], f"<i{row['width']}").reshape(len(row["rows"]) // 8, row["dim"])


def _exact(a: np.ndarray, *others: np.ndarray) -> list[np.ndarray]:
    """The matrices as float64 where all sums are exact in it, else int64."""
    worst = max((int(np.abs(x.astype(np.int64)).max(initial=0)) for x in others), default=0) \
        * int(np.abs(a.astype(np.int64)).max(initial=0)) * a.shape[1]
    if 100 * worst >= 1 << 63:
        raise OverflowError("a score does not fit 64 bits")
    return [x.astype(np.float64 if worst < _EXACT else np.int64) for x in (a, *others)]


class Searcher:
    """Rows and anchors in blocks, and searches over them."""

    def __init__(self, rows: DataFrame, block_rows: int = BLOCK_ROWS, anchor_rows: int = ANCHOR_ROWS):
        rows = persist_table(with_key(rows), "points")
        n, m = rows.agg(F.count("*"), F.count_if("anchor")).first()
        slots = rows.sparkSession.sparkContext.defaultParallelism
        self.blocks = blocks_of(rows, max(1, min(-(-n // block_rows), max(slots, n // (8 * block_rows)))), block_rows)
        self.anchors = blocks_of(rows.where("anchor"), max(1, -(-m // anchor_rows)), None).withColumnRenamed("block", "ablock")
        self.parts = (self.anchors.agg(F.max("ablock")).first()[0] or 0) + 1
        self.pages = 1 + self.blocks.count() // PAGE
        self.ids = rows.where("anchor").select(F.col("_row").alias("arow"), F.col("id").alias("anchor_id"))
        self.place = self.anchors.select("ablock", "dim", F.explode("own_rows").alias("arow"))

    def windows(self) -> DataFrame:
        """A window without ends for each anchor."""
        return self.place.select("ablock", "dim", "arow", F.lit(-1).cast("bigint").alias("wkey"),
                                 F.lit(-_END).alias("low"), F.lit(_END).alias("high"))

    def search(self, windows: DataFrame, same: bool, k: int) -> DataFrame:
        """``FOUND`` and ``rank``: the ``k`` best rows of each window (``ablock,
        dim, arow, wkey, low, high``; a stored table) by score, then the smaller
        id: rows of the anchor's own label but itself, or of other labels."""
        own = self.blocks.select("block", "dim", F.explode("own_rows").alias("arow")) \
            .join(windows.select("arow", "ablock").distinct(), "arow").select("ablock", "block", "dim").distinct()
        first = self._best(self._score(own, self._asked(windows), same, k), k)
        kth = first.where(F.col("rank") == k).select("arow", "wkey", F.col("score").alias("kth"))
        closer = persist_table(windows.join(kth, ["arow", "wkey"], "left")
                               .withColumn("low", F.greatest("low", "kth")).drop("kth"), "windows")
        asked = self._asked(closer)
        self.pairs = persist_table(self._select(asked, same), "chosen")
        return self._best(self._score(self.pairs, asked, same, k), k)

    def _asked(self, windows: DataFrame) -> DataFrame:
        """Anchor blocks with their windows: a bounded list, as the blocks
        are and each anchor has a few windows."""
        lists = windows.groupBy("ablock", "dim").agg(
            *[F.collect_list(F.struct("arow", "wkey", "low", "high")).getField(c).alias(f"w_{c}")
              for c in ("arow", "wkey", "low", "high")])
        return self.anchors.join(lists, ["ablock", "dim"])

    def _select(self, asked: DataFrame, same: bool) -> DataFrame:
        """``ablock, block, dim`` of the blocks that windows must read. Zone
        maps meet anchor blocks page by page."""
        zones = self.blocks.select("block", "dim", "lo", "hi", "kinds", F.pmod(F.hash("block"), F.lit(self.pages)).alias("page")) \
            .withColumn("ablock", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(self.parts - 1).cast("bigint"))))
        ask = asked.select("ablock", "dim", "rows", "labels", "width", "v", "w_arow", "w_low", "w_high",
                           F.explode(F.sequence(F.lit(0), F.lit(self.pages - 1))).alias("page"))
        key = ["ablock", "dim", "page"]

        def choose(zone: pa.Table, ask: pa.Table) -> pa.Table:
            out = []
            if len(zone) and len(ask):
                ask = ask.to_pylist()[0]
                lo, hi = (np.array(zone[c].to_pylist(), np.int64).reshape(len(zone), ask["dim"]) for c in ("lo", "hi"))
                a, lo, hi = _exact(_matrix(ask), lo, hi)
                up, down = np.maximum(a, 0), np.minimum(a, 0)
                most, least = up @ hi.T + down @ lo.T, up @ lo.T + down @ hi.T
                kinds = [set(x) for x in zone["kinds"].to_pylist()]
                labels = np.frombuffer(ask["labels"], np.int64)
                has = {x: np.array([x in s if same else s != {x} for s in kinds]) for x in set(labels.tolist())}
                at = {r: i for i, r in enumerate(np.frombuffer(ask["rows"], np.int64).tolist())}
                i = np.array([at[r] for r in ask["w_arow"]])
                low, high = np.array(ask["w_low"])[:, None], np.array(ask["w_high"])[:, None]
                may = (most[i] >= low) & (least[i] <= high) & np.array([has[x] for x in labels[i].tolist()])
                out = zone["block"].filter(pa.array(may.any(axis=0))).to_pylist()
                return pa.table({"ablock": pa.array([ask["ablock"]] * len(out), pa.int64()), "block": pa.array(out, pa.int64()),
                                 "dim": pa.array([ask["dim"]] * len(out), pa.int32())})
            return pa.table({"ablock": pa.array([], pa.int64()), "block": pa.array([], pa.int64()), "dim": pa.array([], pa.int32())})

        return zones.groupBy(*key).cogroup(_apart(ask).groupBy(*key)).applyInArrow(choose, "ablock bigint, block bigint, dim int")

    def _score(self, pairs: DataFrame, asked: DataFrame, same: bool, k: int) -> DataFrame:
        """The ``k`` best of each window in each pair of blocks."""
        key = ["ablock", "dim", "block"]
        left = pairs.join(self.blocks.select("block", "dim", "ids", "rows", "labels", "width", "v"), ["block", "dim"])
        right = pairs.join(asked.drop("own_rows", "ids", "lo", "hi", "kinds"), ["ablock", "dim"])

        def score(rows: pa.Table, ask: pa.Table) -> pa.Table:
            out = []
            if len(rows) and len(ask):
                rows, ask = rows.to_pylist()[0], ask.to_pylist()[0]
                a, x = _exact(_matrix(ask), _matrix(rows))
                s = (a @ x.T).astype(np.int64)
                ids, keys, labels = (np.frombuffer(rows[c], np.int64) for c in ("ids", "rows", "labels"))
                own = np.frombuffer(ask["labels"], np.int64)
                at = {r: i for i, r in enumerate(np.frombuffer(ask["rows"], np.int64).tolist())}
                for arow, wkey, low, high in zip(ask["w_arow"], ask["w_wkey"], ask["w_low"], ask["w_high"]):
                    i = at[arow]
                    fit = (s[i] >= low) & (s[i] <= high) & ((labels == own[i]) == same) & (keys != arow)
                    fit = np.flatnonzero(fit)
                    if len(fit) > k:  # all of the k-th score, as ties go by id
                        fit = fit[s[i, fit] >= np.partition(s[i, fit], len(fit) - k)[len(fit) - k]]
                    best = fit[np.lexsort((keys[fit], ids[fit], -s[i, fit]))][:k]
                    out += [(arow, wkey, int(s[i, j]), int(ids[j]), int(keys[j])) for j in best]
            cols = list(zip(*out)) or [()] * 5
            return pa.table({f.split()[0]: pa.array(c, pa.int64()) for f, c in zip(FOUND.split(", "), cols)})

        return left.groupBy(*key).cogroup(_apart(right).groupBy(*key)).applyInArrow(score, FOUND)

    @staticmethod
    def _best(found: DataFrame, k: int) -> DataFrame:
        by = Window.partitionBy("arow", "wkey").orderBy(F.desc("score"), "id", "hit")
        return persist_table(found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k), "best")


def hard_negatives(table: DataFrame, is_anchor, label: Column, positives: int = 5, negatives: int = 5, low: int = 80,
                   high: int = 100, id_col: str = "vec_id", vector_col: str = "embedding", factor: float = 256.0,
                   block_rows: int = BLOCK_ROWS, anchor_rows: int = ANCHOR_ROWS) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score``: for each row of ``table`` for which
    ``is_anchor`` (a function of the id column) holds, its ``positives`` best other
    rows of the same ``label``; for each of these the ``negatives`` best rows of
    other labels with ``low * p <= 100 * s <= high * p`` (scores ``p`` of the
    positive and ``s``). All, if there are fewer; equal scores go to the smaller
    id.

    Rows with a null id or label, a null vector or a null or non-finite
    component take no part. Rows with a repeated id count each, as anchors, too;
    vectors meet vectors of their own length; other columns are not read. Tables
    without anchors give no rows. Scores of 57 bits or more raise
    OverflowError."""
    s = Searcher(points(table, is_anchor, label, id_col, vector_col, factor), block_rows, anchor_rows)
    found = s.search(persist_table(s.windows(), "windows"), True, positives).select(
        "arow", F.col("hit").alias("wkey"), F.col("id").alias("positive_id"), F.col("score").alias("p"))
    windows = found.join(s.place, "arow").select(  # integer floor and ceiling
        "ablock", "dim", "arow", "wkey", F.expr(f"(p * {low} + pmod(-(p * {low}), 100)) div 100").alias("low"),
        F.expr(f"(p * {high} - pmod(p * {high}, 100)) div 100").alias("high"))
    worst = s.search(persist_table(windows.where("low <= high"), "windows"), False, negatives)
    return worst.join(found, ["arow", "wkey"]).join(s.ids, "arow").select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), F.col("p").alias("positive_score"),
        F.col("score").alias("negative_score"))
