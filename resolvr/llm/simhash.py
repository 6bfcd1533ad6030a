"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints that differ in at most ``2 * h`` bits share a variant
that is at most ``h`` bit flips away from both; and all fingerprints that share
such a variant differ in at most ``2 * h`` bits pairwise, so a bucket needs no
pairs: linking each member to the one before it keeps every component.

A full ball (2,081 variants for h = 2) for every fingerprint would mostly hold
variants that nothing else reaches. One 32-bit half of a linked pair differs in
at most ``h`` bits, so the same meeting is first made on the halves (66 short
variants each). Half variants that two or three fingerprints share give their
pairs at once; for those that more share, the full variants with that half are
emitted. No link can be lost by this: a pair's meeting point has such a half by
construction.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import persist_table
from .common import as_bytes, cut, keyed
from .components import connected_components

SEED = 42
_CHUNK = 1 << 16


def fingerprint(text: bytes | None, shingle: int = 4) -> int:
    """Signed 64-bit fingerprint of a text's word shingles (A-Z lower-cased,
    words between ASCII white space); 0 without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    starts = ends - lens
    k = min(shingle, len(words))
    s, e = starts[:len(words) - k + 1].tolist(), ends[k - 1:].tolist()
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(s), _CHUNK):
        h = np.array([digest(joined[i:j], SEED) for i, j in zip(s[at:at + _CHUNK], e[at:at + _CHUNK])], np.uint64)
        ones += np.unpackbits(h.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(s), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
                 row_col: str | None = None) -> DataFrame:
    """``_row, doc_id, fp`` of every row of a stored table, no shuffle;
    ``_row`` is ``row_col``, or without one numbered in this scan."""
    def run(batches):
        for batch in cut(batches):
            fps = [fingerprint(t, shingle) for t in as_bytes(batch["text"])]
            yield pa.RecordBatch.from_arrays([batch["_row"], batch["doc_id"], pa.array(fps, pa.int64())],
                                             ["_row", "doc_id", "fp"])
    rows = keyed(docs, doc_id=id_col, text=text_col) if row_col is None else docs.select(
        *[F.col(f"`{old}`").alias(new) for new, old in (("_row", row_col), ("doc_id", id_col), ("text", text_col))])
    rows = rows.withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return rows.mapInArrow(run, "_row bigint, doc_id bigint, fp bigint")


def _masks(bits: int, radius: int) -> list[int]:
    return [sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(bits), r)]


def _low(fp):
    return fp.bitwiseAND(F.lit(0xFFFFFFFF))


def _high(fp):
    return F.shiftrightunsigned(fp, 32)


def links(fps: DataFrame, max_distance: int = 4) -> DataFrame:
    """Edges ``a, b`` between distinct fingerprints (column ``fp``) that keep
    every component of "differ in at most ``max_distance`` bits"."""
    if max_distance % 2 or not 2 <= max_distance <= 8:
        raise ValueError("max_distance must be 2, 4, 6 or 8")
    h = max_distance // 2
    near = (h + 1) // 2
    fp = F.col("fp")
    flip = F.explode(F.array(*[F.lit(m).cast("bigint") for m in _masks(32, near)])).alias("m")
    halves = fps.select("fp", F.explode(F.array(F.lit(0), F.lit(1))).alias("side")).select("fp", "side", flip).select(
        "fp", F.when(F.col("side") == 0, _low(fp)).otherwise(_high(fp)).bitwiseXOR(F.col("m"))
        .bitwiseOR(F.shiftleft(F.col("side").cast("bigint"), 32)).alias("half"))
    # ends and exclusive-or name all members of a bucket of two or three: they are compared as they are
    met = persist_table(halves.groupBy("half").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi"),
                                                   F.bit_xor("fp").alias("x"), F.count("*").alias("n"))
                        .where("n > 1"), "halves")
    third = F.col("x").bitwiseXOR(F.col("lo")).bitwiseXOR(F.col("hi"))
    pair = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    few = met.where("n <= 3").select(F.explode(
        F.when(F.col("n") == 2, F.array(pair(F.col("lo"), F.col("hi"))))
        .otherwise(F.array(pair(F.col("lo"), F.col("hi")), pair(F.col("lo"), third), pair(third, F.col("hi"))))).alias("p")) \
        .select("p.a", "p.b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_distance)
    # larger buckets meet on full variants; a sort-merge join, as either side grows with the corpus
    many = met.where("n > 3").select("half").hint("merge")
    on = halves.join(many, "half").select("fp", F.shiftrightunsigned("half", 32).alias("side"),
                                          _low(F.col("half")).alias("half"))
    # the join leaves a crowded bucket in one task; its members are dealt out before each grows into hundreds of rows
    on = on.repartition("fp", "side", "half")
    own, other = [F.when(F.col("side") == 0, x).otherwise(y) for x, y in
                  ((_low(fp), _high(fp)), (_high(fp), _low(fp)))]
    used = F.bit_count(own.bitwiseXOR(F.col("half")))
    spare = F.lit(None)
    for r in range(near + 1):
        spare = F.when(used == r, F.array(*[F.lit(m).cast("bigint") for m in _masks(32, h - r)])).otherwise(spare)
    full = on.select("fp", "side", "half", other.alias("other"), F.explode(spare).alias("m")).select(
        "fp", F.when(F.col("side") == 0, F.shiftleft(F.col("other").bitwiseXOR(F.col("m")), 32)
                     .bitwiseOR(F.col("half")))
        .otherwise(F.shiftleft(F.col("half"), 32).bitwiseOR(F.col("other").bitwiseXOR(F.col("m")))).alias("variant"))
    # at most 2,081 fingerprints (h = 2) are as near to one variant, so a bucket's window is bounded
    chain = full.withColumn("b", F.lag("fp").over(Window.partitionBy("variant").orderBy("fp"))) \
        .where("b is not null and b <> fp").select(fp.alias("a"), "b") \
        .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_distance)
    return few.union(chain).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
                    max_distance: int = 4, row_col: str | None = None) -> DataFrame:
    """Fingerprint and component of every row of a stored table.

    Returns ``doc_id, fingerprint, component_id, keep, row_key``:
    ``component_id`` is the smallest id reachable over links, ``keep`` marks
    one row of each component (its smallest id; of repeated rows the first).
    ``row_key`` is the stored key ``row_col`` (bigint, unique), by which the
    result can be joined to ``docs``; without one it only tells rows apart.
    Null and empty texts have fingerprint zero and are linked like any other;
    rows without an id take part and are kept only where no member has one
    (``component_id`` is null then). Exact copies share a fingerprint, so
    links are made between distinct fingerprints only. An empty table gives
    no rows.
    """
    fps = persist_table(fingerprints(docs, id_col, text_col, shingle, row_col), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("_row"))).alias("first")
    distinct = persist_table(fps.groupBy("fp").agg(first), "distinct-fingerprints")
    roots = connected_components(links(distinct.select("fp"), max_distance))
    member = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left") \
        .select("fp", "first", F.coalesce("root", "fp").alias("root"))
    # min() over a struct needs its own fields: the smallest row of all members
    best = member.groupBy("root").agg(F.min("first").alias("best"))
    table = member.join(best, "root").select("fp", "best")
    return fps.join(table, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("best.doc_id").alias("component_id"), (F.col("_row") == F.col("best._row")).alias("keep"),
        F.col("_row").alias("row_key"))
