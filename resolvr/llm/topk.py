"""Exact top-k inner products with the threshold algorithm.

Rows and queries are cut into blocks of bounded size; a task gets one block of
each, sorts the rows once per dimension, and walks the sorted lists for each
query from the end that its sign asks for. Rows met on the way are scored in
full; the scores at the current depth bound every row not met yet, and the walk
ends when that bound cannot reach the k-th best score. Rows sorted by their
length are one more list: what is not met is no longer than its last row, which
bounds its score by the product of the lengths. The blocks' results are merged
with a grouped top-k.

How early a walk ends depends on the data: with a few telling dimensions or
lengths that differ it meets a small share of the rows, on unit vectors that
point everywhere (64 dimensions) it meets nearly all before the bounds close.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import persist_table

MAX_ROWS, MAX_QUERIES = 16_384, 2_048
#: Integers up to here are exact in float64 sums.
_EXACT = 1 << 53


def quantised(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", factor: float = 64.0) -> DataFrame:
    """``vec_id, v array<bigint>``: floor(factor * x) of each component.
    Rows without an id and vectors that are null or hold null or non-finite
    components are left out."""
    v = F.transform(F.col(f"`{vector_col}`"), lambda x: x.cast("double"))
    good = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < F.lit(math.inf)))  # a NaN is above infinity
    return table.select(F.col(f"`{id_col}`").cast("bigint").alias("vec_id"), v.alias("v")) \
        .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & good) \
        .withColumn("v", F.transform("v", lambda x: F.floor(x * factor).cast("bigint")))


class Lists:
    """The rows of a block by rising value, per dimension, and by falling
    length."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows
        self.order = np.argsort(rows, axis=0, kind="stable").T.copy()
        self.length = np.sqrt((rows.astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-9)  # never below the true one
        self.by_length = np.argsort(-self.length, kind="stable")


def threshold_search(lists: Lists, ids: np.ndarray, keys: np.ndarray, q: np.ndarray, own: int, k: int):
    """The k best (score, id) of the rows for ``q``, without the row whose
    key is ``own``: best score first, then the smaller id. And how many rows
    were scored."""
    rows, order = lists.rows, lists.order
    n, used = len(rows), np.flatnonzero(q)
    seen, other = np.zeros(n, bool), keys != own
    score = np.zeros(n, rows.dtype)
    up = q[used] > 0
    long = float(np.sqrt((q.astype(np.float64) ** 2).sum())) * (1 + 1e-9)
    depth, kth = 0, None
    while depth < n:
        step = max(8, n // 64) if depth == 0 else depth
        to = min(n, depth + step)
        met = np.zeros(n, bool)
        met[lists.by_length[depth:to]] = True
        if len(used):
            met[np.where(up[:, None], order[used, n - to:n - depth], order[used, depth:to])] = True
        new = np.flatnonzero(met & ~seen)
        score[new] = rows[new] @ q
        seen[new] = True
        depth = to
        got = np.flatnonzero(seen & other)
        if len(got) >= k:
            kth = np.partition(score[got], len(got) - k)[len(got) - k]
            edge = np.where(up, order[used, n - to], order[used, to - 1])
            # an unseen row may equal the bound, and win by its id: go on until the bound is below
            if min((rows[edge, used] * q[used]).sum(), long * lists.length[lists.by_length[to - 1]]) < kth or seen.all():
                break
    got = np.flatnonzero(seen & other)
    if kth is not None:
        got = got[score[got] >= kth]
    best = got[np.lexsort((keys[got], ids[got], -score[got]))][:k]
    return [(int(score[i]), int(ids[i]), int(keys[i])) for i in best], int(seen.sum())


def _largest(x: np.ndarray) -> int:
    return max(abs(int(x.max())), abs(int(x.min())))


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    v = table["v"].combine_chunks()
    return table["vec_id"].to_numpy(), table["_row"].to_numpy(), v.flatten().to_numpy(zero_copy_only=False).reshape(len(table), -1)


def top_k(table: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
          factor: float = 64.0, max_rows: int = MAX_ROWS, max_queries: int = MAX_QUERIES) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row for which ``is_query``
    (a function of the id column) holds, its ``k`` best other rows, all if
    there are fewer. Rows with a repeated id count each, as queries and as
    candidates; only the query's own row is none of its candidates. Equal
    scores go to the smaller id. Vectors are compared with vectors of their own
    length; other columns are not read. Empty tables give no rows."""
    vectors = persist_table(quantised(table, id_col, vector_col, factor).withColumn("dim", F.size("v"))
                            .withColumn("_row", F.monotonically_increasing_id()), "vectors")
    queries = vectors.where(is_query(F.col("vec_id")))
    slots = vectors.sparkSession.sparkContext.defaultParallelism
    n, m = vectors.count(), queries.count()
    # blocks of bounded size, and at least as many pairs of them as task slots
    row_blocks = max(math.ceil(n / max_rows), min(4, math.ceil(n / 512)))
    query_blocks = max(math.ceil(m / max_queries), min(math.ceil(2 * slots / max(1, row_blocks)), math.ceil(m / 64)), 1)
    block = lambda c, blocks: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    left = vectors.withColumn("rb", block("_row", row_blocks)) \
        .withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))).select("dim", "rb", "qb", "_row", "vec_id", "v")
    right = queries.withColumn("qb", block("_row", query_blocks)) \
        .withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1)))).select(
            *[F.col(c).alias(c) for c in ("dim", "rb", "qb", "_row", "vec_id", "v")])  # apart from the left side's ids

    def search(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        if len(rows) and len(asked) and asked["v"].combine_chunks().flatten():
            ids, keys, x = _matrix(rows)
            qids, qkeys, q = _matrix(asked)
            worst = _largest(x) * _largest(q) * x.shape[1]
            if worst < _EXACT:
                x, q = x.astype(np.float64), q.astype(np.float64)
            elif worst >= 1 << 63:
                raise OverflowError("a score does not fit 64 bits")
            lists = Lists(x)
            for qid, qkey, qv in zip(qids.tolist(), qkeys.tolist(), q):
                out += [(qkey, qid, i, s, key) for s, i, key in threshold_search(lists, ids, keys, qv, qkey, k)[0]]
        cols = list(zip(*out)) or [()] * 5
        return pa.table({f.split()[0]: pa.array(v, pa.int64()) for f, v in zip(found.split(", "), cols)})

    found = "query_row bigint, query_id bigint, vec_id bigint, score bigint, hit bigint"
    by = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "hit")
    return left.groupBy("dim", "rb", "qb").cogroup(right.groupBy("dim", "rb", "qb")).applyInArrow(search, found) \
        .withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
