"""Exact cuts of a table by position, without sorting or ranking it.

A split by time or a seeded sample needs a few order statistics, not every
row's rank. The values at the cut positions are found by the distributed
selection of ``quantile.py``; rows on either side are told by comparison.
Only where rows with the same value lie on both sides of a cut are those rows
ranked (by the full order), so a table is never shuffled as a whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantile import select_ranks
from .rank import global_rank


def label_by_position(df: DataFrame, value: Column, orders: list[Column], cuts: list[int],
                      labels: list[str], out: str, n: int | None = None) -> DataFrame:
    """Add ``out``: ``labels[i]`` for a row whose 1-based position lies behind
    ``i`` of the ``cuts`` (ascending numbers of rows).

    ``value`` is a double that never falls along ``orders`` (the total order
    of the positions); null values come last. ``df`` must be stable
    (row-wise expressions over a stored table), as it is read more than once.
    Rows equal in every column of ``orders`` may take each other's places. ``n`` is
    the number of rows where it is known. An empty table gives no rows."""
    x = F.coalesce(value.cast("double"), F.lit(float("1e300")))
    rows = df.select(x.alias("_x"))
    n = rows.count() if n is None else n
    inner = sorted({c for c in cuts if 0 < c < n})
    at = dict(zip(inner, select_ranks(rows, [c - 1 for c in inner]))) if inner else {}
    values = sorted(set(at.values()))
    counts = rows.agg(*[e for v in values for e in (F.count_if(F.col("_x") < v), F.count_if(F.col("_x") == v))]
                      ).first() if values else ()
    below = {v: counts[2 * i] for i, v in enumerate(values)}
    ties = {v: counts[2 * i + 1] for i, v in enumerate(values)}
    split = sorted({v for c, v in at.items() if below[v] + ties[v] != c})

    def behind(c: int) -> Column:
        return F.lit(c <= 0) if c not in at else x > at[c]

    def pick(passed: list[Column]) -> Column:
        e = F.lit(labels[0])
        for label, p in zip(labels[1:], passed):
            e = F.when(p, F.lit(label)).otherwise(e)
        return e

    apart = df.where(~x.isin(split)) if split else df
    parts = [apart.withColumn(out, pick([behind(c) for c in cuts]))]
    if split:
        # all tied rows are ranked at once: their values are apart, and how many lie before each is known
        tied, at_value, before = global_rank(df.where(x.isin(split)), [x.asc(), *orders], "_pos"), F.lit(None).cast("long"), 0
        for v in split:
            at_value = F.when(x == v, F.col("_pos") + F.lit(below[v] - before)).otherwise(at_value)
            before += ties[v]
        tied = tied.withColumn("_pos", at_value)
        parts.append(tied.withColumn(out, pick([F.col("_pos") > c for c in cuts])).drop("_pos"))
    return reduce(lambda a, b: a.unionByName(b), parts)
