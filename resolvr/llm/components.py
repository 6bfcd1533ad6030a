"""Connected components of an edge table by alternating large and small
stars. Every round is grouped minima and joins; the edge table of each round
is written to the shared folder, so lineage stays short and a lost executor
costs one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import persist_table


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: each node sends its larger neighbours to the smallest node
    it knows. Small star: it sends its smaller neighbours and itself there."""
    if large:
        near = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = near.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")),
                                              F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")) \
            .select("e.a", "e.b")
    return out.where("a <> b").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``node, root`` (bigint) for every node of an edge that is not its
    root; the root is the smallest node of the component. Self-loops, nulls
    and repeated edges are ignored; no edges give no rows. Raises if the
    stars have not settled after ``max_rounds`` (they need about the
    logarithm of the longest path)."""
    now = persist_table(edges.select(F.col(a).cast("bigint").alias("a"), F.col(b).cast("bigint").alias("b"))
                        .where("a <> b").distinct(), "edges")

    def state(df):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    before = state(now)
    if not before[0]:
        return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for _ in range(max_rounds):
        now = persist_table(_star(_star(now, True), False), "edges")
        after = state(now)
        if after == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = after
    raise RuntimeError(f"components not settled after {max_rounds} rounds")
