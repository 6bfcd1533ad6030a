"""Exact quantiles (linear interpolation, as pandas ``quantile`` and SQL
``quantile_cont``) that scale, globally or per group.

``percentile()`` / ``median()`` keep a value -> count map, and the final
merge of a global (or a hot group's) aggregate happens in one task; the
sketches of ``percentile_approx`` are smaller but still all meet in that one
task. Here the order statistics are found by a distributed selection:

* Each target is one order statistic (group, quantile, lower/upper rank r)
  with a state: a closed value interval [lo, hi] known to hold it, the
  number ``off`` of the group's rows below lo, and the number ``cnt`` of
  rows inside. It starts as [min, max], off = 0.
* While a target's interval holds more than ``final_rows`` rows, one pass
  over the rows inside the intervals builds an equal-width histogram of
  ``buckets`` bins per target (a grouped count with partial aggregation, so
  a hot value costs one row per task) that also records each bin's min and
  max. The bin holding rank r becomes the new interval [bin min, bin max]:
  the bin function is monotone, so exactly the rows of that bin lie in it.
* The last pass groups the rows inside each interval by value and reads
  the order statistic off the cumulative counts (at most ``final_rows``
  rows per target).

Every pass is a distributed aggregate over the narrow (group, value)
projection, written once to the shared checkpoint folder so that all passes
see the same values. Per group, the target state (targets x a few numbers)
is written there between passes; the global case has only 2 x quantiles
targets, so their state stays on the driver as scalars and each pass
returns at most ``buckets`` rows per target.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import persist_table


def _attach_literal(rows: DataFrame, ts: list[tuple]) -> DataFrame:
    """Rows inside the intervals of a few global targets ``(_t, lo, hi,
    need)`` given as scalars: each row picks the targets holding it from a
    literal array (no join)."""
    if not ts:
        return rows.where(F.lit(False)).select(
            "_x", F.lit(0).cast("long").alias("_t"), F.lit(0.0).alias("lo"), F.lit(0.0).alias("hi"),
            F.lit(0).cast("long").alias("need"))
    arr = F.array(*[F.struct(F.lit(int(t)).cast("long").alias("_t"), F.lit(float(lo)).alias("lo"),
                             F.lit(float(hi)).alias("hi"), F.lit(int(need)).cast("long").alias("need"))
                    for t, lo, hi, need in ts])
    hit = F.filter(arr, lambda s: F.col("_x").between(s["lo"], s["hi"]))
    return rows.select("_x", F.explode(hit).alias("_s")).select("_x", "_s._t", "_s.lo", "_s.hi", "_s.need")


def _attach(rows: DataFrame, targets: DataFrame, by: list[str]) -> DataFrame:
    """Rows of each group inside their targets' intervals (equi-join on the
    group keys)."""
    j = rows.join(targets, on=by, how="inner")
    return j.where(F.col("_x").between(F.col("lo"), F.col("hi")))


def _level(rows: DataFrame, targets: DataFrame, by: list[str], buckets: int) -> DataFrame:
    """One histogram pass: narrow each active target to one bin."""
    j = _attach(rows, targets, by)
    width = F.col("hi") - F.col("lo")
    b = F.least(F.floor((F.col("_x") - F.col("lo")) / width * F.lit(buckets)), F.lit(buckets - 1))
    h = j.groupBy("_t", b.alias("_b")).agg(F.count(F.lit(1)).alias("c"), F.min("_x").alias("bmin"),
                                          F.max("_x").alias("bmax"))
    w = Window.partitionBy("_t").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    h = h.withColumn("before", F.coalesce(F.sum("c").over(w), F.lit(0)))
    t = targets.select("_t", "r", "off")
    pick = (h.join(t, "_t")
             .where((F.col("off") + F.col("before") <= F.col("r")) &
                    (F.col("r") < F.col("off") + F.col("before") + F.col("c"))))
    return pick.select("_t", F.col("bmin").alias("lo"), F.col("bmax").alias("hi"),
                       (F.col("off") + F.col("before")).alias("off"), F.col("c").alias("cnt"))


def _finish(rows: DataFrame, targets: DataFrame, by: list[str]) -> DataFrame:
    """Value-grouped pass: (_t, value) for each remaining target."""
    j = _attach(rows, targets, by)
    g = j.groupBy("_t", "_x").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("_t").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    g = g.withColumn("cum", F.sum("c").over(w)).join(targets.select("_t", "r", "off"), "_t")
    return (g.where(F.col("off") + F.col("cum") > F.col("r"))
             .groupBy("_t").agg(F.min("_x").alias("value")))


def exact_quantiles(df: DataFrame, col: str, qs: list[float], by: list[str] | None = None,
                    buckets: int = 4096, final_rows: int = 1_000_000, max_levels: int = 64,
                    stable: bool = False) -> DataFrame:
    """Long table (by..., q, value): exact q-quantiles of ``col`` (nulls and
    NaN left out) per group (groups without values are absent).

    The passes must see identical values. A recomputed aggregate can differ
    in the last bit, so the narrow (group, value) projection is written once,
    unless the caller states that ``df`` is ``stable`` (row-wise expressions
    over a stored table)."""
    by = list(by or [])
    rows = df.select(*by, F.col(col).cast("double").alias("_x")).where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    if not stable:
        rows = persist_table(rows, "quantile_rows")
    if not by:
        return _global_quantiles(rows, qs, buckets, final_rows, max_levels)
    stats = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("_x").alias("mn"),
                                  F.max("_x").alias("mx"))
    specs = []
    for j, q in enumerate(qs):
        pos = F.lit(float(q)) * (F.col("n") - 1)
        k0 = F.floor(pos)
        for side, r in ((0, k0), (1, F.least(k0 + 1, F.col("n") - 1))):
            specs.append(F.struct(F.lit(j).alias("j"), F.lit(side).alias("side"), r.alias("r"),
                                  (pos - k0).alias("frac")))
    targets = (stats.select(*by, "n", "mn", "mx", F.explode(F.array(*specs)).alias("s"))
                    .select(*by, "n", "s.*", F.col("mn").alias("lo"), F.col("mx").alias("hi"),
                            F.lit(0).cast("long").alias("off"), F.col("n").alias("cnt"))
                    .withColumn("_t", F.monotonically_increasing_id()))
    targets = persist_table(targets, "quantile_targets")
    meta = targets.select("_t", *by, "j", "side", "frac")
    state = targets.select("_t", *by, "r", "lo", "hi", "off", "cnt")
    for _ in range(max_levels):
        active = state.where((F.col("cnt") > F.lit(final_rows)) & (F.col("lo") < F.col("hi")))
        if active.limit(1).count() == 0:
            break
        narrowed = _level(rows, active, by, buckets)
        nxt = (state.join(narrowed.withColumnsRenamed({"lo": "nlo", "hi": "nhi", "off": "noff", "cnt": "ncnt"}),
                          "_t", "left")
                    .select("_t", *by, "r",
                            F.coalesce("nlo", "lo").alias("lo"), F.coalesce("nhi", "hi").alias("hi"),
                            F.coalesce("noff", "off").alias("off"), F.coalesce("ncnt", "cnt").alias("cnt")))
        state = persist_table(nxt, "quantile_state")
    # targets already narrowed to one value need no value pass
    single = state.where(F.col("lo") == F.col("hi")).select("_t", F.col("lo").alias("value"))
    rest = state.where(F.col("lo") < F.col("hi"))
    values = single.unionByName(_finish(rows, rest, by))
    v = values.join(meta, "_t")
    out = v.groupBy(*by, "j").agg(
        F.max(F.when(F.col("side") == 0, F.col("value"))).alias("v0"),
        F.max(F.when(F.col("side") == 1, F.col("value"))).alias("v1"),
        F.first("frac").alias("frac"))
    qmap = F.element_at(F.array(*[F.lit(float(q)) for q in qs]), F.col("j") + 1)
    value = F.col("v0") + (F.col("v1") - F.col("v0")) * F.col("frac")
    return out.select(*by, qmap.alias("q"), value.alias("value"))


def select_ranks(rows: DataFrame, ranks: list[int], buckets: int = 4096, final_rows: int = 1_000_000,
                 max_levels: int = 64) -> list[float]:
    """Values at the 0-based ``ranks`` of column ``_x`` (stable, no nulls or
    NaN). The same selection, with the state of these few targets kept on the
    driver as scalars (no state tables between passes). Each histogram pass
    returns at most ``buckets`` rows per target."""
    st = rows.agg(F.count(F.lit(1)).alias("n"), F.min("_x").alias("mn"), F.max("_x").alias("mx")).first()
    targets = [{"r": r, "lo": st["mn"], "hi": st["mx"], "off": 0, "cnt": st["n"]} for r in ranks]
    wide = lambda: [i for i, t in enumerate(targets) if t["cnt"] > final_rows and t["lo"] < t["hi"]]
    for _ in range(max_levels):
        active = wide()
        if not active:
            break
        j = _attach_literal(rows, [(i, targets[i]["lo"], targets[i]["hi"], 0) for i in active])
        width = F.col("hi") - F.col("lo")
        b = F.least(F.floor((F.col("_x") - F.col("lo")) / width * F.lit(buckets)), F.lit(buckets - 1))
        hist: dict[int, list] = {}
        for h in j.groupBy("_t", b.alias("_b")).agg(F.count(F.lit(1)).alias("c"), F.min("_x").alias("bmin"),
                                                    F.max("_x").alias("bmax")).collect():
            hist.setdefault(h["_t"], []).append(h)
        for i in active:
            t, before = targets[i], targets[i]["off"]
            for h in sorted(hist.get(i, []), key=lambda h: h["_b"]):
                if before <= t["r"] < before + h["c"]:
                    t.update(lo=h["bmin"], hi=h["bmax"], off=before, cnt=h["c"])
                    break
                before += h["c"]
    if wide():
        raise RuntimeError(f"order statistics not narrowed after {max_levels} passes")
    values = {i: t["lo"] for i, t in enumerate(targets) if t["lo"] == t["hi"]}
    rest = [(i, t["lo"], t["hi"], t["r"] - t["off"]) for i, t in enumerate(targets) if t["lo"] < t["hi"]]
    if rest:
        g = _attach_literal(rows, rest).groupBy("_t", "need", "_x").agg(F.count(F.lit(1)).alias("c"))
        w = Window.partitionBy("_t").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
        picked = (g.withColumn("cum", F.sum("c").over(w)).where(F.col("cum") > F.col("need"))
                   .groupBy("_t").agg(F.min("_x").alias("value")).collect())
        values.update({p["_t"]: p["value"] for p in picked})
    return [values[i] for i in range(len(targets))]


def _global_quantiles(rows: DataFrame, qs: list[float], buckets: int, final_rows: int,
                      max_levels: int) -> DataFrame:
    """Global case: 2 x quantiles ranks, interpolated on the driver."""
    n = rows.count()
    if not n:
        return rows.sparkSession.createDataFrame([], "q double, value double")
    places = [(float(q), float(q) * float(n - 1)) for q in qs]
    ranks = [r for _, pos in places for r in (math.floor(pos), min(math.floor(pos) + 1, n - 1))]
    v = select_ranks(rows, ranks, buckets, final_rows, max_levels)
    out = [(q, v[2 * i] + (v[2 * i + 1] - v[2 * i]) * (pos - math.floor(pos))) for i, (q, pos) in enumerate(places)]
    return rows.sparkSession.createDataFrame(out, "q double, value double")


def exact_quantile(df: DataFrame, col: str, q: float, **kw) -> float | None:
    """Scalar exact quantile of the non-null values of ``col``."""
    rows = exact_quantiles(df, col, [q], **kw).collect()
    return rows[0]["value"] if rows else None
