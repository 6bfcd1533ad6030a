"""Feature attribution as a Spark job.

Monte-Carlo Shapley values (Strumbelj and Kononenko): for each explained
row x and each of P seeded permutations, a background row z is drawn from a
small fixed-size background sample (broadcast, size bounded by its
parameter), and the F+1 coalition instances (first s features of the
permutation from x, the rest from z, s = 0..F) are scored. The difference of adjacent
coalitions is the marginal contribution of the feature that entered; its
mean over permutations is the attribution. Work = rows x P x (F+1)
predictions, spread over all tasks. A model that scores arrays does so where the row
is: no coalition leaves its task, nothing is shuffled, and a row with its attributions
is stored once. Other models score the exploded frame in one ``model.transform``. In every permutation the differences telescope to f(x) - f(z), so a
row's attributions sum to f(x) minus the mean of f(z) over its draws.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from .split import exact_sample


def shapley(model, rows: DataFrame, background: DataFrame, features: list[str],
            key: str = "SR_NUMBER", permutations: int = 8, background_size: int = 100,
            seed: int = 42, model_name: str = "model") -> DataFrame:
    """(key, model_name, feature, value, attribution) per explained row."""
    from ..session import persist_table
    nf = len(features)
    # a stored unique row id: the request key may repeat, and the ids must
    # not change between the branches that reuse them
    # (dealt evenly, as every row is scored permutations x (features + 1) times)
    slots = rows.sparkSession.sparkContext.defaultParallelism
    rows = persist_table(rows.select(key, *features).withColumn("_rid", F.monotonically_increasing_id())
                             .repartition(4 * slots), "shapley_rows")
    bg = exact_sample(background.select(key, *features), background_size, seed, key)
    if hasattr(model, "score"):
        return _long(_scored_in_place(model, rows, bg, features, key, permutations, seed), features, key, model_name)
    bg = bg.withColumn("_bg", F.row_number().over(Window.orderBy(key)) - 1)   # <= background_size rows
    bg = bg.select("_bg", *[F.col(f).alias(f"_z_{f}") for f in features])
    n_bg = bg.count()
    perm = rows.withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))))
    perm = perm.withColumn("_bg", F.pmod(F.xxhash64(key, "_rid", "_p", F.lit(seed)), F.lit(n_bg)))
    # permutation order: features sorted by a hash of (row, permutation, feature)
    order = F.array_sort(F.array(*[
        F.struct(F.xxhash64(F.col(key), F.col("_rid"), F.col("_p"), F.lit(i), F.lit(seed)).alias("h"),
                 F.lit(i).alias("f"))
        for i in range(nf)]))
    perm = perm.withColumn("_order", F.transform(order, lambda s: s["f"]))
    j = perm.join(F.broadcast(bg), "_bg")
    coal = j.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(nf))))
    # position of each feature inside the permutation decides x or z
    cols = {}
    for i, f in enumerate(features):
        pos = F.array_position(F.col("_order"), F.lit(i))  # 1-based
        cols[f"_in_{f}"] = F.when(pos <= F.col("_s"), F.col(f)).otherwise(F.col(f"_z_{f}")).cast("double")
    coal = coal.withColumns(cols)
    vec = VectorAssembler(inputCols=[f"_in_{f}" for f in features], outputCol="features",
                          handleInvalid="keep").transform(coal.select("_rid", "_p", "_s", "_order", *cols.keys()))
    scored = model.transform(vec).select("_rid", "_p", "_s", "_order", "prediction")
    # a score counts for the feature that entered last and against the one that enters next
    steps = scored.select("_rid", F.explode(F.array(
        F.struct(F.get("_order", F.col("_s") - 1).alias("_fi"), F.col("prediction").alias("_d")),
        F.struct(F.get("_order", F.col("_s")).alias("_fi"), (-F.col("prediction")).alias("_d")))).alias("_e"))
    att = (steps.select("_rid", "_e.*").where("_fi is not null")
                .groupBy("_rid", "_fi").agg((F.sum("_d") / F.lit(permutations)).alias("attribution")))
    names = F.element_at(F.array(*[F.lit(f) for f in features]), F.col("_fi") + 1)
    values = rows.select("_rid", key, F.explode(F.array(*[
        F.struct(F.lit(i).alias("_fi"), F.col(f).cast("double").alias("value")) for i, f in enumerate(features)
    ])).alias("v")).select("_rid", key, "v.*")
    return (att.join(values, ["_rid", "_fi"])
               .select(key, F.lit(model_name).alias("model_name"), names.alias("feature"), "value", "attribution"))


#: Coalitions that are scored at a time.
SCORED = 200_000


def _scored_in_place(model, rows: DataFrame, bg: DataFrame, features: list[str], key: str, permutations: int,
                     seed: int) -> DataFrame:
    """``rows`` (key, features) with ``_att``, the attribution of each feature, stored."""
    from ..session import importable, persist_table
    spark, nf = rows.sparkSession, len(features)
    importable(spark)
    # <= background_size rows
    z = np.array([[np.nan if v is None else float(v) for v in r[1:]] for r in bg.orderBy(key).select(key, *features).collect()])
    if not len(z):
        rows, z = rows.limit(0), np.zeros((1, nf))
    if hasattr(model, "for_rows"):
        model = model.for_rows(spark, rows.count() * permutations * (nf + 1))
    shared = spark.sparkContext.broadcast((model, z))

    def draw(*more):
        return F.xxhash64(F.col(key), F.col("_rid"), *[F.lit(x) for x in (*more, seed)])
    given = rows.select(
        key, *features, F.array(*[F.col(f).cast("double") for f in features]).alias("_x"),
        F.array(*[F.pmod(draw(p), F.lit(len(z))) for p in range(permutations)]).alias("_bg"),
        F.array(*[draw(p, i) for p in range(permutations) for i in range(nf)]).alias("_order"))
    own = [f for f in given.schema.fields if f.name in (key, *features)]

    def explained(batches):
        model, z = shared.value
        step = max(1, SCORED // (permutations * (nf + 1)))
        for batch in batches:
            for b in (batch.slice(a, step) for a in range(0, len(batch), step)):
                n = len(b)
                x = b["_x"].flatten().to_numpy(zero_copy_only=False).reshape(n, 1, nf)
                bg = b["_bg"].flatten().to_numpy(zero_copy_only=False).reshape(n, permutations)
                # permutation order: features sorted by a hash of (row, permutation, feature)
                order = np.argsort(b["_order"].flatten().to_numpy().reshape(n, permutations, nf), axis=2, kind="stable")
                place = np.argsort(order, axis=2)[:, :, None, :]
                # position of each feature inside the permutation decides x or z
                mixed = np.where(place < np.arange(nf + 1)[:, None], x[:, :, None, :], z[bg][:, :, None, :])
                got = model.score(mixed.reshape(-1, nf)).reshape(n, permutations, nf + 1)
                att = np.take_along_axis(np.diff(got, axis=2), place[:, :, 0, :], 2).sum(1) / permutations
                yield pa.RecordBatch.from_arrays([*[b[f.name] for f in own], pa.array(list(att), pa.list_(pa.float64()))],
                                                 [*[f.name for f in own], "_att"])
    kind = StructType([*own, StructField("_att", ArrayType(DoubleType()))])
    return persist_table(given.mapInArrow(explained, kind), "shapley")


def _long(rows: DataFrame, features: list[str], key: str, model_name: str) -> DataFrame:
    """A row per row and feature."""
    parts = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"),
                                         F.col("_att")[i].alias("attribution")) for i, f in enumerate(features)]))
    return rows.select(key, F.lit(model_name).alias("model_name"), parts.alias("_v")).select(key, "model_name", "_v.*")


def attribution_summary(att: DataFrame) -> DataFrame:
    """Mean absolute and mean signed attribution per feature."""
    return (att.groupBy("model_name", "feature")
               .agg(F.avg(F.abs("attribution")).alias("mean_abs_attribution"),
                    F.avg("attribution").alias("mean_attribution"))
               .orderBy(F.desc("mean_abs_attribution")))


def top_attributed(att: DataFrame, k: int = 3) -> DataFrame:
    """Top-k features by mean absolute attribution."""
    s = att.groupBy("model_name", "feature").agg(F.avg(F.abs("attribution")).alias("m"))
    w = Window.partitionBy("model_name").orderBy(F.desc("m"), "feature")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("m")


def dependence(att: DataFrame, k: int = 3) -> DataFrame:
    """(feature, value, attribution) rows of the top-k features."""
    top = top_attributed(att, k).select("model_name", "feature")
    return att.join(F.broadcast(top), ["model_name", "feature"])   # k rows per model


def first_rows_subset(ranked: DataFrame, n: int = 500, rank_col: str = "row_rank") -> DataFrame:
    """The reference's explanation subset: the first ``n`` rows in time
    order (W13). Optional; the attribution keys explain every row."""
    return ranked.where(F.col(rank_col) <= F.lit(n))


def permutation_importance(rows: DataFrame, predict, features: list[str], seeds: list[int],
                           key: str = "SR_NUMBER", target: str = "RESPONSE_TIME_DAYS") -> DataFrame:
    """``feature, mae, permuted_mae, importance, n_rows`` (M17): how much the mean absolute
    error grows when a feature's values go to other rows.

    Per seed the rows stand in a seeded hash order (by key, then every column),
    and each takes the feature of the row behind it, the last that of the first:
    no row keeps its own. The order is the range-partitioned global rank, the
    exchange one join on the position; nothing is collected. ``predict`` adds ``y_pred`` to rows
    of any values; ``permuted_mae`` is the mean over the seeds. One row keeps its
    values; an empty table gives no rows."""
    from ..session import persist_table
    from .rank import global_rank, sort_orders
    from .split import hash_order
    parts = [predict(rows).select(F.lit(None).cast("string").alias("feature"), F.lit(0).alias("seed"),
                                  F.abs(F.col(target) - F.col("y_pred")).alias("e"))]
    for seed in seeds:
        hashed = rows.withColumn("_h", hash_order(key, seed))
        ranked = persist_table(global_rank(hashed, sort_orders(["_h"], hashed), "_at"), "permuted")
        n = ranked.agg(F.max("_at")).scalar()
        donors = ranked.select(F.when(F.col("_at") == 1, n).otherwise(F.col("_at") - 1).alias("_at"),
                               *[F.col(f).alias(f"_other_{f}") for f in features])
        both = persist_table(ranked.join(donors, "_at"), "permuted")
        for f in features:
            mixed = both.withColumn(f, F.col(f"_other_{f}")).drop("_h", "_at", *[f"_other_{x}" for x in features])
            parts.append(predict(mixed).select(F.lit(f).alias("feature"), F.lit(seed).alias("seed"),
                                               F.abs(F.col(target) - F.col("y_pred")).alias("e")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    maes = persist_table(every.groupBy("feature", "seed").agg(F.avg("e").alias("m"), F.count("e").alias("n")), "permuted-mae")
    base = maes.where("feature is null")
    mae, n_rows = base.agg(F.max("m")).scalar(), base.agg(F.max("n")).scalar()
    mixed = maes.where("feature is not null").groupBy("feature").agg(F.avg("m").alias("permuted_mae"))
    return mixed.select("feature", mae.alias("mae"), "permuted_mae", (F.col("permuted_mae") - mae).alias("importance"),
                        n_rows.alias("n_rows"))
