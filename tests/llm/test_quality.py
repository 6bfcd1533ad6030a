"""Held-out accuracy of the classifier, shrinkage of sparse sites."""
from pyspark.sql import functions as F

from resolvr.llm import quality

SF = "/root/testdata/sf0.01"


def test_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    train = labels.where("doc_id % 2 = 0")
    got = quality.score(docs, train, F.col("source"), F.col("lang"))
    assert got.count() == docs.count()
    test = got.select("doc_id", F.col("keep").cast("int").alias("k")).join(
        labels.where("doc_id % 2 = 1").select("doc_id", F.col("quality").alias("y")), "doc_id").collect()
    assert sum(r.k == r.y for r in test) >= 0.97 * len(test)


def test_sparse_sites_are_pulled_to_their_parent(spark):
    rows = [(i, "good words in a row. " * 5 if i % 10 else "### $$$ %%% ### ", f"h{i % 4}", f"p{i % 8}") for i in range(400)]
    rows += [(1000, "### $$$ %%% ### ", "rare", "rare"), (1001, "good words in a row. " * 5, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, host string, path string")
    labels = docs.select("doc_id", (F.col("doc_id") % 10 != 0).cast("int").alias("quality")).where("doc_id < 400")
    by = {r.doc_id: r for r in quality.score(docs, labels, F.col("host"), F.col("path")).collect()}
    assert len(by) == 402 and not by[1000].keep and by[1001].keep
    assert by[1000].classifier < by[1000].path_posterior < 0.95


def test_edge_rows(edge, nothing, spark):
    labels = spark.createDataFrame([(3, 1), (6, 0), (6, None), (None, 1), (4, 1)], "doc_id bigint, quality int")
    got = quality.score(edge, labels, F.col("lang"), F.lit(None))
    assert got.count() == 11
    assert {r.quality for r in quality.score(edge, labels.where("false"), F.lit("h"), F.lit("p")).collect()} == {0.5}
    assert quality.score(nothing, labels, F.col("lang"), F.col("lang")).count() == 0


def test_long_runs_are_read_whole():
    ends = "begin" * 3, "close" * 3
    a, b = quality.features([ends[0] + "x" * 200 + ends[1], ends[0] + "#7$" * 67 + ends[1]], quality._Slots())
    assert (a[:quality.BUCKETS] != b[:quality.BUCKETS]).any()
    assert quality.pieces(["ab", "x" * 24 + "y" * 24 + "z"]) == ["ab", "x" * 24, "y" * 24, "z"]


def plain_posteriors(rows):
    """(p, host, path) per document -> posteriors by dictionaries: group
    means shrunk to their parent's, by the variance between groups beyond what
    sampling explains."""
    from collections import defaultdict
    n, mean = len(rows), (sum(p for p, _, _ in rows) + 1) / (len(rows) + 2)
    by_host, by_path = defaultdict(list), defaultdict(list)
    for p, h, q in rows:
        by_host[h].append(p)
        by_path[h, q].append(p)

    def strength(between, within):
        return 1000.0 if between <= 0 or not within else min(1000.0, max(1.0, within / between - 1))

    between = sum(len(x) / n * (sum(x) / len(x) - mean) ** 2 for x in by_host.values()) - len(by_host) * mean * (1 - mean) / n
    k = strength(between, mean * (1 - mean))
    host = {h: (sum(x) + k * mean) / (len(x) + k) for h, x in by_host.items()}
    inner = {hq: host[hq[0]] * (1 - host[hq[0]]) for hq in by_path}
    between = sum(len(x) / n * (sum(x) / len(x) - host[hq[0]]) ** 2 for hq, x in by_path.items()) - sum(inner.values()) / n
    k = strength(between, sum(len(x) / n * inner[hq] for hq, x in by_path.items()))
    return host, {hq: (sum(x) + k * host[hq[0]]) / (len(x) + k) for hq, x in by_path.items()}


def test_posteriors_of_a_plain_version(spark):
    import math
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    sites = {r.doc_id: (r.source, None if r.doc_id % 5 == 0 else r.lang) for r in docs.collect()}
    got = quality.score(docs, labels, F.col("source"), F.when(F.col("doc_id") % 5 != 0, F.col("lang"))).collect()
    host, path = plain_posteriors([(r.classifier, *sites[r.doc_id]) for r in got])
    share = labels.where("quality is not null").agg(F.sum("quality"), F.count("quality")).first()
    prior = math.log((share[0] + 1) / (share[1] - share[0] + 1))
    for r in got:
        h, q = sites[r.doc_id]
        assert abs(r.host_posterior - host[h]) < 1e-9 and abs(r.path_posterior - path[h, q]) < 1e-9
        odds = math.log(r.classifier / (1 - r.classifier)) - prior + math.log(path[h, q] / (1 - path[h, q]))
        assert abs(math.log(r.quality / (1 - r.quality)) - odds) < 1e-6 and r.keep == (r.quality >= 0.5)


def test_the_fit_does_not_depend_on_the_order_of_rows(spark):
    """Ids that repeat with other texts, dealt in two ways."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select((F.col("doc_id") % 150).alias("doc_id"), "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select((F.col("doc_id") % 150).alias("doc_id"), "quality")
    a, b = (quality.fit(d, labels, train_docs=60) for d in (docs.repartition(7), docs.orderBy(F.desc("text")).coalesce(2)))
    assert (a[0] == b[0]).all() and a[1] == b[1]
