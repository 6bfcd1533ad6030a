"""Document quality by hierarchical empirical Bayes.

A logistic classifier over word shapes gives each document its evidence. Hosts
and paths within hosts get posteriors by grouped aggregation: a path's share of
good documents is shrunk towards its host's, a host's towards the global share,
each with the prior strength that the spread of the shares supports (method of
moments). A document's posterior adds its evidence to the log odds of its path.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import persist_table

BUCKETS = 256
#: Labelled documents that the classifier is fitted on at most.
TRAIN_DOCS = 10_000
_RUNS = ((re.compile(r"[a-zß-öø-ÿ]+"), "a"), (re.compile(r"[A-ZÀ-ÖØ-Þ]+"), "A"), (re.compile(r"[0-9]+"), "9"))
_DENSE = 4
#: Characters of a word; a longer run counts as several words.
LONGEST = 24


def shape(word: str) -> str:
    """Lower-case runs as ``a``, capitals as ``A``, digits as ``9``; other
    characters stay."""
    for pattern, mark in _RUNS:
        word = pattern.sub(mark, word)
    return word


def pieces(words: list[str]) -> list[str]:
    """Words of at most 24 characters as they are, longer runs (texts without
    spaces) whole, in consecutive pieces of 24."""
    if max(map(len, words), default=0) <= LONGEST:
        return words
    return [w[i:i + LONGEST] for w in words for i in range(0, len(w), LONGEST)]


def _slot(word: str) -> int:
    h = 2166136261
    for b in shape(word).encode():
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return (h ^ h >> 15) % BUCKETS


class _Slots(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= 300_000:
            self.clear()
        n = _slot(word)
        self[word] = n
        return n


def features(texts: list[str | None], slots: _Slots) -> np.ndarray:
    """Square roots of the shares of word shapes, then the share of repeated
    lines, the mean word length, the logarithm of the length, and one."""
    out = np.zeros((len(texts), BUCKETS + _DENSE))
    for i, t in enumerate(texts):
        words = (t or "").split()
        if words:
            parts = pieces(words)
            n = np.bincount(np.fromiter(map(slots.__getitem__, parts), np.int64, len(parts)), minlength=BUCKETS)
            out[i, :BUCKETS] = np.sqrt(n / len(parts))
            lines = [x for x in t.split("\n") if x.strip()]
            out[i, BUCKETS] = 1 - len(set(lines)) / len(lines) if lines else 0
            out[i, BUCKETS + 1] = min(sum(map(len, words)) / len(words) / 10, 3)
        out[i, BUCKETS + 2] = math.log1p(len(t or "")) / 10
    out[:, -1] = 1
    return out


def _logits(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.clip(x @ w, -12, 12)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", train_docs: int = TRAIN_DOCS, rounds: int = 12, ridge: float = 0.3):
    """Weights and log odds of the labels, from at most ``train_docs``
    labelled documents (the smallest hashes of their ids); None without both
    labels. A document labelled both ways counts as both, an id that repeats
    with the text of the smallest hash, so at most ``train_docs`` rows of 256
    numbers reach the driver and the fit does not depend on how rows are dealt."""
    chosen = labels.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{label_col}`").cast("int").alias("y")) \
        .where("_id is not null and y in (0, 1)").orderBy(F.xxhash64("_id"), "_id", "y").limit(train_docs)
    text = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("text"))

    def rows(batches):
        slots = _Slots()
        for batch in batches:
            x = features(batch["text"].to_pylist(), slots).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch["h"], batch["y"], pa.array([r.tobytes() for r in x], pa.binary())], ["h", "y", "x"])

    one = text.join(F.broadcast(chosen.distinct()), "_id").groupBy("_id", "y").agg(
        F.min(F.struct(F.xxhash64("text").alias("t"), "text")).getField("text").alias("text"))
    got = one.select(F.xxhash64("_id").alias("h"), "y", "text").mapInArrow(rows, "h bigint, y int, x binary").collect()
    got.sort(key=lambda r: (r["h"], r["y"], bytes(r["x"])))
    y = np.array([r["y"] for r in got], float)
    if not len(y) or y.min() == y.max():
        return None
    x = np.stack([np.frombuffer(r["x"], np.float32) for r in got]).astype(float)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-_logits(x, w)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w += np.linalg.solve(hessian, x.T @ (y - p) - ridge * w)
    share = (y.sum() + 1) / (len(y) + 2)
    return w, math.log(share / (1 - share))


def _strength(between: float | None, within: float | None, least: float = 1.0, most: float = 1000.0) -> float:
    """Prior strength from the variance of group shares around their parent's
    (``between``) and p (1 - p) of the parent (``within``)."""
    if not between or not within or between <= 0:
        return most
    return min(most, max(least, within / between - 1))


def score(docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id",
          text_col: str = "text", label_col: str = "quality", threshold: float = 0.5) -> DataFrame:
    """``doc_id, classifier, host_posterior, path_posterior, quality, keep``
    of every row.

    ``classifier`` is the probability from the text alone, ``quality`` the
    posterior, ``keep`` whether it reaches ``threshold``. Null hosts and paths
    are groups of their own; null and empty texts are scored by their (empty)
    shape. Without usable labels every document has 0.5 and is kept."""
    model = fit(docs, labels, id_col, text_col, label_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), host.cast("string").alias("host"),
                       path.cast("string").alias("path"), F.col(f"`{text_col}`").alias("text"))

    def evidence(batches):
        slots = _Slots()
        for batch in batches:
            e = np.zeros(batch.num_rows)
            if shared.value is not None and batch.num_rows:
                w, prior = shared.value
                e = _logits(features(batch["text"].to_pylist(), slots), w) - prior
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["host"], batch["path"], pa.array(e)],
                                             ["doc_id", "host", "path", "e"])

    id_type = dict(rows.dtypes)["doc_id"]
    prior = model[1] if model else 0.0
    scored = persist_table(rows.mapInArrow(evidence, f"doc_id {id_type}, host string, path string, e double")
                           .withColumn("p", 1 / (1 + F.exp(-(F.col("e") + prior)))), "quality")
    paths = scored.groupBy("host", "path").agg(F.sum("p").alias("s"), F.count("*").alias("n"))
    paths = persist_table(paths, "quality-paths")
    hosts = paths.groupBy("host").agg(F.sum("s").alias("hs"), F.sum("n").alias("hn"))
    total = hosts.agg(F.sum("hs"), F.sum("hn")).first()
    mean = (total[0] + 1) / (total[1] + 2) if total[1] else 0.5
    share, pull = F.col("hs") / F.col("hn"), F.col("hn") / F.lit(total[1] or 1)
    spread = hosts.agg(F.sum(pull * F.pow(share - mean, 2)), F.sum(mean * (1 - mean) / F.lit(total[1] or 1))).first()
    k_host = _strength((spread[0] or 0) - (spread[1] or 0), mean * (1 - mean))
    hosts = hosts.select(F.col("host").alias("h"), ((F.col("hs") + k_host * mean) / (F.col("hn") + k_host))
                         .alias("host_posterior"))
    both = persist_table(paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))).select(
        "h", F.col("path").alias("q"), "s", "n", "host_posterior"), "quality-sites")
    inner, weight = F.col("host_posterior") * (1 - F.col("host_posterior")), F.col("n") / F.lit(total[1] or 1)
    spread = both.agg(F.sum(weight * F.pow(F.col("s") / F.col("n") - F.col("host_posterior"), 2)),
                      F.sum(inner / F.lit(total[1] or 1)), F.sum(weight * inner)).first()
    k_path = _strength((spread[0] or 0) - (spread[1] or 0), spread[2])
    sites = both.select("h", "q", "host_posterior", ((F.col("s") + k_path * F.col("host_posterior")) / (F.col("n") + k_path))
                        .alias("path_posterior"))
    odds = F.log(F.col("path_posterior") / (1 - F.col("path_posterior")))
    quality = 1 / (1 + F.exp(-(F.col("e") + odds)))
    return scored.join(sites, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("q"))).select(
        "doc_id", F.col("p").alias("classifier"), "host_posterior", "path_posterior", quality.alias("quality"),
        (quality >= threshold).alias("keep"))
