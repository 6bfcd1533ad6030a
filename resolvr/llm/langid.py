"""Language identification by multinomial naive Bayes over hashed character
n-grams. Counting is one pass over all labelled texts (partial sums per task,
then a grouped sum); the log-probability matrix has a fixed number of feature
rows and one column per language, and is broadcast; scoring gathers the rows
of a batch's n-grams and sums them per document in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import persist_table
from .common import cut, handed_through, slices

BUCKETS = 1 << 14
SIZES = (2, 3)
MAX_LANGUAGES = 1024
_MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35))
_SPACE = np.uint32(32)


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of texts end to end, ASCII other than letters
    as spaces, two spaces before each text; and where each text begins."""
    raw = [(t or "").lower().encode("utf-32-le", "surrogatepass") for t in texts]
    lens = np.fromiter((len(r) // 4 for r in raw), np.int64, len(raw))
    gap = b"\x20\0\0\0" * 2
    c = np.frombuffer(gap + gap.join(raw) + gap, "<u4").copy()
    c[(c < 128) & ((c < 97) | (c > 122))] = _SPACE
    return c, np.cumsum(lens + 2) - lens


def ngrams(texts: list[str], buckets: int = BUCKETS, sizes=SIZES) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all texts and, per n-gram, the index of its text.
    An n-gram starts one character before the text at the earliest, holds at
    most spaces at its ends, and never runs into another text."""
    c, first = codes(texts)
    start = np.concatenate([first - 1, [len(c)]])
    owner = np.repeat(np.arange(-1, len(texts)), np.diff(np.concatenate([[0], start])))
    letter = c != _SPACE
    out, own = [], []
    for n in sizes:
        m = len(c) - n + 1
        h = c[:m] * _MIX[0]
        for k in range(1, n):
            h = (h ^ (h >> np.uint32(15))) * _MIX[k % 3] + c[k:m + k] * _MIX[(k + 1) % 3]
        h ^= h >> np.uint32(16)
        inner = letter[:m] | letter[1:m + 1] if n == 2 else np.logical_and.reduce([letter[k:m + k] for k in range(1, n - 1)])
        keep = np.flatnonzero(inner)
        out.append((h[keep] + np.uint32(n)) & np.uint32(buckets - 1))
        own.append(owner[keep])
    h, own = np.concatenate(out), np.concatenate(own)
    ok = own >= 0
    return (h, own) if ok.all() else (h[ok], own[ok])


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def learn(docs: DataFrame, lang: Column, text_col: str = "text", buckets: int = BUCKETS, sizes=SIZES,
          alpha: float = 0.1) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages (sorted), log priors and the ``buckets`` x languages matrix
    of log probabilities, from all rows whose ``lang`` is not null. Above
    MAX_LANGUAGES languages a list of functions, each of which gives these three
    for the next MAX_LANGUAGES ones. The driver gets the languages' names and the
    counts of one such block at a time."""
    rows = docs.select(F.col(f"`{text_col}`").alias("text"), lang.cast("string").alias("lang")) \
        .where("lang is not null")

    def count(batches):
        total, n_docs = {}, {}
        for batch in cut(batches):
            texts, labels = batch["text"].to_pylist(), np.array(batch["lang"].to_pylist(), object)
            for lab in labels:
                n_docs[lab] = n_docs.get(lab, 0) + 1
            for s, e in slices(texts):
                names, code = np.unique(labels[s:e].astype(str), return_inverse=True)
                h, own = ngrams(texts[s:e], buckets, sizes)
                both = np.bincount(code[own] * buckets + h, minlength=len(names) * buckets)
                for k, name in enumerate(names):
                    part = both[k * buckets:(k + 1) * buckets]
                    total[name] = total[name] + part if name in total else part
        for name, n in n_docs.items():
            c = total.get(str(name), np.zeros(buckets, np.int64))
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * (len(at) + 1)), pa.array(np.append(at, -1), pa.int32()),
                 pa.array(np.append(c[at], n), pa.int64())], ["lang", "feature", "n"])

    counts = persist_table(rows.mapInArrow(count, "lang string, feature int, n bigint")
                           .groupBy("lang", "feature").agg(F.sum("n").alias("n")), "language-counts")
    n_docs = {r["lang"]: r["n"] for r in counts.where("feature < 0").collect()}
    langs, total = sorted(n_docs), max(sum(n_docs.values()), 1)

    def block(names: list[str]):
        matrix, place = np.full((buckets, len(names)), alpha), {x: k for k, x in enumerate(names)}
        if names:
            found = counts.where("feature >= 0").where(F.col("lang").between(names[0], names[-1])).toArrow()
            at = np.array([place[x] for x in found["lang"].to_pylist()], np.int64)
            matrix[found["feature"].to_numpy(), at] += found["n"].to_numpy()
        prior = np.array([n_docs[x] for x in names], float)
        return names, np.log(prior / total), np.log(matrix / matrix.sum(0))

    if len(langs) <= MAX_LANGUAGES:
        return block(langs)
    return [lambda a=a: block(langs[a:a + MAX_LANGUAGES]) for a in range(0, len(langs), MAX_LANGUAGES)]


def predict(docs: DataFrame, model, text_col: str = "text", carry: list[str] | None = None, buckets: int = BUCKETS,
            sizes=SIZES) -> DataFrame:
    """The columns ``carry`` of ``docs`` (all by default) with ``lang_pred`` and ``score`` (the posterior probability of
    ``lang_pred``) behind them, no shuffle. Null texts and texts
    without a letter get ``und`` and score 0, as does every text when no
    language was learned; equal posteriors go to the first language by name.
    Columns of these names that ``docs`` has already, in any case, are
    replaced; repeated rows are scored one by one, an empty table gives no rows."""
    if isinstance(model, list):
        return _predict_in_blocks(docs, model, text_col, carry, buckets, sizes)
    langs, prior, logp = model
    shared = docs.sparkSession.sparkContext.broadcast((langs, prior, np.ascontiguousarray(logp.T, np.float32)))
    work, kept, schema, named = handed_through(docs, text_col, carry, "lang_pred string, score double")

    def run(batches):
        langs, prior, logp = shared.value
        for batch in cut(batches):
            texts = batch["text"].to_pylist()
            known = np.array([has_letter(t) for t in texts], bool) & bool(langs)
            post = _posteriors(texts, langs, prior, logp, buckets, sizes)
            best = post.argmax(1)
            top = post[np.arange(len(texts)), best]
            score = np.where(known, 1 / np.exp(post - top[:, None]).sum(1), 0.0)
            pred = [langs[b] if k else "und" for b, k in zip(best, known)]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in kept.values()], pa.array(pred, pa.string()), pa.array(score)],
                                             schema.names)

    return named(work.mapInArrow(run, schema))


def _posteriors(texts: list, langs, prior, logp, buckets: int, sizes) -> np.ndarray:
    """Log joint probability of each text and language."""
    post = np.zeros((len(texts), max(1, len(langs))))
    for s, e in slices(texts) if langs else ():
        h, own = ngrams(texts[s:e], buckets, sizes)
        for k in range(len(langs)):
            post[s:e, k] = np.bincount(own, logp[k][h], e - s) + prior[k]
    return post


def _predict_in_blocks(docs: DataFrame, blocks: list, text_col: str, carry: list[str] | None, buckets: int,
                       sizes) -> DataFrame:
    """``predict`` with one block of languages at a time: a pass over the
    stored documents gives each one's best language of the block and the sum of
    its probabilities, and a document's passes are put together."""
    work, kept, schema, named = handed_through(docs, text_col, carry, "lang_pred string, score double")
    stored = persist_table(work.withColumn("row", F.monotonically_increasing_id()), "predicted")

    def one(block):
        langs, prior, logp = block()
        shared = docs.sparkSession.sparkContext.broadcast((langs, prior, np.ascontiguousarray(logp.T, np.float32)))

        def run(batches):
            langs, prior, logp = shared.value
            for batch in cut(batches):
                texts = batch["text"].to_pylist()
                post = _posteriors(texts, langs, prior, logp, buckets, sizes)
                best = post.argmax(1)
                top = post[np.arange(len(texts)), best]
                known = np.flatnonzero([has_letter(t) for t in texts])
                yield pa.RecordBatch.from_arrays(
                    [batch["row"], pa.array([langs[b] for b in best], pa.string()), pa.array(top),
                     pa.array(np.exp(post - top[:, None]).sum(1))], ["row", "lang", "top", "mass"]).take(pa.array(known))
        return persist_table(stored.select("row", "text").mapInArrow(run, "row bigint, lang string, top double, mass double"),
                             "language-block")

    passes = [one(b) for b in blocks]
    every = passes[0]
    for p in passes[1:]:
        every = every.unionByName(p)
    # of equal posteriors the first language by name: the blocks are in that order
    top = every.groupBy("row").agg(F.max("top").alias("best"))
    found = every.join(top, "row").groupBy("row").agg(
        F.min(F.when(F.col("top") == F.col("best"), F.col("lang"))).alias("lang_pred"),
        (1 / F.sum(F.col("mass") * F.exp(F.col("top") - F.col("best")))).alias("score"))
    return named(stored.join(found, "row", "left").withColumn("lang_pred", F.coalesce("lang_pred", F.lit("und")))
                 .withColumn("score", F.coalesce("score", F.lit(0.0))))
