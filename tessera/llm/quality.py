"""Quality classifier: supervised subword embeddings.

A document is the mean of the learned vectors of its hashed features: words, pairs of neighbouring words, and n-grams
of bytes within words. A softmax layer gives the classes; vectors and layer are trained together by stochastic
gradient descent in numpy, on a bounded sample of labelled rows (``ROWS`` a class, ``BYTES`` in all). Since the output
is linear in the mean up to the softmax, scoring needs one number a feature: the vectors are projected once and a
text's score is a sum of table look-ups over its bytes, with no Python object for a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textbytes as tb
from tessera.llm.common import fold, table, trim
from tessera.llm.sample import labelled, log_odds

ROWS, BYTES = 1500, 32 << 20
BUCKETS_LOG2 = 18
DIM, EPOCHS, RATE = 12, 12, 1.0
NGRAMS = (3, 5)
#: Seed of the sampling order and of the vectors.
SEED = 11
_U = np.uint64
_SHIFT = _U(64 - BUCKETS_LOG2)


def _bucket(h: np.ndarray, kind: int) -> np.ndarray:
    return ((h ^ _U(0x9E3779B97F4A7C15 * (kind + 1) & (2**64 - 1))) * _U(0xD6E8FEB86659FD93) >> _SHIFT).astype(np.int64)


def features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (starts, buckets): the features of text i are buckets[starts[i]:starts[i + 1]]. One pair a kind of feature."""
    w = tb.words(texts)
    h = w.hashes()
    yield tb.firsts(w.doc, w.n), _bucket(h, 0)
    if len(h) > 1:
        same = w.doc[1:] == w.doc[:-1]
        again = same & (h[1:] == h[:-1])
        pair = np.where(again, _U(1), tb.grams(h, 2))  # any word that follows itself is one feature
        yield tb.firsts(w.doc[1:][same], w.n), _bucket(pair[same], 1)
    outside = np.zeros(len(w.data) + 1, np.int64)
    np.cumsum(tb.SPACE[w.data], out=outside[1:])
    for n in NGRAMS:
        if len(w.data) < n:
            continue
        within = outside[n:] == outside[:-n]
        for cut in w.offsets[1:-1]:
            within[max(0, cut - n + 1) : cut] = False
        at = np.flatnonzero(within)
        yield np.searchsorted(at, w.offsets), _bucket(w.hash_of(at, at + n), n)


class Model:
    """The projected table and the intercept of the log odds of class 1."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def scores(self, texts: pa.Array) -> np.ndarray:
        out = []
        for lo, hi in tb.pieces(texts):
            total, count = np.zeros(hi - lo), np.zeros(hi - lo)
            for starts, buckets in features(texts.slice(lo, hi - lo)):
                sums = np.concatenate([[0.0], np.cumsum(self.weights[buckets], dtype=np.float64)])
                total += sums[starts[1:]] - sums[starts[:-1]]
                count += np.diff(starts)
            out.append(1 / (1 + np.exp(-np.clip(self.bias + total / np.maximum(count, 1), -30, 30))))
        return np.concatenate(out) if out else np.zeros(0)


def train(texts: pa.Array, y: np.ndarray, share: float, epochs: int = EPOCHS, rate: float = RATE) -> Model:
    """A model of sampled texts; ``share`` is that of class 1 among all, which moves the intercept from the sample's."""
    rng = np.random.default_rng(SEED)
    vectors = ((rng.random((1 << BUCKETS_LOG2, DIM), dtype=np.float32) - 0.5) / DIM).astype(np.float32)
    layer, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    rows: list[tuple[np.ndarray, np.ndarray]] = []
    for lo, hi in tb.pieces(texts):
        parts = list(features(texts.slice(lo, hi - lo)))
        for d in range(hi - lo):
            own = np.concatenate([b[s[d] : s[d + 1]] for s, b in parts])
            ids, count = np.unique(own, return_counts=True)
            rows.append((ids.astype(np.int32), (count / max(1, len(own))).astype(np.float32)))
    steps, step = max(1, epochs * len(rows)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            pace = rate * (1 - step / steps)
            step += 1
            ids, part = rows[i]
            own = vectors[ids]
            x = part @ own
            z = x @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[int(y[i])] -= 1
            back = layer @ p
            layer -= pace * np.outer(x, p)
            bias -= np.float32(pace * 0.1) * p
            # a feature's gradient is its part of the mean; scaled up so that rare features learn at a useful pace
            vectors[ids] = own - (pace * np.sqrt(part))[:, None] * back
    mine = float(y.mean()) if len(y) else 0.5
    return Model((vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0]) + log_odds(share) - log_odds(mine))


def fitted(docs: DataFrame, labels: DataFrame) -> Model:
    """Trained on the rows of ``labels`` of which crc32 of doc_id mod 3 is not 1."""
    model = train(*labelled(docs, labels, "quality", lambda i: fold(i, 3) != 1, ROWS, BYTES))
    trim()
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` and ``score``, the probability of class 1. Null and empty texts get that of no feature."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # a table of fixed size
    names = [f"__{i}" for i in range(len(docs.columns))]
    flat = docs.toDF(*names)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(held.value.scores(b.column(at)))], [*names, "__score"])

    kinds = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema, strict=True))
    return flat.mapInArrow(run, f"{kinds}, __score double").toDF(*docs.columns, "score")


def op10_quality(spark, sf_dir):
    """The quality of each whole text of ``documents``, by a model of the labelled rows whose crc32 of doc_id mod 3 is
    not 1. A null or empty text gets the score of no features; every row has a row, repeated ones equal scores."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fitted(docs, table(spark, sf_dir, "labels"))
    scored = score(docs.select("doc_id", "text"), model).select("doc_id", "score")
    return scored.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
