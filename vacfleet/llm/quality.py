"""Operator 5: quality classifier on supervised subword embeddings.

Every word, word pair, immediate repeat of a word and character n-gram (3 and 4 bytes) of a
text hashes to a bucket with a learned vector; the mean vector of the document goes through a linear layer and a
softmax. Vectors and layer are trained together by plain stochastic gradient descent in
numpy. At scoring time vector and layer are multiplied out once, so a document's score is
the mean of one number per n-gram.

The classifier is fitted on a bounded sample: at most ``per_class`` labelled rows of each
class, those with the smallest key hash. A row's features there are its bucket frequencies,
never more numbers than buckets, so long texts stay bounded as well. Scoring reads texts only.

Null and empty texts have no n-grams: their score is that of the bias. Without labelled
rows of both classes nothing is learned and every score is 1 (nothing is rejected). Labels
other than 0 and 1 are ignored; a document with several labels takes the smallest. Texts of
any length are read whole. Extra columns pass through; columns named like an added one are
replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, DoubleType, FloatType, IntegerType, StructField,
                               StructType)

from vacfleet.llm.common import enrich, utf8

BUCKETS = 1 << 13
#: Labelled rows of one class that the classifier is fitted on, at most.
PER_CLASS = 1500
KEEP_FROM = 0.7

_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def ngrams(off: np.ndarray, data: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of every feature of the rows that ``off`` cuts ``data`` into."""
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    n = len(data)
    row_of = np.repeat(np.arange(len(off) - 1, dtype=np.int32), np.diff(off))
    rows, hashes = [], []
    with np.errstate(over="ignore"):
        b = data.astype(np.uint64) + np.uint64(1)
        for size, seed in ((3, 0x51), (4, 0x52)):
            if n >= size:
                h = np.full(n - size + 1, seed, np.uint64)
                for j in range(size):
                    h = (h ^ b[j:n - size + 1 + j]) * _BASE
                    h ^= h >> np.uint64(29)
                inside = row_of[:n - size + 1] == row_of[size - 1:]
                rows.append(row_of[:n - size + 1][inside])
                hashes.append(h[inside])
        word = ~_SPACE[data]
        first = np.empty(n, bool)
        if n:
            first[0] = True
            first[1:] = ~word[:-1] | (row_of[1:] != row_of[:-1])
        at = np.flatnonzero(word & first)
        if len(at):
            # each byte times a weight by its place in the word, summed over the word
            place = np.arange(n) - np.repeat(at, np.diff(np.append(at, n))) if at[0] == 0 else \
                np.arange(n) - np.concatenate([np.zeros(at[0], np.int64), np.repeat(at, np.diff(np.append(at, n)))])
            weight = (place.astype(np.uint64) * np.uint64(2) + np.uint64(1)) * _BASE
            weight ^= weight >> np.uint64(31)
            w = np.add.reduceat(np.where(word, b * weight * _BASE, np.uint64(0)), at)
            w = (w ^ (w >> np.uint64(32))) * _BASE
            rows.append(row_of[at])
            hashes.append(w)
            pair = row_of[at[1:]] == row_of[at[:-1]]
            two = (w[:-1] * np.uint64(3) + w[1:]) * _BASE
            rows.append(row_of[at[:-1]][pair])
            hashes.append(two[pair] ^ (two[pair] >> np.uint64(30)) * _BASE)
            again = pair & (w[1:] == w[:-1])  # a word said twice: one bucket for all words
            rows.append(row_of[at[:-1]][again])
            hashes.append(np.full(int(again.sum()), 0x53, np.uint64))
        if not rows:
            return np.empty(0, np.int32), np.empty(0, np.int64)
        return np.concatenate(rows), ((np.concatenate(hashes) * _BASE) >> shift).astype(np.int64)


class Model:
    """Learned bucket vectors times the output layer: one number per bucket, and a bias."""

    def __init__(self, weights: np.ndarray | None, bias: float):
        self.weights, self.bias = weights, bias

    def scores(self, off: np.ndarray, data: np.ndarray) -> np.ndarray:
        n = len(off) - 1
        if self.weights is None:
            return np.ones(n)
        row, bucket = ngrams(off, data, len(self.weights))
        total = np.bincount(row, self.weights[bucket], n)
        mean = total / np.maximum(np.bincount(row, minlength=n), 1)
        return 1.0 / (1.0 + np.exp(-np.clip(mean + self.bias, -60, 60)))


def train(features: np.ndarray, labels: np.ndarray, dim: int = 16, epochs: int = 30,
          rate: float = 2.0, batch: int = 16, seed: int = 7) -> Model:
    """SGD on softmax cross entropy; ``features`` rows are bucket frequencies summing to 1."""
    rng = np.random.default_rng(seed)
    x = features.astype(np.float32, copy=False)
    n, buckets = x.shape
    y = np.eye(2, dtype=np.float32)[labels]
    # both classes weigh the same, however rare one is
    share = np.bincount(labels, minlength=2) / n
    cost = (0.5 / share)[labels].astype(np.float32)
    vectors = rng.uniform(-1.0 / dim, 1.0 / dim, (buckets, dim)).astype(np.float32)
    out = np.zeros((dim, 2), np.float32)
    bias = np.zeros(2, np.float32)
    steps = max(1, epochs * -(-n // batch))
    step = 0
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(n), -(-n // batch)):
            lr = rate * (1 - step / steps)
            step += 1
            xb = x[at]
            used = np.flatnonzero(xb.any(axis=0))
            xu = xb[:, used]
            hidden = xu @ vectors[used]
            logits = hidden @ out + bias
            e = np.exp(logits - logits.max(axis=1, keepdims=True))
            wrong = (e / e.sum(axis=1, keepdims=True) - y[at]) * cost[at, None] / len(at)
            back = wrong @ out.T
            out -= lr * (hidden.T @ wrong)
            bias -= lr * wrong.sum(axis=0)
            # a document's frequencies are small: the vectors take a step of their scale
            vectors[used] -= lr * 50 * (xu.T @ back)
    weights = vectors @ (out[:, 1] - out[:, 0])
    return Model(weights.astype(np.float64), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, use: Column, per_class: int = PER_CLASS,
        buckets: int = BUCKETS, key_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learn ``labels.quality`` from documents whose key has ``use`` (a condition on ``doc_id``)."""
    order = Window.partitionBy("quality").orderBy(F.xxhash64("doc_id"), "doc_id")
    sample = (labels.where(F.col("quality").isin(0, 1) & use).groupBy("doc_id").agg(F.min("quality").alias("quality"))
              .withColumn("at", F.row_number().over(order)).where(F.col("at") <= per_class)
              .select(F.col("doc_id").alias("key"), "quality"))
    # at most 2 * per_class ids: safe to broadcast
    rows = docs.select(F.col(key_col).alias("key"), F.col(text_col).alias("body")).join(F.broadcast(sample), "key")

    def start():
        def make(column: pa.Array) -> list:
            off, data = utf8(column)
            row, bucket = ngrams(off, data, buckets)
            cell, count = np.unique(row.astype(np.int64) * buckets + bucket, return_counts=True)
            total = np.maximum(np.bincount(row, minlength=len(column)), 1)
            ends = np.searchsorted(cell, np.arange(len(column) + 1) * buckets).astype(np.int32)
            freq = (count / total[cell // buckets]).astype(np.float32)
            return [pa.ListArray.from_arrays(ends, pa.array((cell % buckets).astype(np.int32))),
                    pa.ListArray.from_arrays(ends, pa.array(freq))]
        return make

    added = StructType([StructField("bucket", ArrayType(IntegerType(), False)),
                        StructField("freq", ArrayType(FloatType(), False))])
    found = (enrich(rows, "body", added, start, slice_rows=64).drop("body")
             .orderBy("key", "quality", F.hash("bucket", "freq")).toArrow())
    y = found["quality"].to_numpy().astype(np.int64)
    if len(np.unique(y)) < 2:
        return Model(None, 0.0)
    x = np.zeros((len(y), buckets), np.float32)
    for i in range(len(y)):
        x[i, found["bucket"][i].values.to_numpy()] = found["freq"][i].values.to_numpy()
    return train(x, y)


def score(docs: DataFrame, model: Model, text_col: str = "text", keep_from: float = KEEP_FROM) -> DataFrame:
    """Add ``score`` (0 to 1, higher is likelier label 1) and ``predicted`` (1 from ``keep_from``)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        model = shared.value

        def make(column: pa.Array) -> list:
            s = model.scores(*utf8(column))
            return [pa.array(s), pa.array((s >= keep_from).astype(np.int32))]

        return make

    added = StructType([StructField("score", DoubleType()), StructField("predicted", IntegerType())])
    return enrich(docs, text_col, added, start, slice_rows=128)
