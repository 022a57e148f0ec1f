"""A quality classifier over learned subword embeddings.

A document is the mean of the vectors of its features: its words, its pairs of neighbouring words and its character
n-grams, each hashed to one of `BUCKETS` rows. A softmax over two classes reads the mean. Vectors and output weights are
learned together by plain stochastic gradient descent in numpy, one document a step, with a falling learning rate.

Training takes at most `SAMPLE_ROWS` labelled documents of `SAMPLE_BYTES` in all, those with the smallest seeded hash of
doc_id, so a bound on the driver's memory is known; each contributes its whole text, and the rarer class weighs more. Scoring covers every document
and whole texts: since the mean and the output layer are linear, each bucket's vector is folded with the output weights
once, and a document's logit is the mean of its buckets' values.

Empty or null texts have no features and get the bias alone; so do tables without labels of both classes (score 0.5 or
the only class's share). Repeated rows are scored each by itself; empty tables give empty results; other columns pass
through, but for the names that a function adds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slim

BUCKETS, DIM, EPOCHS, RATE, SEED = 1 << 16, 16, 8, 0.5, 11
GRAMS = (3, 4)
SAMPLE_ROWS, SAMPLE_BYTES = 2000, 64 << 20
_P = np.uint64(0x9E3779B97F4A7C15)
_CHUNK = 1 << 20
_WHITE = bytes(32 if 9 <= i <= 13 else i for i in range(256))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h ^ (h >> np.uint64(29))) & np.uint64(BUCKETS - 1)).astype(np.int32)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P ** i and P ** -i modulo 2 ** 64."""
    inverse = np.uint64(pow(int(_P), -1, 1 << 64))
    up, down = np.full(n, _P), np.full(n, inverse)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_UP, _DOWN = _powers(_CHUNK + 1)


def features(text: str | None) -> np.ndarray:
    """The buckets of all features of a text, repeats included; none if it has no words. Words are runs of anything but
    the six ASCII white space bytes, n-grams run over the bytes with white space as one kind and a space at both ends.
    Long texts go by pieces of _CHUNK bytes: a word over an edge carries its hash on, n-grams look ahead."""
    raw = b" " + (text or "").encode("utf-8", "surrogatepass").translate(_WHITE) + b" "
    out: list[np.ndarray] = []
    if not raw.strip():
        return np.empty(0, np.int32)
    held, n_held, before = np.uint64(0), 0, np.empty(0, np.uint64)  # an unfinished word and its length; the word before
    for at in range(0, len(raw), _CHUNK):
        b = np.frombuffer(raw[at : at + _CHUNK + GRAMS[-1] - 1], dtype=np.uint8)
        x, n_own = b.astype(np.uint64) + np.uint64(1), min(_CHUNK, len(b))
        for n in GRAMS:
            m = min(n_own, len(x) - n + 1)
            if m > 0:
                h = x[:m].copy()
                for k in range(1, n):
                    h = h * np.uint64(1099511628211) + x[k : m + k]
                out.append(_mix(h * np.uint64(2 * n + 1) + np.uint64(n)))
        space = np.ones(n_own + 2, dtype=bool)
        space[1:-1] = b[:n_own] == 32
        edge = np.flatnonzero(space[1:] != space[:-1])
        start, stop = edge[::2], edge[1::2]
        # the hash of a slice is a difference of prefix sums, shifted back to position 0
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x[:n_own] * _UP[:n_own], dtype=np.uint64)])
        words, sizes = (total[stop] - total[start]) * _DOWN[start], stop - start
        if n_held and space[1]:
            words, sizes = np.concatenate([[held], words]), np.concatenate([[n_held], sizes])
        elif n_held:
            words[:1] = held + np.uint64(pow(int(_P), n_held, 1 << 64)) * words[:1]
            sizes[0] += n_held
        if space[-2]:
            n_held = 0
        else:
            held, n_held, words = words[-1], int(sizes[-1]), words[:-1]
        row = np.concatenate([before, words])
        out += [_mix(words * np.uint64(3)), _mix((row[1:] - row[:-1]) * np.uint64(5) + np.uint64(1))]
        before = row[-1:]
    return np.concatenate(out)


class Model:
    """The folded model: a value for each bucket, and a bias."""

    def __init__(self, values: np.ndarray, bias: float):
        self.values, self.bias = values.astype(np.float32), float(bias)

    def score(self, text: str | None) -> float:
        f = features(text)
        z = self.bias + (float(self.values[f].mean(dtype=np.float64)) if len(f) else 0.0)
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -30.0, 30.0))))


def train(texts: list[str | None], labels: list[int], epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Model:
    y = np.asarray(labels, dtype=np.int64)
    values = np.zeros(BUCKETS)
    if len(y) == 0 or y.min() == y.max():
        return Model(values, 0.0 if len(y) == 0 else (3.0 if y[0] else -3.0))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
    out, bias = rng.normal(0.0, 0.1, (2, DIM)), np.zeros(2)
    docs = []
    for t in texts:
        rows, n = np.unique(features(t), return_counts=True)
        docs.append((rows, (n / max(1, n.sum())).astype(np.float32)[:, None]))
    weight = len(y) / (2.0 * np.bincount(y, minlength=2))
    weight = np.sqrt(weight)
    steps, done = epochs * len(y), 0
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            lr = rate * (1.0 - done / steps)
            done += 1
            rows, share = docs[i]
            hidden = (vectors[rows] * share).sum(axis=0)
            z = out @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1.0
            p *= weight[y[i]] * lr
            step = p @ out
            out -= np.outer(p, hidden)
            bias -= 0.1 * p
            vectors[rows] -= share * len(rows) ** 0.5 * step
    return Model(vectors @ (out[1] - out[0]), bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES, seed: int = SEED) -> Model:
    """Trains on at most sample_rows documents of labels(doc_id, label), in the order of a seeded hash, leaving out those
    that would bring the sample over sample_bytes; rows without a label are left out."""
    some = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("_y"))
    some = some.withColumn("_place", F.xxhash64(F.lit(seed), "doc_id")).orderBy("_place", "doc_id").limit(sample_rows)  # its size is bounded: broadcast
    rows = docs.select("doc_id", F.octet_length("text").alias("_bytes")).join(F.broadcast(some), "doc_id").groupBy("doc_id", "_y", "_place").agg(F.max("_bytes").alias("_bytes")).collect()
    taken, total = {}, 0
    for r in sorted(rows, key=lambda r: (r["_place"], r["doc_id"])):
        if total + (r["_bytes"] or 0) <= sample_bytes:
            taken[r["doc_id"]], total = r["_y"], total + (r["_bytes"] or 0)
    ids = docs.sparkSession.createDataFrame([(i,) for i in taken], T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType)]))
    texts = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")).collect()
    texts = sorted(texts, key=lambda r: r["doc_id"])
    return train([r["text"] for r in texts], [taken[r["doc_id"]] for r in texts], seed=seed)


def score(df: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """df with the probability of label 1."""
    rest = df.drop(into)
    shared = df.sparkSession.sparkContext.broadcast((model.values, model.bias))  # BUCKETS numbers, whatever the data

    @slim
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Model(*shared.value)
        for pdf in batches:
            yield pdf.assign(**{into: [m.score(t) for t in pdf[text]]})

    return rest.mapInPandas(run, T.StructType([*rest.schema.fields, T.StructField(into, T.DoubleType())]))
