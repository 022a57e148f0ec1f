import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lumenframe.llm import classifier
from lumenframe.llm.queries import op5_subword_quality

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = op5_subword_quality(spark, SF).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [(labels[r.doc_id], r.score) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = ([s for y, s in held if y == k] for k in (1, 0))
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert len(held) > 50 and auc > 0.97


def test_scores_come_from_the_text_alone(spark):
    rows = spark.createDataFrame([(1, "same text", "en"), (2, "same text", "de"), (2, "same text", None)], "doc_id long, text string, lang string")
    model = classifier.train(["good words", "bad %%%"] * 5, [1, 0] * 5)
    assert len({r.score for r in classifier.score(rows, model).collect()}) == 1


def test_one_class_and_none():
    assert classifier.train([], []).score("x") == 0.5
    assert classifier.train(["a"], [1]).score(None) > 0.9 > 0.1 > classifier.train(["a"], [0]).score("b")


def plain(text):
    """Word by word, in Python integers."""
    full, p = (1 << 64) - 1, int(classifier._P)

    def bucket(h):
        h = (h ^ h >> 31) * 0xBF58476D1CE4E5B9 & full
        return (h ^ h >> 29) & classifier.BUCKETS - 1

    raw = re.sub(rb"[\x09-\x0d]", b" ", b" " + (text or "").encode() + b" ")
    words = [sum((c + 1) * pow(p, i, 1 << 64) for i, c in enumerate(w)) & full for w in raw.split(b" ") if w]
    if not words:
        return []
    out = [bucket(w * 3 & full) for w in words] + [bucket(((v - u) * 5 + 1) & full) for u, v in zip(words, words[1:])]
    for n in classifier.GRAMS:
        for i in range(len(raw) - n + 1):
            h = 0
            for c in raw[i : i + n]:
                h = (h * 1099511628211 + c + 1) & full
            out.append(bucket((h * (2 * n + 1) + n) & full))
    return sorted(out)


@pytest.mark.parametrize("chunk", [3, 7, 64, 1 << 20])
def test_features_are_those_of_a_plain_reading(monkeypatch, chunk):
    monkeypatch.setattr(classifier, "_CHUNK", chunk)
    r = random.Random(chunk)
    texts = [None, "", " ", "a", " a ", "é\u3000x", "word" * 50] + ["".join(r.choice("ab \n\x1c\U0001f600") for _ in range(r.randint(1, 90))) for _ in range(60)]
    for t in texts:
        assert sorted(classifier.features(t).tolist()) == plain(t), t


@pytest.mark.parametrize("n", [(1 << 20) - 2, (1 << 20) - 1, 1 << 20, (1 << 20) + 1])
def test_the_last_byte_counts(n):
    assert not np.array_equal(*(np.sort(classifier.features("a" * n + c)) for c in "bc"))


def test_the_sample_is_bounded_by_bytes(spark):
    docs = spark.createDataFrame([(i, ("good " if i % 2 else "bad ") * (10 if i else 100_000)) for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    model = classifier.fit(docs, labels, sample_bytes=5000)
    assert model.score("good good good") > 0.5 > model.score("bad bad bad")


def test_training_is_reproducible():
    texts, y = ["good words here", "bad %%% ###", "fine text", "&&& $$$"], [1, 0, 1, 0]
    assert np.array_equal(classifier.train(texts, y).values, classifier.train(texts, y).values)


def plain_train(texts, labels, buckets, dim, epochs, rate, seed):
    """The same descent number by number: (value of each bucket, bias)."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).tolist()
    out, bias = rng.normal(0.0, 0.1, (2, dim)).tolist(), [0.0, 0.0]
    counts = [Counter(classifier.features(t).tolist()) for t in texts]
    weight = [math.sqrt(len(labels) / (2.0 * labels.count(c))) for c in (0, 1)]
    steps, done = epochs * len(labels), 0
    for _ in range(epochs):
        for i in rng.permutation(len(labels)):
            lr, n, y = rate * (1.0 - done / steps), sum(counts[i].values()), labels[i]
            done += 1
            hidden = [sum(c / n * vectors[f][k] for f, c in counts[i].items()) for k in range(dim)]
            z = [sum(o * h for o, h in zip(out[c], hidden)) + bias[c] for c in (0, 1)]
            p = [math.exp(x - max(z)) for x in z]
            g = [(x / sum(p) - (c == y)) * weight[y] * lr for c, x in enumerate(p)]
            step = [g[0] * out[0][k] + g[1] * out[1][k] for k in range(dim)]
            out = [[out[c][k] - g[c] * hidden[k] for k in range(dim)] for c in (0, 1)]
            bias = [b - 0.1 * x for b, x in zip(bias, g)]
            for f, c in counts[i].items():
                vectors[f] = [v - c / n * len(counts[i]) ** 0.5 * s for v, s in zip(vectors[f], step)]
    return [sum(v[k] * (out[1][k] - out[0][k]) for k in range(dim)) for v in vectors], bias[1] - bias[0]


def test_training_number_by_number():
    texts = ["good words here", "bad bad text!!", "", "good text", "words and more words", "a bad one"]
    labels = [1, 0, 0, 1, 1, 0]
    model = classifier.train(texts, labels, epochs=4, rate=0.3, seed=7)
    values, bias = plain_train(texts, labels, classifier.BUCKETS, classifier.DIM, 4, 0.3, 7)
    assert np.allclose(model.values, values, atol=1e-4) and abs(model.bias - bias) < 1e-4
    for t in [*texts, "unseen words", None]:
        f = classifier.features(t).tolist()
        z = bias + (sum(values[i] for i in f) / len(f) if f else 0.0)
        assert abs(model.score(t) - 1 / (1 + math.exp(-z))) < 1e-4
