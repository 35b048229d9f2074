"""Toxicity: FTRL-proximal logistic regression over hashed n-grams and skip-grams.

Features are the distinct hashed words, word pairs and pairs with one word
between. Per-coordinate learning rates adapt to each feature; the L1 term keeps
most weights at exactly zero, so the model is a short list of (bucket, weight)
that is shipped to every task. Null and empty texts have only the intercept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, byte_classes, held_out, mix64, small_batches, texts_of, word_hashes
from .samples import labelled_texts

BITS = 20
# every ASCII character that is neither a letter nor a digit parts words
TABLE = byte_classes(bytes(b for b in range(128) if not chr(b).isalnum()))


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and document of each feature occurrence."""
    words, at = word_hashes(data, offsets, TABLE)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    parts, docs = [words], [doc]
    for gap, salt in ((1, 0xA24BAED4963EE407), (2, 0x9FB21C651E98DF25)):
        if len(words) > gap:
            same = doc[:-gap] == doc[gap:]
            pair = (words[:-gap] * np.uint64(3) ^ np.uint64(salt)) + words[gap:]
            parts.append(mix64(pair)[same])
            docs.append(doc[gap:][same])
    return (np.concatenate(parts) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(docs)


@dataclass
class SparseModel:
    buckets: np.ndarray
    weights: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        w = np.zeros(1 << BITS, np.float32)
        w[self.buckets] = self.weights
        return w


def fit(texts: list[bytes], labels: np.ndarray, epochs: int = 8, alpha: float = 1.0, beta: float = 1.0, l1: float = 6.0, l2: float = 0.1, seed: int = 11) -> SparseModel:
    """One FTRL-proximal update a document, ``epochs`` times over the sample."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    z0 = n0 = bias = 0.0
    rng = np.random.default_rng(seed)
    each = []
    for t in texts:
        each.append(np.unique(features(np.frombuffer(t, np.uint8), np.array([0, len(t)], np.int64))[0]))

    def weights(zi, ni):
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    for _ in range(epochs):
        for i in rng.permutation(len(each)):
            at = each[i]
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - labels[i]
            if abs(g) < 1e-4:
                continue
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[at] = zi + g - sigma * w
            n[at] = ni + g * g
            s0 = (np.sqrt(n0 + g * g) - np.sqrt(n0)) / alpha
            z0, n0 = z0 + g - s0 * bias, n0 + g * g
            bias = -z0 * alpha / (beta + np.sqrt(n0))
    w = weights(z, n)
    at = np.flatnonzero(w)
    return SparseModel(at, w[at].astype(np.float32), float(bias))


def score_texts(dense: np.ndarray, bias: float, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    out = np.full(len(offsets) - 1, bias)
    for i, j in blocks(offsets):
        buckets, doc = features(data, offsets[i : j + 1])
        hit = np.flatnonzero(dense[buckets])
        once = np.unique(doc[hit] << BITS | buckets[hit])
        np.add.at(out, i + (once >> BITS), dense[once & ((1 << BITS) - 1)])
    return 1 / (1 + np.exp(-np.clip(out, -35, 35)))


def train_toxicity(documents: DataFrame, labels: DataFrame, label: str = "toxic", max_docs: int = 12000, max_bytes: int = 64 << 20) -> SparseModel:
    """Fit on whole texts of labelled documents that are not held out: at most ``max_docs``, with ``max_bytes`` together."""
    texts, y = labelled_texts(documents, labels, label, max_docs, max_bytes)
    return fit(texts, np.array(y))


def score_toxicity(documents: DataFrame, model: SparseModel, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; repeated rows stay repeated."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    buckets, weights, bias = model.buckets, model.weights, model.bias

    def run(batches):
        dense = SparseModel(buckets, weights, bias).dense()
        for b in batches:
            data, offsets = texts_of(b["text"])
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(score_texts(dense, bias, data, offsets))], ["doc_id", "score"])

    out = small_batches(documents).select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def toxicity_of(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return score_toxicity(documents, train_toxicity(documents, labels))
