"""Quality classifier: a byte-level convolutional network in numpy.

Every document is cut into overlapping chunks of 24 bytes at a stride of 8
that cover all of it. Learned filters over learned byte embeddings respond to
each chunk, the strongest response of each filter is kept, and a logistic unit
combines them. It is trained by back-propagation on the driver, on a bounded
sample of labelled documents; its parameters take about 25 kB.

Null and empty texts are one chunk of padding and get that chunk's score.
Scoring rounds embeddings and filters to whole multiples of 2**-19: their sums
of products are then exact in double precision, so that a score depends on the
text alone and not on where the text stands in a batch.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import blocks, held_out, small_batches, texts_of
from .samples import labelled_texts

STRIDE, PARTS, DIM, FILTERS = 8, 3, 6, 24


@dataclass
class ByteCnn:
    embed: np.ndarray  # 256 x DIM
    conv: np.ndarray  # STRIDE * DIM x PARTS * FILTERS
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def fresh(cls, seed: int) -> ByteCnn:
        rng = np.random.default_rng(seed)
        f = lambda *shape, by: (rng.standard_normal(shape) * by).astype(np.float32)
        return cls(f(256, DIM, by=0.5), f(STRIDE * DIM, PARTS * FILTERS, by=(PARTS * STRIDE * DIM) ** -0.5), np.zeros(FILTERS, np.float32), f(FILTERS, by=0.1), np.zeros(1, np.float32))

    def tensors(self) -> list[np.ndarray]:
        return [self.embed, self.conv, self.bias, self.out, self.out_bias]

    def responses(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Embedded bytes of each stride, and the filters' response to the chunk that begins there."""
        x = self.embed[rows].reshape(len(rows), STRIDE * DIM)
        z = x @ self.conv
        r = z[:-2, :FILTERS] + z[1:-1, FILTERS : 2 * FILTERS]
        r += z[2:, 2 * FILTERS :]
        r += self.bias
        return x, r

    def pooled_logit(self, pooled: np.ndarray) -> np.ndarray:
        return (np.maximum(pooled, 0) * self.out).sum(1) + self.out_bias  # each row by itself, which a matrix product isn't

    def exact(self) -> ByteCnn:
        """The network in double precision, with embeddings and filters below 8 in multiples of 2**-19: 48 products take 50 bits."""
        whole = lambda t: np.clip(np.rint(t.astype(np.float64) * 2**19), 1 - 2**22, 2**22 - 1) / 2**19
        return ByteCnn(whole(self.embed), whole(self.conv), *(t.astype(np.float64) for t in (self.bias, self.out, self.out_bias)))


def strided(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of STRIDE bytes, each document with two rows of padding after it, and the documents' first rows."""
    lengths = np.diff(offsets)
    rows = np.maximum(1, -(-lengths // STRIDE)) + PARTS - 1
    first = np.concatenate([[0], np.cumsum(rows)])
    flat = np.zeros(int(first[-1]) * STRIDE, np.uint8)
    begin = int(offsets[0])
    shift = np.repeat(first[:-1] * STRIDE - (offsets[:-1] - begin), lengths)
    flat[np.arange(len(shift)) + shift] = data[begin : int(offsets[-1])]
    return flat.reshape(-1, STRIDE), first


def pool(responses: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The largest response of each filter over the chunks of each document."""
    # the last two rows of a document are padding: chunks that begin there reach into the next one
    bounds = np.stack([first[:-1], np.minimum(first[1:] - (PARTS - 1), len(responses))], 1).ravel()
    if bounds[-1] == len(responses):
        bounds = bounds[:-1]
    return np.maximum.reduceat(responses, bounds, axis=0)[::2]


#: Rows of STRIDE bytes that go through the network at once.
PIECE = 1 << 16


def tops(net: ByteCnn, rows: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The largest response of each filter in each document, and the row of the chunk that gives it.

    Long documents go through in pieces that overlap by a chunk, so memory is
    bounded by the piece.
    """
    n = len(first) - 1
    top, best = np.full((n, FILTERS), -np.inf, np.float32), np.zeros((n, FILTERS), np.int64)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(first, first[i] + PIECE, "right")) - 1)
        for a in range(int(first[i]), int(first[j]) - PARTS + 1, PIECE):
            r = net.responses(rows[a : min(a + PIECE, int(first[j]) - PARTS + 1) + PARTS - 1])[1]
            for d in range(i, j):
                p, q = max(int(first[d]), a) - a, min(int(first[d + 1]) - PARTS + 1 - a, len(r))
                if q > p:
                    at = r[p:q].argmax(0)
                    value = r[p + at, np.arange(FILTERS)]
                    better = value > top[d]
                    top[d, better], best[d, better] = value[better], (a + p + at)[better]
        i = j
    return top, best


def fit(texts: list[bytes], labels: np.ndarray, seed: int = 7, steps: int = 600, batch: int = 32) -> ByteCnn:
    """Adam on the log loss; a step takes ``batch`` whole documents."""
    net, rng = ByteCnn.fresh(seed), np.random.default_rng(seed)
    if not len(texts):
        return net
    rate = float(np.clip(np.mean(labels), 0.01, 0.99))
    net.out_bias[:] = np.log(rate / (1 - rate))
    moments = [(np.zeros_like(t), np.zeros_like(t)) for t in net.tensors()]
    order: list[int] = []
    for step in range(1, steps + 1):
        if len(order) < batch:
            order += list(rng.permutation(len(texts)))
        take, order = order[:batch], order[batch:]
        offsets = np.concatenate([[0], np.cumsum([len(texts[i]) for i in take])])
        rows, first = strided(np.frombuffer(b"".join(texts[i] for i in take), np.uint8), offsets)
        top, best = tops(net, rows, first)
        p = 1 / (1 + np.exp(-net.pooled_logit(top)))
        d = ((p - labels[take]) / len(take)).astype(np.float32)
        d_top = d[:, None] * net.out * (top > 0)
        d_conv, d_embed = np.zeros_like(net.conv), np.zeros_like(net.embed)
        filters = np.broadcast_to(np.arange(FILTERS), best.shape)
        for k in range(PARTS):
            at = rows[best + k]
            cols = slice(k * FILTERS, (k + 1) * FILTERS)
            d_conv[:, cols] = np.einsum("nfx,nf->xf", net.embed[at].reshape(*best.shape, STRIDE * DIM), d_top)
            back = net.conv[:, cols].T[filters] * d_top[..., None]
            np.add.at(d_embed, at.ravel(), back.reshape(-1, DIM))
        grads = [d_embed, d_conv, d_top.sum(0), np.maximum(top, 0).T @ d, d.sum(keepdims=True)]
        lr = 0.01 * min(1.0, 2 * (1 - step / (steps + 1)))
        for t, g, (m, v) in zip(net.tensors(), grads, moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            t -= lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)
    return net


def score_texts(net: ByteCnn, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    net, out = net.exact(), np.zeros(len(offsets) - 1)
    for i, j in blocks(offsets, 1 << 18):
        rows, first = strided(data, offsets[i : j + 1])
        tops = []
        # a very long document goes through in pieces of rows that overlap by two
        if j == i + 1 and len(rows) > 1 << 16:
            for a in range(0, len(rows) - PARTS + 1, 1 << 15):
                tops.append(net.responses(rows[a : a + (1 << 15) + PARTS - 1])[1].max(0))
            top = np.max(tops, 0)[None]
        else:
            top = pool(net.responses(rows)[1], first)
        out[i:j] = 1 / (1 + np.exp(-net.pooled_logit(top)))
    return out


def train_quality(documents: DataFrame, labels: DataFrame, label: str = "quality", max_docs: int = 4000, max_bytes: int = 64 << 20) -> ByteCnn:
    """Fit on whole texts of labelled documents that are not held out: at most ``max_docs``, with ``max_bytes`` together."""
    texts, y = labelled_texts(documents, labels, label, max_docs, max_bytes)
    return fit(texts, np.array(y, np.float32))


def score_quality(documents: DataFrame, net: ByteCnn, threshold: float = 0.3) -> DataFrame:
    """The columns of ``documents`` that aren't named alike, with ``score`` and ``predicted``.

    ``score`` is in 0..1, ``predicted`` is 1 from ``threshold``. Rows are never
    dropped, repeated ids stay repeated.
    """
    own = small_batches(documents).drop("score", "predicted")
    names = own.columns
    schema = StructType([*own.schema.fields, StructField("score", DoubleType())])

    def run(batches):
        for b in batches:
            data, offsets = texts_of(b["text"])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score_texts(net, data, offsets))], [*names, "score"])

    return own.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def quality_of(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Train, then (doc_id, held_out, score, predicted) of every document."""
    net = train_quality(documents, labels)
    slim = small_batches(documents).select("doc_id", F.col("text").cast("string").alias("text"))
    return score_only(slim, net).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def score_only(slim: DataFrame, net: ByteCnn, threshold: float = 0.3) -> DataFrame:
    """As ``score_quality``, but texts don't go back to the JVM."""

    def run(batches):
        for b in batches:
            data, offsets = texts_of(b["text"])
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(score_texts(net, data, offsets))], ["doc_id", "score"])

    out = slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
