"""Language ID: a bidirectional gated recurrent network over bytes, in numpy.

Texts are cut into windows of 48 bytes that together cover everything. One
gated recurrent unit reads a window forwards, another backwards; from both
states each position gets a distribution over the languages, and a document's
probability of a language is the mean over its positions. Training is
back-propagation through time on the driver, over all windows of a bounded
sample of documents.

Documents whose text is null or has no letter are ``und`` with score 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, held_out, may_learn, small_batches, texts_of
from .samples import sampled

SPAN, HIDDEN, AT_ONCE = 48, 8, 1024


@dataclass
class Gru:
    """Input table (a byte's share of the gates), recurrent weights, recurrent bias of the candidate."""

    table: np.ndarray  # 3H x 256, gates r, u, candidate
    rec: np.ndarray  # 3H x H
    bias: np.ndarray  # H x 1

    @classmethod
    def fresh(cls, rng: np.random.Generator) -> Gru:
        return cls((rng.standard_normal((3 * HIDDEN, 256)) * 0.3).astype(np.float32), (rng.standard_normal((3 * HIDDEN, HIDDEN)) * HIDDEN**-0.5).astype(np.float32), np.zeros((HIDDEN, 1), np.float32))

    def run(self, x: np.ndarray, keep: bool = False):
        """States after each of the rows of bytes in ``x`` (time, batch); with ``keep`` what back-propagation needs."""
        h = np.zeros((HIDDEN, x.shape[1]), np.float32)
        states = np.empty((len(x), *h.shape), np.float32)
        trace = []
        for t, row in enumerate(x):
            a = np.take(self.table, row, axis=1)
            b = self.rec @ h
            gates = a[: 2 * HIDDEN]
            gates += b[: 2 * HIDDEN]
            gates *= 0.5
            np.tanh(gates, out=gates)
            gates += 1
            gates *= 0.5
            inner = b[2 * HIDDEN :]
            inner += self.bias
            c = gates[:HIDDEN] * inner
            c += a[2 * HIDDEN :]
            np.tanh(c, out=c)
            if keep:
                trace.append((h, gates.copy(), inner.copy(), c.copy()))
            new = h - c
            new *= gates[HIDDEN:]
            new += c  # c + u (h - c)
            states[t] = h = new
        return (states, trace) if keep else states

    def back(self, x: np.ndarray, trace: list, d_states: np.ndarray) -> list[np.ndarray]:
        d_table, d_rec, d_bias = np.zeros_like(self.table), np.zeros_like(self.rec), np.zeros_like(self.bias)
        by_byte = np.zeros((256, 3 * HIDDEN), np.float32)
        carry = np.zeros_like(d_states[0])
        for t in range(len(x) - 1, -1, -1):
            h, gates, inner, c = trace[t]
            r, u = gates[:HIDDEN], gates[HIDDEN:]
            d = d_states[t] + carry
            dc = d * (1 - u) * (1 - c * c)
            du = d * (h - c) * u * (1 - u)
            dr = dc * inner * r * (1 - r)
            d_in = np.concatenate([dr, du, dc * r])  # at the recurrent products
            d_rec += d_in @ h.T
            d_bias += (dc * r).sum(1, keepdims=True)
            carry = d * u + self.rec.T @ d_in
            np.add.at(by_byte, x[t], np.concatenate([dr, du, dc]).T)
        d_table += by_byte.T
        return [d_table, d_rec, d_bias]


@dataclass
class LanguageModel:
    languages: list[str]
    ahead: Gru
    behind: Gru
    out: np.ndarray  # languages x 2H
    out_bias: np.ndarray

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Probabilities (time, language, batch) of each position of ``x`` (time, batch)."""
        n = self.out.shape[1] // 2
        z = self.out[:, :n] @ self.ahead.run(x)
        z += self.out[:, n:] @ self.behind.run(x[::-1])[::-1]
        z += self.out_bias
        z -= z.max(1, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(1, keepdims=True)
        return z


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes by window, zero after a document's end; windows of each document (offsets); positions filled in each."""
    lengths = np.diff(offsets)
    n = np.maximum(1, -(-lengths // SPAN))
    first = np.concatenate([[0], np.cumsum(n)])
    flat = np.zeros(int(first[-1]) * SPAN, np.uint8)
    begin = int(offsets[0])
    flat[np.arange(int(lengths.sum())) + np.repeat(first[:-1] * SPAN - (offsets[:-1] - begin), lengths)] = data[begin : int(offsets[-1])]
    filled = np.full(int(first[-1]), SPAN)
    filled[first[1:] - 1] = lengths - (n - 1) * SPAN
    return flat.reshape(-1, SPAN), first, filled


def fit(x: np.ndarray, first: np.ndarray, y: np.ndarray, languages: list[str], seed: int = 5, steps: int = 600, batch: int = 192) -> LanguageModel:
    """Adam on the log loss of every position of windows ``x`` (window, SPAN).

    Document d has the windows from ``first[d]`` on and language number
    ``y[d]``; a step draws documents, then any window of each.
    """
    rng = np.random.default_rng(seed)
    k = len(languages)
    net = LanguageModel(languages, Gru.fresh(rng), Gru.fresh(rng), (rng.standard_normal((k, 2 * HIDDEN)) * 0.2).astype(np.float32), np.zeros((k, 1), np.float32))
    if not len(x):
        return net
    tensors = [*vars(net.ahead).values(), *vars(net.behind).values(), net.out, net.out_bias]
    moments = [(np.zeros_like(t), np.zeros_like(t)) for t in tensors]
    for step in range(1, steps + 1):
        doc = rng.integers(0, len(y), batch)
        take = first[doc] + (rng.random(batch) * (first[doc + 1] - first[doc])).astype(np.int64)
        xs = np.ascontiguousarray(x[take].T)
        ahead, trace_a = net.ahead.run(xs, True)
        behind, trace_b = net.behind.run(xs[::-1], True)
        behind = behind[::-1]
        both = np.concatenate([ahead, behind], 1)  # time, 2H, batch
        z = net.out @ both + net.out_bias
        z = np.exp(z - z.max(1, keepdims=True))
        z /= z.sum(1, keepdims=True)
        z[:, y[doc], np.arange(batch)] -= 1
        z *= (xs > 0)[:, None] / (batch * SPAN)
        d_both = net.out.T @ z
        grads = [*net.ahead.back(xs, trace_a, d_both[:, :HIDDEN]), *net.behind.back(xs[::-1], trace_b, d_both[::-1, HIDDEN:]), np.einsum("tkb,thb->kh", z, both), z.sum((0, 2))[:, None]]
        scale = min(1.0, 1.0 / (1e-9 + float(np.sqrt(sum((g * g).sum() for g in grads)))))
        lr = 0.02 * (1 - step / (steps + 1))
        for t, g, (m, v) in zip(tensors, grads, moments, strict=True):
            g = g * scale
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            t -= lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def document_probabilities(net: LanguageModel, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(document, language): the mean over the positions of each text; zeros for empty texts."""
    k = len(net.languages)
    out = np.zeros((len(offsets) - 1, k))
    place = np.arange(SPAN)[:, None]
    for i, j in blocks(offsets):
        x, first, filled = windows(data, offsets[i : j + 1])
        sums = np.empty((len(x), k))
        for a in range(0, len(x), AT_ONCE):
            p = net.positions(np.ascontiguousarray(x[a : a + AT_ONCE].T))
            part = filled[a : a + AT_ONCE]
            if (part < SPAN).any():
                p *= (place < part)[:, None]
            sums[a : a + AT_ONCE] = p.sum(0).T
        out[i:j] = np.add.reduceat(sums, first[:-1]) / np.maximum(1, np.diff(offsets[i : j + 1]))[:, None]
    return out


def train_language(documents: DataFrame, max_docs: int = 2000, max_bytes: int = 64 << 20) -> LanguageModel | None:
    """Fit on whole texts of documents with a language that aren't held out; None if there are none.

    At most ``max_docs`` documents, with ``max_bytes`` together, in the order of a hash of their ids.
    """
    rows = small_batches(documents).select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & may_learn())
    chosen = rows.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    got = [(r["text"].encode(), r["lang"]) for r in sampled(rows, [r["doc_id"] for r in chosen.collect()], max_bytes)]
    got = [(t, lang) for t, lang in got if t]
    if not got:
        return None
    languages = sorted({lang for _, lang in got})
    x, first, _ = windows(np.frombuffer(b"".join(t for t, _ in got), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t, _ in got])]))
    return fit(x, first, np.array([languages.index(lang) for _, lang in got]), languages)


def identify_language(documents: DataFrame, net: LanguageModel | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of ``documents``."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            has = b["letters"].to_numpy(zero_copy_only=False)
            names, score = np.full(b.num_rows, "und", object), np.zeros(b.num_rows)
            if net is not None:
                p = document_probabilities(net, *texts_of(b["text"]))
                best = p.argmax(1)
                names = np.where(has, np.array(net.languages, object)[best], "und")
                score = np.where(has, np.clip(p[np.arange(len(p)), best], 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    slim = small_batches(documents).select("doc_id", F.col("text").cast("string").alias("text"))
    slim = slim.withColumn("letters", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    out = slim.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def languages_of(documents: DataFrame) -> DataFrame:
    return identify_language(documents, train_language(documents))
