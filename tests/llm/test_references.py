"""Operators against plain versions written from their definitions, and rows that tables may hold."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plexgrid.llm import decontaminate, language, lines, quality, toxicity

WORDS = [f"w{k}" for k in range(200)]


def prose(n, seed=0, words=40):
    r = random.Random(seed)
    return [" ".join(r.choice(WORDS) for _ in range(r.randint(1, words))) for _ in range(n)]


def flat(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in raw])]).astype(np.int64)


# quality: one chunk after the other, byte by byte


def convolution_score(net, raw):
    size, stride = quality.PARTS * quality.STRIDE, quality.STRIDE
    chunks = max(1, -(-len(raw) // stride))
    best = [-math.inf] * quality.FILTERS
    for c in range(chunks):
        chunk = [raw[c * stride + k] if c * stride + k < len(raw) else 0 for k in range(size)]
        for f in range(quality.FILTERS):
            z = float(net.bias[f])
            for k, byte in enumerate(chunk):
                part, at = divmod(k, stride)
                for e in range(quality.DIM):
                    z += float(net.embed[byte, e]) * float(net.conv[at * quality.DIM + e, part * quality.FILTERS + f])
            best[f] = max(best[f], z)
    logit = float(net.out_bias[0]) + sum(max(b, 0) * float(w) for b, w in zip(best, net.out, strict=True))
    return 1 / (1 + math.exp(-logit))


def test_quality_against_a_plain_convolution():
    rng = np.random.default_rng(1)
    net = quality.ByteCnn.fresh(4)
    net.bias[:] = rng.standard_normal(quality.FILTERS)
    net.out[:] = rng.standard_normal(quality.FILTERS)
    texts = ["", "a", "abcdefg", "abcdefgh", "x" * 24, "y" * 25, *prose(6, words=10)]
    got = quality.score_texts(net, *flat(texts))
    assert np.allclose(got, [convolution_score(net, t.encode()) for t in texts], atol=1e-5)


def test_quality_gradient_steps_lower_the_loss_of_long_texts(monkeypatch):
    texts = [(t * 40).encode() for t in prose(30)] + [(t * 40 + " bad bad bad").encode() for t in prose(30, 1)]
    y = np.array([1] * 30 + [0] * 30, np.float32)
    whole = quality.fit(texts, y, steps=80)
    monkeypatch.setattr(quality, "PIECE", 64)  # texts in many pieces give the same network
    pieces = quality.fit(texts, y, steps=80)
    assert all(np.allclose(a, b, atol=1e-3) for a, b in zip(whole.tensors(), pieces.tensors(), strict=True))
    p = quality.score_texts(whole, *flat([t.decode() for t in texts]))
    assert ((p > 0.5) == (y == 1)).mean() > 0.9  # the mark stands at the end of each text


# language: one step after the other, both directions


def recurrent_probabilities(net, raw):
    h = language.HIDDEN
    sums, n = np.zeros(len(net.languages)), 0
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    for begin in range(0, max(1, len(raw)), language.SPAN):
        window = list(raw[begin : begin + language.SPAN])
        padded = window + [0] * (language.SPAN - len(window))

        def states(cell, row):
            s, out = np.zeros(h), []
            for byte in row:
                a, b = cell.table[:, byte].astype(float), cell.rec.astype(float) @ s
                r, u = sigmoid(a[:h] + b[:h]), sigmoid(a[h : 2 * h] + b[h : 2 * h])
                c = np.tanh(a[2 * h :] + r * (b[2 * h :] + cell.bias[:, 0]))
                s = u * s + (1 - u) * c
                out.append(s)
            return out

        ahead, behind = states(net.ahead, padded), states(net.behind, padded[::-1])[::-1]
        for k in range(len(window)):
            z = net.out @ np.concatenate([ahead[k], behind[k]]) + net.out_bias[:, 0]
            e = np.exp(z - z.max())
            sums += e / e.sum()
            n += 1
    return sums / max(n, 1)


def test_language_against_a_plain_recurrent_network():
    rng = np.random.default_rng(2)
    k = 3
    net = language.LanguageModel(list("abc"), language.Gru.fresh(rng), language.Gru.fresh(rng), rng.standard_normal((k, 2 * language.HIDDEN)).astype(np.float32), rng.standard_normal((k, 1)).astype(np.float32))
    texts = ["", "a", "b" * 48, "c" * 49, "mixed é text " * 20, *prose(4)]
    got = language.document_probabilities(net, *flat(texts))
    for g, t in zip(got, texts, strict=True):
        assert np.allclose(g, recurrent_probabilities(net, t.encode()), atol=1e-4)


# toxicity: one coordinate after the other


def test_toxicity_against_plain_ftrl():
    texts = [t.encode() for t in prose(60, 3)]
    y = np.array([int("w1" in t.decode().split() or "w2" in t.decode().split()) for t in texts], float)
    alpha, beta, l1, l2, epochs, seed = 1.0, 1.0, 0.5, 0.1, 3, 11
    got = toxicity.fit(texts, y, epochs, alpha, beta, l1, l2, seed)
    sets = [sorted(set(toxicity.features(np.frombuffer(t, np.uint8), np.array([0, len(t)], np.int64))[0].tolist())) for t in texts]
    z, n, z0, n0 = {}, {}, 0.0, 0.0

    def weight(i):
        v = z.get(i, 0.0)
        return 0.0 if abs(v) <= l1 else -(v - math.copysign(l1, v)) / ((beta + math.sqrt(n.get(i, 0.0))) / alpha + l2)

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for d in rng.permutation(len(texts)):
            w = {i: weight(i) for i in sets[d]}
            b = -z0 * alpha / (beta + math.sqrt(n0))
            g = 1 / (1 + math.exp(-(sum(w.values()) + b))) - y[d]
            if abs(g) < 1e-4:
                continue
            for i in sets[d]:
                old = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / alpha * w[i]
                n[i] = old + g * g
            z0, n0 = z0 + g - (math.sqrt(n0 + g * g) - math.sqrt(n0)) / alpha * b, n0 + g * g
    want = {i: weight(i) for i in z if weight(i)}
    assert dict(zip(got.buckets.tolist(), got.weights.tolist(), strict=True)) == pytest.approx(want, rel=1e-4)
    assert got.bias == pytest.approx(-z0 * alpha / (beta + math.sqrt(n0)), rel=1e-6)
    scores = toxicity.score_texts(got.dense(), got.bias, *flat([t.decode() for t in texts]))
    plain = [1 / (1 + math.exp(-(got.bias + sum(want.get(i, 0.0) for i in s)))) for s in sets]
    assert np.allclose(scores, plain, atol=1e-4)


def test_features_are_words_pairs_and_skips():
    count = lambda t: len(set(toxicity.features(*flat([t]))[0].tolist()))
    assert count("a b c d") == 4 + 3 + 2 and count("a") == 1 and count("") == 0 and count("A, b; C d") == count("a b c d")
    assert count("a b") == 3 and count("a a a") == 1 + 1 + 1


# lines: what goes is found without the operator's chunks


def test_lines_against_runs_and_copies(spark):
    r = random.Random(4)
    fresh = iter(range(10**9))
    line = lambda n: " ".join(f"q{next(fresh)}" for _ in range(n))
    texts = []
    for k in range(12):
        passage = [line(r.choice([2, 9, 14, 30])) for _ in range(6)]
        texts.append("\n".join([line(7), *passage, line(5)]))
        texts.append("\n".join([line(3), line(12), *passage, line(6), line(2)]))
        if k % 3 == 0:
            texts.append(texts[-1])
    short = "one\ntwo"  # a document of two short lines is a chunk of several lines
    texts += [short, short, "single line only", "single line only", f"{line(4)}\n{line(4)}"]
    got = {x["doc_id"]: x["text"] for x in lines.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    seen_runs, seen_texts = set(), set()
    for i, t in enumerate(texts):
        ls = t.split("\n")
        runs = [(a, b) for a in range(len(ls)) for b in range(a + 1, len(ls) + 1) if sum(len(x.split()) for x in ls[a:b]) >= lines.LONG]
        gone = {k for a, b in runs if tuple(ls[a:b]) in seen_runs for k in range(a, b)}
        if len(ls) > 1 and t in seen_texts:
            gone = set(range(len(ls)))
        assert got[i] == "\n".join(x for k, x in enumerate(ls) if k not in gone), i
        seen_runs |= {tuple(ls[a:b]) for a, b in runs}
        seen_texts.add(t)
    assert got[len(texts) - 4] == "" and got[len(texts) - 2] == "single line only"


# rows and columns that tables may hold


def test_columns_with_any_name_stay(spark):
    rows = [(k, t, 1.5, k, k, "p", 7, 8, "o", k, k) for k, t in enumerate(["a b\nc d", "a b\nc d", "x", None])]
    d = spark.createDataFrame(rows, "doc_id long, text string, score double, _id long, _row long, _places string, n_lines int, n_removed int, _own string, `with space` long, predicted int")
    out = lines.dedup_lines(d).orderBy("doc_id").collect()
    assert [(r["_id"], r["_row"], r["_places"], r["_own"], r["with space"], r["score"]) for r in out] == [(k, k, "p", "o", k, 1.5) for k in range(4)]
    assert [r["n_removed"] for r in out] == [0, 2, 0, 0] and out[1]["text"] == ""


@pytest.mark.parametrize("kind", ["int", "long"])
def test_classifiers_take_ids_of_any_integer_type(spark, kind):
    d = spark.createDataFrame([(k, t) for k, t in enumerate(prose(40))] + [(None, "null id")], f"doc_id {kind}, text string")
    lab = spark.createDataFrame([(k, k % 2, k % 3 == 0) for k in range(40)], f"doc_id {kind}, quality int, toxic boolean").withColumn("toxic", F.col("toxic").cast("int"))
    for out in (quality.quality_of(d, lab), toxicity.toxicity_of(d, lab), language.languages_of(d.withColumn("lang", F.lit("en")))):
        got = out.collect()
        assert len(got) == 41 and all(r["held_out"] is not None for r in got) and out.schema["doc_id"].dataType.simpleString() in ("int", "bigint")


def test_training_takes_whole_texts(spark):
    from plexgrid.llm.samples import labelled_texts

    long = "word " * 50_000 + "end"
    d = spark.createDataFrame([(k, long) for k in range(10)], "doc_id long, text string")
    lab = spark.createDataFrame([(k, 1) for k in range(10)], "doc_id long, quality int")
    texts, y = labelled_texts(d, lab, "quality", 3, 1 << 30)
    assert len(texts) == 3 == len(y) and all(t == long.encode() for t in texts)
    assert len(labelled_texts(d, lab, "quality", 10, 2 * len(long) + 5)[0]) == 2
    net = language.train_language(d.withColumn("lang", F.lit("en")))
    assert net.languages == ["en"]


def test_contamination_of_rows_without_or_with_repeated_ids(spark):
    item = "this is a test item with quite a few words in it"
    bench = spark.createDataFrame([(5, item), (6, item), (7, None), (None, "another item that is long enough to count here")], "item_id long, text string")
    rows = [(None, f"x {item} y"), (None, "clean text"), (1, f"{item}"), (1, "clean text of the same id"), (2, None), (3, "x another item that is long enough to count here")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["contaminated"], r["n_items"]) for r in decontaminate.contamination(d, bench).collect())
    assert got == [(-1, False, 0), (-1, True, 2), (1, False, 0), (1, True, 2), (2, False, 0), (3, True, 0)]
    assert sorted((r["doc_id"] or -1, r["item_id"] or -1) for r in decontaminate.matches(d, bench).collect()) == [(-1, 5), (-1, 6), (1, 5), (1, 6), (3, -1)]


def test_stages_keep_columns_and_rows_of_their_own(spark, tmp_path):
    item = "this is a test item with quite a few words in it"
    rows = [(k, t, 7.5, 3, 4, "k", "h") for k, t in enumerate(prose(30, 9))] + [(None, "no id but text", 7.5, 3, 4, "k", "h"), (None, f"z {item}", 7.5, 3, 4, "k", "h"), (40, None, 7.5, 3, 4, "k", "h")]
    d = spark.createDataFrame(rows, "doc_id int, text string, score double, n_lines int, n_removed int, _kept string, _held string")
    spark.createDataFrame([(k, int(k % 4 > 0)) for k in range(30)], "doc_id int, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, d, str(tmp_path))
        assert out.columns == d.columns and [f.dataType for f in out.schema] == [f.dataType for f in d.schema], name
        got = out.collect()
        assert got and all((r["score"], r["n_lines"], r["n_removed"], r["_kept"], r["_held"]) == (7.5, 3, 4, "k", "h") for r in got), name
        texts = [r["text"] for r in got if r["doc_id"] is None]
        if name == "decontamination":
            assert texts == ["no id but text"]
        elif name != "quality":
            assert sorted(texts) == ["no id but text", f"z {item}"]
