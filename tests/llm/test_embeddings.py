"""Embedding near-dedup against brute force."""

import numpy as np
import pytest

from plexgrid.llm import embeddings
from plexgrid.llm.embeddings import Codes, near_vectors


def brute(x, threshold=0.9):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= threshold
    np.fill_diagonal(near, False)
    root = np.arange(len(x))
    for _ in range(len(x)):
        new = np.minimum(root, np.where(near, root[None, :], len(x)).min(1))
        if (new == root).all():
            break
        root = new
    return near.sum(1), root


def frame(spark, vectors, ids=None):
    rows = [(int(i) if i is not None else None, None if v is None else [None if a is None else float(a) for a in v], "x", "x", "x") for i, v in zip(range(len(vectors)) if ids is None else ids, vectors, strict=True)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, key string, rep string, copies string")


@pytest.mark.parametrize("tile", [512, 8])
def test_against_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(embeddings, "TILE", tile)
    rng = np.random.default_rng(0)
    base = rng.standard_normal((60, 32))
    x = np.concatenate([base, *(base[k] + rng.standard_normal((m, 32)) * s for k, m, s in ((0, 40, 0.1), (1, 10, 0.3), (2, 5, 0.4), (3, 30, 0.45))), base[4:8], base[4:8] * 3]).astype(np.float32).astype(float)
    n, root = brute(x)
    got = near_vectors(frame(spark, x)).orderBy("vec_id").collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sure = u @ u.T
    edge = ((sure > 0.9) & (sure < 0.903)).any()  # pairs at the threshold may be missed, if rarely
    differ = sum(r["n_links"] != k for r, k in zip(got, n, strict=True))
    assert differ <= (4 if edge else 0)
    assert all(r["n_links"] <= k for r, k in zip(got, n, strict=True))
    if not differ:
        assert [r["component_id"] for r in got] == root.tolist()
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_odd_vectors(spark):
    v = [1.0, 2.0, 3.0]
    rows = [v, v, None, [0, 0, 0], [1, None, 2], [1, float("nan"), 2], [1, float("inf"), 2], [], [1, 2], [2e30, 4e30, 6e30], [-0.0, 0.0, 1.0], [0.0, 0.0, 1.0], [2, 4]]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_vectors(frame(spark, rows)).collect()}
    assert got[0] == (2, 0, True) and got[1] == (2, 0, False) and got[9] == (2, 0, False)
    assert all(got[k] == (0, k, True) for k in range(2, 8))
    assert got[8] == (1, 8, True) and got[12] == (1, 8, False)  # vectors of another length link among themselves
    assert got[10] == (1, 10, True) and got[11] == (1, 10, False)
    assert near_vectors(frame(spark, [])).count() == 0
    assert near_vectors(frame(spark, [None, [0.0]])).count() == 2
    null = near_vectors(frame(spark, [v, v], [None, 1])).collect()
    assert sorted((r["vec_id"] or 0, r["n_links"], r["kept"]) for r in null) == [(0, 0, True), (1, 0, True)]


def test_estimates_are_unbiased():
    rng = np.random.default_rng(1)
    a, b = rng.standard_normal((2, 64))
    a, b = a / np.linalg.norm(a), b / np.linalg.norm(b)
    b = 0.9 * a + (1 - 0.81) ** 0.5 * (b - (a @ b) * a) / np.linalg.norm(b - (a @ b) * a)
    found, inside = [], 0
    for seed in range(300):
        t = Codes(64, 10_000, 0.9, 1e-4, seed)
        code, f = t.of(np.stack([a, b]))
        r, s = t.rebuilt(code, f), t.spread(f)
        e = (r[0][0] @ r[1][1] + r[1][0] @ r[0][1]) / 2
        found.append(e)
        inside += abs(e - 0.9) <= embeddings.BOUND * np.hypot(s[0], s[1])
    assert np.mean(found) == pytest.approx(0.9, abs=0.01) and inside == 300


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((400, 48))
    x = np.concatenate([base, *(base + rng.standard_normal((400, 48)) * s for s in (0.2, 0.35, 0.44, 0.47))])
    n, root = brute(x.astype(np.float32).astype(float))
    got = near_vectors(frame(spark, x.astype(np.float32))).orderBy("vec_id").collect()
    found = sum(r["n_links"] for r in got)
    assert n.sum() > 1000 and 0.999 * n.sum() <= found <= n.sum()
    assert np.mean([r["component_id"] == c for r, c in zip(got, root, strict=True)]) > 0.99


def test_few_components_and_several_lengths(spark):
    rng = np.random.default_rng(5)
    parts = [rng.standard_normal((50, d)).astype(np.float32) for d in (1, 2, 3, 5)]
    got = {r["vec_id"]: r for r in near_vectors(frame(spark, [v for p in parts for v in p])).collect()}
    at = 0
    for p in parts:
        n, root = brute(p.astype(float))
        assert sum(got[at + k]["n_links"] != n[k] for k in range(50)) <= 2
        if all(got[at + k]["n_links"] == n[k] for k in range(50)):
            assert [got[at + k]["component_id"] for k in range(50)] == (root + at).tolist()
        at += 50


def test_repeated_ids_are_one_vector(spark):
    got = near_vectors(frame(spark, [[1, 0, 0], [1, 0, 0], [0, 1, 0], [1, 0.1, 0], [1, 0, 0]], [7, 7, 7, 3, 9])).collect()
    assert len(got) == 5 and len({(r["n_links"], r["component_id"]) for r in got if r["vec_id"] == 7}) == 1
    assert {r["component_id"] for r in got if r["vec_id"] in (3, 9)} == {3}
