"""Outlines of polygons against brute force on points and on whole squares."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_spatial import box, shapes

from plexgrid.functions import geometry as G
from plexgrid.operators import models, outlines, resolve, spatial, tiling
from plexgrid.operators.kernels import overlay as O
from plexgrid.operators.kernels.polygons import convex_hull


def star(rng, n, x, y, r):
    angle, far = np.sort(rng.uniform(0, 2 * np.pi, n)), rng.uniform(0.3, 1, n) * r
    return [(x + float(d * np.cos(a)), y + float(d * np.sin(a))) for a, d in zip(angle, far, strict=True)]


def holds(ring, x, y):
    odd = np.zeros(x.shape, bool)
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
        if y1 != y2:
            odd ^= ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
    return odd


RULES = [lambda s: s.any(1), lambda s: s.all(1), lambda s: s[:, 0] & ~s[:, 1:].any(1), lambda s: s.sum(1) == 2]


@pytest.mark.parametrize("rule", range(len(RULES)))
def test_overlay_of_stars(rule):
    rng = np.random.default_rng(rule)
    x, y = rng.uniform(-3, 4, (2, 20_000))
    for _ in range(10):
        rings = [star(rng, n, a, b, 2) for n, a, b in ((20, 0, 0), (15, 1, 0.5), (9, 0.3, 0.2))]
        want = RULES[rule](np.stack([holds(r, x, y) for r in rings], 1))
        got = np.zeros(x.shape, bool)
        for r in O.overlay([[r] for r in rings], RULES[rule]):
            got ^= holds(r, x, y)
        assert (got == want).all()


@pytest.mark.parametrize("rule", range(len(RULES)))
def test_overlay_of_boxes_with_shared_borders(rule):
    rng = np.random.default_rng(rule)
    for _ in range(60):
        grid, rings = np.zeros((4, 6, 6), bool), []
        for k in range(4):
            (a, c), (b, d) = np.sort(rng.choice(6, 2, False)), np.sort(rng.choice(6, 2, False))
            grid[k, a:c, b:d] = True
            rings.append([[(int(a), int(b)), (int(c), int(b)), (int(c), int(d)), (int(a), int(d))]])
        want = RULES[rule](grid.reshape(4, -1).T).sum()
        assert O.area_of(O.overlay(rings, RULES[rule])) == pytest.approx(want)


def test_holes_and_touching_corners():
    rings = O.difference([box(0, 0, 9, 9)], [box(3, 3, 6, 6)])
    assert sorted(round(O.signed_area(r)) for r in rings) == [-9, 81]
    assert O.largest(rings) == box(0, 0, 9, 9)
    assert sorted(len(r) for r in O.union([box(0, 0, 1, 1)], [box(1, 1, 2, 2)])) == [4, 4]
    assert O.union([box(0, 0, 2, 2)], [box(2, 0, 4, 2)]) == [box(0, 0, 4, 2)]
    assert O.overlay([[]], lambda s: s.any(1)) == [] and O.largest([]) == []


def test_relations():
    named = lambda a, b: {k for k, f in O.PREDICATES.items() if f(O.relation(a, b))}
    big, small = box(0, 0, 4, 4), box(1, 1, 2, 2)
    assert named(big, small) == {"intersects", "contains", "covers", "contains_properly"}
    assert named(small, big) == {"intersects", "within", "covered_by"}
    assert named(big, box(0, 1, 2, 2)) == {"intersects", "contains", "covers"}
    assert named(big, box(4, 0, 5, 4)) == {"intersects", "touches"} == named(big, box(4, 4, 5, 5))
    assert named(big, box(2, 2, 6, 6)) == {"intersects", "overlaps"}
    assert named(big, box(7, 7, 8, 8)) == set()
    assert named(big, big) == {"intersects", "within", "covered_by", "contains", "covers"}


@pytest.mark.parametrize("predicate", sorted(spatial.BOX_PREDICATES))
def test_joins_of_boxes_and_of_rings_agree(spark, predicate):
    rng = np.random.default_rng(11)
    some = lambda n: shapes(spark, [box(int(x), int(y), int(x + w), int(y + h)) for x, y, w, h in zip(rng.integers(0, 9, n), rng.integers(0, 9, n), rng.integers(1, 7, n), rng.integers(1, 7, n), strict=True)])
    left, right = some(40), some(45)
    both = [sorted(map(tuple, spatial.sjoin(left, right, exact=how, predicate=predicate).collect())) for how in ("box", "polygon")]
    assert both[0] == both[1] and (bool(both[0]) or predicate == "crosses")


def test_unknown_relation(spark):
    with pytest.raises(ValueError, match="predicate"):
        spatial.sjoin(shapes(spark, [box(0, 0, 1, 1)]), shapes(spark, [box(0, 0, 1, 1)]), predicate="near")


def test_one_huge_shape_among_small_ones(spark):
    small = [box(10 * k, 10 * (k % 7), 10 * k + 1 + k % 3, 10 * (k % 7) + 2) for k in range(60)]
    huge = [box(-1e6, -1e6, 1e6, 1e6), box(5, 0, 25, 25)]
    got = sorted(map(tuple, spatial.sjoin(shapes(spark, small), shapes(spark, huge)).collect()))
    meet = lambda a, b: a[0][0] <= b[2][0] and b[0][0] <= a[2][0] and a[0][1] <= b[2][1] and b[0][1] <= a[2][1]
    assert got == sorted((i, j) for i, a in enumerate(small) for j, b in enumerate(huge) if meet(a, b))


def test_merged_outlines_are_unions(spark):
    hook = [(0, 0), (4, 0), (4, 2), (2, 2), (2, 4), (0, 4)]
    out = resolve.solve_conflicts(shapes(spark, [hook, box(1, 0, 5, 2), box(3, 3, 4, 4)]), 0.5)
    got = {r["source_ord"]: (r["merged"], r["a"]) for r in out.withColumn("a", G.area()).collect()}
    # the third lies in the hull of the hook, but not in the hook
    assert got == {0: (True, pytest.approx(14)), 2: (False, pytest.approx(1))}


def test_later_growth_is_seen(spark):
    # the first two share too little until the second has swallowed the third
    cells = [box(0, 0, 10, 2), box(9, 0, 13, 2), box(4, 0, 12.9, 2)]
    out = resolve.solve_conflicts(shapes(spark, cells), 0.5).withColumn("a", G.area()).collect()
    assert [(r["source_ord"], r["merged"], round(r["a"], 6)) for r in out] == [(0, True, 26.0)]


def test_shared_parts_go_to_the_nearest(spark):
    cells = shapes(spark, [box(0, 0, 4, 4), box(2, 0, 6, 4), box(20, 0, 22, 2), box(50, 0, 52, 2), box(50, 0, 52, 2)])
    out = {r["ord"]: r for r in outlines.remove_overlap(cells).withColumn("a", G.area()).collect()}
    assert [out[k]["a"] for k in range(3)] == pytest.approx([12, 12, 4]) and out[0]["xmax"] == pytest.approx(3) == out[1]["xmin"]
    assert out[3]["xs"] is None is out[4]["xs"]  # neither has a place of its own


def test_parted_cells_share_nothing_and_keep_what_they_hold_alone():
    rng = np.random.default_rng(5)
    x, y = rng.uniform(-3, 5, (2, 20_000))
    for _ in range(8):
        rings = [convex_hull(star(rng, 12, cx, cy, 2)) for cx, cy in ((0, 0), (1.2, 0.4), (0.2, 1.9))]
        meet = [[j for j in range(3) if j != i and O.relation(rings[i], rings[j])["meet"]] for i in range(3)]
        was = np.stack([holds(r, x, y) for r in rings])
        parts = O.split_cells(rings, meet)
        now = np.stack([holds(r, x, y) for r in parts])
        assert not (now.sum(0) > 1).any() and not (now & ~was).any()
        assert (now | (was.sum(0) != 1) | ~was).mean() > 0.999  # but for parts that are cut off


def test_dissolve(spark):
    rng = np.random.default_rng(6)
    grid, rings, group = np.zeros((2, 40, 40), bool), [], []
    for k in range(130):
        a, b, w, h = (int(v) for v in (*rng.integers(0, 34, 2), *rng.integers(1, 6, 2)))
        grid[k % 2, a : a + w, b : b + h] = True
        rings.append(box(a, b, a + w, b + h))
        group.append((k, "uv"[k % 2]))
    s = shapes(spark, rings).join(spark.createDataFrame(group, "ord long, g string"), "ord")
    out = outlines.dissolve(s, "g").withColumn("a", G.signed_area())
    assert {r["g"]: round(r["s"]) for r in out.groupBy("g").agg(F.sum("a").alias("s")).collect()} == {"u": grid[0].sum(), "v": grid[1].sum()}
    assert out.where("(a < 0) <> hole").isEmpty()


def test_repaired_rings(spark):
    bow, line = [(0, 0), (2, 2), (2, 0), (0, 4)], [(0, 0), (1, 1), (2, 2)]
    s = shapes(spark, [bow, line, box(5, 5, 7, 7)]).unionByName(spark.createDataFrame([(9, None, None, None, None, None, None)], "ord long, xs array<double>, ys array<double>, xmin double, ymin double, xmax double, ymax double"))
    out = {r["ord"]: r["a"] for r in outlines.valid_polygons(s).withColumn("a", G.area()).collect()}
    assert set(out) == {0, 2} and out[2] == pytest.approx(4) and out[0] == pytest.approx(8 / 3)


def test_regions_of_interest(spark):
    tiles = tiling.image_patches(spark, 30, 20, 10)
    roi = shapes(spark, [[(2, 2), (18, 2), (2, 18)], box(4, 4, 12, 6), box(20, 10, 30, 20)])
    got = {r["old_id"]: r for r in tiling.patches_in_polygons(tiles, roi).collect()}
    inside = lambda ring, x, y: holds(ring, x, y)
    x, y = (v.ravel() for v in np.meshgrid(np.arange(0.05, 30, 0.1), np.arange(0.05, 20, 0.1)))
    held = inside([(2, 2), (18, 2), (2, 18)], x, y) | inside(box(4, 4, 12, 6), x, y) | inside(box(20, 10, 30, 20), x, y)
    at = (y // 10 * 3 + x // 10).astype(int)
    for k in range(6):
        assert (got[k]["area"] if k in got else 0) == pytest.approx(held[at == k].sum() * 0.01, abs=0.6)
    assert sorted(r["patch_id"] for r in got.values()) == list(range(len(got)))
    centred = tiling.patches_with_centroids(tiles, roi)
    assert [(r["patch_id"], r["old_id"]) for r in centred.orderBy("patch_id").collect()] == [(0, 0), (1, 5)]


def test_models_without_their_libraries(spark):
    assert models.default_min_area(30) == 225
    with pytest.raises(ValueError, match="channels"):
        models.cellpose(30, ["a", "b", "c"])
    for method in (models.cellpose(30, ["a"]), models.stardist()):
        with pytest.raises(models.MissingLibrary):
            method(np.zeros((1, 4, 4)))
