"""Spatial operators against brute force and hand-computed cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plexgrid.functions import geometry as G
from plexgrid.functions import text as T
from plexgrid.model import Affine, Dataset
from plexgrid.operators import aggregate, graph, niches, resolve, spatial, staining, tiling
from plexgrid.operators.kernels import raster
from plexgrid.operators.kernels.polygons import clip_area, fit_vertices, rings_intersect, simplify
from plexgrid.sources import readers, sinks


def shapes(spark, rings):
    df = spark.createDataFrame([(i, [float(x) for x, _ in r], [float(y) for _, y in r]) for i, r in enumerate(rings)], "ord long, xs array<double>, ys array<double>")
    return G.with_bounds(df)


def box(a, b, c, d, by=0.0):
    return [(a - by, b - by), (c + by, b - by), (c + by, d + by), (a - by, d + by)]


def matrix(counts, n, genes):
    got = {(r["ord"], r["gene"]): r["n"] for r in counts.collect()}
    return [[got.get((i, g), 0) for g in genes] for i in range(n)]


RNG = np.random.default_rng(17)
#: Points on whole numbers, so that many lie on borders.
POINTS = [(int(x), int(y), str(g)) for x, y, g in zip(RNG.integers(0, 12, 150), RNG.integers(0, 12, 150), RNG.choice(["g1", "g2", "g3", "blank_9", "NegControl"], 150), strict=True)] + [(4, 4, None)]
CELLS = [[(1, 1), (9, 2), (5, 8)], [(3, 3), (11, 3), (11, 10), (3, 10)], [(0, 6), (4, 2), (8, 6), (4, 11)], [(2, 0), (10, 0), (10, 5), (6, 2), (2, 5)]]


def holds(ring, x, y):
    """By whole numbers: on an edge, or an odd number of edges to the right."""
    odd = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
        cross = (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)
        if cross == 0 and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
            return True
        if (y1 > y) != (y2 > y) and (cross > 0) == (y2 > y1):
            odd = not odd
    return odd


def counted(genes):
    return [[sum(g == gene and holds(c, x, y) for x, y, g in POINTS) for gene in genes] for c in CELLS]


def point_frame(spark):
    return spark.createDataFrame([(float(x), float(y), g) for x, y, g in POINTS], "x double, y double, gene string")


def test_counts_with_borders(spark):
    p, c = point_frame(spark), shapes(spark, CELLS)
    assert matrix(aggregate.count_transcripts(p, c), 4, ["g1", "g2", "g3"]) == counted(["g1", "g2", "g3"])
    assert matrix(aggregate.count_transcripts(p, c, only_excluded=True), 4, ["blank_9", "NegControl"]) == counted(["blank_9", "NegControl"])
    dense = aggregate.completed(aggregate.count_transcripts(p, c), c, aggregate.features(p))
    assert dense.count() == 12


def test_boxes_need_no_test_of_edges(spark):
    rings = [box(0, 0, 4, 2), [(0, 2), (0, 0), (4, 0), (4, 2)], [(0, 0), (4, 2), (4, 0), (0, 2)], [(0, 0), (4, 0), (2, 2)], [(0, 0), (2, 0), (4, 0), (4, 2), (0, 2)], [(0, 1), (2, 0), (4, 1), (2, 2)]]
    assert [r["b"] for r in shapes(spark, rings).select("ord", G.is_box().alias("b")).orderBy("ord").collect()] == [True, True, False, False, False, False]


def test_low_quality_points_are_left_out(spark):
    rows = [(float(k), 0.5 * k, f"g{k % 2}", None if k == 6 else k % 3 == 0) for k in range(9)]
    p = spark.createDataFrame(rows, "x double, y double, gene string, low_quality_transcript boolean")
    assert matrix(aggregate.count_transcripts(p, shapes(spark, [box(0, 0, 7, 7)])), 1, ["g0", "g1"]) == [[3, 3]]


def test_all_cells_filtered_is_an_error(spark):
    p, c = point_frame(spark), shapes(spark, CELLS)
    with pytest.raises(ValueError, match="filtered"):
        aggregate.aggregate(c, p, min_transcripts=10_000)
    flagged = aggregate.aggregate(c, p, min_transcripts=10_000, drop=False)["cells"].collect()
    assert len(flagged) == 4 and not any(r["passes_filtering"] for r in flagged)
    counts = aggregate.count_transcripts(p, c)
    genes = spark.createDataFrame([("g1",), ("never",)], "gene string")
    assert [tuple(r) for r in aggregate.low_count_genes(counts, 4, genes=genes).collect()] == [("never", 0.0)]


def test_random_counts_come_back(spark):
    rng = np.random.default_rng(0)
    n = rng.poisson(1, (40, 13))
    rows = [(2.0 * i + float(dx), 2.0 * i + 1 + float(dy), f"g{j:02d}") for i in range(40) for j in range(13) for dx, dy in rng.uniform(-0.4, 0.4, (n[i, j], 2))]
    p = spark.createDataFrame(rows, "x double, y double, gene string")
    c = shapes(spark, [box(2 * i - 0.5, 2 * i + 0.5, 2 * i + 0.5, 2 * i + 1.5) for i in range(40)])
    assert matrix(aggregate.count_transcripts(p, c), 40, [f"g{j:02d}" for j in range(13)]) == n.tolist()


def test_first_match(spark):
    rng = np.random.default_rng(2)
    boxes = [(int(x), int(y), int(x + w), int(y + h)) for x, y, w, h in zip(rng.integers(0, 40, 9), rng.integers(0, 40, 9), rng.integers(3, 15, 9), rng.integers(3, 15, 9), strict=True)]
    at = [(int(x), int(y)) for x, y in rng.integers(0, 55, (80, 2))]
    first = [next((k for k, (a, b, c, d) in enumerate(boxes) if a <= x <= c and b <= y <= d), None) for x, y in at]
    c = shapes(spark, [box(*b) for b in boxes])
    p = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(at)], "id int, x double, y double")
    by = lambda u: [r["cell"] for r in spatial.assign_first(p, c, ["id"], u).orderBy("id").collect()]
    assert by(None) == first and len(set(first)) > 5
    assert by(0) == [0 if k is None else k + 1 for k in first]


@pytest.mark.parametrize("exact", ["box", "polygon"])
def test_shapes_that_meet(spark, exact):
    rng = np.random.default_rng(3)
    some = lambda n: [(int(x), int(y), int(x) + int(w), int(y) + int(h)) for x, y, w, h in zip(rng.integers(0, 30, n), rng.integers(0, 30, n), rng.integers(1, 9, n), rng.integers(1, 9, n), strict=True)]
    one, two = some(12), [*some(10), (100, 100, 101, 101)]
    a, b = shapes(spark, [box(*v) for v in one]), shapes(spark, [box(*v) for v in two])

    def meets(u, v):
        return u[0] <= v[2] and v[0] <= u[2] and u[1] <= v[3] and v[1] <= u[3]

    for x, y, left, right in ((a, b, one, two), (b, a, two, one)):
        got = [(r["left_key"], r["right_key"]) for r in spatial.sjoin(x, y, "left", exact).orderBy("left_key", "right_key").collect()]
        want = [(i, j) for i, u in enumerate(left) for j in ([j for j, v in enumerate(right) if meets(u, v)] or [None])]
        assert got == want


def test_bins(spark):
    rng = np.random.default_rng(4)
    at = [(2 * i + 1, 2 * j + 1) for i in range(6) for j in range(6)]
    n = rng.integers(0, 9, (36, 3))
    bins = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(at)], "bin_id int, x double, y double")
    counts = spark.createDataFrame([(i, f"g{k}", int(n[i, k])) for i in range(36) for k in range(3)], "bin_id int, gene string, n long")
    want = [[int(sum(n[i, k] for i, (x, y) in enumerate(at) if holds(c, x, y))) for k in range(3)] for c in CELLS]
    assert matrix(aggregate.aggregate_bins(bins, counts, shapes(spark, CELLS)), 4, ["g0", "g1", "g2"]) == want


def test_shared_bins_go_to_the_like_cell(spark):
    # two discs that overlap; bins on the left hold red, on the right blue, and the two shared ones a little more of either
    at = [(0, 0, "red", 8), (1, 0, "red", 9), (3, 0, "red", 7), (3, 1, "blue", 7), (5, 0, "blue", 9), (6, 0, "blue", 8)]
    bins = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y, _, _) in enumerate(at)], "bin_id int, x double, y double")
    counts = spark.createDataFrame([(i, g, n) for i, (_, _, g, n) in enumerate(at)], "bin_id int, gene string, n long")
    disc = lambda x, y, r: [(x + r * np.cos(t), y + r * np.sin(t)) for t in np.linspace(0, 2 * np.pi, 90, endpoint=False)]
    c = shapes(spark, [disc(1.5, 0.5, 2.2), disc(4.5, 0.5, 2.2)])
    hits = spatial.points_in_shapes(bins, c).select("bin_id", "ord").cache()
    total = lambda h: matrix(h.join(counts, "bin_id").groupBy("ord", "gene").agg(F.sum("n").alias("n")), 2, ["red", "blue"])
    assert total(hits) == [[24, 7], [7, 24]]
    assert total(aggregate.assign_bins_once(hits, counts)) == [[24, 0], [0, 24]]


def test_channels(spark):
    image = np.random.default_rng(5).integers(0, 200, (2, 20, 17))
    names = ["ch_a", "ch_b"]
    p = spark.createDataFrame([(names[k], y, x, int(image[k, y, x])) for k in range(2) for y in range(20) for x in range(17)], "c string, y int, x int, value int")
    at = [(2, 5, 6, 9), (0, 0, 3, 12), (10, 11, 16, 19)]
    cells = shapes(spark, [box(*b) for b in at])
    for mode, f in (("average", np.mean), ("min", np.min), ("max", np.max)):
        got = {(r["ord"], r["channel"]): r["value"] for r in aggregate.aggregate_channels(p, cells, mode).collect()}
        for i, (x1, y1, x2, y2) in enumerate(at):
            for k, c in enumerate(names):
                inside = [image[k, y, x] for y in range(20) for x in range(17) if x1 <= x <= x2 and y1 <= y <= y2]
                assert got[i, c] == pytest.approx(f(inside))


def test_tiles(spark):
    for side, w, o in ((700, 250, 50), (640, 640, 0), (333, 90, 15)):
        along = 1
        while w + (along - 1) * (w - o) < side:
            along += 1
        assert tiling.image_patches(spark, side, side, w, o).count() == along**2
    rng = np.random.default_rng(6)
    xy = [(0.0, 0.0), (8.0, 8.0), *((float(a), float(b)) for a, b in rng.uniform(0, 8, (40, 2)))]
    p = spark.createDataFrame([(x, y, f"n{i:02d}") for i, (x, y) in enumerate(xy)], "x double, y double, gene string")
    got = tiling.in_patches(p, *tiling.transcript_axes(p, 4.0, 0)).groupBy("patch_id").agg(F.sort_array(F.collect_list("gene")).alias("g"))
    want: dict = {}
    for i, (x, y) in enumerate(xy):
        want.setdefault(2 * int(y >= 4) + int(x >= 4), []).append(f"n{i:02d}")
    assert {r["patch_id"]: r["g"] for r in got.collect()} == want
    with pytest.raises(ValueError):
        tiling.patch_count(10, 2, 3)


def test_gene_names(spark):
    kept, gone = ["ACTB", "cd_blank", "Negative", "NANOG2x"], ["nan", "BLANK-01", "my Control 7", "antisense_x", "Unassigned1", "Deprecated", "INTERGENIC", "FalseCode"]
    gone += ["NEGprobe", "Negative"]
    kept = [g for g in kept if g != "Negative" and not g.lower().startswith("nan")]
    df = spark.createDataFrame([(g,) for g in [*kept, *gone, None]], "gene string")
    out = {r["gene"]: r["x"] for r in df.withColumn("x", T.excluded()).collect()}
    assert {g for g, x in out.items() if not x} == set(kept) and out[None]
    assert not any(r["x"] for r in df.withColumn("x", T.excluded(pattern=None)).collect())
    flags = {r["gene"]: [f for f in T.GENE_FLAGS if r[f]] for r in df.withColumns(T.gene_flags()).collect()}
    assert flags["NEGprobe"] == ["is_negative_control_probe"] and flags["BLANK-01"] == ["is_blank_codeword"] and flags["FalseCode"] == ["is_deprecated"] and flags["ACTB"] == ["is_gene"]


def test_recode(spark):
    rec = lambda v, u, kind: [r["prior"] for r in tiling.recode_unassigned(spark.createDataFrame([(i, x) for i, x in enumerate(v)], f"i int, c {kind}"), "c", u).orderBy("i").collect()]
    named = rec(["k7", "none", "k2", "k7", "none", "k9"], "none", "string")
    assert named[1] == named[4] == 0 and named[0] == named[3] and len({named[0], named[2], named[5], 0}) == 4
    assert rec([5, 99, 0, 99], 99, "long") == [5, 0, (1 << 63) - 2, 0]
    assert rec([0, 3, 3, 8], 0, "int") == [0, 3, 3, 8]
    with pytest.raises(ValueError):
        rec([2.5], 0, "double")


def test_cell_names(spark):
    def name(k):
        out = ""
        for _ in range(8):
            out, k = "abcdefghijklmnop"[k % 16] + out, k // 16
        return out + "-1"

    numbers = [0, 5, 15, 16, 255, 256, 4095, 123_456, (1 << 32) - 1]
    df = spark.createDataFrame([(k,) for k in numbers], "id long").withColumn("s", T.cell_name("id"))
    rows = df.withColumn("back", T.cell_number("s")).orderBy("id").collect()
    assert [r["s"] for r in rows] == [name(k) for k in numbers] and [r["back"] for r in rows] == numbers
    good, bad = ["mnopabcd-1", "ppppbbbb", "ABCDefgh-9"], ["mnopabcd-", "mnopabc7", "mnopabcd-10", "mnop", ""]
    df = spark.createDataFrame([(x,) for x in good + bad], "s string")
    assert {r["s"] for r in df.where(T.is_cell_name("s")).collect()} == set(good)


def nodes(spark, at, niche=None):
    rows = [(0, i, float(x), float(y), niche[i] if niche else "even" if i % 2 == 0 else "odd" if i % 3 else "third") for i, (x, y) in enumerate(at)]
    return spark.createDataFrame(rows, "lib int, node long, x double, y double, niche string")


def neighbours_by_brute_force(at, most):
    """Edges of the triangles whose circle holds no other point, up to a length."""
    edges = set()
    n = len(at)
    for a in range(n):
        for b in range(a + 1, n):
            for c in range(b + 1, n):
                (ax, ay), (bx, by), (cx, cy) = at[a], at[b], at[c]
                d = 2 * (ax * (by - cy) + bx * (cy - ay) + cx * (ay - by))
                if abs(d) < 1e-12:
                    continue
                ux = ((ax * ax + ay * ay) * (by - cy) + (bx * bx + by * by) * (cy - ay) + (cx * cx + cy * cy) * (ay - by)) / d
                uy = ((ax * ax + ay * ay) * (cx - bx) + (bx * bx + by * by) * (ax - cx) + (cx * cx + cy * cy) * (bx - ax)) / d
                r = (ax - ux) ** 2 + (ay - uy) ** 2
                if all((x - ux) ** 2 + (y - uy) ** 2 >= r - 1e-9 for x, y in at):
                    edges |= {(a, b), (a, c), (b, c)}
    return {(a, b) for a, b in edges if np.hypot(at[a][0] - at[b][0], at[a][1] - at[b][1]) <= most}


def test_hops(spark):
    at = [tuple(v) for v in np.random.default_rng(7).uniform(0, 10, (24, 2)).tolist()]
    n = nodes(spark, at)
    edges = neighbours_by_brute_force(at, 4.0)
    e = graph.spatial_neighbors(n, (0.0, 4.0)).cache()
    assert {(min(r["src"], r["dst"]), max(r["src"], r["dst"])) for r in e.collect()} == edges
    group = {r["node"]: r["niche"] for r in n.collect()}
    near = {k: {b for a, b in edges if a == k} | {a for a, b in edges if b == k} for k in range(24)}
    want = {}
    for k in range(24):
        front, seen, hop = {k}, {k}, 0
        while front:
            for v in front:
                want.setdefault((k, group[v]), hop)
            front, hop = {w for v in front for w in near[v]} - seen, hop + 1
            seen |= front
    hops = graph.cells_to_groups(n, e, "niche").cache()
    assert {(r["node"], r["grp"]): r["hops"] for r in hops.collect() if r["hops"] is not None} == want
    m = {r["target"]: r["hops"] for r in graph.mean_distance(n, hops, "niche").where("grp = 'odd'").collect()}
    for g in set(group.values()):
        of = [want[k, g] for k in range(24) if group[k] == "odd" and (k, g) in want]
        assert m[g] == pytest.approx(np.mean(of))
    zero = graph.cells_to_groups(n, e, "niche", ignore_zeros=True)
    assert min(r["hops"] for r in zero.collect() if r["hops"] is not None) == 1


def test_niches(spark):
    # two triangles with sides 3, 4 and 5, six apart
    n = nodes(spark, [(0, 0), (4, 0), (0, 3), (10, 0), (13, 0), (10, 4)], ["u", "u", "u", "v", "v", "v"])
    tri = graph.delaunay(n)
    e = graph.pruned(graph.triangle_edges(tri, n), 5.5)
    parts = niches.niche_components(niches.niche_triangles(tri, n, e)).cache()
    geo = niches.component_geometry(parts, n).collect()
    assert len(geo) == 2
    assert all(r["area"] == pytest.approx(6) and r["length"] == pytest.approx(12) for r in geo)
    d = {r["target"]: r["distance"] for r in niches.niche_distances(parts, n).where("niche = 'u'").collect()}
    assert d == pytest.approx({"u": 0, "v": 6})


def test_conflicts(spark):
    c = shapes(spark, [box(0, 0, 4, 4), box(1, 0, 5, 4), box(3.9, 0, 8, 4), box(20, 20, 22, 22)])
    out = resolve.solve_conflicts(c, 0.5).orderBy("ord").collect()
    assert [(r["source_ord"], r["merged"]) for r in out] == [(2, False), (3, False), (0, True)]
    assert resolve.combine([c.where("ord = 3"), c.where("ord = 3")], 0.5).count() == 1


def test_overlay(spark):
    was = [(0, 0, 10, 10), (20, 0, 30, 10), (40, 0, 44, 4), (60, 0, 70, 10), (8, 20, 12, 30)]
    laid = [(5, -2, 16, 12), (27, 0, 35, 10), (39, -1, 46, 9), (0, 40, 5, 45)]
    shared = lambda u, v: max(0, min(u[2], v[2]) - max(u[0], v[0])) * max(0, min(u[3], v[3]) - max(u[1], v[1]))
    stay = [k for k, u in enumerate(was) if max(shared(u, v) for v in laid) / ((u[2] - u[0]) * (u[3] - u[1])) < 0.4]
    assert stay == [1, 3, 4]
    old, new = shapes(spark, [box(*b) for b in was]), shapes(spark, [box(*b) for b in laid])
    out = aggregate.overlay_segmentation(old, new, threshold=0.4)["cells"].orderBy("ord").collect()
    assert [(r["source_ord"], r["is_overlay"]) for r in out] == [(k, False) for k in stay] + [(k, True) for k in range(4)]


def test_transforms(spark):
    p = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0)], "x double, y double")
    d = Dataset()
    d.add("points", "p", p, "transcripts", {"global": Affine.scale(2)})
    d.add("shapes", "s", shapes(spark, [box(0, 0, 1, 1)]), None, {"global": Affine()})
    out = d.between("p", "s").points(p).collect()
    assert [(r["x"], r["y"]) for r in out] == [(2, 2), (4, 4)]
    assert d.rebased("p", "global")["global"].identity
    with pytest.raises(ValueError):
        Affine.from_array([[1, 0, 1, 0], [0, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1]], "xyz")
    d.add("shapes", "cellpose_boundaries", shapes(spark, [box(0, 0, 1, 1)]))
    assert d.boundaries()[0] == "cellpose_boundaries"
    with pytest.raises(ValueError):
        d.get("shapes")


def test_polygons():
    assert rings_intersect(box(0, 0, 2, 2), box(1, 1, 3, 3)) and not rings_intersect(box(0, 0, 1, 1), box(2, 2, 3, 3))
    assert rings_intersect(box(0, 0, 9, 9), box(1, 1, 2, 2))
    assert clip_area(box(0, 0, 2, 2), box(1, 1, 3, 3)) == pytest.approx(1)
    ring = [(np.cos(t), np.sin(t)) for t in np.linspace(0, 2 * np.pi, 100, endpoint=False)]
    assert len(simplify(ring, 0.1)) < 20
    assert len(fit_vertices([(100 * x, 100 * y) for x, y in ring], 13)) == 13
    assert len(fit_vertices(box(0, 0, 1, 1), 13)) == 13


def test_masks():
    m = raster.rasterize([(2, 3), (2, 7), (6, 7), (6, 3)], 10, 9)
    assert m[3:8, 2:7].all() and m.sum() == 25
    two = np.zeros((12, 12), int)
    two[1:5, 1:5], two[7:11, 6:11] = 1, 1
    assert raster.label(two).max() == 2
    rings = raster.vectorize(raster.label(two), smooth_ratio=0)
    assert len(rings) == 2
    for v, ring in rings:
        again = raster.rasterize(ring, 12, 12)
        own = raster.label(two) == v
        assert (again & own).sum() / (again | own).sum() > 0.99
    assert (raster.opened(two, 1) <= raster.dilate(two, 1)).all()
    assert raster.median(two.astype(float)).shape == two.shape


def test_mask_fill(spark):
    rows = [("a", 0, 0, 12, True), ("a", 0, 1, 20, True), ("a", 0, 2, 251, False)]
    df = spark.createDataFrame(rows, "c string, y int, x int, value int, inside boolean")
    assert [r["value"] for r in staining.fill_outside(df).orderBy("x").collect()] == [12, 20, 16]


def test_segmentation_by_patch(spark):
    pixels = spark.range(64 * 64).select(F.lit("DAPI").alias("c"), (F.col("id") / 64).cast("int").alias("y"), (F.col("id") % 64).cast("int").alias("x"), (F.col("id") % 7).cast("int").alias("value"))
    out = staining.segment(pixels, tiling.image_patches(spark, 64, 64, 32), "dummy", ["DAPI"]).collect()
    assert len(out) == 4
    e = staining.embed_tiles(pixels, tiling.image_patches(spark, 64, 64, 32), "dummy", ["DAPI"])
    assert {r["patch_id"]: r["embedding"][0] for r in e.collect()}[0] == 0.0


def test_tiles_without_pixels(spark):
    pixels = spark.createDataFrame([("a", 1, 0, 51), ("b", 9, 9, 255), ("z", 2, 2, 9)], "c string, y int, x int, value int")
    whole = lambda batch: batch.sum(axis=(2, 3))
    out = staining.embed_tiles(pixels, tiling.image_patches(spark, 10, 10, 4), whole, ["a", "b"]).collect()
    assert {r["patch_id"]: list(r["embedding"]) for r in out} == {k: {0: [0.2, 0.0], 8: [0.0, 1.0]}.get(k, [0.0, 0.0]) for k in range(9)}


def test_readers_and_sinks(spark, tmp_path):
    d = readers.toy(spark, side=3, per_cell=5)
    _, points = d.get("points", role="transcripts")
    _, cells = d.boundaries()
    counts = aggregate.count_transcripts(points, cells)
    out = sinks.explorer(d, counts, cells, str(tmp_path / "x"), "+bctm")
    assert out["polygons"] == 9 and out["levels"] >= 1
    names = sinks.write_store(d, str(tmp_path / "store"))
    assert readers.read_store(spark, str(tmp_path / "store"), names).get("shapes")[1].count() == 9
    (tmp_path / "mc.txt").write_text("1\t2\t0\tgene_a\t\n3\t4\t0\tgene_b\t\n")
    assert readers.molecular_cartography(spark, str(tmp_path / "mc.txt")).get("points")[1].count() == 2
    (tmp_path / "sel.csv").write_text("#a\n#b\nSelection,X,Y\ns1,0,0\ns1,2.125,0\ns1,0,2.125\n")
    sel = readers.selections(spark, str(tmp_path / "sel.csv")).collect()
    assert len(sel) == 1 and sel[0]["xs"] == pytest.approx([0, 10, 0])
    (tmp_path / "cells.json").write_text('{"type":"GeometryCollection","geometries":[{"type":"Polygon","coordinates":[[[0,0],[2,0],[2,2],[0,2],[0,0]]]},{"type":"Polygon","coordinates":[[[0,0],[1,0],[0,0]]]}]}')
    got = readers.geojson_cells(spark, str(tmp_path / "cells.json")).collect()
    assert [(r["ord"], r["area"]) for r in got] == [(0, 4.0)]
    with pytest.raises(ValueError):
        sinks.wanted("bo", "b")
    with pytest.raises(ValueError):
        readers.dataset_id(["a.csv"])


def test_fov_instrument(spark, tmp_path):
    (tmp_path / "S_tx_file.csv").write_text("fov,cell_ID,x_global_px,y_global_px,x_local_px,y_local_px,target\n1,0,10,10,0,0,A\n1,2,20,10,10,0,B\n2,1,110,10,0,0,A\n")
    (tmp_path / "S_fov_positions_file.csv").write_text("FOV,X_mm,Y_mm\n1,0.001,0\n2,0.012,0\n")
    d = readers.cosmx(spark, str(tmp_path), "S")
    got = d.get("points")[1].orderBy("x_global_px").collect()
    assert [r["global_cell_id"] for r in got] == [0, 5, 7]
    assert got[0]["x"] == pytest.approx((10 - 1 / readers.FOV_MICRONS) * readers.FOV_MICRONS)


def test_no_nested_loops(spark):
    c = shapes(spark, CELLS)
    p = spark.createDataFrame([(1.0, 1.0, "a")], "x double, y double, gene string")
    plan = aggregate.count_transcripts(p, c)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    plan = spatial.sjoin(c, c)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_stream_counts_equal_batch(spark, tmp_path):
    from plexgrid.streaming.counts import stream_counts

    p = point_frame(spark)
    p.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("x double, y double, gene string").parquet(str(tmp_path / "in"))
    c = shapes(spark, CELLS)
    q = stream_counts(s, c).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    assert matrix(spark.table("counts"), 4, ["g1", "g2", "g3"]) == counted(["g1", "g2", "g3"])
