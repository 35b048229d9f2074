"""Equal shapes, and points of one place, are compared once: more copies of a table give no more rows to compare."""

import os
import random

import duckdb
import pytest

from plexgrid.functions import geometry as G
from plexgrid.operators import kernels, outlines, resolve, spatial
from plexgrid.plans import catalogue

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")

#: Queries that compared every copy with every other one.
QUERIES = [
    "aggregate_filtered",
    "count_transcripts_convex",
    "count_transcripts_polygon",
    "overlay_segmentation",
    "resolve_conflicts",
    "sjoin_polygons",
    "combine_segmentations",
    "expand_radius_hits",
    "sjoin_contains",
    "sjoin_overlaps",
    "sjoin_within",
    "sjoin_touches",
    "assign_transcript_to_cell",
    "assign_transcript_to_cell_null",
    "aggregate_flagged",
    "count_transcripts",
    "cell_totals_q95",
    "compare_segmentations",
    "count_transcripts_dense",
    "density_priors",
    "hvg_dispersion",
    "low_count_genes",
    "gene_counts_csr",
    "log1p_tpm",
    "count_transcripts_excluded",
    "overlap_ratio",
    "conflict_pairs",
    "sjoin_inner",
]


@pytest.fixture(scope="module")
def copies(tmp_path_factory):
    """The smallest tables five and ten times, with shifted keys; five times have each outline at least once."""
    top = {t: duckdb.sql(f"SELECT max({c}) + 1 FROM '{DIR}/{t}.parquet'").fetchall()[0][0] for t, c in (("supplier", "s_suppkey"), ("part", "p_partkey"), ("orders", "o_orderkey"))}
    shifted = {
        "supplier": f"s_suppkey + k * {top['supplier']} AS s_suppkey",
        "part": f"p_partkey + k * {top['part']} AS p_partkey",
        "lineitem": f"l_orderkey + k * {50 * top['orders']} AS l_orderkey, l_partkey + k * {top['part']} AS l_partkey, l_suppkey + k * {top['supplier']} AS l_suppkey",
    }
    folders = {}
    for n in (5, 10):
        folders[n] = str(tmp_path_factory.mktemp(f"x{n}"))
        for t in ("region", "nation"):
            duckdb.sql(f"COPY (SELECT * FROM '{DIR}/{t}.parquet') TO '{folders[n]}/{t}.parquet'")
        for t, keys in shifted.items():
            duckdb.sql(f"COPY (SELECT * EXCLUDE k REPLACE ({keys}) FROM '{DIR}/{t}.parquet', range({n}) r(k)) TO '{folders[n]}/{t}.parquet'")
    return folders


@pytest.fixture
def compared(monkeypatch):
    """Counts of rows that joins found and that tests of rings got."""
    seen = []

    def spy(module, name, counted):
        plain = getattr(module, name)

        def f(*args, **named):
            out = plain(*args, **named)
            seen.append(counted(out, *args, **named))
            return out

        monkeypatch.setattr(module, name, f)

    spy(spatial, "points_in_shapes", lambda out, *_, **__: out.count())
    spy(spatial, "shape_pairs", lambda out, left, right, exact="box", *_, **__: out.count() if exact == "box" else 0)
    for module in (kernels, resolve):
        spy(module, "filter_pairs", lambda out, pairs, *_: pairs.count())
    return seen


@pytest.mark.parametrize("name", QUERIES)
def test_copies_give_no_more_to_compare(spark, copies, compared, name):
    few = catalogue.queries()[name](spark, copies[5]) and sum(compared)
    compared.clear()
    many = catalogue.queries()[name](spark, copies[10]) and sum(compared)
    assert 0 < many <= 1.1 * few


def shapes(spark, rings):
    rows = [(i, [float(x) for x, _ in r], [float(y) for _, y in r]) for i, r in rings]
    return G.with_bounds(spark.createDataFrame(rows, "ord long, xs array<double>, ys array<double>"))


def box(x, y, r):
    return [(x - r, y - r), (x + r, y - r), (x + r, y + r), (x - r, y + r)]



def test_keys_that_are_null_or_repeat(spark):
    c = spark.createDataFrame([(None, 1.0), (1, 1.0), (1, 1.0), (1, 9.0)], "ord long, x double").withColumns({"a": spatial.F.col("x") - 1, "b": spatial.F.col("x") + 1})
    c = c.select("ord", *(v.alias(k) for k, v in G.box("a", "a", "b", "b").items()))
    assert sorted(map(str, (tuple(r) for r in spatial.sjoin(c.where("xmin = 0"), c.where("xmin = 0")).collect()))) == sorted(str((i, j)) for i in (None, 1, 1) for j in (None, 1, 1))
    p = spark.createDataFrame([(1.0, 1.0, "g"), (1.0, 1.0, "g"), (9.0, 9.0, "g")], "x double, y double, gene string")
    counts = {r["ord"]: r["n"] for r in spatial.counts_in_shapes(p, c, ["gene"]).collect()}
    assert counts == {None: 2, 1: 5}



def one_by_one(rings, pairs, threshold):
    """Merging with all pairs listed, in ascending order, each seen from both cells."""
    ring, stands, merged = dict(rings), {n: n for n in rings}, set()

    def now(n):
        return n if stands[n] == n else now(stands[n])

    for i, j in sorted(pairs | {(j, i) for i, j in pairs}):
        a, b = now(i), now(j)
        if a == b:
            continue
        small = min(abs(resolve.signed_area(ring[a])), abs(resolve.signed_area(ring[b])))
        if small > 0 and resolve.shared_area(ring[a], ring[b]) >= threshold * small:
            low, high = min(a, b), max(a, b)
            ring[low] = resolve.largest(resolve.union([ring[a]], [ring[b]])) or ring[low]
            stands[high] = low
            merged.add(low)
    return [(n, ring[n], n in merged) for n in sorted(rings) if stands[n] == n]


@pytest.mark.parametrize("seed", range(30))
def test_merging_by_outlines_equals_merging_by_pairs(seed):
    draw = random.Random(seed)
    hook = lambda x, y, r: [(x, y), (x + 2 * r, y), (x + 2 * r, y + r), (x + r, y + r), (x + r, y + 2 * r), (x, y + 2 * r)]
    diamond = lambda x, y, r: [(x + r, y), (x, y + r), (x - r, y), (x, y - r)]
    kinds = sorted({tuple(draw.choice([box, hook, diamond])(float(draw.randrange(8)), float(draw.randrange(8)), draw.choice([1.0, 2.0, 3.0]))) for _ in range(draw.choice([2, 5, 9]))})
    patch = [draw.randrange(2) if seed % 3 == 0 else k for k in range(len(kinds))]
    cells = {n: draw.randrange(len(kinds)) for n in draw.sample(range(99), draw.choice([6, 20, 35]))}
    met = lambda a, b: kernels.rings_intersect(list(kinds[a]), list(kinds[b])) and (seed % 3 > 0 or patch[a] != patch[b])
    pairs = {(i, j) for i in cells for j in cells if i < j and met(cells[i], cells[j])}
    busy = {n for p in pairs for n in p}
    number = {k: min(n for n in cells if cells[n] == k) for k in set(cells.values())}
    members, partners = {}, {}
    for n in sorted(busy):
        members.setdefault(number[cells[n]], []).append(n)
    for i, j in pairs | {(j, i) for i, j in pairs}:
        partners.setdefault(number[cells[i]], set()).add(number[cells[j]])
    threshold = draw.choice([0.2, 0.5, 0.9])
    got = resolve.merge({o: list(kinds[cells[o]]) for o in members}, members, {o: sorted(p) for o, p in partners.items()}, threshold)
    assert got == one_by_one({n: list(kinds[cells[n]]) for n in busy}, pairs, threshold)


def test_many_copies_in_conflict(spark):
    out = resolve.solve_conflicts(shapes(spark, [(i, box(10 * (i % 3), 0, 2)) for i in range(3000)]), 0.5)
    assert sorted((r["source_ord"], r["merged"], r["a"]) for r in out.withColumn("a", G.area()).collect()) == [(k, True, 16.0) for k in range(3)]


def test_copies_have_no_core(spark):
    cells = shapes(spark, [(0, box(0, 0, 2)), (1, box(0, 0, 2)), (2, box(2, 0, 2)), (3, box(30, 0, 1)), (4, box(30, 5, 1))])
    out = {r["ord"]: r["a"] for r in outlines.remove_overlap(cells).withColumn("a", G.area()).collect()}
    assert out == {0: None, 1: None, 2: 16.0, 3: 4.0, 4: 4.0}  # what is shared goes to the one with a core



def test_pairs_of_copies_dealt_over_bundles(spark, monkeypatch):
    monkeypatch.setattr(spatial, "BUNDLE", 3)
    draw = random.Random(5)
    kinds = [box(draw.randrange(9), draw.randrange(9), draw.choice([1, 2])) for _ in range(5)]
    rings = [(i, draw.choice(kinds)) for i in range(60)]
    meet = lambda a, b: all(max(a[0][k], b[0][k]) <= min(a[2][k], b[2][k]) for k in (0, 1))
    want = sorted((i, j) for i, a in rings for j, b in rings if meet(a, b))
    c = shapes(spark, rings)
    for exact in ("box", "polygon"):
        assert sorted(map(tuple, spatial.sjoin(c, c, exact=exact).collect())) == want
        assert sorted(map(tuple, resolve.conflict_pairs(c, exact).collect())) == [p for p in want if p[0] < p[1]]
    first = {r["left_key"]: r["cell"] for r in spatial.first_shape(c, c).collect()}
    assert first == {i: 1 + min(b for a, b in want if a == i) for i, _ in rings}



def test_first_shape_of_points_without_ids(spark):
    p = spark.createDataFrame([(None, 1.0, 1.0), (1, 1.0, 1.0), (2, None, 1.0), (3, 50.0, 1.0)], "id long, x double, y double")
    c = shapes(spark, [(7, box(1, 1, 1)), (3, box(1, 1, 1)), (5, box(1, 1, 2))])
    assert {r["id"]: r["cell"] for r in spatial.assign_first(p, c, ["id"]).collect()} == {None: 4, 1: 4, 2: 0, 3: 0}



def test_dissolve_compares_outlines(spark, compared):
    s = shapes(spark, [(i, box(3 * (i % 4), 0, 2)) for i in range(200)]).withColumn("g", spatial.F.col("ord") % 2)
    out = outlines.dissolve(s, "g").withColumn("a", G.area()).collect()
    assert sorted((r["g"], r["a"]) for r in out) == [(0, 16.0), (0, 16.0), (1, 16.0), (1, 16.0)]
    assert sum(compared) <= 4 * 4 * 2



def test_small_components_share_a_task(spark, monkeypatch):
    from pyspark.sql.pandas.group_ops import PandasGroupedOpsMixin

    def refused(*_):
        raise AssertionError("a call for each component")

    monkeypatch.setattr(PandasGroupedOpsMixin, "applyInPandas", refused)
    assert catalogue.queries()["resolve_concave"](spark, DIR).where("merged").count() > 0
    assert catalogue.queries()["remove_overlap"](spark, DIR).count() > 0
