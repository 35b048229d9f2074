"""The queries registered for the spatial operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import stats as S
from ..functions import text as T
from ..functions.channels import channel_labels
from ..model import Affine
from ..operators import aggregate as A
from ..operators import annotate as N
from ..operators import graph, niches, outlines, resolve, spatial, staining, tiling
from ..sources import readers, sinks
from ..streaming.counts import event_windows
from .fixtures import POINT_ID, Elements, sql

_found: dict[str, tuple[Callable, str | None]] = {}


def query(name: str, oracle: str | None = None):
    def put(f):
        _found[name] = (f, oracle)
        return f

    return put


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: (lambda spark, d, f=f: f(Elements(spark, d))) for k, (f, _) in _found.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _found.items() if s}


_box = spatial.in_box()
_ids = ", ".join(POINT_ID)

# counting points in cells


@query("count_transcripts", sql("counts", "SELECT * FROM counts"))
def _(e):
    return A.count_transcripts(e.points(), e.cells(), exact=_box)


@query("count_transcripts_excluded", sql("points cells", "SELECT c.ord, p.gene, count(*) AS n FROM points p JOIN cells c ON p.x BETWEEN c.xmin AND c.xmax AND p.y BETWEEN c.ymin AND c.ymax WHERE NOT low_quality_transcript AND gene IS NOT NULL AND regexp_matches(gene, '(?i)^(?:" + T.EXCLUDED + ")') GROUP BY 1, 2"))
def _(e):
    return A.count_transcripts(e.points(), e.cells(), only_excluded=True, exact=_box)


@query("count_transcripts_dense", sql("counts", "SELECT c.ord, g.gene, coalesce(n.n, 0) AS n FROM cells c CROSS JOIN (SELECT DISTINCT gene FROM kept_all) g LEFT JOIN counts n ON n.ord = c.ord AND n.gene = g.gene").replace("kept_all", "(SELECT gene FROM points WHERE gene IS NOT NULL AND NOT regexp_matches(gene, '(?i)^(?:" + T.EXCLUDED + ")'))"))
def _(e):
    p = e.points()
    return A.completed(A.count_transcripts(p, e.cells(), exact=_box), e.cells(), A.features(p))


@query("count_transcripts_polygon", sql("kept diamonds", "SELECT c.ord, p.gene, count(*) AS n FROM kept p JOIN diamonds c ON abs(p.x - c.cx) + abs(p.y - c.cy) <= c.r GROUP BY 1, 2"))
def _(e):
    return A.count_transcripts(e.points(), e.diamonds())


@query("count_transcripts_convex", sql("kept diamonds", "SELECT c.ord, p.gene, count(*) AS n FROM kept p JOIN diamonds c ON abs(p.x - c.cx) + abs(p.y - c.cy) <= c.r GROUP BY 1, 2"))
def _(e):
    return A.count_transcripts(e.points(), e.diamonds(), exact=G.contains_convex)


@query("assign_transcript_to_cell", sql("points cells", f"SELECT {_ids}, CAST(coalesce(min(c.ord) + 1, 0) AS BIGINT) AS cell FROM points p LEFT JOIN cells c ON p.x BETWEEN c.xmin AND c.xmax AND p.y BETWEEN c.ymin AND c.ymax GROUP BY {_ids}"))
def _(e):
    return spatial.assign_first(e.points(), e.cells(), POINT_ID, 0, exact=_box).select(*POINT_ID, "cell")


@query("assign_transcript_to_cell_null", sql("points cells", f"SELECT {_ids}, CAST(min(c.ord) AS VARCHAR) AS cell FROM points p LEFT JOIN cells c ON p.x BETWEEN c.xmin AND c.xmax AND p.y BETWEEN c.ymin AND c.ymax GROUP BY {_ids}"))
def _(e):
    return spatial.assign_first(e.points(), e.cells(), POINT_ID, None, exact=_box).select(*POINT_ID, F.col("cell").cast("string").alias("cell"))


_overlap = "a.xmin <= b.xmax AND b.xmin <= a.xmax AND a.ymin <= b.ymax AND b.ymin <= a.ymax"


@query("sjoin_inner", sql("cells cells2", f"SELECT a.ord AS left_key, b.ord AS right_key FROM cells a JOIN cells2 b ON {_overlap}"))
def _(e):
    return spatial.sjoin(e.cells(), e.cells2(), "inner")


def _as_text(df):
    """Keys that may be null as text, which all engines show alike."""
    return df.select(*(F.col(c).cast("string").alias(c) for c in df.columns))


@query("sjoin_left", sql("cells roi", f"SELECT CAST(a.ord AS VARCHAR) AS left_key, CAST(b.roi AS VARCHAR) AS right_key FROM cells a LEFT JOIN roi b ON {_overlap}"))
def _(e):
    return _as_text(spatial.sjoin(e.cells(), e.roi(), "left", right_key="roi"))


@query("sjoin_right", sql("cells roi", f"SELECT CAST(a.ord AS VARCHAR) AS left_key, CAST(b.roi AS VARCHAR) AS right_key FROM cells a RIGHT JOIN roi b ON {_overlap}"))
def _(e):
    return _as_text(spatial.sjoin(e.cells(), e.roi(), "right", right_key="roi"))


@query("sjoin_polygons", sql("diamonds", "SELECT a.ord AS left_key, b.ord AS right_key FROM diamonds a JOIN diamonds b ON abs(a.cx - b.cx) + abs(a.cy - b.cy) <= a.r + b.r"))
def _(e):
    return spatial.sjoin(e.diamonds(), e.diamonds(), "inner", exact="polygon")


_shared = "greatest(least(a.xmax, b.xmax) - greatest(a.xmin, b.xmin), 0) * greatest(least(a.ymax, b.ymax) - greatest(a.ymin, b.ymin), 0)"


@query("overlap_ratio", sql("cells cells2", f"SELECT a.ord AS left_key, b.ord AS right_key, {_shared} / ((a.xmax - a.xmin) * (a.ymax - a.ymin)) AS ratio FROM cells a JOIN cells2 b ON {_overlap}"))
def _(e):
    return spatial.overlap_ratio(e.cells(), e.cells2())


@query("expand_radius_hits", sql("kept cells", "SELECT c.ord, p.gene, count(*) AS n FROM kept p JOIN cells c ON greatest(c.xmin - p.x, 0, p.x - c.xmax)**2 + greatest(c.ymin - p.y, 0, p.y - c.ymax)**2 <= (SELECT 0.5 * avg(sqrt((xmax - xmin) * (ymax - ymin) / pi())) FROM cells)**2 GROUP BY 1, 2"))
def _(e):
    r = A.radius(e.cells(), 0.5)
    return spatial.counts_in_shapes(e.kept().select("x", "y", "gene"), e.cells(), ["gene"], lambda: G.within_distance(r), r)


@query("dissolve_boxes", sql("cells", "#u AS (SELECT DISTINCT c.ord % 7 AS g, CAST(gx.i AS DOUBLE) AS x, CAST(gy.i AS DOUBLE) AS y FROM cells c, range(-5, 60) gx(i), range(-5, 60) gy(i) WHERE gx.i >= c.xmin AND gx.i < c.xmax AND gy.i >= c.ymin AND gy.i < c.ymax) SELECT g, CAST(count(*) AS DOUBLE) AS area FROM u GROUP BY 1"))
def _(e):
    return spatial.dissolve_boxes(e.cells().withColumn("g", F.col("ord") % 7), "g")


# bins, pixels, tables


@query("aggregate_bins", sql("bin_hits bin_counts", "SELECT ord, gene, CAST(sum(n) AS BIGINT) AS n FROM bin_hits JOIN bin_counts USING (bin_id) GROUP BY 1, 2"))
def _(e):
    return A.aggregate_bins(e.bins(), e.bin_counts(), e.cells(), _box)


_tpm = "ln(1 + n / (sum(n) OVER (PARTITION BY {k}) + 1e-8) * 1e6)"
_once = (
    "#k AS (SELECT bin_id, count(*) AS k FROM bin_hits GROUP BY 1), alone AS (SELECT h.* FROM bin_hits h JOIN k USING (bin_id) WHERE k = 1), shared AS (SELECT h.* FROM bin_hits h JOIN k USING (bin_id) WHERE k > 1), "
    "prof AS (SELECT ord, gene, " + _tpm.format(k="ord") + " AS c FROM (SELECT ord, gene, sum(n) AS n FROM alone JOIN bin_counts USING (bin_id) GROUP BY 1, 2)), "
    "own AS (SELECT bin_id, gene, " + _tpm.format(k="bin_id") + " AS b FROM bin_counts WHERE bin_id IN (SELECT bin_id FROM shared)), "
    "bb AS (SELECT bin_id, sum(b * b) AS s FROM own GROUP BY 1), cc AS (SELECT ord, sum(c * c) AS s FROM prof GROUP BY 1), dd AS (SELECT s.bin_id, s.ord, sum(b * c) AS s FROM shared s JOIN own USING (bin_id) JOIN prof ON prof.ord = s.ord AND prof.gene = own.gene GROUP BY 1, 2), "
    "far AS (SELECT s.bin_id, s.ord, round(coalesce(bb.s, 0) + coalesce(cc.s, 0) - 2 * coalesce(dd.s, 0), 6) AS f FROM shared s LEFT JOIN bb ON bb.bin_id = s.bin_id LEFT JOIN cc ON cc.ord = s.ord LEFT JOIN dd ON dd.bin_id = s.bin_id AND dd.ord = s.ord), "
    "best AS (SELECT bin_id, ord FROM (SELECT *, row_number() OVER (PARTITION BY bin_id ORDER BY f, ord) AS r FROM far) WHERE r = 1) "
)


@query("aggregate_bins_no_overlap", sql("bin_hits bin_counts", _once + "SELECT ord, gene, CAST(sum(n) AS BIGINT) AS n FROM (SELECT * FROM alone UNION ALL SELECT * FROM best) JOIN bin_counts USING (bin_id) GROUP BY 1, 2"))
def _(e):
    hits = spatial.points_in_shapes(e.bins(), e.cells(), _box).select("bin_id", "ord")
    once = A.assign_bins_once(hits, e.bin_counts())
    return once.join(e.bin_counts(), "bin_id").groupBy("ord", "gene").agg(F.sum("n").cast("long").alias("n"))


@query("aggregate_bins_no_overlap_pca")
def _(e):
    hits = spatial.points_in_shapes(e.bins(), e.cells(), _box).select("bin_id", "ord")
    genes = [r["gene"] for r in e.bin_counts().select("gene").distinct().orderBy("gene").collect()]
    once = A.assign_bins_by_pca(hits, e.bin_counts(), genes, min(5, len(genes)))
    return once.join(e.bin_counts(), "bin_id").groupBy("ord", "gene").agg(F.sum("n").cast("long").alias("n"))


_pixels = "FROM image i JOIN cells c ON i.x BETWEEN c.xmin AND c.xmax AND i.y BETWEEN c.ymin AND c.ymax GROUP BY 1, 2"
for _mode, _value in (("average", "CAST(sum(value) AS DOUBLE) / count(*)"), ("min", "CAST(min(value) AS DOUBLE)"), ("max", "CAST(greatest(max(value), 0) AS DOUBLE)")):

    @query(f"aggregate_channels_{_mode}", sql("image cells", f"SELECT c.ord, i.c AS channel, {_value} AS value {_pixels}"))
    def _(e, mode=_mode):
        return A.aggregate_channels(e.image(), e.cells(), mode, _box)


_flags = (
    "#totals AS (SELECT ord, sum(n) AS t FROM counts GROUP BY 1), inten AS (SELECT c.ord, i.c AS channel, CAST(sum(value) AS DOUBLE) / count(*) AS value " + _pixels + "), means AS (SELECT c.ord, coalesce(avg(value), 0) AS m FROM cells c LEFT JOIN inten USING (ord) GROUP BY 1), "
    "flags AS (SELECT c.ord, coalesce(t, 0) >= 40 AND m >= CAST(0.9 AS DOUBLE) * (SELECT quantile_cont(m, 0.9) FROM means) AS passes_filtering FROM cells c LEFT JOIN totals USING (ord) JOIN means USING (ord)) "
)


@query("aggregate_flagged", sql("counts image", _flags + "SELECT * FROM flags"))
def _(e):
    counts = A.count_transcripts(e.points(), e.cells(), exact=_box)
    return A.filter_flags(e.cells(), counts, 40, A.aggregate_channels(e.image(), e.cells(), "average", _box), 0.9)


@query("aggregate_filtered", sql("counts image", _flags + "SELECT c.ord, concat(translate(lpad(lower(hex(c.ord)), 8, '0'), '0123456789abcdef', 'abcdefghijklmnop'), '-1') AS cell_id, (c.xmin + c.xmax) / 2 AS x, (c.ymin + c.ymax) / 2 AS y, (c.xmax - c.xmin) * (c.ymax - c.ymin) AS area FROM cells c JOIN flags USING (ord) WHERE passes_filtering"))
def _(e):
    out = A.aggregate(e.cells(), e.points(), pixels=e.image(), min_transcripts=40, min_intensity_ratio=0.9)
    return out["cells"].withColumns({c: F.round(c, 9) for c in ("x", "y", "area")})


_gone = f"SELECT DISTINCT a.ord FROM cells a JOIN cells2 b ON {_overlap} WHERE {_shared} / ((a.xmax - a.xmin) * (a.ymax - a.ymin)) >= 0.5"
_over = f"#gone AS ({_gone}), both_cells AS (SELECT false AS is_overlay, * FROM cells WHERE ord NOT IN (SELECT ord FROM gone) UNION ALL SELECT true, * FROM cells2), numbered AS (SELECT row_number() OVER (ORDER BY is_overlay, ord) - 1 AS new_ord, * FROM both_cells) "


@query("overlay_cells", sql("cells cells2", _over + "SELECT new_ord AS ord, ord AS source_ord, is_overlay FROM numbered"))
def _(e):
    return A.overlay_segmentation(e.cells(), e.cells2(), threshold=0.5)["cells"].select("ord", "source_ord", "is_overlay")


@query("overlay_segmentation", sql("kept cells cells2", _over + "SELECT c.new_ord AS ord, p.gene, count(*) AS n FROM kept p JOIN numbered c ON p.x BETWEEN c.xmin AND c.xmax AND p.y BETWEEN c.ymin AND c.ymax GROUP BY 1, 2"))
def _(e):
    return A.overlay_segmentation(e.cells(), e.cells2(), e.points(), 0.5)["counts"]


@query("low_count_genes", sql("counts", "SELECT gene, CAST(sum(n) AS DOUBLE) / (SELECT count(*) FROM cells) AS mean_count FROM counts GROUP BY 1 HAVING CAST(sum(n) AS DOUBLE) / (SELECT count(*) FROM cells) < 8 ORDER BY gene LIMIT 50"))
def _(e):
    return A.low_count_genes(A.count_transcripts(e.points(), e.cells(), exact=_box), e.cells().count(), 8.0)


@query("cell_totals_q95", sql("counts", "SELECT round(quantile_cont(t, 0.95), 6) AS q95 FROM (SELECT CAST(sum(n) AS DOUBLE) AS t FROM counts GROUP BY ord)"))
def _(e):
    t = A.count_transcripts(e.points(), e.cells(), exact=_box).groupBy("ord").agg(F.sum("n").alias("t"))
    return t.agg(F.round(F.percentile("t", 0.95), 6).alias("q95"))


@query("compare_segmentations", sql("kept cells cells2", "SELECT 'first' AS segmentation, (SELECT count(*) FROM cells) AS n_cells, count(*) AS total, count(*) / CAST((SELECT count(*) FROM cells) AS DOUBLE) AS mean_count FROM kept p JOIN cells c ON p.x BETWEEN c.xmin AND c.xmax AND p.y BETWEEN c.ymin AND c.ymax UNION ALL SELECT 'second', (SELECT count(*) FROM cells2), count(*), count(*) / CAST((SELECT count(*) FROM cells2) AS DOUBLE) FROM kept p JOIN cells2 c ON p.x BETWEEN c.xmin AND c.xmax AND p.y BETWEEN c.ymin AND c.ymax"))
def _(e):
    both = {"first": e.cells(), "second": e.cells2()}
    return A.compare_segmentations({k: A.count_transcripts(e.points(), c, exact=_box) for k, c in both.items()}, {k: c.count() for k, c in both.items()})


@query("geometry_stats", sql("diamonds", "SELECT ord, 2 * r * r AS area, round(4 * r * sqrt(2), 6) AS length, cx, cy, round(4 * pi() * 2 * r * r / (4 * r * sqrt(2))**2, 6) AS roundness FROM diamonds"))
def _(e):
    cx, cy = G.centroid()
    return e.diamonds().select("ord", G.area().alias("area"), F.round(G.perimeter(), 6).alias("length"), F.round(cx, 6).alias("cx"), F.round(cy, 6).alias("cy"), F.round(G.roundness(), 6).alias("roundness"))


@query("bounding_box_roi", sql("points", "SELECT min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax FROM points"))
def _(e):
    return readers.bounding_box(e.points())


@query("pixel_outer_bounds", sql("diamonds", "SELECT ord, CAST(floor(cx - r) AS INT) AS px0, CAST(floor(cy - r) AS INT) AS py0, CAST(ceil(cx + r) + 1 AS INT) AS px1, CAST(ceil(cy + r) + 1 AS INT) AS py1 FROM diamonds"))
def _(e):
    return e.diamonds().select("ord", *(c.alias(k) for k, c in G.outer_pixel_bounds().items()))


@query("rasterize", sql("diamonds", "SELECT d.ord, CAST(gy.i AS INT) AS y, CAST(gx.i AS INT) AS x FROM diamonds d, range(-5, 60) gx(i), range(-5, 60) gy(i) WHERE abs(gx.i - cx) + abs(gy.i - cy) <= r"))
def _(e):
    return staining.rasterized(e.diamonds())


@query("split_overlaps")
def _(e):
    return staining.split_overlaps(e.image(), e.diamonds())


@query("affine_transform", sql("points", f"SELECT {_ids}, 2 * x + y + 3 AS x, x - y - 1 AS y FROM points"))
def _(e):
    return Affine((2.0, 1.0, 3.0, 1.0, -1.0, -1.0)).points(e.points()).select(*POINT_ID, "x", "y")


# names


@query("cell_ids", "SELECT s_suppkey AS id, translate(lpad(lower(hex(s_suppkey)), 8, '0'), '0123456789abcdef', 'abcdefghijklmnop') || '-1' AS cell_id, s_suppkey AS back, true AS valid FROM supplier")
def _(e):
    s = e.table("supplier").select(F.col("s_suppkey").alias("id"), T.cell_name("s_suppkey").alias("cell_id"))
    return s.withColumns({"back": T.cell_number("cell_id"), "valid": T.is_cell_name("cell_id")})


@query("gene_category", sql("points", "SELECT gene, CASE WHEN regexp_matches(lower(gene), 'negcontrol|negprobe') THEN 'negative_control' WHEN contains(lower(gene), 'blank') THEN 'blank' WHEN regexp_matches(lower(gene), 'systemcontrol|falsecode') THEN 'deprecated' ELSE 'gene' END AS category, count(*) AS n FROM points GROUP BY 1, 2"))
def _(e):
    return e.points().groupBy("gene", T.gene_category("gene").alias("category")).agg(F.count("*").alias("n"))


@query("gene_exclusion", sql("points", "SELECT gene, coalesce(regexp_matches(gene, '(?i)^(?:" + T.EXCLUDED + ")'), true) AS excluded, count(*) AS n FROM points GROUP BY 1, 2"))
def _(e):
    return e.points().groupBy("gene", T.excluded("gene").alias("excluded")).agg(F.count("*").alias("n"))


@query("low_quality_filter", sql("points", "SELECT low_quality_transcript, count(*) AS n FROM points GROUP BY 1"))
def _(e):
    return e.points().groupBy("low_quality_transcript").agg(F.count("*").alias("n"))


@query("dedup_names", "SELECT p_partkey, CASE WHEN k > 0 THEN p_type || ' (' || CAST(k AS VARCHAR) || ')' ELSE p_type END AS name FROM (SELECT p_partkey, p_type, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) - 1 AS k FROM part)")
def _(e):
    return T.dedup_names(e.table("part").select("p_partkey", F.col("p_type").alias("name")), "name", "p_partkey")


@query("channel_names", "SELECT p_partkey, replace(p_name, '/', '_') AS name, TRY_CAST(nullif(regexp_extract(p_name || ' 488nm', '(?:^|[^0-9])([0-9]{3})(?:[^0-9]|$)', 1), '') AS INT) AS wavelength FROM part")
def _(e):
    p = e.table("part").select("p_partkey", T.channel_name("p_name").alias("name"), F.concat("p_name", F.lit(" 488nm")).alias("_n"))
    return p.select("p_partkey", "name", T.wavelength("_n").alias("wavelength"))


_channel = "CASE p_partkey % 7 WHEN 0 THEN 'DAPI' WHEN 1 THEN 'DNA1' WHEN 2 THEN p_name || ' 488' ELSE p_name END"


@query("channel_colors", f"""
WITH c AS (SELECT p_brand, p_partkey, {_channel} AS name FROM part),
w AS (SELECT *, regexp_matches(name, '(^|[^0-9])[0-9]{{3}}([^0-9]|$)') AS wave, name IN ('DAPI', 'DNA1', 'DNA2', 'DAPI (000)') AS known FROM c),
t AS (SELECT *, ceil(sum(CASE WHEN wave OR known THEN 0 ELSE 1 END) OVER (PARTITION BY p_brand) / 4.0) AS share, sum(CASE WHEN wave OR known THEN 0 ELSE 1 END) OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS turn FROM w)
SELECT p_brand, p_partkey, CASE WHEN wave THEN name WHEN known THEN name || ' (color=white)' ELSE name || ' (color=' || CAST(700 - 100 * CAST(floor(turn / share) AS INT) AS VARCHAR) || ')' END AS label FROM t
""")
def _(e):
    p = e.table("part").select("p_brand", "p_partkey", F.expr(_channel).alias("name"))
    return channel_labels(p, "name", "p_partkey", ["p_brand"]).select("p_brand", "p_partkey", "label")


@query("gene_flags", sql("points", "SELECT DISTINCT gene, NOT (g OR b OR d) AS is_gene, g AS is_negative_control_probe, false AS is_negative_control_codeword, d AND NOT g AND NOT b AS is_deprecated, false AS is_predicted_false_positive, false AS is_unassigned_codeword, b AND NOT g AS is_blank_codeword, false AS is_anti_sense, false AS is_genomic_control FROM (SELECT gene, regexp_matches(lower(gene), 'negcontrol|negprobe') AS g, contains(lower(gene), 'blank') AS b, regexp_matches(lower(gene), 'systemcontrol|falsecode') AS d FROM points WHERE gene IS NOT NULL)"))
def _(e):
    return e.points().where("gene IS NOT NULL").select("gene").distinct().withColumns(T.gene_flags())


# statistics


@query("log1p_tpm", sql("counts", "SELECT ord, gene, round(ln(1 + n / (sum(n) OVER (PARTITION BY ord) + 1e-8) * 1e6), 6) AS value FROM counts"))
def _(e):
    c = A.count_transcripts(e.points(), e.cells(), exact=_box)
    return S.log1p_tpm(c, "ord").select("ord", "gene", F.round("log_tpm", 6).alias("value"))


@query("normalize_log1p", sql("counts", "#t AS (SELECT ord, sum(n) AS t FROM counts GROUP BY 1) SELECT ord, gene, round(ln(1 + CAST(n AS DOUBLE) / t * (SELECT quantile_cont(CAST(t AS DOUBLE), 0.5) FROM t)), 6) AS value FROM counts JOIN t USING (ord)"))
def _(e):
    c = A.count_transcripts(e.points(), e.cells(), exact=_box)
    return S.normalize_log1p(c, "ord").select("ord", "gene", F.round("value", 6).alias("value"))


@query("hvg_dispersion", sql("counts", "#k AS (SELECT count(*) AS k FROM cells) SELECT gene, round(sum(n) / CAST(k AS DOUBLE), 6) AS mean, round((sum(n * n) - sum(n) * CAST(sum(n) AS DOUBLE) / k) / (k - 1), 6) AS variance, round((sum(n * n) - sum(n) * CAST(sum(n) AS DOUBLE) / k) / (k - 1) / (sum(n) / CAST(k AS DOUBLE)), 6) AS dispersion FROM counts, k GROUP BY gene, k"))
def _(e):
    c = A.count_transcripts(e.points(), e.cells(), exact=_box)
    return S.hvg_dispersion(c, e.cells().count(), value="n").select("gene", *(F.round(x, 6).alias(x) for x in ("mean", "variance", "dispersion")))


_fluo = "#q AS (SELECT channel, CASE WHEN quantile_cont(value, 0.2) = 0 THEN max(value) ELSE 5 * quantile_cont(value, 0.2) END AS d FROM intensities GROUP BY 1), t AS (SELECT cell, channel, asinh(value / d) AS a FROM intensities JOIN q USING (channel)), s AS (SELECT channel, avg(a) AS m, stddev_samp(a) AS sd FROM t GROUP BY 1), z AS (SELECT cell, channel, (a - m) / sd AS z FROM t JOIN s USING (channel)) "


@query("preprocess_fluo", sql("intensities", _fluo + "SELECT cell, channel, round(z, 6) AS z FROM z"))
def _(e):
    return S.fluorescence_scores(e.intensities()).select("cell", "channel", F.round("z", 6).alias("z"))


@query("higher_z_score", sql("intensities", _fluo + "SELECT cell, cell_type, round(z, 6) AS z FROM (SELECT cell, CASE channel WHEN 'a' THEN 'A' WHEN 'b' THEN 'B' ELSE 'C' END AS cell_type, z, row_number() OVER (PARTITION BY cell ORDER BY z DESC, channel) AS r FROM z WHERE channel IN ('a', 'b', 'c')) WHERE r = 1"))
def _(e):
    return S.higher_z_score(e.intensities(), {"a": "A", "b": "B", "c": "C"}).select("cell", "cell_type", F.round("z", 6).alias("z"))


@query("hard_labels", sql("intensities", "#q AS (SELECT channel, quantile_cont(value, 0.95) AS q, min(value) AS lo FROM intensities GROUP BY 1), s AS (SELECT cell, channel, CASE WHEN q > lo THEN (least(value, q) - lo) / (q - lo) ELSE 0 END AS s FROM intensities JOIN q USING (channel)) SELECT cell, channel AS label, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY s DESC, channel) AS r FROM s) WHERE r = 1"))
def _(e):
    x = e.intensities().withColumn("pos", F.ascii("channel")).withColumnRenamed("channel", "label")
    return S.hard_labels(x).select("cell", "label", F.round("score", 6).alias("score"))


@query("clip_quantile_scale", sql("image", "#q AS (SELECT c, quantile_cont(CAST(value AS DOUBLE), 0.99) AS top FROM image GROUP BY 1) SELECT c, y, x, CAST(floor(greatest(0, least(1, value / top)) * 255) AS INT) AS scaled FROM image JOIN q USING (c)"))
def _(e):
    return S.clip_quantile_scale(e.image()).select("c", "y", "x", "scaled")


@query("scale_dtype", sql("image", "SELECT c, y, x, CAST(floor(value * (CAST(65535 AS DOUBLE) / CAST(255 AS DOUBLE))) AS BIGINT) AS value FROM image"))
def _(e):
    return e.image().select("c", "y", "x", S.scale_dtype("value", 8, 16).alias("value"))


@query("otsu_threshold", sql("image", "#h AS (SELECT c, CAST(value AS BIGINT) AS v, count(*) AS n FROM image GROUP BY 1, 2), w AS (SELECT c, v, CAST(sum(n) OVER (PARTITION BY c ORDER BY v) AS DOUBLE) AS w0, CAST(sum(n * v) OVER (PARTITION BY c ORDER BY v) AS DOUBLE) AS s0, CAST(sum(n) OVER (PARTITION BY c) AS DOUBLE) AS w, CAST(sum(n * v) OVER (PARTITION BY c) AS DOUBLE) AS s FROM h) SELECT c, v AS threshold FROM (SELECT c, v, row_number() OVER (PARTITION BY c ORDER BY w0 * (w - w0) * (s0 / w0 - (s - s0) / (w - w0)) * (s0 / w0 - (s - s0) / (w - w0)) DESC, v) AS r FROM w WHERE w > w0) WHERE r = 1"))
def _(e):
    return S.otsu_threshold(e.image(), by=["c"])


@query("fill_outside", sql("image", "SELECT c, y, x, CAST(CASE WHEN x BETWEEN 10 AND 30 THEN value ELSE floor((SELECT avg(value) FROM image j WHERE j.c = i.c AND j.x BETWEEN 10 AND 30)) END AS INT) AS value FROM image i"))
def _(e):
    return staining.fill_outside(e.image().withColumn("inside", F.col("x").between(10, 30))).select("c", "y", "x", "value")


@query("tissue_mask", sql("image", "#g AS (SELECT y, x, CAST(sum(value) AS INT) AS value FROM image GROUP BY 1, 2), h AS (SELECT CAST(value AS BIGINT) AS v, count(*) AS n FROM g GROUP BY 1), w AS (SELECT v, CAST(sum(n) OVER (ORDER BY v) AS DOUBLE) AS w0, CAST(sum(n * v) OVER (ORDER BY v) AS DOUBLE) AS s0, CAST(sum(n) OVER () AS DOUBLE) AS w, CAST(sum(n * v) OVER () AS DOUBLE) AS s FROM h), t AS (SELECT v FROM w WHERE w > w0 ORDER BY w0 * (w - w0) * (s0 / w0 - (s - s0) / (w - w0)) * (s0 / w0 - (s - s0) / (w - w0)) DESC, v LIMIT 1) SELECT y, x FROM g WHERE value > (SELECT v FROM t)"))
def _(e):
    g = e.image().groupBy("y", "x").agg(F.sum("value").cast("int").alias("value"))
    return staining.tissue_mask(g)


@query("half_image", sql("image", "SELECT c, CAST(y // 2 AS INT) AS y, CAST(x // 2 AS INT) AS x, CAST(floor(avg(value)) AS INT) AS value FROM image GROUP BY 1, 2, 3"))
def _(e):
    return sinks.half_image(e.image())


# tiles


def _patch_sql(w, o, n, x0, y0, width):
    return f"SELECT CAST(i AS BIGINT) AS patch_id, CAST(i % {n} AS INT) AS ix, CAST(i // {n} AS INT) AS iy, {x0} + (i % {n}) * {w - o} AS xmin, {y0} + (i // {n}) * {w - o} AS ymin, {x0} + (i % {n}) * {w - o} + {width} AS xmax, {y0} + (i // {n}) * {w - o} + {width} AS ymax FROM range({n * n}) t(i)"


@query("image_patches", "SELECT patch_id, ix, iy, CAST(xmin AS DOUBLE) AS xmin, CAST(ymin AS DOUBLE) AS ymin, CAST(xmax AS DOUBLE) AS xmax, CAST(ymax AS DOUBLE) AS ymax FROM (" + _patch_sql(300, 100, 3, 0, 0, 300) + ")")
def _(e):
    p = tiling.image_patches(e.spark, 512, 512, 300, 100)
    return p.select("patch_id", "ix", "iy", *(F.col(c).cast("double").alias(c) for c in ("xmin", "ymin", "xmax", "ymax")))


_axes = "#ax AS (SELECT min(x) AS x0, max(x) - min(x) AS dx, min(y) AS y0, max(y) - min(y) AS dy FROM points), an AS (SELECT *, CAST(ceil((dx - 4) / 16.0) AS BIGINT) AS nx, CAST(ceil((dy - 4) / 16.0) AS BIGINT) AS ny FROM ax), aw AS (SELECT *, (dx + (nx - 1) * 4) / nx + CAST(1e-4 AS DOUBLE) AS wx, (dy + (ny - 1) * 4) / ny + CAST(1e-4 AS DOUBLE) AS wy FROM an), pat AS (SELECT CAST(j * nx + i AS BIGINT) AS patch_id, i AS ix, j AS iy, x0 + i * (wx - 4) AS xmin, y0 + j * (wy - 4) AS ymin, x0 + i * (wx - 4) + wx AS xmax, y0 + j * (wy - 4) + wy AS ymax FROM aw, range(100) a(i), range(100) b(j) WHERE i < nx AND j < ny) "


@query("transcript_patches", sql("points", _axes + "SELECT patch_id, CAST(ix AS INT) AS ix, CAST(iy AS INT) AS iy, round(xmin, 6) AS xmin, round(ymin, 6) AS ymin, round(xmax, 6) AS xmax, round(ymax, 6) AS ymax FROM pat"))
def _(e):
    p = tiling.patches(e.spark, *tiling.transcript_axes(e.points(), 20, 4))
    return p.select("patch_id", "ix", "iy", *(F.round(c, 6).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")))


_inside = "x BETWEEN xmin AND xmax AND y BETWEEN ymin AND ymax"


@query("patch_assignment", sql("points", _axes + f"SELECT {_ids}, patch_id FROM points JOIN pat ON {_inside}"))
def _(e):
    return tiling.in_patches(e.points(), *tiling.transcript_axes(e.points(), 20, 4)).select(*POINT_ID, "patch_id")


@query("valid_patches", sql("points", _axes + f"SELECT patch_id, count(*) AS n_points FROM points JOIN pat ON {_inside} GROUP BY 1 HAVING count(*) >= 100"))
def _(e):
    return tiling.valid_patches(tiling.in_patches(e.points(), *tiling.transcript_axes(e.points(), 20, 4)), 100)


@query("roi_patches", sql("roi", "#pat AS (" + _patch_sql(20, 0, 3, 0, 0, 20) + "), cut AS (SELECT p.patch_id, greatest(p.xmin, r.xmin) AS xmin, greatest(p.ymin, r.ymin) AS ymin, least(p.xmax, r.xmax) AS xmax, least(p.ymax, r.ymax) AS ymax FROM pat p JOIN roi r ON p.xmin < r.xmax AND r.xmin < p.xmax AND p.ymin < r.ymax AND r.ymin < p.ymax) SELECT CAST(row_number() OVER (ORDER BY patch_id, xmin, ymin, xmax, ymax) - 1 AS BIGINT) AS patch_id, patch_id AS old_id, xmin, ymin, xmax, ymax FROM cut"))
def _(e):
    p = tiling.image_patches(e.spark, 60, 60, 20).withColumns({c: F.col(c).cast("double") for c in ("xmin", "ymin", "xmax", "ymax")})
    return tiling.patches_in_roi(p, e.roi()).select("patch_id", "old_id", "xmin", "ymin", "xmax", "ymax")


@query("unassigned_to_zero", sql("points", f"SELECT {_ids}, CAST(CASE WHEN gene IS NULL THEN -1 WHEN gene = 'BLANK_7' THEN 0 ELSE r END AS BIGINT) AS prior FROM points LEFT JOIN (SELECT gene AS g, row_number() OVER (ORDER BY gene) AS r FROM (SELECT DISTINCT gene FROM points WHERE gene IS NOT NULL AND gene <> 'BLANK_7')) ON gene = g"))
def _(e):
    return tiling.recode_unassigned(e.points(), "gene", "BLANK_7").select(*POINT_ID, "prior")


def _keyed(e):
    return e.points().withColumn("point_id", F.col("l_orderkey") * 8 + F.col("l_linenumber"))


for _level in (0, 1, 2):
    _where = "" if _level == 0 else f" WHERE ((l_orderkey * 8 + l_linenumber) * 2654435761) % 4294967296 < {4294967296 // 4**_level}"

    @query(f"tile_pyramid_level{_level}", sql("points", f"SELECT CAST(floor(x / {10 * 2**_level}) AS INT) AS tx, CAST(floor(y / {10 * 2**_level}) AS INT) AS ty, count(*) AS n FROM points{_where} GROUP BY 1, 2"))
    def _(e, level=_level):
        return tiling.pyramid_level(_keyed(e), level, 10)


@query("gene_density_grid", sql("points", 'SELECT gene, CAST(floor(y / 5) AS INT) AS "row", CAST(floor(x / 5) AS INT) AS col, count(*) AS n FROM points WHERE gene IS NOT NULL GROUP BY 1, 2, 3'))
def _(e):
    return tiling.density_grid(e.points().where("gene IS NOT NULL"), 5, ["gene"])


@query("metrics_density", sql("points", "SELECT CAST(floor(y / 10) AS INT) AS \"row\", CAST(floor(x / 10) AS INT) AS col, count(*) AS total, count(*) AS total_again, CAST(coalesce(sum(CASE WHEN regexp_matches(lower(gene), 'negcontrol|negprobe') THEN 1 ELSE 0 END), 0) AS BIGINT) AS negative, CAST(0 AS BIGINT) AS zero FROM points GROUP BY 1, 2"))
def _(e):
    return tiling.metrics_density(e.points(), 10)


@query("padded_region", sql("image", "SELECT c.c, CAST(gy.i AS INT) AS y, CAST(gx.i AS INT) AS x, coalesce(i.value, 0) AS value FROM (SELECT DISTINCT c FROM image) c, range(40, 60) gx(i), range(40, 60) gy(i) LEFT JOIN image i ON i.c = c.c AND i.x = gx.i AND i.y = gy.i"))
def _(e):
    return tiling.padded_region(e.image(), 40, 40, 20, 20)


@query("patch_centroids", "SELECT CAST(i AS BIGINT) AS patch_id, CAST((i % 3) * 200 + 150 AS DOUBLE) AS x, CAST((i // 3) * 200 + 150 AS DOUBLE) AS y FROM range(9) t(i)")
def _(e):
    return tiling.patch_centroids(tiling.image_patches(e.spark, 512, 512, 300, 100))


@query("prior_centroids", sql("diamonds", "SELECT row_number() OVER (ORDER BY ord) AS cell, round(cx, 6) AS x, round(cy, 6) AS y, CAST(0 AS DOUBLE) AS z FROM diamonds"))
def _(e):
    return tiling.prior_centroids(e.diamonds()).withColumns({c: F.round(c, 6) for c in "xy"})


@query("bins_to_prior", sql("bins cells", "SELECT CAST(b.bin_id AS BIGINT) AS left_key, CAST(coalesce(min(c.ord) + 1, 0) AS BIGINT) AS cell FROM bins b LEFT JOIN cells c ON b.x - 0.5 <= c.xmax AND c.xmin <= b.x + 0.5 AND b.y - 0.5 <= c.ymax AND c.ymin <= b.y + 0.5 GROUP BY 1"))
def _(e):
    half = lambda c, by: (F.col(c) + by).alias(("xmin" if by < 0 else "xmax") if c == "x" else ("ymin" if by < 0 else "ymax"))
    squares = e.bins().select(F.col("bin_id").cast("long").alias("ord"), half("x", -0.5), half("x", 0.5), half("y", -0.5), half("y", 0.5))
    return spatial.first_shape(squares, e.cells())


# conflicts


@query("conflict_pairs", sql("cells", f"SELECT a.ord AS src, b.ord AS dst FROM cells a JOIN cells b ON a.ord < b.ord AND {_overlap}"))
def _(e):
    return resolve.conflict_pairs(e.cells())


@query("conflict_components", sql("nodes", "#p AS (SELECT a.node AS u, b.node AS v FROM nodes a JOIN nodes b ON a.node <> b.node AND abs(a.x - b.x) <= 8 AND abs(a.y - b.y) <= 8), reach AS (SELECT node, node AS r FROM nodes UNION SELECT r.node, p.v FROM reach r JOIN p ON p.u = r.r) SELECT node AS ord, min(r) AS component FROM reach GROUP BY 1", recursive=True))
def _(e):
    n = e.nodes().select(F.col("node").alias("ord"), (F.col("x") - 4).alias("_a"), (F.col("y") - 4).alias("_b"), (F.col("x") + 4).alias("_c"), (F.col("y") + 4).alias("_d"))
    cells = n.withColumns(G.box("_a", "_b", "_c", "_d")).drop("_a", "_b", "_c", "_d")
    return resolve.conflict_components(cells, resolve.conflict_pairs(cells))


@query("resolve_conflicts")
def _(e):
    return resolve.solve_conflicts(e.diamonds(), 0.5).select("ord", "source_ord", "merged", F.round(G.area(), 6).alias("area"))


@query("combine_segmentations")
def _(e):
    return resolve.combine([e.diamonds(), e.diamonds()], 0.5).select("ord", "source_ord", "merged", F.round(G.area(), 6).alias("area"))


def _pairs_of(e, first, second):
    """Two rings for each supplier, far from those of others and 1 to 3 times as large: numbers 2k and 2k + 1."""
    k = F.col("s_suppkey")
    parts = [e.table("supplier").select((2 * k + i).alias("ord"), (1 + k % 3).cast("double").alias("s"), (40 * k).cast("double").alias("o"), F.lit(i).alias("i")) for i in (0, 1)]
    both = parts[0].unionByName(parts[1])
    at = lambda d, shift: F.when(F.col("i") == 0, F.array(*(F.lit(float(p[d])) for p in first))).otherwise(F.array(*(F.lit(float(p[d])) for p in second)))
    both = both.withColumns({"xs": at(0, True), "ys": at(1, False)})
    return G.with_bounds(both.select("ord", F.transform("xs", lambda v: v * F.col("s") + F.col("o")).alias("xs"), F.transform("ys", lambda v: v * F.col("s")).alias("ys")))


_scale = "(1 + s_suppkey % 3)"


@query("resolve_concave", f"SELECT CAST(2 * s_suppkey AS BIGINT) AS source_ord, true AS merged, CAST(14 * {_scale} * {_scale} AS DOUBLE) AS area FROM supplier")
def _(e):
    cells = _pairs_of(e, [(0, 0), (4, 0), (4, 2), (2, 2), (2, 4), (0, 4)], [(1, 0), (5, 0), (5, 2), (1, 2)])
    return resolve.solve_conflicts(cells, 0.5).select("source_ord", "merged", F.round(G.area(), 6).alias("area"))


@query("remove_overlap", f"SELECT CAST(2 * s_suppkey + i AS BIGINT) AS ord, CAST(12 * {_scale} * {_scale} AS DOUBLE) AS area, CAST(40 * s_suppkey + 3 * i * {_scale} AS DOUBLE) AS xmin FROM supplier, range(2) t(i)")
def _(e):
    cells = _pairs_of(e, [(0, 0), (4, 0), (4, 4), (0, 4)], [(2, 0), (6, 0), (6, 4), (2, 4)])
    return outlines.remove_overlap(cells).select("ord", F.round(G.area(), 6).alias("area"), F.round("xmin", 6).alias("xmin"))


@query("valid_polygons", f"SELECT CAST(2 * s_suppkey + i AS BIGINT) AS ord, CAST((CASE i WHEN 0 THEN 4 ELSE 6 END) * {_scale} * {_scale} AS DOUBLE) AS area FROM supplier, range(2) t(i)")
def _(e):
    cells = _pairs_of(e, [(0, 0), (4, 4), (4, 0), (0, 4)], [(8, 0), (11, 0), (11, 2), (8, 2)])
    return outlines.valid_polygons(cells).select(F.col("ord").cast("long").alias("ord"), F.round(G.area(), 6).alias("area"))


_within = "a.xmin >= b.xmin AND a.xmax <= b.xmax AND a.ymin >= b.ymin AND a.ymax <= b.ymax"
_around = "b.xmin >= a.xmin AND b.xmax <= a.xmax AND b.ymin >= a.ymin AND b.ymax <= a.ymax"
_touch = "(a.xmin = b.xmax OR b.xmin = a.xmax OR a.ymin = b.ymax OR b.ymin = a.ymax)"
for _predicate, _how in (("within", _within), ("contains", _around), ("touches", _touch), ("overlaps", f"NOT {_touch} AND NOT ({_within}) AND NOT ({_around})")):

    @query(f"sjoin_{_predicate}", sql("cells cells2", f"SELECT a.ord AS left_key, b.ord AS right_key FROM cells a JOIN cells2 b ON {_overlap} AND {_how}"))
    def _(e, predicate=_predicate):
        return spatial.sjoin(e.cells(), e.cells2(), exact="polygon", predicate=predicate)


@query("dissolve", sql("cells", "#u AS (SELECT DISTINCT c.ord % 7 AS g, CAST(gx.i AS DOUBLE) AS x, CAST(gy.i AS DOUBLE) AS y FROM cells c, range(-5, 60) gx(i), range(-5, 60) gy(i) WHERE gx.i >= c.xmin AND gx.i < c.xmax AND gy.i >= c.ymin AND gy.i < c.ymax) SELECT g, CAST(count(*) AS DOUBLE) AS area FROM u GROUP BY 1"))
def _(e):
    rings = outlines.dissolve(e.cells().withColumn("g", F.col("ord") % 7), "g")
    return rings.groupBy("g").agg(F.round(F.sum(G.signed_area()), 6).alias("area"))


@query("roi_patches_polygons", sql("roi", "#pat AS (" + _patch_sql(20, 0, 3, 0, 0, 20) + ") SELECT p.patch_id AS old_id, CAST(sum((least(p.xmax, r.xmax) - greatest(p.xmin, r.xmin)) * (least(p.ymax, r.ymax) - greatest(p.ymin, r.ymin))) AS DOUBLE) AS area FROM pat p JOIN roi r ON p.xmin < r.xmax AND r.xmin < p.xmax AND p.ymin < r.ymax AND r.ymin < p.ymax GROUP BY 1"))
def _(e):
    p = tiling.image_patches(e.spark, 60, 60, 20)
    r = e.roi().select(F.col("xmin").alias("_a"), F.col("ymin").alias("_b"), F.col("xmax").alias("_c"), F.col("ymax").alias("_d"))
    return tiling.patches_in_polygons(p, r.withColumns(G.box("_a", "_b", "_c", "_d"))).select("old_id", F.round("area", 6).alias("area"))


@query("roi_patches_centroids", sql("roi", "#pat AS (" + _patch_sql(20, 0, 3, 0, 0, 20) + ") SELECT p.patch_id AS old_id FROM pat p WHERE EXISTS (SELECT 1 FROM roi r WHERE (r.xmin + r.xmax) / 2 BETWEEN p.xmin AND p.xmax AND (r.ymin + r.ymax) / 2 BETWEEN p.ymin AND p.ymax)"))
def _(e):
    p = tiling.image_patches(e.spark, 60, 60, 20)
    r = e.roi().select(F.col("xmin").alias("_a"), F.col("ymin").alias("_b"), F.col("xmax").alias("_c"), F.col("ymax").alias("_d"))
    return tiling.patches_with_centroids(p, r.withColumns(G.box("_a", "_b", "_c", "_d"))).select("old_id")


@query("chunk_offsets", "WITH c AS (SELECT CAST(n_nationkey // 5 AS INT) AS row, CAST(n_nationkey % 5 AS INT) AS col, CAST(10 + 3 * (n_nationkey // 5) AS INT) AS height, CAST(7 + n_nationkey % 5 AS INT) AS width FROM nation) SELECT *, CAST((SELECT coalesce(sum(height), 0) FROM c d WHERE d.col = c.col AND d.row < c.row) AS BIGINT) AS y0, CAST((SELECT coalesce(sum(width), 0) FROM c d WHERE d.row = c.row AND d.col < c.col) AS BIGINT) AS x0 FROM c")
def _(e):
    k = F.col("n_nationkey")
    c = e.table("nation").select(F.floor(k / 5).cast("int").alias("row"), (k % 5).cast("int").alias("col"), (10 + 3 * F.floor(k / 5)).cast("int").alias("height"), (7 + k % 5).cast("int").alias("width"))
    return tiling.chunk_offsets(c)


# graphs


def _graph(e):
    nodes = e.nodes().cache()
    tri = graph.delaunay(nodes).cache()
    edges = graph.pruned(graph.triangle_edges(tri, nodes), 45.0)
    both = edges.unionByName(edges.select("lib", F.col("dst").alias("src"), F.col("src").alias("dst"), "dist")).cache()
    return nodes, tri, edges, both


@query("delaunay_triangles", sql("triangles", "SELECT * FROM triangles"))
def _(e):
    return graph.delaunay(e.nodes())


@query("delaunay_edges", sql("edges", "SELECT lib, src, dst, round(dist, 6) AS dist FROM edges"))
def _(e):
    return graph.triangle_edges(graph.delaunay(e.nodes()), e.nodes()).withColumn("dist", F.round("dist", 6))


@query("spatial_neighbors", sql("both_edges", "SELECT lib, src, dst, round(dist, 6) AS dist FROM both_edges"))
def _(e):
    return graph.spatial_neighbors(e.nodes(), 45.0).withColumn("dist", F.round("dist", 6))


@query("spatial_neighbors_percentile", sql("edges", "#q AS (SELECT lib, quantile_cont(dist, 0.8) AS q FROM edges GROUP BY 1) SELECT lib, src, dst, round(dist, 6) AS dist FROM edges JOIN q USING (lib) WHERE dist <= q UNION ALL SELECT lib, dst, src, round(dist, 6) FROM edges JOIN q USING (lib) WHERE dist <= q UNION ALL SELECT lib, node, node, 0 FROM nodes"))
def _(e):
    return graph.spatial_neighbors(e.nodes(), percentile=80.0, set_diag=True).withColumn("dist", F.round("dist", 6))


def _hops_sql(group: str, ignore: bool, name: str = "hops") -> str:
    walk = f"walk_{name} AS (SELECT node, {group} AS grp, 0 AS hops FROM nodes UNION SELECT b.dst, w.grp, w.hops + 1 FROM walk_{name} w JOIN both_edges b ON b.src = w.node WHERE w.hops < 25)"
    return f"{walk}, {name} AS (SELECT node, grp, min(hops) AS hops FROM walk_{name}{' WHERE hops > 0' if ignore else ''} GROUP BY 1, 2)"


for _ignore in (False, True):

    @query("cells_to_groups" + "_ignore_zeros" * _ignore, sql("both_edges", "#" + _hops_sql("cell_type", _ignore) + " SELECT node, grp, CAST(hops AS INT) AS hops FROM hops", recursive=True))
    def _(e, ignore=_ignore):
        nodes, _, _, both = _graph(e)
        return graph.cells_to_groups(nodes, both, "cell_type", ignore).select("node", "grp", F.col("hops").cast("int").alias("hops"))

    @query("mean_distance" + "_ignore_zeros" * _ignore, sql("both_edges", "#" + _hops_sql("cell_type", _ignore) + " SELECT n.niche AS grp, h.grp AS target, round(avg(hops), 6) AS hops FROM hops h JOIN nodes n USING (node) GROUP BY 1, 2", recursive=True))
    def _(e, ignore=_ignore):
        nodes, _, _, both = _graph(e)
        return graph.mean_distance(nodes, graph.cells_to_groups(nodes, both, "cell_type", ignore), "niche").withColumn("hops", F.round("hops", 6))


_null = "(SELECT sum(d * (pow(1 - p, 4 * d * (d - 1) + 1) - pow(1 - p, 4 * d * (d + 1) + 1))) FROM range(1, 30) t(d))"


@query("mean_distance_corrected", sql("both_edges", "#" + _hops_sql("cell_type", False) + f", sh AS (SELECT cell_type AS t, count(*) / CAST((SELECT count(*) FROM nodes) AS DOUBLE) AS p FROM nodes GROUP BY 1), ex AS (SELECT t, {_null} AS ex FROM sh), m AS (SELECT n.niche AS grp, h.grp AS target, avg(hops) AS hops FROM hops h JOIN nodes n USING (node) GROUP BY 1, 2) SELECT m.grp, m.target, round(m.hops - ex, 6) AS hops FROM m JOIN ex ON ex.t = m.target", recursive=True))
def _(e):
    nodes, _, _, both = _graph(e)
    hops = graph.cells_to_groups(nodes, both, "cell_type")
    return graph.mean_distance_corrected(nodes, hops, "niche", "cell_type").withColumn("hops", F.round("hops", 6))


_four = " UNION ALL ".join(f"SELECT n.{g} AS a, h.grp AS b, avg(hops) AS d FROM {h} h JOIN nodes n USING (node) GROUP BY 1, 2" for g in ("niche", "cell_type") for h in ("hops_n", "hops_t"))


@query("prepare_network", sql("both_edges", "#" + _hops_sql("niche", False, "hops_n") + ", " + _hops_sql("cell_type", False, "hops_t") + f", four AS ({_four}), w AS (SELECT a, b, CASE WHEN d = 0 THEN 3 ELSE least(3, 1 / d) END AS w FROM four WHERE a <> b) SELECT a, b, round(sum(w) / 2, 6) AS weight FROM (SELECT * FROM w UNION ALL SELECT b, a, w FROM w) GROUP BY 1, 2", recursive=True))
def _(e):
    nodes, _, _, both = _graph(e)
    hops = {g: graph.cells_to_groups(nodes, both, g) for g in ("niche", "cell_type")}
    d = None
    for own in ("niche", "cell_type"):
        for target in ("niche", "cell_type"):
            m = graph.mean_distance(nodes, hops[target], own)
            d = m if d is None else d.unionByName(m)
    return graph.prepare_network(d).withColumn("weight", F.round("weight", 6))


_tri = "ntri AS (SELECT t.lib, t.a, t.b, t.c, p.niche FROM triangles t JOIN nodes p ON p.node = t.a JOIN nodes q ON q.node = t.b JOIN nodes r ON r.node = t.c WHERE p.niche = q.niche AND q.niche = r.niche AND EXISTS (SELECT 1 FROM kept_edges k WHERE k.src = a AND k.dst = b) AND EXISTS (SELECT 1 FROM kept_edges k WHERE k.src = a AND k.dst = c) AND EXISTS (SELECT 1 FROM kept_edges k WHERE k.src = b AND k.dst = c)), tn AS (SELECT row_number() OVER (ORDER BY a, b, c) AS t, * FROM ntri), ts AS (SELECT t, a AS u, b AS v FROM tn UNION ALL SELECT t, a, c FROM tn UNION ALL SELECT t, b, c FROM tn), treach AS (SELECT t, t AS r FROM tn UNION SELECT r.t, y.t FROM treach r JOIN ts x ON x.t = r.r JOIN ts y ON y.u = x.u AND y.v = x.v), comp AS (SELECT t, min(r) AS component FROM treach GROUP BY 1), ta AS (SELECT tn.niche, component, sum(abs((q.x-p.x)*(r.y-p.y)-(q.y-p.y)*(r.x-p.x)) / 2) AS area FROM tn JOIN comp USING (t) JOIN nodes p ON p.node = a JOIN nodes q ON q.node = b JOIN nodes r ON r.node = c GROUP BY 1, 2), rim AS (SELECT niche, component, u, v FROM ts JOIN comp USING (t) JOIN tn USING (t) GROUP BY 1, 2, 3, 4 HAVING count(*) = 1), tl AS (SELECT rim.niche, component, sum(sqrt((p.x-q.x)**2 + (p.y-q.y)**2)) AS length FROM rim JOIN nodes p ON p.node = u JOIN nodes q ON q.node = v GROUP BY 1, 2), geo AS (SELECT niche, component, area, length, 4 * pi() * area / (length * length) AS roundness FROM ta JOIN tl USING (niche, component)) "


def _niche_parts(e):
    nodes, tri, edges, _ = _graph(e)
    return nodes, niches.niche_components(niches.niche_triangles(tri, nodes, edges))


@query("niche_components", sql("kept_edges", "#" + _tri + "SELECT niche, round(area, 6) AS area, round(length, 6) AS length, round(roundness, 6) AS roundness FROM geo", recursive=True))
def _(e):
    nodes, parts = _niche_parts(e)
    return niches.component_geometry(parts, nodes).select("niche", *(F.round(c, 6).alias(c) for c in ("area", "length", "roundness")))


@query("niche_stats", sql("kept_edges", "#" + _tri + "SELECT niche, count(*) AS n_components, round(avg(length), 6) AS length, round(avg(area), 6) AS area, round(avg(roundness), 6) AS roundness FROM geo g WHERE area >= 0.05 * (SELECT max(area) FROM geo h WHERE h.niche = g.niche) GROUP BY 1", recursive=True))
def _(e):
    nodes, parts = _niche_parts(e)
    s = niches.geometry_stats(niches.major_components(niches.component_geometry(parts, nodes)))
    return s.select("niche", "n_components", *(F.round(c, 6).alias(c) for c in ("length", "area", "roundness")))


@query("niche_outlines", sql("kept_edges", "#" + _tri + "SELECT niche, round(area, 6) AS area, round(length, 6) AS length FROM geo", recursive=True))
def _(e):
    nodes, parts = _niche_parts(e)
    rings = outlines.niche_outlines(parts, nodes)
    return rings.groupBy("niche", "component").agg(F.round(F.sum(G.signed_area()), 6).alias("area"), F.round(F.sum(G.perimeter()), 6).alias("length")).drop("component")


@query("niche_distances")
def _(e):
    nodes, parts = _niche_parts(e)
    return niches.niche_distances(parts, nodes).withColumn("distance", F.round("distance", 6))


# annotation, embeddings


@query("shared_genes", sql("counts", "SELECT gene, p_brand AS reference_gene, n_cells FROM (SELECT gene, count(*) AS n_cells FROM counts GROUP BY 1) JOIN (SELECT DISTINCT upper(p_brand) AS p_brand FROM part) ON lower(gene) = lower(p_brand)"))
def _(e):
    c = A.count_transcripts(e.points(), e.cells(), exact=_box)
    ref = e.table("part").select(F.upper("p_brand").alias("gene"), F.lit(1).alias("n"))
    return N.shared_genes(c, ref)


@query("density_priors", sql("counts", "SELECT ord, 1 / CAST(count(*) OVER () AS DOUBLE) AS uniform_density, CAST(t AS DOUBLE) / sum(t) OVER () AS rna_density FROM (SELECT ord, CAST(sum(n) AS BIGINT) AS t FROM counts GROUP BY 1)"))
def _(e):
    return N.density_priors(A.count_transcripts(e.points(), e.cells(), exact=_box))


@query("annotation_bags", "SELECT c_custkey, CAST(floor((c_custkey * 2654435761) % 4294967296 * (SELECT (count(*) + 499) // 500 FROM customer) / 4294967296.0) AS INT) AS bag FROM customer")
def _(e):
    return N.bags(e.table("customer").select("c_custkey"), "c_custkey", 500)


@query("subsample", "SELECT c_custkey FROM customer ORDER BY (c_custkey * 2654435761) % 4294967296, c_custkey LIMIT 100")
def _(e):
    return N.subsample(e.table("customer").select("c_custkey"), "c_custkey", 100)


@query("annotation_proportions", "SELECT c_mktsegment, count(*) AS n, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS share FROM customer GROUP BY 1")
def _(e):
    return N.proportions(e.table("customer"), "c_mktsegment")


@query("parent_consistency", "SELECT p_brand, count(DISTINCT p_type) AS n_parents FROM part GROUP BY 1 HAVING count(DISTINCT p_type) <> 1")
def _(e):
    return N.parent_consistency(e.table("part"), "p_brand", "p_type")


@query("embedding_nearest_centroid")
def _(e):
    v = e.table("embeddings")
    centre = v.groupBy(F.col("label").alias("centroid")).agg(F.array(*(F.avg(F.col("embedding")[k].cast("double")) for k in range(64))).alias("centre"))
    return N.nearest_centroid(v, centre)


@query("embedding_kmeans")
def _(e):
    return N.kmeans(e.table("embeddings"), 10)


@query("embedding_pca")
def _(e):
    return N.pca(e.table("embeddings"), 3).select("vec_id", *(F.round(F.abs(F.col("pc")[k]), 4).alias(f"pc{k + 1}") for k in range(3)))


@query("label_propagation")
def _(e):
    nodes, _, _, both = _graph(e)
    return N.propagate_labels(both, nodes)


@query("embed_tiles", sql("image", "SELECT CAST(py * 4 + px AS BIGINT) AS patch_id, n.c, coalesce(value, 0) / CAST(255 AS DOUBLE) AS value FROM (SELECT i % 4 AS px, i // 4 AS py FROM range(16) t(i)) CROSS JOIN (SELECT unnest(['F', 'O']) AS c) n LEFT JOIN image m ON m.c = n.c AND m.x = px * 13 AND m.y = py * 13"))
def _(e):
    channels = ["F", "O"]
    t = staining.embed_tiles(e.image(), tiling.image_patches(e.spark, 50, 50, 13), "dummy", channels)
    return t.select("patch_id", F.posexplode("embedding").alias("k", "value")).select("patch_id", F.array(*map(F.lit, channels))[F.col("k")].alias("c"), "value")


@query("segment_patches")
def _(e):
    s = staining.segment(e.image(), tiling.image_patches(e.spark, 50, 50, 30), "dummy", ["F", "O"])
    return s.select("patch_id", "k", F.round(G.area(), 6).alias("area"))


@query("tissue_regions")
def _(e):
    g = e.image().groupBy("y", "x").agg(F.sum("value").cast("int").alias("value"))
    return staining.tissue(g, 1).select("k", "area")


# readers and sinks


@query("cosmx_global_id", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CAST(CASE WHEN l_partkey % 7 > 0 THEN l_suppkey * (SELECT max(l_partkey % 7) + 1 FROM lineitem) ELSE 0 END + l_partkey % 7 AS BIGINT) AS global_cell_id FROM lineitem")
def _(e):
    df = e.table("lineitem").select(*POINT_ID, (F.col("l_partkey") % 7).alias("cell_ID"))
    return readers.global_cell_id(df, "l_suppkey").drop("cell_ID")


@query("fov_offsets", sql("fovs", "SELECT fov, x AS xmin, y - 10 AS ymin, x + 10 AS xmax, y AS ymax, CAST(x - min(x) OVER () AS BIGINT) AS x_offset, CAST(y - min(y) OVER () AS BIGINT) AS y_offset FROM fovs"))
def _(e):
    return readers.fov_boxes(e.fovs(), 10.0, 10.0, True)


@query("fov_shift", sql("points fovs", "SELECT avg(CASE WHEN lo < y THEN 1.0 ELSE 0.0 END) AS share, avg(CASE WHEN lo < y THEN 1.0 ELSE 0.0 END) > 0.1 AS shift FROM (SELECT l_suppkey % 25 AS fov, min(y) AS lo FROM points GROUP BY 1) JOIN fovs USING (fov)"))
def _(e):
    p = e.points().select((F.col("l_suppkey") % 25).alias("fov"), "y")
    return readers.needs_shift(p, e.fovs())


@query("polygons_from_vertices", sql("diamonds", "SELECT ord, 4 AS n_vertices, cx - r AS xmin, cy - r AS ymin, cx + r AS xmax, cy + r AS ymax FROM diamonds"))
def _(e):
    v = e.diamonds().select("ord", F.posexplode(F.arrays_zip("xs", "ys")).alias("pos", "v")).select("ord", "pos", F.col("v.xs").alias("x"), F.col("v.ys").alias("y"))
    p = readers.polygons_from_vertices(v, ["ord"], "x", "y", "pos")
    return p.select("ord", F.size("xs").alias("n_vertices"), "xmin", "ymin", "xmax", "ymax")


@query("gene_counts_csr", sql("counts", "#g AS (SELECT 0 AS last, gene, count(*) AS n_entries FROM counts GROUP BY 2 UNION ALL SELECT 1, 'Total transcripts', count(DISTINCT ord) FROM counts) SELECT gene, CAST(row_number() OVER (ORDER BY last, gene) - 1 AS INT) AS pos, CAST(coalesce(sum(n_entries) OVER (ORDER BY last, gene ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS indptr, n_entries FROM g"))
def _(e):
    return sinks.gene_counts_csr(A.count_transcripts(e.points(), e.cells(), exact=_box), e.cells())[0]


@query("cell_categories", "SELECT category, CAST(row_number() OVER (ORDER BY category) - 1 AS INT) AS code, CAST(coalesce(sum(n) OVER (ORDER BY category ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS indptr, n FROM (SELECT coalesce(c_mktsegment, 'NA') AS category, count(*) AS n FROM customer GROUP BY 1)")
def _(e):
    return sinks.cell_categories(e.table("customer"), "c_mktsegment", "c_custkey")[0]


@query("polygon_vertices", sql("diamonds", "SELECT ord, 13 AS n_vertices, round((cx - r) * CAST(0.2125 AS DOUBLE), 6) AS xmin, round((cy + r) * CAST(0.2125 AS DOUBLE), 6) AS ymax FROM diamonds"))
def _(e):
    p = sinks.polygon_vertices(e.diamonds())
    return p.select("ord", F.size("xs").alias("n_vertices"), F.round(F.array_min("xs"), 6).alias("xmin"), F.round(F.array_max("ys"), 6).alias("ymax"))


@query("event_windows", "SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n FROM events GROUP BY 1, 2")
def _(e):
    return event_windows(e.table("events")).select("event_type", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")
