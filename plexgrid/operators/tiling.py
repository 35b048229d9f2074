"""Overlapping patches, what lies in them, and tile pyramids."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def patch_count(extent: float, width: float, overlap: float) -> int:
    if width <= overlap:
        raise ValueError("patches must be wider than their overlap")
    return 1 if width >= extent else math.ceil((extent - overlap) / (width - overlap))


class Axis:
    """Patches along one axis; ``tight`` narrows them until they just cover the extent."""

    def __init__(self, low: float, high: float, width: float | None, overlap: float, tight: bool):
        self.low, self.extent = low, high - low
        if width is None or width < 0:
            width = math.floor(self.extent + 1)
        self.n = patch_count(self.extent, width, overlap)
        if tight and self.n > 1 or tight and width > self.extent:
            width = (self.extent + (self.n - 1) * overlap) / self.n + 1e-4
        # a single patch has no next one, and may be narrower than the overlap
        self.width, self.step = width, width - overlap if self.n > 1 else max(width, 1e-9)


def patches(spark: SparkSession, x: Axis, y: Axis) -> DataFrame:
    """(patch_id, ix, iy, xmin, ymin, xmax, ymax), row by row."""
    p = spark.range(x.n * y.n).select(F.col("id").alias("patch_id"), (F.col("id") % x.n).cast("int").alias("ix"), F.floor(F.col("id") / x.n).cast("int").alias("iy"))
    a, b = F.lit(x.low) + F.col("ix") * x.step, F.lit(y.low) + F.col("iy") * y.step
    return p.withColumns({"xmin": a, "ymin": b, "xmax": a + x.width, "ymax": b + y.width})


def image_patches(spark: SparkSession, width_px: int, height_px: int, patch: float | None, overlap: float = 0) -> DataFrame:
    """Patches over an image; the last ones may reach beyond it."""
    return patches(spark, Axis(0, width_px, patch, overlap, False), Axis(0, height_px, patch, overlap, False))


def transcript_axes(points: DataFrame, patch: float | None, overlap: float = 0) -> tuple[Axis, Axis]:
    r = points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    return Axis(float(r[0]), float(r[1]), patch, overlap, True), Axis(float(r[2]), float(r[3]), patch, overlap, True)


def in_patches(points: DataFrame, x: Axis, y: Axis) -> DataFrame:
    """Points with each ``patch_id`` they lie in, the border included. The indices are computed; there is no join."""

    def span(name: str, axis: Axis):
        v = F.col(name) - axis.low
        first = F.greatest(F.lit(0), F.ceil((v - axis.width) / axis.step)).cast("int")
        last = F.least(F.lit(axis.n - 1), F.floor(v / axis.step)).cast("int")
        return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))

    out = points.withColumn("_ix", F.explode(span("x", x))).withColumn("_iy", F.explode(span("y", y)))
    return out.withColumn("patch_id", (F.col("_iy") * x.n + F.col("_ix")).cast("long")).drop("_ix", "_iy")


def valid_patches(assigned: DataFrame, min_points: int, cells: DataFrame | None = None, min_cells: int = 0) -> DataFrame:
    """(patch_id, n_points[, n_cells]) of the patches with enough points, and enough cell centres if given."""
    out = assigned.groupBy("patch_id").agg(F.count("*").alias("n_points")).where(F.col("n_points") >= min_points)
    if cells is not None and min_cells:
        n = cells.groupBy("patch_id").agg(F.count("*").alias("n_cells"))
        out = out.join(n, "patch_id").where(F.col("n_cells") >= min_cells)
    return out


def patches_in_roi(tiles: DataFrame, roi: DataFrame) -> DataFrame:
    """Patches cut to the boxes of ``roi``, without those outside, numbered anew; one row for each box met."""
    from .storage import ordinals
    from .spatial import shape_pairs

    need = ["xmin", "ymin", "xmax", "ymax"]
    pairs = shape_pairs(tiles.select("patch_id", *need), roi.select(*need))
    cut = pairs.select(F.col("a.patch_id").alias("old_id"), *(F.expr(f"{'greatest' if c[1:] == 'min' else 'least'}(a.{c}, b.{c})").alias(c) for c in need))
    cut = cut.where("xmax > xmin AND ymax > ymin")
    return ordinals(cut, ["old_id", *need], "patch_id")


def patches_in_polygons(tiles: DataFrame, roi: DataFrame) -> DataFrame:
    """Patches cut to the union of the polygons of ``roi``, without those outside, numbered anew.

    (patch_id, old_id, parts, area and the whole patch's bounds); ``parts`` are
    rings with ``hole``. A patch's group are the polygons that reach into it.
    """
    from .kernels.overlay import area_of, overlay, signed_area
    from .spatial import shape_pairs
    from .storage import ordinals

    need = ["xmin", "ymin", "xmax", "ymax"]
    pairs = shape_pairs(tiles.select("patch_id", *need), roi.select("xs", "ys", *need))
    rows = pairs.select(F.col("a.patch_id").cast("long").alias("old_id"), *(F.col(f"a.{c}").cast("double").alias(c) for c in need), "b.xs", "b.ys")

    def run(pdf):
        import pandas as pd

        x0, y0, x1, y1 = (float(pdf[c].iloc[0]) for c in need)
        shapes = [[[(x0, y0), (x1, y0), (x1, y1), (x0, y1)]], *([list(zip(x, y, strict=True))] for x, y in zip(pdf["xs"], pdf["ys"], strict=True))]
        rings = overlay(shapes, lambda s: s[:, 0] & s[:, 1:].any(1))
        parts = [{"xs": [p[0] for p in r], "ys": [p[1] for p in r], "hole": signed_area(r) < 0} for r in rings]
        return pd.DataFrame({"old_id": [int(pdf["old_id"].iloc[0])], "parts": [parts], "area": [area_of(rings)], "xmin": x0, "ymin": y0, "xmax": x1, "ymax": y1})

    schema = "old_id long, parts array<struct<xs: array<double>, ys: array<double>, hole: boolean>>, area double, " + ", ".join(f"{c} double" for c in need)
    return ordinals(rows.groupBy("old_id").applyInPandas(run, schema).where("area > 0"), ["old_id"], "patch_id")


def patches_with_centroids(tiles: DataFrame, roi: DataFrame) -> DataFrame:
    """Whole patches that hold the centre of some polygon of ``roi``, the border included, numbered anew."""
    from ..functions import geometry as G
    from .spatial import in_box, points_in_shapes
    from .storage import ordinals

    cx, cy = G.centroid()
    boxes = tiles.select(F.col("patch_id").alias("old_id"), *(F.col(c).cast("double").alias(c) for c in ("xmin", "ymin", "xmax", "ymax")))
    held = points_in_shapes(roi.select(cx.alias("x"), cy.alias("y")), boxes, in_box())
    return ordinals(boxes.join(held.select("old_id").distinct(), "old_id", "left_semi"), ["old_id"], "patch_id")


def chunk_offsets(chunks: DataFrame) -> DataFrame:
    """Chunks (row, col, height, width) of an image with ``y0`` and ``x0``, the sizes of those before added up."""

    def before(at: str, size: str, out: str) -> DataFrame:
        # one row for each row (or column) of chunks
        lines = chunks.groupBy(at).agg(F.max(size).alias("_s"))
        return lines.select(at, F.coalesce(F.sum("_s").over(Window.orderBy(at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long").alias(out))

    return chunks.join(before("row", "height", "y0"), "row").join(before("col", "width", "x0"), "col")


def recode_unassigned(df: DataFrame, column: str, unassigned, out: str = "prior") -> DataFrame:
    """Unassigned becomes 0. Strings get numbers from 1 in order of name, null -1; integers keep theirs, but an old 0 becomes the largest integer less 1."""
    kind = dict(df.dtypes)[column]
    if kind == "string":
        names = df.where(F.col(column).isNotNull() & (F.col(column) != unassigned)).select(column).distinct()
        from .storage import ordinals

        codes = ordinals(names, [column], "_code")
        coded = df.join(codes, column, "left")
        return coded.withColumn(out, F.when(F.col(column).isNull(), -1).when(F.col(column) == unassigned, 0).otherwise(F.col("_code") + 1).cast("long")).drop("_code")
    if kind in ("int", "bigint", "smallint", "tinyint"):
        c = F.col(column).cast("long")
        if unassigned == 0:
            return df.withColumn(out, c)
        return df.withColumn(out, F.when(c == unassigned, F.lit(0)).when(c == 0, F.lit(2**63 - 2)).otherwise(c))
    raise ValueError(f"{column}: strings or integers are needed, not {kind}")


def pyramid_level(points: DataFrame, level: int, tile: float, x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    """(tx, ty, n) of a level whose tiles are ``tile`` times 2^level wide; a level keeps a quarter of the points below it.

    Which points stay follows from a hash that only depends on ``point_id``.
    """
    kept = points if level == 0 else points.where((F.col("point_id") * 2654435761) % 4294967296 < 4294967296 // 4**level)
    side = tile * 2**level
    at = lambda c, o: F.greatest(F.floor((F.col(c) - o) / side), F.lit(0)).cast("int")
    return kept.groupBy(at("x", x0).alias("tx"), at("y", y0).alias("ty")).agg(F.count("*").alias("n"))


def density_grid(points: DataFrame, cell: float, by: list[str], x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    """Counts of ``by`` in squares of a side of ``cell``: (…, row, col, n)."""
    at = lambda c, o: F.greatest(F.floor((F.col(c) - o) / cell), F.lit(0)).cast("int")
    return points.groupBy(*by, at("y", y0).alias("row"), at("x", x0).alias("col")).agg(F.count("*").alias("n"))


def metrics_density(points: DataFrame, cell: float, x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    """(row, col, total, total_again, negative, zero): the four channels of a coarse grid."""
    from ..functions.text import gene_category

    at = lambda c, o: F.greatest(F.floor((F.col(c) - o) / cell), F.lit(0)).cast("int")
    negative = F.sum((gene_category("gene") == "negative_control").cast("int"))
    g = points.groupBy(at("y", y0).alias("row"), at("x", x0).alias("col")).agg(F.count("*").alias("total"), negative.cast("long").alias("negative"))
    return g.select("row", "col", "total", F.col("total").alias("total_again"), "negative", F.lit(0).cast("long").alias("zero"))


def padded_region(pixels: DataFrame, x0: int, y0: int, width: int, height: int) -> DataFrame:
    """All pixels of a region, zero where the image has none."""
    spark = pixels.sparkSession
    grid = spark.range(width * height).select((F.col("id") % width + x0).cast("int").alias("x"), (F.floor(F.col("id") / width) + y0).cast("int").alias("y"))
    channels = pixels.select("c").distinct()
    inside = pixels.where(f"x >= {x0} AND x < {x0 + width} AND y >= {y0} AND y < {y0 + height}")
    return grid.crossJoin(channels).join(inside, ["c", "y", "x"], "left").withColumn("value", F.coalesce("value", F.lit(0)))


def patch_centroids(tiles: DataFrame) -> DataFrame:
    """(patch_id, x, y): the middle of each patch's box, whatever a region has cut from it."""
    return tiles.select("patch_id", ((F.col("xmin") + F.col("xmax")) / 2).alias("x"), ((F.col("ymin") + F.col("ymax")) / 2).alias("y"))


def prior_centroids(cells: DataFrame) -> DataFrame:
    """(cell, x, y, z): centres of prior cells, numbered from 1 in order, z being 0."""
    from ..functions import geometry as G
    from .storage import ordinals

    cx, cy = G.centroid()
    c = ordinals(cells.select("ord", cx.alias("x"), cy.alias("y")), ["ord"], "cell")
    return c.select((F.col("cell") + 1).alias("cell"), "x", "y", F.lit(0.0).alias("z"))
