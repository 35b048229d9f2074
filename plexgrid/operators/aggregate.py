"""Counting points, bins and pixels per cell, and the cell table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..functions.stats import log1p_tpm
from . import spatial
from .storage import ordinals, quantiles, written


def kept_points(points: DataFrame, gene: str = "gene", pattern: str | None = T.EXCLUDED, only_excluded: bool = False, low_quality: str = "low_quality_transcript") -> DataFrame:
    """Points that count: of good quality, and of a gene that is not excluded (or only of those that are)."""
    out = points
    if low_quality in points.columns:
        out = out.where(~F.coalesce(F.col(low_quality), F.lit(False)))
    gone = T.excluded(gene, pattern)
    # an excluded point without a gene has no column to be counted in
    return out.where(gone & F.col(gene).isNotNull()) if only_excluded else out.where(~gone)


def count_transcripts(points: DataFrame, cells: DataFrame, gene: str = "gene", pattern: str | None = T.EXCLUDED, only_excluded: bool = False, exact: Callable[[], Column] | None = None, order: str = "ord") -> DataFrame:
    """(order, gene, n): points of each gene in each cell; a point on a border or in several cells counts in each."""
    p = kept_points(points, gene, pattern, only_excluded).select("x", "y", gene)
    return spatial.counts_in_shapes(p, cells, [gene], exact, order=order)


def features(points: DataFrame, gene: str = "gene", pattern: str | None = T.EXCLUDED, only_excluded: bool = False) -> DataFrame:
    """All genes of the table's column axis, counted or not."""
    gone = T.excluded(gene, pattern)
    return points.where(F.col(gene).isNotNull() & (gone if only_excluded else ~gone)).select(gene).distinct()


def completed(counts: DataFrame, cells: DataFrame, genes: DataFrame, order: str = "ord", gene: str = "gene") -> DataFrame:
    """Every cell with every gene, zeros filled in. For sinks; grows as cells times genes."""
    grid = cells.select(order).crossJoin(F.broadcast(genes.select(gene)) if _small(genes) else genes.select(gene))
    return grid.join(counts, [order, gene], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def _small(df: DataFrame, rows: int = 100_000) -> bool:
    """True if ``df`` has at most ``rows`` rows; stops counting beyond."""
    return df.limit(rows + 1).count() <= rows


def aggregate_bins(bins: DataFrame, counts: DataFrame, cells: DataFrame, exact: Callable[[], Column] | None = None, reach: float = 0.0) -> DataFrame:
    """(ord, gene, n): bin counts summed over the cells that hold the bin's centre; a bin in two cells counts in both."""
    hits = spatial.points_in_shapes(bins.select("bin_id", "x", "y"), cells.select("ord", "xs", "ys", "xmin", "ymin", "xmax", "ymax"), exact, reach)
    return hits.select("ord", "bin_id").join(counts, "bin_id").groupBy("ord", "gene").agg(F.sum("n").cast("long").alias("n"))


def assign_bins_once(hits: DataFrame, counts: DataFrame) -> DataFrame:
    """(bin_id, ord), each bin in one cell: a shared bin goes to the cell whose profile is nearest to its own.

    Profiles are log parts per million; a cell's comes from the bins that it
    shares with no other. The distance is squared Euclidean over all genes; of
    equally near cells the first wins. ``hits`` has (bin_id, ord).
    """
    n = hits.groupBy("bin_id").agg(F.count("*").alias("_k"))
    marked = hits.join(n, "bin_id")
    alone, shared = marked.where("_k = 1").drop("_k"), marked.where("_k > 1").drop("_k")
    cell = log1p_tpm(alone.join(counts, "bin_id").groupBy("ord", "gene").agg(F.sum("n").alias("n")), "ord").select("ord", "gene", F.col("log_tpm").alias("c"))
    own = log1p_tpm(counts.join(shared.select("bin_id").distinct(), "bin_id", "left_semi"), "bin_id").select("bin_id", "gene", F.col("log_tpm").alias("b"))
    squares = lambda df, k, v: df.groupBy(k).agg(F.sum(F.col(v) * F.col(v)).alias(f"_{v}"))
    dots = shared.join(own, "bin_id").join(cell, ["ord", "gene"]).groupBy("bin_id", "ord").agg(F.sum(F.col("b") * F.col("c")).alias("_d"))
    d = shared.join(squares(own, "bin_id", "b"), "bin_id", "left").join(squares(cell, "ord", "c"), "ord", "left").join(dots, ["bin_id", "ord"], "left")
    zero = F.lit(0.0)
    d = d.withColumn("_far", F.round(F.coalesce("_b", zero) + F.coalesce("_c", zero) - 2 * F.coalesce("_d", zero), 6))
    best = d.groupBy("bin_id").agg(F.min(F.struct("_far", "ord")).alias("_best")).select("bin_id", F.col("_best.ord").alias("ord"))
    return alone.select("bin_id", "ord").unionByName(best)


def assign_bins_by_pca(hits: DataFrame, counts: DataFrame, genes: list[str], components: int) -> DataFrame:
    """As ``assign_bins_once``, with distances between principal components of the cells' profiles.

    ``genes`` is the column axis; vectors of that length are made for cells and
    for shared bins only. Where fewer than two cells have bins of their own
    there is nothing to project, and plain distances decide.
    """
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    n = hits.groupBy("bin_id").agg(F.count("*").alias("_k"))
    marked = hits.join(n, "bin_id")
    alone, shared = marked.where("_k = 1").drop("_k"), marked.where("_k > 1").drop("_k")
    if alone.select("ord").distinct().limit(2).count() < 2:
        return assign_bins_once(hits, counts)
    index = {g: i for i, g in enumerate(genes)}

    def vectors(df: DataFrame, by: str) -> DataFrame:
        pairs = F.map_from_entries(F.collect_list(F.struct("gene", "log_tpm")))
        names = F.array(*(F.lit(g) for g in index))
        m = log1p_tpm(df, by).groupBy(by).agg(pairs.alias("_m"))
        return m.select(by, array_to_vector(F.transform(names, lambda g: F.coalesce(F.element_at("_m", g), F.lit(0.0)))).alias("v"))

    cells = vectors(alone.join(counts, "bin_id").groupBy("ord", "gene").agg(F.sum("n").alias("n")), "ord")
    own = vectors(counts.join(shared.select("bin_id").distinct(), "bin_id", "left_semi"), "bin_id")
    model = PCA(k=components, inputCol="v", outputCol="p").fit(cells)
    near = shared.join(model.transform(own).select("bin_id", vector_to_array("p").alias("b")), "bin_id").join(model.transform(cells).select("ord", vector_to_array("p").alias("c")), "ord")
    far = F.aggregate(F.zip_with("b", "c", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, x: s + x)
    best = near.groupBy("bin_id").agg(F.min(F.struct(F.round(far, 9).alias("f"), "ord")).alias("_b")).select("bin_id", F.col("_b.ord").alias("ord"))
    return alone.select("bin_id", "ord").unionByName(best)


def aggregate_channels(pixels: DataFrame, cells: DataFrame, mode: str = "average", exact: Callable[[], Column] | None = None) -> DataFrame:
    """(ord, channel, value) of the pixels that a cell holds, its border included.

    ``pixels`` is long: c, y, x, value. The average is the sum over the number
    of pixels; max begins from 0. A cell without pixels isn't in the result.
    """
    outlines, members = spatial.distinct_shapes(cells)
    hits = spatial.points_in_shapes(pixels.withColumns({"x": F.col("x").cast("double"), "y": F.col("y").cast("double")}), outlines.drop("ord"), exact)
    parts = {"sum": F.sum("value"), "min": F.min("value"), "max": F.max("value"), "count": F.count("*")}
    need = ["sum", "count"] if mode == "average" else [mode]
    held = hits.groupBy("_shape", F.col("c").alias("channel")).agg(*(parts[k].alias(f"_{k}") for k in need))  # once for equal cells
    value = {"average": lambda: F.sum("_sum").cast("double") / F.sum("_count"), "min": lambda: F.min("_min").cast("double"), "max": lambda: F.greatest(F.max("_max"), F.lit(0)).cast("double")}[mode]()
    return members.join(held, "_shape").groupBy("ord", "channel").agg(value.alias("value"))


def cell_geometry(cells: DataFrame) -> DataFrame:
    """Id, centroid, area and region of each cell."""
    cx, cy = G.centroid()
    return cells.select("ord", T.cell_name("ord").alias("cell_id"), cx.alias("x"), cy.alias("y"), G.area().alias("area"))


def filter_flags(cells: DataFrame, counts: DataFrame | None = None, min_transcripts: int = 0, intensities: DataFrame | None = None, min_intensity_ratio: float = 0.0) -> DataFrame:
    """(ord, passes_filtering) by total count and by mean intensity against 0.9 quantile over all cells."""
    out = cells.select("ord")
    ok = F.lit(True)
    if counts is not None and min_transcripts:
        totals = counts.groupBy("ord").agg(F.sum("n").alias("_total"))
        out = out.join(totals, "ord", "left")
        ok &= F.coalesce("_total", F.lit(0)) >= min_transcripts
    if intensities is not None and min_intensity_ratio:
        means = cells.select("ord").join(intensities.groupBy("ord").agg(F.avg("value").alias("_mean")), "ord", "left").withColumn("_mean", F.coalesce("_mean", F.lit(0.0)))
        top = quantiles(means, "_mean", 0.9, out="_top")
        out = out.join(means, "ord").crossJoin(F.broadcast(top))
        ok &= F.col("_mean") >= min_intensity_ratio * F.col("_top")
    return out.select("ord", ok.alias("passes_filtering"))


def aggregate(
    cells: DataFrame,
    points: DataFrame | None = None,
    bins: tuple[DataFrame, DataFrame] | None = None,
    pixels: DataFrame | None = None,
    min_transcripts: int = 0,
    min_intensity_ratio: float = 0.1,
    expand_radius_ratio: float | None = None,
    no_overlap: bool = False,
    drop: bool = True,
    pattern: str | None = T.EXCLUDED,
) -> dict[str, DataFrame]:
    """The cell table: ``cells`` (with ids and flags), ``counts`` and ``intensities`` where there are sources.

    Bins come before points. Ids are given before cells are dropped, so they
    keep their numbers. ``expand_radius_ratio`` grows cells by that share of the
    mean radius (1 for bins, 0 for channels if none is given). If no cell
    passes and cells are dropped, that is an error.
    """
    counts = intensities = None
    if bins is not None:
        r = radius(cells, 1.0 if expand_radius_ratio is None else expand_radius_ratio)
        exact = (lambda: G.within_distance(r)) if r else None
        hits = spatial.points_in_shapes(bins[0].select("bin_id", "x", "y"), cells.select("ord", "xs", "ys", "xmin", "ymin", "xmax", "ymax"), exact, r).select("bin_id", "ord")
        hits = assign_bins_once(hits, bins[1]) if no_overlap else hits
        counts = hits.join(bins[1], "bin_id").groupBy("ord", "gene").agg(F.sum("n").cast("long").alias("n"))
    elif points is not None:
        counts = count_transcripts(points, cells, pattern=pattern)
    if pixels is not None:
        r = radius(cells, expand_radius_ratio or 0.0)
        exact = (lambda: G.within_distance(r)) if r else None
        intensities = aggregate_channels(pixels, cells, "average", exact)
    if counts is None and intensities is None:
        raise ValueError("nothing to aggregate: give points, bins or pixels")
    flags = written(filter_flags(cells, counts, min_transcripts, intensities, min_intensity_ratio), "flags")
    table = cell_geometry(cells).join(flags, "ord")
    if drop:
        if flags.where("passes_filtering").isEmpty() and not flags.isEmpty():
            raise ValueError("all cells were filtered; lower the limits")
        table = table.where("passes_filtering").drop("passes_filtering")
    keep = table.select("ord")
    return {k: v for k, v in (("cells", table), ("counts", counts and counts.join(keep, "ord", "left_semi")), ("intensities", intensities and intensities.join(keep, "ord", "left_semi"))) if v is not None}


def radius(cells: DataFrame, ratio: float) -> float:
    """``ratio`` times the mean radius of all cells, each taken as a disc of its area."""
    if not ratio:
        return 0.0
    return ratio * float(cells.agg(F.avg(F.sqrt(G.area() / F.pi()))).first()[0] or 0.0)


def overlay_segmentation(old: DataFrame, new: DataFrame, points: DataFrame | None = None, threshold: float = 0.25, exact: str = "box", pattern: str | None = T.EXCLUDED) -> dict[str, DataFrame]:
    """New cells laid over old ones: old cells of which a new one covers the threshold or more go.

    Old cells that stay come first, numbered anew from 0; ``is_overlay`` marks the new.
    """
    kept = old.join(spatial.covered(old, new, threshold, exact).distinct(), "ord", "left_anti")
    shape = ["ord", "xs", "ys", "xmin", "ymin", "xmax", "ymax"]
    both = kept.select(*shape, F.lit(False).alias("is_overlay")).unionByName(new.select(*shape, F.lit(True).alias("is_overlay")))
    cells = ordinals(both, ["is_overlay", "ord"]).withColumnRenamed("ord", "source_ord").withColumnRenamed("new_ord", "ord")
    out = {"cells": cells}
    if points is not None:
        out["counts"] = count_transcripts(points, cells, pattern=pattern)
    return out


def low_count_genes(counts: DataFrame, n_cells: int, below: float = 0.01, most: int = 50, genes: DataFrame | None = None) -> DataFrame:
    """Genes whose mean count over all cells is low, the first ``most`` by name; with ``genes``, those never counted too."""
    mean = counts.groupBy("gene").agg((F.sum("n") / n_cells).alias("mean_count"))
    if genes is not None:
        mean = genes.select("gene").distinct().join(mean, "gene", "left").withColumn("mean_count", F.coalesce("mean_count", F.lit(0.0)))
    return mean.where(F.col("mean_count") < below).orderBy("gene").limit(most)


def compare_segmentations(tables: dict[str, DataFrame], n_cells: dict[str, int]) -> DataFrame:
    """Cells, counts, and counts a cell of several tables."""
    out = None
    for name, counts in tables.items():
        row = counts.agg(F.lit(name).alias("segmentation"), F.lit(n_cells[name]).cast("long").alias("n_cells"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total")).withColumn("mean_count", F.col("total") / F.col("n_cells"))
        out = row if out is None else out.unionByName(row)
    return out
