"""Segmentation of image patches, embeddings of tiles, tissue regions.

Segmentation methods and models are callables that the user gives; they run on
the executors, a patch at a time.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import otsu_threshold
from .kernels import raster

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def dummy_method(image: np.ndarray, margin: int = 10) -> np.ndarray:
    """One square cell that leaves a margin: a stand-in for a segmentation model."""
    mask = np.zeros(image.shape[-2:], np.int32)
    mask[margin : image.shape[-2] - margin, margin : image.shape[-1] - margin] = 1
    return mask


def dummy_model(batch: np.ndarray) -> np.ndarray:
    """The first pixel of each channel: a stand-in for an embedding model."""
    return batch[:, :, 0, 0]


#: Models by name; users add their own.
MODELS: dict[str, Callable] = {"dummy": dummy_model}
METHODS: dict[str, Callable] = {"dummy": dummy_method}


def patch_pixels(pixels: DataFrame, patches: DataFrame) -> DataFrame:
    """Pixels with the patches they lie in; ends excluded. Patches are boxes on whole pixels.

    Goes by the same grid as other joins, so no pixel is compared with every patch.
    """
    from .spatial import points_in_shapes

    boxes = patches.withColumns({"xs": F.array("xmin", "xmax"), "ys": F.array("ymin", "ymax")})
    p = pixels.withColumns({"x": F.col("x").cast("double"), "y": F.col("y").cast("double")})
    inside = lambda: F.expr("x >= xmin AND x < xmax AND y >= ymin AND y < ymax")
    out = points_in_shapes(p, boxes.select("patch_id", "xs", "ys", "xmin", "ymin", "xmax", "ymax"), inside)
    return out.select("patch_id", "c", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), "value", "xmin", "ymin", "xmax", "ymax")


def _array(pdf, channels):
    x0, y0 = int(pdf["xmin"].iloc[0]), int(pdf["ymin"].iloc[0])
    h, w = int(np.ceil(pdf["ymax"].iloc[0])) - y0, int(np.ceil(pdf["xmax"].iloc[0])) - x0
    out = np.zeros((len(channels), h, w), float)
    index = {c: i for i, c in enumerate(channels)}
    pdf = pdf[pdf["c"].notna()]
    out[pdf["c"].map(index).to_numpy(int), pdf["y"].to_numpy(int) - y0, pdf["x"].to_numpy(int) - x0] = pdf["value"].to_numpy(float)
    return out, x0, y0


def segment(pixels: DataFrame, patches: DataFrame, method: Callable | str, channels: list[str], min_area: float = 0.0, sigma: float = 1.0, clip: float = 0.2, tiles: int = 8) -> DataFrame:
    """(patch_id, k, xs, ys) of the cells that ``method`` finds in each patch, in the image's frame.

    Each patch is smoothed, its contrast equalised, segmented, and its labels
    turned into rings; rings of at least ``min_area`` stay. A patch has a fixed
    number of pixels, so a group is bounded.
    """
    run_method = METHODS[method] if isinstance(method, str) else method

    def run(pdf):
        import pandas as pd

        image, x0, y0 = _array(pdf, channels)
        image = np.stack([raster.equalize(raster.gaussian(c, sigma), tiles, clip) for c in image])
        rings = [r for _, r in raster.vectorize(run_method(image))]
        from plexgrid.operators.kernels.polygons import signed_area

        rows = [(int(pdf["patch_id"].iloc[0]), [x + x0 for x, _ in r], [y + y0 for _, y in r]) for r in rings if len(r) >= 3 and abs(signed_area(r)) >= min_area]
        return pd.DataFrame({"patch_id": [r[0] for r in rows], "k": list(range(len(rows))), "xs": [r[1] for r in rows], "ys": [r[2] for r in rows]}).astype({"patch_id": "int64", "k": "int32"})

    wanted = patch_pixels(pixels.where(F.col("c").isin(channels)), patches)
    return wanted.groupBy("patch_id").applyInPandas(run, "patch_id long, k int, xs array<double>, ys array<double>")


def embed_tiles(pixels: DataFrame, patches: DataFrame, model: Callable | str, channels: list[str], levels: float = 255.0) -> DataFrame:
    """(patch_id, embedding) of each tile, one without pixels included; values are divided by ``levels``, missing pixels are 0."""
    run_model = MODELS[model] if isinstance(model, str) else model

    def run(pdf):
        import pandas as pd

        image, _, _ = _array(pdf, channels)
        v = np.asarray(run_model(image[None] / levels))
        if v.ndim != 2 or len(v) != 1:
            raise ValueError("a model must return one vector for each tile")
        return pd.DataFrame({"patch_id": [int(pdf["patch_id"].iloc[0])], "embedding": [v[0].astype(float).tolist()]})

    box = ["xmin", "ymin", "xmax", "ymax"]
    wanted = patches.select("patch_id", *box).join(patch_pixels(pixels.where(F.col("c").isin(channels)), patches).drop(*box), "patch_id", "left")
    return wanted.groupBy("patch_id").applyInPandas(run, "patch_id long, embedding array<double>")


def fill_outside(pixels: DataFrame, by: str = "c") -> DataFrame:
    """Pixels outside ``inside`` take the mean of their channel's pixels inside (rounded down to an integer)."""
    mean = pixels.where("inside").groupBy(by).agg(F.avg("value").alias("_m"))
    return pixels.join(F.broadcast(mean), by, "left").withColumn("value", F.when(F.col("inside"), F.col("value")).otherwise(F.floor(F.coalesce("_m", F.lit(0.0)))).cast("int")).drop("_m")


def saturation(pixels: DataFrame) -> DataFrame:
    """(y, x, value): saturation 0..255 of images of channels r, g, b."""
    g = pixels.groupBy("y", "x").agg(F.max("value").alias("_hi"), F.min("value").alias("_lo"))
    return g.select("y", "x", F.when(F.col("_hi") > 0, F.floor((F.col("_hi") - F.col("_lo")) * 255 / F.col("_hi"))).otherwise(0).cast("int").alias("value"))


def tissue_mask(gray: DataFrame) -> DataFrame:
    """(y, x) of pixels above the threshold that Otsu's method finds."""
    return gray.crossJoin(F.broadcast(otsu_threshold(gray))).where("value > threshold").select("y", "x")


def tissue(gray: DataFrame, radius: int = 2, drop_share: float = 0.01) -> DataFrame:
    """(k, xs, ys, area) of tissue regions in a thumbnail: median, Otsu, opening and closing, outlines; small ones go.

    A thumbnail is one image of bounded size; it is one task's group.
    """

    def run(pdf):
        import pandas as pd

        from plexgrid.operators.kernels.polygons import signed_area

        h, w = int(pdf["y"].max()) + 1, int(pdf["x"].max()) + 1
        image = np.zeros((h, w))
        image[pdf["y"].to_numpy(int), pdf["x"].to_numpy(int)] = pdf["value"].to_numpy(float)
        image = raster.median(image)
        values, n = np.unique(image, return_counts=True)
        w0, s0 = np.cumsum(n)[:-1], np.cumsum(n * values)[:-1]
        if not len(w0):
            return pd.DataFrame({"k": [], "xs": [], "ys": [], "area": []}).astype({"k": "int32", "area": "float64"})
        w1, s1 = n.sum() - w0, (n * values).sum() - s0
        mask = image > values[:-1][np.argmax(w0 * w1 * (s0 / w0 - s1 / w1) ** 2)]
        mask = raster.closed(raster.opened(mask, radius), radius)
        rings = [r for _, r in raster.vectorize(raster.label(mask), smooth_ratio=0.0)]
        areas = [abs(signed_area(r)) for r in rings]
        keep = [i for i, a in enumerate(areas) if a > drop_share * sum(areas)]
        return pd.DataFrame({"k": np.arange(len(keep), dtype="int32"), "xs": [[p[0] for p in rings[i]] for i in keep], "ys": [[p[1] for p in rings[i]] for i in keep], "area": [areas[i] for i in keep]})

    return gray.withColumn("_one", F.lit(1)).groupBy("_one").applyInPandas(run, "k int, xs array<double>, ys array<double>, area double")


def rasterized(shapes: DataFrame) -> DataFrame:
    """(ord, y, x) of the whole pixels that each polygon holds, its border included; by columns only."""
    from ..functions import geometry as G

    s = shapes.withColumn("_y", F.explode(F.sequence(F.ceil("ymin").cast("int"), F.floor("ymax").cast("int"))))
    s = s.withColumn("_x", F.explode(F.sequence(F.ceil("xmin").cast("int"), F.floor("xmax").cast("int"))))
    return s.where(G.contains("_x", "_y")).select("ord", F.col("_y").alias("y"), F.col("_x").alias("x"))


def largest_parts(parts: DataFrame, key: str = "ord") -> DataFrame:
    """Of each shape's parts (xs, ys) the one with the largest area, without holes."""
    from ..functions import geometry as G

    p = parts.where("size(xs) >= 3").withColumn("_a", G.area()).where("_a > 0")
    return p.groupBy(key).agg(F.max_by(F.struct("xs", "ys"), "_a").alias("_p")).select(key, "_p.xs", "_p.ys")


def split_overlaps(pixels: DataFrame, cells: DataFrame) -> DataFrame:
    """(y, x, ord): each pixel of some cell with one cell; of several, that whose own pixels are nearest.

    Own pixels are those in one cell only; a cell without any is represented by its centre.
    """
    from ..functions import geometry as G
    from .spatial import points_in_shapes

    p = pixels.select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).distinct()
    hits = points_in_shapes(p, cells.select("ord", "xs", "ys", "xmin", "ymin", "xmax", "ymax")).select("x", "y", "ord")
    k = hits.groupBy("x", "y").agg(F.count("*").alias("_k"))
    marked = hits.join(k, ["x", "y"])
    alone = marked.where("_k = 1").select("x", "y", "ord")
    cx, cy = G.centroid()
    lonely = cells.select("ord", cx.alias("ox"), cy.alias("oy")).join(alone.select("ord").distinct(), "ord", "left_anti")
    own = alone.select("ord", F.col("x").alias("ox"), F.col("y").alias("oy")).unionByName(lonely)
    shared = marked.where("_k > 1").select("x", "y", "ord")
    d = shared.join(own, "ord").groupBy("x", "y", "ord").agg(F.min(F.expr("(x - ox) * (x - ox) + (y - oy) * (y - oy)")).alias("d"))
    best = d.groupBy("x", "y").agg(F.min(F.struct("d", "ord")).alias("b")).select("x", "y", F.col("b.ord").alias("ord"))
    return alone.unionByName(best)
