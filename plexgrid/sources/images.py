"""Image files as long tables (image, c, y, x, value) or tiles, read by Spark's binaryFile source.

Decoding runs on the executors, a file at a time; ``decode`` may be any callable
from bytes to an array (channel, y, x), such as one around a vendor's library.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import clip_quantile_scale
from ..functions.text import dedup_names
from . import tiff
from .readers import renamed_channels

cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(tiff)

TILE = 1024


def tiles(spark: SparkSession, path: str, decode: Callable[[bytes], np.ndarray] = tiff.read, tile: int = TILE) -> DataFrame:
    """(path, n_channels, k, ty, tx, height, width, data): tiles of every channel of every file, as little-endian 32-bit integers."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for name, content in zip(b["path"].to_pylist(), b["content"].to_pylist(), strict=True):
                image = np.asarray(decode(content))
                if not np.issubdtype(image.dtype, np.integer):
                    top = np.quantile(image, 0.99, axis=(1, 2), keepdims=True)
                    image = (np.clip(image / np.where(top > 0, top, 1), 0, 1) * 255).astype(np.uint8)
                for k in range(image.shape[0]):
                    for y in range(0, image.shape[1], tile):
                        for x in range(0, image.shape[2], tile):
                            part = np.ascontiguousarray(image[k, y : y + tile, x : x + tile], "<i4")
                            yield pa.RecordBatch.from_pydict({"path": [name], "n_channels": [image.shape[0]], "k": [k], "ty": [y // tile], "tx": [x // tile], "height": [part.shape[0]], "width": [part.shape[1]], "data": [part.tobytes()]}, pa.schema([("path", pa.string()), *((c, pa.int32()) for c in ("n_channels", "k", "ty", "tx", "height", "width")), ("data", pa.binary())]))

    return files.mapInArrow(run, "path string, n_channels int, k int, ty int, tx int, height int, width int, data binary")


def pixels(tiled: DataFrame, tile: int = TILE) -> DataFrame:
    """(path, k, y, x, value), a row a pixel; a batch a tile."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for r in b.to_pylist():
                v = np.frombuffer(r["data"], "<i4").reshape(r["height"], r["width"])
                y, x = np.mgrid[0 : r["height"], 0 : r["width"]]
                n = v.size
                yield pa.RecordBatch.from_arrays([pa.array([r["path"]] * n, pa.string()), pa.array(np.full(n, r["k"], np.int32)), pa.array((y.ravel() + r["ty"] * tile).astype(np.int32)), pa.array((x.ravel() + r["tx"] * tile).astype(np.int32)), pa.array(v.ravel().astype(np.int32))], ["path", "k", "y", "x", "value"])

    return tiled.select("path", "k", "ty", "tx", "height", "width", "data").mapInArrow(run, "path string, k int, y int, x int, value int")


def named(p: DataFrame, channels: list[str] | None) -> DataFrame:
    """Channel numbers as names: those given, else the number itself."""
    if channels is None:
        return p.withColumn("c", F.col("k").cast("string")).drop("k")
    names = F.array(*(F.lit(c) for c in channels))
    return p.withColumn("c", F.element_at(names, F.col("k") + 1)).drop("k")


def ome_tif(spark: SparkSession, path: str, channels: list[str] | None = None, decode: Callable = tiff.read) -> DataFrame:
    """One file; channels are numbered from 0 where no names are given."""
    return named(pixels(tiles(spark, path, decode)), channels).select("c", "y", "x", "value")


def tif_folder(spark: SparkSession, path: str, pattern: str, decode: Callable = tiff.read) -> DataFrame:
    """A file a channel: the channel's name is what ``pattern`` captures in the file's name, repeats being numbered."""
    t = tiles(spark, path, decode)
    names = dedup_names(t.select("path").distinct().withColumn("c", F.regexp_extract("path", pattern, 1)), "c", "path")
    return pixels(t).join(F.broadcast(names), "path").select("c", "y", "x", "value")


def macsima(spark: SparkSession, path: str, decode: Callable = tiff.read) -> DataFrame:
    return tif_folder(spark, path, r"_A-(.*?)_C-", decode)


def hyperion(spark: SparkSession, path: str, decode: Callable = tiff.read) -> DataFrame:
    """A file a channel, always scaled to 0..255 by the channel's 0.99 quantile."""
    p = tif_folder(spark, path, r"([^/]*?)\.(?:ome\.)?tiff?$", decode)
    return clip_quantile_scale(p).select("c", "y", "x", F.col("scaled").alias("value"))


def phenocycler(spark: SparkSession, path: str, channels: list[str] | None = None, renamed: dict[str, str] | None = None, decode: Callable = tiff.read) -> DataFrame:
    """One file whose description names its channels in Biomarker elements, unless names are given."""
    if channels is None:
        head = spark.read.format("binaryFile").load(path).select("content").first()["content"]
        channels = re.findall(r"<Biomarker>(.*?)</Biomarker>", tiff.description(bytes(head))) or None
    return renamed_channels(ome_tif(spark, path, channels, decode), renamed or {}, "c")


def wsi(spark: SparkSession, path: str, decode: Callable, mpp: float | None = None) -> tuple[DataFrame, dict]:
    """A whole-slide image by a decoder of the user's, with its resolution and objective power."""
    return ome_tif(spark, path, ["r", "g", "b"], decode), {"mpp": mpp, "objective": None if mpp is None else 10 / mpp}


def bioimage(spark: SparkSession, path: str, decode: Callable, z: int = 0, t: int = 0) -> DataFrame:
    """One plane of an image of any rank: ``decode`` returns (t, c, z, y, x)."""
    return ome_tif(spark, path, None, lambda content: np.asarray(decode(content))[t, :, z])


def pyramid(p: DataFrame, levels: int) -> list[DataFrame]:
    """The image and ``levels`` halvings of it."""
    from .sinks import half_image

    out = [p]
    for _ in range(levels):
        out.append(half_image(out[-1]))
    return out


def stitched(spark: SparkSession, parts: DataFrame, boxes: DataFrame) -> DataFrame:
    """(c, y, x, value): images of fields in one mosaic; ``parts`` has fov, c, y, x, value, ``boxes`` offsets."""
    b = boxes.select("fov", F.col("x_offset").alias("_x"), F.col("y_offset").alias("_y"))
    return parts.join(F.broadcast(b), "fov").select("c", (F.col("y") + F.col("_y")).alias("y"), (F.col("x") + F.col("_x")).alias("x"), "value")
