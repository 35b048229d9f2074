"""Instrument outputs as DataFrames: schemas, units, ids.

Paths are read by Spark, so any file system that Spark knows will do.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import dedup_names
from ..model import Affine, Dataset

#: Microns a pixel of the fields-of-view instrument. Fixed value.
FOV_MICRONS = 0.120280945


def xenium(spark: SparkSession, path: str, qv_threshold: float = 20) -> Dataset:
    """Transcripts with ``low_quality_transcript``; the cell column is a prior with UNASSIGNED."""
    points = spark.read.parquet(f"{path}/transcripts.parquet")
    names = {"x_location": "x", "y_location": "y", "z_location": "z", "feature_name": "gene"}
    points = points.withColumnsRenamed({k: v for k, v in names.items() if k in points.columns})
    if dict(points.dtypes).get("gene") == "binary":
        points = points.withColumn("gene", F.col("gene").cast("string"))
    if "qv" in points.columns:
        points = points.withColumn("low_quality_transcript", F.col("qv") < qv_threshold)
    out = Dataset()
    out.add("points", "transcripts", points, "transcripts", {"global": Affine(), "microns": Affine()})
    out.roles |= {"prior": "cell_id", "prior_unassigned": "UNASSIGNED"}
    return out


def merscope(spark: SparkSession, path: str) -> Dataset:
    """Transcripts of a CSV with a header; the cell column is a prior with -1."""
    points = spark.read.option("header", True).option("inferSchema", True).csv(f"{path}/detected_transcripts.csv")
    points = points.withColumnsRenamed({"global_x": "x", "global_y": "y", "global_z": "z"})
    out = Dataset()
    out.add("points", "transcripts", points, "transcripts", {"global": Affine(), "microns": Affine()})
    out.roles |= {"prior": "cell_id", "prior_unassigned": "-1"}
    return out


def fov_positions(df: DataFrame) -> DataFrame:
    """(fov, x, y) in pixels from whichever of three pairs of columns there is; millimetres are turned into pixels."""
    low = df.select(*(F.col(f"`{c}`").alias(c.lower()) for c in df.columns))
    scale = 1e3 / FOV_MICRONS
    for x, y, by in (("x_global_px", "y_global_px", 1.0), ("x_mm", "y_mm", scale), ("x_global_mm", "y_global_mm", scale)):
        if x in low.columns and y in low.columns:
            return low.select(F.col("fov").cast("int").alias("fov"), (F.col(x) * by).alias("x"), (F.col(y) * by).alias("y"))
    raise ValueError(f"no position columns among {df.columns}")


def fov_boxes(fovs: DataFrame, width: float, height: float, shift: bool) -> DataFrame:
    """(fov, xmin, ymin, xmax, ymax, x_offset, y_offset): fields and their offsets in whole pixels from the least of all.

    With ``shift`` the position is the field's upper edge, so it reaches downwards.
    """
    y0 = F.col("y") - height if shift else F.col("y")
    b = fovs.select("fov", F.col("x").alias("xmin"), y0.alias("ymin"), (F.col("x") + width).alias("xmax"), (y0 + height).alias("ymax"))
    least = b.agg(F.min("xmin").alias("_x"), F.min("ymin").alias("_y"))
    b = b.crossJoin(F.broadcast(least))
    return b.select("fov", "xmin", "ymin", "xmax", "ymax", F.round(F.col("xmin") - F.col("_x")).cast("long").alias("x_offset"), F.round(F.col("ymin") - F.col("_y")).cast("long").alias("y_offset"))


def needs_shift(points: DataFrame, fovs: DataFrame) -> DataFrame:
    """(share, shift): the share of fields whose points begin below the field's position; shift if over 0.1."""
    low = points.groupBy("fov").agg(F.min("y").alias("_min"))
    share = low.join(fovs.select("fov", F.col("y").alias("_fov_y")), "fov").agg(F.avg((F.col("_min") < F.col("_fov_y")).cast("double")).alias("share"))
    return share.withColumn("shift", F.col("share") > 0.1)


def global_cell_id(df: DataFrame, fov: str = "fov", cell: str = "cell_ID", out: str = "global_cell_id", max_id: int | None = None) -> DataFrame:
    """One number for a cell of any field: fov * (largest id + 1) + id, 0 for background."""
    if max_id is None:
        max_id = int(df.agg(F.max(cell)).first()[0] or 0)
    c = F.col(cell).cast("long")
    return df.withColumn(out, F.when(c > 0, F.col(fov).cast("long") * (max_id + 1)).otherwise(F.lit(0)) + c)


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds, through the file system that it belongs to."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    return sorted(f.getPath().getName() for f in files)


def largest_cell_id(tables: list[DataFrame], cell: str = "cell_ID") -> int:
    """The largest local cell number, on which all tables must agree, since global numbers are made from it."""
    found = {int(t.agg(F.max(cell)).first()[0] or 0) for t in tables}
    if len(found) > 1:
        raise ValueError(f"the largest {cell} differs between files: {sorted(found)}")
    return found.pop()


def cosmx(spark: SparkSession, path: str, dataset: str | None = None, fov: int | None = None, shape: tuple[int, int] | None = None, shift: bool | None = None) -> Dataset:
    """Transcripts with global cell ids, and cell polygons, counts and metadata where their files are there.

    The name of the data set is found from its files unless given. Transcripts
    are in microns and polygons in pixels, both from the least position of all
    fields, or of their own field if ``fov`` is named. With ``shape`` (height and
    width of a field's image) there is also a table of the fields' places in the
    mosaic; ``shift`` says whether positions are fields' upper edges, which is
    found from the polygons otherwise.
    """
    names = listed(spark, path)
    dataset = dataset or dataset_id(names)
    file = lambda suffix: next((f"{path}/{n}" for n in (f"{dataset}{suffix}", f"{dataset}{suffix}.gz") if n in names), None)
    read = lambda suffix: spark.read.option("header", True).option("inferSchema", True).csv(file(suffix)) if file(suffix) else None
    points, fovs = read("_tx_file.csv"), read("_fov_positions_file.csv")
    if points is None or fovs is None:
        raise FileNotFoundError(f"transcripts and field positions of {dataset} are needed in {path}")
    fovs = fov_positions(fovs)
    polygons, counts, metadata = read("-polygons.csv"), read("_exprMat_file.csv"), read("_metadata_file.csv")
    if polygons is not None and "cellID" in polygons.columns:
        polygons = polygons.withColumnRenamed("cellID", "cell_ID")
    out = Dataset()
    top = largest_cell_id([t for t in (polygons, counts, metadata) if t is not None] or [points])
    if shift is None:
        shift = polygons is not None and fov is None and bool(needs_shift(polygons.select("fov", F.col("y_global_px").alias("y")), fovs).first()["shift"])
    boxes = None if shape is None else fov_boxes(fovs, shape[1], shape[0], shift)
    points = global_cell_id(points, max_id=top)
    low = (fovs if boxes is None else boxes.select(F.col("xmin").alias("x"), F.col("ymin").alias("y"))).agg(F.min("x").alias("_x"), F.min("y").alias("_y"))
    if fov is None:
        points = points.crossJoin(F.broadcast(low))
        points = points.withColumns({"x": (F.col("x_global_px") - F.col("_x")) * FOV_MICRONS, "y": (F.col("y_global_px") - F.col("_y")) * FOV_MICRONS}).drop("_x", "_y")
    else:
        points = points.where(F.col("fov") == fov).withColumns({"x": F.col("x_local_px") * FOV_MICRONS, "y": F.col("y_local_px") * FOV_MICRONS})
    out.add("points", "transcripts", points.withColumnRenamed("target", "gene"), "transcripts")
    out.add("tables", "fovs", fovs if boxes is None else boxes)
    if polygons is not None:
        at = F.monotonically_increasing_id()  # vertices in the order of the file
        if fov is None:
            v = global_cell_id(polygons.withColumn("_at", at), max_id=top, out="cell").crossJoin(F.broadcast(low))
            v = v.select("cell", "fov", "_at", (F.col("x_global_px") - F.col("_x")).alias("px"), (F.col("y_global_px") - F.col("_y")).alias("py"))
        else:
            v = polygons.withColumn("_at", at).where(F.col("fov") == fov).select(F.col("cell_ID").cast("long").alias("cell"), "fov", "_at", F.col("x_local_px").alias("px"), F.col("y_local_px").alias("py"))
        out.add("shapes", "cells_polygons", polygons_from_vertices(v, ["cell", "fov"], "px", "py", "_at"), "boundaries")
    if metadata is not None:
        metadata = global_cell_id(metadata, max_id=top)
        out.add("tables", "cells", metadata)
    if counts is not None:
        local = global_cell_id(counts.where("cell_ID <> 0"), max_id=top)
        if metadata is not None:
            lost = local.select("global_cell_id").join(metadata.select("global_cell_id"), "global_cell_id", "left_anti")
            more = metadata.select("global_cell_id").join(local.select("global_cell_id"), "global_cell_id", "left_anti")
            if not lost.isEmpty() or not more.isEmpty():
                raise ValueError("counts and metadata are not of the same cells")
        out.add("tables", "counts", long_counts(local.drop("fov", "cell_ID"), ["global_cell_id"], None))
    out.roles |= {"prior": "global_cell_id", "prior_unassigned": "0"}
    return out


def morphology_channels(description: str) -> list[str]:
    """Channels of a morphology image in the order of its description, by their target where it is told; no slashes."""
    target = dict(zip(re.findall(r'"ChannelId": "(.*?)",', description), re.findall(r'"BiologicalTarget": "(.*?)",', description), strict=False))
    order = re.search(r'"ChannelOrder": "(.*?)",', description)
    if order is None:
        raise ValueError("the description tells no order of channels")
    return [target.get(c, c).replace("/", ".") for c in order[1]]


def protein_channel(description: str) -> str:
    """The name that a protein image's description displays, without slashes."""
    found = re.search(r'"DisplayName": "(.*?)",', description)
    if found is None:
        raise ValueError("the description displays no name")
    return found[1].replace("/", ".")


def fov_file(names: list[str], fov: int) -> str:
    """The one image of a field among file names."""
    found = [n for n in names if re.search(rf"_F0*{fov}\.[Tt][Ii][Ff]$", n)]
    if len(found) != 1:
        raise ValueError(f"one image of field {fov} is needed, found {found}")
    return found[0]


def polygons_from_vertices(df: DataFrame, keys: list[str], x: str, y: str, position: str) -> DataFrame:
    """Rings assembled from a row a vertex, in the order of ``position``."""
    from ..functions.geometry import with_bounds

    v = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")))).alias("v"))
    return with_bounds(v.select(*keys, F.col("v.x").alias("xs"), F.col("v.y").alias("ys")))


def long_counts(df: DataFrame, ids: list[str], background: str | None = "cell_ID") -> DataFrame:
    """(ids, gene, n) from a column a gene, without zeros and without the background's row."""
    genes = [c for c in df.columns if c not in ids]
    if background:
        df = df.where(F.col(background) != 0)
    return df.unpivot(ids, genes, "gene", "n").where("n > 0").withColumn("n", F.col("n").cast("long"))


def relabelled(labels: DataFrame, ids: DataFrame, boxes: DataFrame, height: int) -> DataFrame:
    """(y, x, value): labels of fields placed in one mosaic, local numbers replaced by global ones, the vertical axis flipped.

    ``labels``: fov, y, x, value; ``ids``: fov, local, global.
    """
    out = labels.join(F.broadcast(boxes.select("fov", "x_offset", "y_offset")), "fov").join(ids.withColumnRenamed("local", "value"), ["fov", "value"], "left")
    return out.select((F.col("y_offset") + height - 1 - F.col("y")).alias("y"), (F.col("x_offset") + F.col("x")).alias("x"), F.coalesce("global", F.lit(0)).cast("long").alias("value"))


def dataset_id(names: list[str]) -> str:
    """What precedes ``_fov_positions_file.csv`` in one of the names; several or none are an error."""
    found = sorted({m[1] for n in names if (m := re.fullmatch(r"(.*)_fov_positions_file\.csv(?:\.gz)?", n))})
    if len(found) != 1:
        raise ValueError(f"one dataset is needed, found {found}")
    return found[0]


def fov_number(name: str) -> int:
    """The number after F in an image's name."""
    m = re.search(r"_F(\d+)", name) or re.search(r"FOV(\d+)", name)
    if not m:
        raise ValueError(f"no field number in {name!r}")
    return int(m[1])


def molecular_cartography(spark: SparkSession, path: str) -> Dataset:
    """Tab-separated values without a header."""
    points = spark.read.schema("x double, y double, z double, gene string, unnamed string").option("sep", "\t").csv(path)
    out = Dataset()
    out.add("points", "transcripts", points.drop("unnamed"), "transcripts")
    return out


def visium_hd(spark: SparkSession, path: str, bin_name: str = "square_002um") -> Dataset:
    """Bins with their centres and a long table of counts; the finest bins are those used."""
    bins = spark.read.parquet(f"{path}/{bin_name}/bins.parquet")
    counts = spark.read.parquet(f"{path}/{bin_name}/counts.parquet")
    out = Dataset()
    out.add("shapes", bin_name, bins, "bins")
    out.add("tables", bin_name, counts, "bins_table")
    out.add("shapes", "roi", bounding_box(bins))
    return out


def bounding_box(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    return df.agg(F.min(x).alias("xmin"), F.min(y).alias("ymin"), F.max(x).alias("xmax"), F.max(y).alias("ymax"))


def microns_per_pixel(diameter: float, area: float | None = None, radius: float | None = None) -> float:
    """From a bin's known diameter and its area (a square) or radius in pixels."""
    return diameter / area**0.5 if area is not None else diameter / (2 * radius)


def channel_files(spark: SparkSession, path: str, pattern: str = r"_A-(.*?)_C-") -> DataFrame:
    """(path, channel, content) of image files, the channel from the file's name; repeated names are numbered."""
    files = spark.read.format("binaryFile").load(path)
    named = files.select("path", F.regexp_extract("path", pattern, 1).alias("channel"), "content")
    return dedup_names(named, "channel", "path")


def renamed_channels(df: DataFrame, names: dict[str, str], channel: str = "channel") -> DataFrame:
    m = F.create_map(*(F.lit(v) for kv in names.items() for v in kv)) if names else None
    return df if m is None else df.withColumn(channel, F.coalesce(m[F.col(channel)], F.col(channel)))


def selections(spark: SparkSession, path: str, pixel_size: float = 0.2125) -> DataFrame:
    """Polygons drawn in the viewer: two comment lines, then X, Y and perhaps Selection."""
    from ..functions.geometry import with_bounds

    lines = spark.read.text(path).withColumn("n", F.monotonically_increasing_id()).where("NOT startswith(value, '#') AND value <> ''")
    head = lines.orderBy("n").first()["value"].split(",")
    at = {h.strip().strip('"'): i for i, h in enumerate(head)}
    cut = F.split("value", ",")
    body = lines.where(F.col("value") != ",".join(head))
    name = cut[at["Selection"]] if "Selection" in at else F.lit("selection")
    v = body.select(name.alias("name"), "n", (cut[at["X"]].cast("double") / pixel_size).alias("x"), (cut[at["Y"]].cast("double") / pixel_size).alias("y"))
    g = v.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("n", "x", "y"))).alias("v"))
    return with_bounds(g.select("name", F.col("v.x").alias("xs"), F.col("v.y").alias("ys")))


def geojson_cells(spark: SparkSession, path: str, min_area: float = 0.0, min_vertices: int = 4) -> DataFrame:
    """(cell, xs, ys) of polygons in a GeometryCollection or FeatureCollection; rings need enough vertices and area over ``min_area``."""
    from ..functions import geometry as G

    raw = spark.read.option("multiLine", True).json(path)
    item = "geometries" if "geometries" in raw.columns else "features"
    g = raw.select(F.posexplode(item).alias("k", "g"))
    geo = "g" if item == "geometries" else "g.geometry"
    ring = F.col(f"{geo}.coordinates")[0]
    rows = g.select(F.col("k").alias("ord"), ring.alias("ring")).where(F.size("ring") >= min_vertices)
    # the last vertex repeats the first
    rows = rows.select("ord", F.transform(F.slice("ring", 1, F.size("ring") - 1), lambda p: p[0].cast("double")).alias("xs"), F.transform(F.slice("ring", 1, F.size("ring") - 1), lambda p: p[1].cast("double")).alias("ys"))
    return G.with_bounds(rows).withColumn("area", G.area()).where(F.col("area") > min_area)


def toy(spark: SparkSession, length: int = 2048, side: int = 20, per_cell: int = 100, genes: int = 5, seed: int = 0) -> Dataset:
    """A synthetic slide: cells on a jittered grid, transcripts around them, an image of noise."""
    step = length / side
    cells = spark.range(side * side).select(F.col("id").alias("ord"), ((F.col("id") % side + 0.5) * step + (F.rand(seed) - 0.5) * step * 0.3).alias("cx"), ((F.floor(F.col("id") / side) + 0.5) * step + (F.rand(seed + 1) - 0.5) * step * 0.3).alias("cy"))
    r = step * 0.4
    angles = [k * 0.7853981633974483 for k in range(8)]
    from math import cos, sin

    from ..functions.geometry import with_bounds

    shapes = with_bounds(cells.select("ord", F.array(*(F.col("cx") + r * cos(a) for a in angles)).alias("xs"), F.array(*(F.col("cy") + r * sin(a) for a in angles)).alias("ys")))
    points = cells.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(per_cell)))).select(
        (F.col("cx") + F.randn(seed + 2) * r / 2).alias("x"), (F.col("cy") + F.randn(seed + 3) * r / 2).alias("y"), F.concat(F.lit("gene_"), F.floor(F.rand(seed + 4) * genes).cast("string")).alias("gene"), F.col("ord").alias("cell_id")
    )
    out = Dataset()
    out.add("shapes", "cells", shapes, "boundaries")
    out.add("points", "transcripts", points, "transcripts", {"global": Affine(), "microns": Affine.scale(0.1)})
    return out


def blobs(spark: SparkSession, n: int = 1000, seed: int = 0) -> Dataset:
    out = Dataset()
    out.add("points", "blobs", spark.range(n).select((F.rand(seed) * 512).alias("x"), (F.rand(seed + 1) * 512).alias("y"), F.substring(F.lit("abcdef"), F.floor(F.rand(seed + 2) * 6).cast("int") + 1, F.lit(1)).alias("gene")), "transcripts")
    return out


def sanity_check(data: Dataset) -> None:
    """An image is there, long with integer values and text channels."""
    if not data.elements["images"]:
        raise ValueError("no image")
    for name, df in data.elements["images"].items():
        kinds = dict(df.dtypes)
        if {"c", "y", "x", "value"} - set(kinds):
            raise ValueError(f"{name}: columns c, y, x and value are needed")
        if kinds["value"] not in ("tinyint", "smallint", "int", "bigint"):
            raise ValueError(f"{name}: values must be integers, not {kinds['value']}")
        if kinds["c"] != "string":
            raise ValueError(f"{name}: channels must be text")


def read_store(spark: SparkSession, path: str, elements: dict[str, list[str]]) -> Dataset:
    """Elements written by ``sinks.write_store``."""
    out = Dataset()
    for kind, names in elements.items():
        for n in names:
            out.add(kind, n, spark.read.parquet(f"{path}/{kind}/{n}"))
    return out


def first_by_position(df: DataFrame, by: list[str], position: str) -> DataFrame:
    """The first row of each group."""
    w = Window.partitionBy(*by).orderBy(position)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
