"""What outside segmentation programs leave in their folders, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions import geometry as G
from .readers import listed


def _depth(kind) -> int:
    return 1 + _depth(kind.elementType) if isinstance(kind, ArrayType) else 0


def feature_polygons(spark: SparkSession, path: str, key: str = "cell") -> DataFrame:
    """(cell, xs, ys, bounds) of a FeatureCollection; of several parts the largest stays, holes are filled."""
    raw = spark.read.option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    rows = raw.select(F.col(f"f.properties.{key}").alias("cell"), F.col("f.geometry.coordinates").alias("rings"))
    if _depth(rows.schema["rings"].dataType) == 4:  # parts of rings of corners of two numbers
        rows = rows.select("cell", F.explode("rings").alias("rings"))
    ring = F.col("rings")[0]
    open_ring = F.slice(ring, 1, F.size(ring) - 1)  # the last corner repeats the first
    rows = rows.where(F.size(ring) >= 4).select("cell", F.transform(open_ring, lambda p: p[0].cast("double")).alias("xs"), F.transform(open_ring, lambda p: p[1].cast("double")).alias("ys"))
    best = rows.withColumn("_a", G.area()).groupBy("cell").agg(F.max_by(F.struct("xs", "ys"), "_a").alias("p"))
    return G.with_bounds(best.select("cell", "p.xs", "p.ys"))


def proseg(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """cells (metadata), shapes and long counts (cell, gene, n) of a finished run.

    Rows of the counts are those of the metadata, in order. Compressed files are
    read by one task each, so rows are numbered as they stand; counts may be fractions.
    """
    names = listed(spark, path)

    def csv(name: str) -> DataFrame:
        file = next((n for n in (f"{name}.csv.gz", f"{name}.csv") if n in names), None)
        if file is None:
            raise FileNotFoundError(f"{path}/{name}.csv.gz")
        return spark.read.option("header", True).option("inferSchema", True).csv(f"{path}/{file}").coalesce(1).withColumn("_at", F.monotonically_increasing_id())

    cells, counts = csv("cell-metadata"), csv("expected-counts")
    n, m = cells.count(), counts.count()
    if n != m:
        raise ValueError(f"{n} cells in the metadata, {m} in the counts")
    key = F.col("cell") if "cell" in cells.columns else F.col("_at")
    genes = [c for c in counts.columns if c != "_at"]
    counts = counts.join(cells.select("_at", key.alias("_cell")), "_at").drop("_at")
    long = counts.unpivot(["_cell"], [F.col(f"`{g}`") for g in genes], "gene", "n").where("n > 0").select(F.col("_cell").alias("cell"), "gene", F.col("n").cast("double").alias("n"))
    file = next((n for n in ("cell-polygons.geojson.gz", "cell-polygons.geojson") if n in names), None)
    if file is None:
        raise FileNotFoundError(f"{path}/cell-polygons.geojson.gz")
    return {"cells": cells.withColumn("cell", key).drop("_at"), "shapes": feature_polygons(spark, f"{path}/{file}"), "counts": long}


def proseg_options(columns: list[str], given: str = "") -> str:
    """Options that follow from the transcripts' columns, after those given. The program's option names."""
    out = [given] if given else []
    fov = next((c for c in columns if c in ("fov", "fov_name")), None)
    if fov and "fov-column" not in given:
        out.append(f"--fov-column {fov}")
    if "qv" in columns:
        out += [f"{o} {v}" for o, v in (("--qv-column", "qv"), ("--min-qv", "20.0")) if o not in given]
    if "compartment-column" not in given:
        nuclear = {"overlaps_nucleus": "1", "CellComp": "Nuclear"}
        column = next((c for c in nuclear if c in columns), None)
        if column:
            out.append(f"--compartment-column {column} --compartment-nuclear {nuclear[column]}")
    return " ".join(out)


def baysor(spark: SparkSession, path: str, min_area: float = 0.0, min_vertices: int = 4) -> dict[str, DataFrame]:
    """shapes (cell, area) and long counts (cell, gene, n) of one patch's finished run.

    Counts are those of the molecules' table, noise left out, of the cells whose
    polygon has enough vertices and an area over ``min_area``. Older versions
    number their cells, newer ones name them.
    """
    names = listed(spark, path)
    file = next((n for n in ("segmentation_polygons.json", "segmentation_polygons_2d.json") if n in names), None)
    if file is None:
        raise FileNotFoundError(f"{path}: no polygons")
    g = spark.read.option("multiLine", True).json(f"{path}/{file}").select(F.explode("geometries").alias("g"))
    ring = F.col("g.coordinates")[0]
    rows = g.where(F.size(ring) >= min_vertices).select(F.col("g.cell").cast("string").alias("cell"), F.slice(ring, 1, F.size(ring) - 1).alias("r"))
    shapes = rows.select("cell", F.transform("r", lambda p: p[0].cast("double")).alias("xs"), F.transform("r", lambda p: p[1].cast("double")).alias("ys"))
    shapes = G.with_bounds(shapes).withColumn("area", G.area()).where(F.col("area") > min_area)
    table = spark.read.option("header", True).csv(f"{path}/segmentation.csv")
    if "is_noise" in table.columns:
        table = table.where("lower(is_noise) NOT IN ('true', '1')")
    counts = table.where("cell IS NOT NULL AND cell NOT IN ('', '0') AND gene IS NOT NULL").groupBy("cell", "gene").agg(F.count("*").alias("n"))
    return {"shapes": shapes, "counts": counts.join(shapes.select("cell"), "cell", "left_semi")}
