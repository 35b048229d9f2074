"""Exports: viewer tables, patch files, stores. Heavy data is written by Spark, descriptors by the driver."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..model import Dataset
from ..operators.storage import ordinals

LETTERS = "bciotm"


def wanted(mode: str | None, letter: str) -> bool:
    """``+bo`` writes only those parts, ``-it`` all but those, None all."""
    if mode is None:
        return True
    if mode[:1] not in "+-" or not mode:
        raise ValueError("a mode begins with + or -")
    return (letter in mode[1:]) == (mode[0] == "+")


def gene_counts_csr(counts: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts by gene as compressed rows: (gene, pos, indptr, n_entries) and entries (pos, cell, n), with a row of totals last.

    Cells are numbered from 0; the totals hold only cells with counts.
    """
    number = ordinals(cells.select("ord"), ["ord"], "cell")
    long = counts.join(number, "ord").groupBy("gene", "cell").agg(F.sum("n").cast("long").alias("n")).where("n > 0").withColumn("last", F.lit(0))
    totals = long.groupBy("cell").agg(F.sum("n").cast("long").alias("n")).select(F.lit("Total transcripts").alias("gene"), "cell", "n", F.lit(1).alias("last"))
    both = long.unionByName(totals)
    rows = both.groupBy("last", "gene").agg(F.count("*").alias("n_entries"))  # a row for each gene
    w = Window.orderBy("last", "gene")
    rows = rows.withColumns({"pos": F.row_number().over(w) - 1, "indptr": F.coalesce(F.sum("n_entries").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")})
    entries = both.join(F.broadcast(rows.select("last", "gene", "pos")), ["last", "gene"]).select("pos", "cell", "n")
    return rows.select("gene", "pos", "indptr", "n_entries"), entries


def cell_categories(cells: DataFrame, column: str, order: str = "ord") -> tuple[DataFrame, DataFrame]:
    """(category, code, indptr, n) and (code, cell): cells of each category; null is NA."""
    named = ordinals(cells.select(order, F.coalesce(F.col(column).cast("string"), F.lit("NA")).alias("category")), [order], "cell")
    groups = named.groupBy("category").agg(F.count("*").alias("n"))
    w = Window.orderBy("category")
    groups = groups.withColumns({"code": F.row_number().over(w) - 1, "indptr": F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")})
    return groups.select("category", "code", "indptr", "n"), named.join(F.broadcast(groups.select("category", "code")), "category").select("code", "cell")


def save_column_csv(cells: DataFrame, column: str, path: str) -> None:
    cells.select(T.cell_name("ord").alias("cell_id"), F.col(column).alias("group")).write.mode("overwrite").option("header", True).csv(path)


def polygon_vertices(cells: DataFrame, n: int = 13, pixel_size: float = 0.2125) -> DataFrame:
    """(ord, xs, ys) of exactly ``n`` vertices in microns: short rings are padded, long ones simplified."""
    from ..functions import geometry as G
    from ..operators.kernels.polygons import fit_vertices

    short = cells.where(F.size("xs") <= n).withColumns(G.padded(n)).select("ord", "xs", "ys")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rings = [fit_vertices(list(zip(x, y, strict=True)), n) for x, y in zip(b["xs"].to_pylist(), b["ys"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b["ord"], pa.array([[float(p[0]) for p in r] for r in rings], pa.list_(pa.float64())), pa.array([[float(p[1]) for p in r] for r in rings], pa.list_(pa.float64()))], ["ord", "xs", "ys"])

    kind = dict(cells.dtypes)["ord"]
    long = cells.where(F.size("xs") > n).select("ord", "xs", "ys").mapInArrow(run, f"ord {kind}, xs array<double>, ys array<double>")
    scale = lambda c: F.transform(c, lambda v: v * pixel_size)
    return short.unionByName(long).select("ord", scale("xs").alias("xs"), scale("ys").alias("ys"))


def write_pyramid(points: DataFrame, path: str, tile: float = 250.0, point_id: str = "point_id") -> int:
    """Points by level and tile as Parquet partitions; levels until one tile holds all. Returns the number of levels."""
    r = points.agg(F.max("x"), F.max("y")).first()
    level = 0
    while True:
        side = tile * 2**level
        kept = points if level == 0 else points.where((F.col(point_id) * 2654435761) % 4294967296 < 4294967296 // 4**level)
        at = lambda c: F.greatest(F.floor(F.col(c) / side), F.lit(0)).cast("int")  # noqa: E731, B023
        kept.withColumns({"tx": at("x"), "ty": at("y")}).repartition("ty").write.mode("overwrite").partitionBy("ty").parquet(f"{path}/level={level}")
        level += 1
        if (r[0] or 0) < side and (r[1] or 0) < side:
            return level


def write_patches(assigned: DataFrame, path: str, fmt: str = "csv") -> None:
    """One folder a patch, written again as a whole on a rerun."""
    w = assigned.repartition("patch_id").write.mode("overwrite").partitionBy("patch_id")
    w.option("header", True).csv(path) if fmt == "csv" else w.parquet(path)


def half_image(pixels: DataFrame) -> DataFrame:
    """The next level of an image's pyramid: means of two by two pixels, rounded down."""
    return pixels.groupBy("c", F.floor(F.col("y") / 2).cast("int").alias("y"), F.floor(F.col("x") / 2).cast("int").alias("x")).agg(F.floor(F.avg("value")).cast("int").alias("value"))


def write_store(data: Dataset, path: str) -> dict[str, list[str]]:
    """All elements as Parquet folders; the names written, by kind."""
    out = {}
    for kind, own in data.elements.items():
        for name, df in own.items():
            df.write.mode("overwrite").parquet(f"{path}/{kind}/{name}")
            out.setdefault(kind, []).append(name)
    return out


def write_text(spark: SparkSession, path: str, content: str) -> None:
    """One small file, through the file system that the path names."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(content.encode()))
    out.close()


def metadata(name: str, n_cells: int, pixel_size: float = 0.2125, files: dict | None = None) -> str:
    """The viewer's descriptor."""
    return json.dumps({"major_version": 4, "region_name": name, "num_cells": n_cells, "pixel_size": pixel_size, "xenium_explorer_files": files or {}}, indent=2)


def explorer(data: Dataset, counts: DataFrame, cells: DataFrame, path: str, mode: str | None = None, categories: tuple[str, ...] = ()) -> dict[str, int]:
    """Everything that ``mode`` names, in one folder; rows or levels written of each part."""
    spark, out = cells.sparkSession, {}
    if wanted(mode, "b"):
        polygon_vertices(cells).write.mode("overwrite").parquet(f"{path}/polygons")
        out["polygons"] = spark.read.parquet(f"{path}/polygons").count()
    if wanted(mode, "c"):
        rows, entries = gene_counts_csr(counts, cells)
        rows.write.mode("overwrite").parquet(f"{path}/genes")
        entries.write.mode("overwrite").parquet(f"{path}/gene_counts")
        out["genes"] = spark.read.parquet(f"{path}/genes").count()
    if wanted(mode, "o"):
        for c in categories:
            groups, members = cell_categories(cells, c)
            groups.write.mode("overwrite").parquet(f"{path}/categories/{c}")
            members.write.mode("overwrite").parquet(f"{path}/category_cells/{c}")
    if wanted(mode, "t") and data.elements["points"]:
        _, points = data.get("points", role="transcripts")
        if "point_id" not in points.columns:
            points = points.withColumn("point_id", F.pmod(F.xxhash64(*points.columns), F.lit(1 << 31)))
        out["levels"] = write_pyramid(points, f"{path}/transcripts")
    if wanted(mode, "m"):
        write_text(spark, f"{path}/experiment.xenium", metadata("slide", out.get("polygons", 0)))
    return out


def report(cells: DataFrame, counts: DataFrame, n_cells: int) -> dict:
    """Figures for a quality report; a section that fails is told, others still come."""
    from ..operators.aggregate import low_count_genes

    sections = {
        "n_cells": lambda: n_cells,
        "area_q95": lambda: cells.agg(F.percentile("area", 0.95)).first()[0],
        "total_q95": lambda: counts.groupBy("ord").agg(F.sum("n").alias("t")).agg(F.percentile("t", 0.95)).first()[0],
        "low_count_genes": lambda: [r["gene"] for r in low_count_genes(counts, n_cells).collect()],
    }
    out: dict = {}
    for name, f in sections.items():
        try:
            out[name] = f()
        except Exception as e:  # a report shows what can be had
            out[name] = f"failed: {type(e).__name__}"
    return out


def report_html(figures: dict, title: str = "Quality report") -> str:
    """The figures of ``report`` as a page."""
    from html import escape

    rows = "".join(f"<tr><th>{escape(k.replace('_', ' '))}</th><td>{escape(', '.join(map(str, v)) if isinstance(v, list) else str(v))}</td></tr>" for k, v in figures.items())
    return f"<!doctype html><html><head><meta charset='utf-8'><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1><table>{rows}</table></body></html>"


def add_selection(data: Dataset, path: str, name: str = "selection", pixel_size: float = 0.2125) -> DataFrame:
    """Polygons drawn in the viewer as a layer of shapes of ``data``."""
    from .readers import selections

    spark = next(df for own in data.elements.values() for df in own.values()).sparkSession
    return data.add("shapes", name, selections(spark, path, pixel_size))


def align(data: Dataset, image: str, matrix: list[list[float]], pixel_size: float = 0.2125) -> None:
    """Places an image by the viewer's 3 x 3 matrix, from its pixels to those of the base image, and in microns."""
    from ..model import Affine

    to = Affine.from_array(matrix)
    data.transforms[image] = {"global": to, "microns": to.then(Affine.scale(pixel_size))}
