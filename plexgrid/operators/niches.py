"""Niches: connected regions of like cells, their geometry and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .storage import written


def niche_triangles(triangles: DataFrame, nodes: DataFrame, edges: DataFrame, niche: str = "niche", library: str = "lib") -> DataFrame:
    """Triangles whose three nodes are of one niche and whose three edges were kept."""
    kind = lambda k: nodes.select(F.col("node").cast("long").alias(k), F.col(niche).alias(f"_{k}"))
    t = triangles
    for k in "abc":
        t = t.join(kind(k), k)
    t = t.where("_a = _b AND _b = _c").select(library, "a", "b", "c", F.col("_a").alias("niche"))
    for p, q in ("ab", "ac", "bc"):
        e = edges.where("src < dst").select(library, F.col("src").alias(p), F.col("dst").alias(q))
        t = t.join(e, [library, p, q], "left_semi")
    return t.withColumn("tri", F.struct("a", "b", "c").cast("string"))


def niche_components(tri: DataFrame, library: str = "lib") -> DataFrame:
    """Triangles with ``component``: those that share an edge are in one; its name is the smallest triangle number."""
    key = F.xxhash64("a", "b", "c")
    t = written(tri.drop("tri").withColumn("tri", key), "triangles")
    sides = F.explode(F.array(*(F.struct(F.col(p).alias("u"), F.col(q).alias("v")) for p, q in ("ab", "ac", "bc"))))
    e = t.select(library, "tri", sides.alias("e")).select(library, "tri", "e.u", "e.v")
    # at most two triangles share an edge
    links = e.groupBy(library, "u", "v").agg(F.min("tri").alias("src"), F.max("tri").alias("dst")).where("src <> dst").select("src", "dst")
    label = components(t.select(F.col("tri").alias("node")), links)
    return t.join(label.withColumnRenamed("node", "tri"), "tri")


def component_geometry(parts: DataFrame, nodes: DataFrame, library: str = "lib") -> DataFrame:
    """(niche, component, area, length, roundness): areas of triangles summed, lengths of edges that one triangle has."""
    at = lambda k: nodes.select(F.col("node").cast("long").alias(k), F.col("x").alias(f"{k}x"), F.col("y").alias(f"{k}y"))
    t = parts
    for k in "abc":
        t = t.join(at(k), k)
    area = F.expr("abs((bx - ax) * (cy - ay) - (by - ay) * (cx - ax)) / 2")
    areas = t.groupBy("niche", "component").agg(F.sum(area).alias("area"))
    side = lambda p, q: F.struct(F.col(p).alias("u"), F.col(q).alias("v"), F.expr(f"sqrt(({p}x - {q}x) * ({p}x - {q}x) + ({p}y - {q}y) * ({p}y - {q}y))").alias("d"))
    e = t.select("niche", "component", F.explode(F.array(side("a", "b"), side("a", "c"), side("b", "c"))).alias("e"))
    rim = e.groupBy("niche", "component", "e.u", "e.v").agg(F.count("*").alias("k"), F.first("e.d").alias("d")).where("k = 1")
    lengths = rim.groupBy("niche", "component").agg(F.sum("d").alias("length"))
    return areas.join(lengths, ["niche", "component"]).withColumn("roundness", 4 * F.pi() * F.col("area") / (F.col("length") * F.col("length")))


def major_components(geometry: DataFrame, share: float = 0.05) -> DataFrame:
    """Components of at least ``share`` of their niche's largest."""
    top = geometry.groupBy("niche").agg(F.max("area").alias("_top"))
    return geometry.join(F.broadcast(top), "niche").where(F.col("area") >= share * F.col("_top")).drop("_top")


def geometry_stats(geometry: DataFrame) -> DataFrame:
    """(niche, n_components, length, area, roundness): means over a niche's components."""
    return geometry.groupBy("niche").agg(F.count("*").alias("n_components"), F.avg("length").alias("length"), F.avg("area").alias("area"), F.avg("roundness").alias("roundness"))


def niche_distances(parts: DataFrame, nodes: DataFrame, aggregation: str = "min") -> DataFrame:
    """(niche, target, distance): from each component of a niche to the nearest of the target's, aggregated.

    The distance of two components is that of their border edges, from vertices
    of either to edges of the other; borders don't cross. Components are the
    niches' pieces and few; pairs of them are compared, never pairs of cells.
    """
    at = lambda k: nodes.select(F.col("node").cast("long").alias(k), F.col("x").alias(f"{k}x"), F.col("y").alias(f"{k}y"))
    side = F.explode(F.array(*(F.struct(F.col(p).alias("u"), F.col(q).alias("v")) for p, q in ("ab", "ac", "bc"))))
    rim = parts.select("niche", "component", side.alias("e")).groupBy("niche", "component", "e.u", "e.v").count().where("count = 1").drop("count")
    rim = rim.join(at("u"), "u").join(at("v"), "v")
    rings = rim.groupBy("niche", "component").agg(F.collect_list(F.array("ux", "uy", "vx", "vy")).alias("edges"))

    @F.pandas_udf("double")
    def apart(a, b):
        import numpy as np
        import pandas as pd

        def one(p, q):
            p, q = np.stack(p), np.stack(q)
            best = np.inf
            for s, t in ((p, q), (q, p)):
                x, y = s[:, None, 0], s[:, None, 1]
                dx, dy = t[None, :, 2] - t[None, :, 0], t[None, :, 3] - t[None, :, 1]
                f = np.clip(((x - t[None, :, 0]) * dx + (y - t[None, :, 1]) * dy) / np.maximum(dx * dx + dy * dy, 1e-300), 0, 1)
                best = min(best, float(np.hypot(x - t[None, :, 0] - f * dx, y - t[None, :, 1] - f * dy).min()))
            return best

        return pd.Series([one(p, q) for p, q in zip(a, b, strict=True)])

    pairs = rings.alias("p").join(rings.select(F.col("niche").alias("target"), F.col("component").alias("other"), F.col("edges").alias("to")), F.lit(True), "cross")
    d = pairs.withColumn("d", F.when(F.col("component") == F.col("other"), F.lit(0.0)).otherwise(apart("edges", "to")))
    near = d.groupBy("niche", "component", "target").agg(F.min("d").alias("d"))
    how = {"min": F.min, "mean": F.avg, "max": F.max}[aggregation]
    return near.groupBy("niche", "target").agg(how("d").alias("distance"))
