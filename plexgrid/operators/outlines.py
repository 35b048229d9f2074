"""Outlines as polygons: unions of layers, cells parted where they overlap, repaired rings, borders of niches."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import with_bounds
from .kernels.overlay import largest, overlay, rings_of, signed_area, split_cells, valid
from .resolve import by_component, conflict_components, conflict_outlines, conflict_pairs
from .spatial import RING

cloudpickle.register_pickle_by_value(sys.modules[__name__])

RINGS = "xs array<double>, ys array<double>"
#: Shapes in one overlay; more are united in halves.
AT_ONCE = 48


def _rings(xs, ys) -> list[list]:
    return [list(zip(x, y, strict=True)) for x, y in zip(xs, ys, strict=True)]


def _columns(rings: list[list]) -> dict[str, list]:
    return {"xs": [[float(p[0]) for p in r] for r in rings], "ys": [[float(p[1]) for p in r] for r in rings]}


def united(shapes: list[list]) -> list[list]:
    """The union of shapes (lists of rings), in halves by place if they are many."""
    if len(shapes) > AT_ONCE:
        shapes = sorted(shapes, key=lambda s: s[0][0] if s else (0.0, 0.0))
        middle = len(shapes) // 2
        shapes = [united(shapes[:middle]), united(shapes[middle:])]
    return overlay(shapes, lambda s: s.any(1))


def valid_polygons(shapes: DataFrame, key: str = "ord") -> DataFrame:
    """(key, xs, ys, bounds): rings that cross themselves become their largest part, without holes; those without area go."""
    kind = dict(shapes.dtypes)[key]

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rings = [largest(valid(r)) if len(r) >= 3 else [] for r in _rings(b["xs"].to_pylist(), b["ys"].to_pylist())]
            keep = [i for i, r in enumerate(rings) if r]
            c = _columns([rings[i] for i in keep])
            yield pa.RecordBatch.from_arrays([b[key].take(pa.array(keep, pa.int64())), pa.array(c["xs"], pa.list_(pa.float64())), pa.array(c["ys"], pa.list_(pa.float64()))], [key, "xs", "ys"])

    return with_bounds(shapes.where("xs IS NOT NULL AND ys IS NOT NULL").select(key, "xs", "ys").mapInArrow(run, f"{key} {kind}, {RINGS}"))


def dissolve(shapes: DataFrame, by: str) -> DataFrame:
    """(by, component, hole, xs, ys): outlines of the union of each group's shapes.

    Shapes that touch one another, directly or not, are one component, which is
    one task's group; components and groups are united side by side.
    """
    from .storage import ordinals

    kind = dict(shapes.dtypes)[by]
    s = ordinals(shapes.select(F.col(by).alias("_by"), "xs", "ys", "xmin", "ymin", "xmax", "ymax").where("_by IS NOT NULL"), ["_by", "xmin", "ymin"], "ord")
    s = s.groupBy("_by", *RING).agg(F.min("ord").alias("ord"))  # equal shapes are one
    pairs = conflict_pairs(s, "polygon", same="_by")
    label = conflict_components(s, pairs)

    def run(pdf):
        import pandas as pd

        rings = united([[r] for r in _rings(pdf["xs"], pdf["ys"])])
        out = pd.DataFrame({"hole": [signed_area(r) < 0 for r in rings], **_columns(rings)})
        out.insert(0, "component", int(pdf["component"].iloc[0]))
        out.insert(0, by, pdf["_by"].iloc[0])
        return out

    return s.join(label, "ord").select("_by", "component", "xs", "ys").groupBy("_by", "component").applyInPandas(run, f"{by} {kind}, component long, hole boolean, {RINGS}")


def remove_overlap(cells: DataFrame, exact: str = "polygon") -> DataFrame:
    """(ord, xs, ys, bounds) of cells that overlap no more: what several hold goes to the nearest of them.

    A cell's core is what it holds alone; a shared place goes to the cell whose
    core has the nearest corner. A cell without a core gets a null ring. Rings have
    no holes, so a hole that another cell's part makes is filled.
    Cells that overlap, directly or not, are one task's group; others don't pass
    through Python.
    """
    rows, free = conflict_outlines(cells, exact)

    def solve(rings, members, partners):
        at = {o: i for i, o in enumerate(rings)}
        doubled = {at[o] for o, ps in partners.items() if o in ps}
        parts = split_cells(list(rings.values()), [[at[p] for p in partners[o] if p != o] for o in rings], doubled)
        return [(n, *([float(v) for v in c] or None for c in (zip(*ring, strict=True) if ring else ((), ())))) for o, ring in zip(rings, parts, strict=True) for n in members[o]]

    done = by_component(rows, solve, f"ord long, {RINGS}")
    return with_bounds(free.select(F.col("ord").cast("long").alias("ord"), "xs", "ys").unionByName(done))


def niche_outlines(parts: DataFrame, nodes: DataFrame, library: str = "lib") -> DataFrame:
    """(niche, component, hole, xs, ys): outlines of each component of like triangles.

    Triangles are turned the same way round, so that an edge of one triangle
    only, kept in its direction, has the niche on its left; a task's group are
    the border edges of one component.
    """
    at = lambda k: nodes.select(F.col(library).alias(library), F.col("node").cast("long").alias(k), F.col("x").alias(f"{k}x"), F.col("y").alias(f"{k}y"))
    t = parts
    for k in "abc":
        t = t.join(at(k), [library, k])
    left = F.expr("(bx - ax) * (cy - ay) - (by - ay) * (cx - ax)") > 0
    corner = lambda k: F.struct(F.col(k).alias("n"), F.col(f"{k}x").cast("double").alias("x"), F.col(f"{k}y").cast("double").alias("y"))
    a, b, c = corner("a"), F.when(left, corner("b")).otherwise(corner("c")), F.when(left, corner("c")).otherwise(corner("b"))
    sides = F.array(*(F.struct(p.alias("p"), q.alias("q")) for p, q in ((a, b), (b, c), (c, a))))
    e = t.select("niche", "component", F.explode(sides).alias("e"))
    rim = e.groupBy("niche", "component", F.least("e.p.n", "e.q.n").alias("u"), F.greatest("e.p.n", "e.q.n").alias("v")).agg(F.count("*").alias("k"), F.first("e").alias("e")).where("k = 1")
    rim = rim.select("niche", "component", F.col("e.p.x").alias("px"), F.col("e.p.y").alias("py"), F.col("e.q.x").alias("qx"), F.col("e.q.y").alias("qy"))
    kinds = dict(parts.dtypes)

    def run(pdf):
        import numpy as np
        import pandas as pd

        n = len(pdf)
        points, ends = np.unique(np.concatenate([pdf[["px", "py"]].to_numpy(float), pdf[["qx", "qy"]].to_numpy(float)]), axis=0, return_inverse=True)
        ends = ends.ravel()
        rings = rings_of(points, ends[:n], ends[n:])
        out = pd.DataFrame({"hole": [signed_area(r) < 0 for r in rings], **_columns(rings)})
        out.insert(0, "component", pdf["component"].iloc[0])
        out.insert(0, "niche", pdf["niche"].iloc[0])
        return out

    return rim.groupBy("niche", "component").applyInPandas(run, f"niche {kinds['niche']}, component {kinds['component']}, hole boolean, {RINGS}")
