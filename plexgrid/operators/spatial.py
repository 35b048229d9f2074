"""Spatial joins on grid buckets.

A range predicate alone would be planned as a nested loop. So each shape goes
to the grid squares that its bounding box covers, on a level whose squares are
at least as large as the shape (four squares at most), each point to one square
for each level from the lowest to the highest in use, and an equi-join on the squares comes before the exact
test. Shapes of very different size don't multiply rows this way. Crowded
squares are skewed join keys, which adaptive execution splits.

Equal shapes are tested as one, and so are points of one place where only
their number or their first shape is asked for: what is compared are distinct
places and distinct outlines, and results go back to all rows by equi-joins.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from . import kernels

MAX_LEVEL = 40
BOUNDS = ["xmin", "ymin", "xmax", "ymax"]
RING = ["xs", "ys", *BOUNDS]
#: About how many numbers of equal shapes one row holds when pairs are made of them.
BUNDLE = 512


def grid_size(shapes: DataFrame) -> tuple[float, int, int]:
    """Side of the squares of level 0, and the lowest and highest level that shapes need."""
    side = F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin"))
    r = shapes.agg(F.min(F.when(side > 0, side)).alias("low"), F.max(side).alias("high")).first()
    if not r["low"]:
        return 1.0, 0, 0
    base = 2.0 ** math.ceil(math.log2(r["low"]))
    top = max(0, math.ceil(math.log2(r["high"] / base)))
    if top <= 2:  # sizes are alike: one level, so that points aren't repeated
        return base * 2.0**top, 0, 0
    if top > MAX_LEVEL:
        base *= 2.0 ** (top - MAX_LEVEL)
        top = MAX_LEVEL
    return base, 0, top


def point_squares(points: DataFrame, grid: tuple[float, int, int], x: str = "x", y: str = "y") -> DataFrame:
    base, low, high = grid
    p = points.withColumn("_lv", F.lit(low) if low == high else F.explode(F.sequence(F.lit(low), F.lit(high))))
    side = F.lit(base) * F.pow(F.lit(2.0), "_lv")
    return p.withColumns({"_gx": F.floor(F.col(x) / side), "_gy": F.floor(F.col(y) / side)})


def shape_squares(shapes: DataFrame, grid: tuple[float, int, int], reach: Column | float = 0.0) -> DataFrame:
    """Shapes at each square they cover; ``reach`` widens their boxes."""
    base, _, high = grid
    size = F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin"))
    level = F.least(F.lit(high), F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(size, F.lit(1e-300)) / base)))).cast("int")
    s = shapes.withColumn("_lv", level)
    side = F.lit(base) * F.pow(F.lit(2.0), "_lv")
    span = lambda a, b: F.explode(F.sequence(F.floor((F.col(a) - reach) / side), F.floor((F.col(b) + reach) / side)))
    return s.withColumn("_gx", span("xmin", "xmax")).withColumn("_gy", span("ymin", "ymax"))


def points_in_shapes(points: DataFrame, shapes: DataFrame, exact: Callable[[], Column] | None = None, reach: float = 0.0, x: str = "x", y: str = "y") -> DataFrame:
    """Every pair of a point and a shape that holds it, the boundary included.

    ``shapes`` has ``xs, ys`` and bounds; ``exact`` is the test in columns of
    both sides (point in polygon if none is given). A point in several shapes
    comes out several times. Points with null coordinates are in none.
    """
    grid = grid_size(shapes)
    left = point_squares(points.where(F.col(x).isNotNull() & F.col(y).isNotNull()), grid, x, y)
    right = shape_squares(shapes, grid, reach)
    box = f"{x} BETWEEN xmin - {reach}D AND xmax + {reach}D AND {y} BETWEEN ymin - {reach}D AND ymax + {reach}D"
    if exact is None:  # boxes, found once a shape, need no more than the test of bounds
        right = right.withColumn("_whole", G.is_box())
        test = F.col("_whole") | G.contains(x, y)
    else:
        test = exact()
    return left.join(right, ["_lv", "_gx", "_gy"]).where(F.expr(box)).where(test).drop("_lv", "_gx", "_gy", "_whole")


def in_box(x: str = "x", y: str = "y") -> Callable[[], Column]:
    """The exact test for shapes that are boxes."""
    return lambda: F.expr(f"{x} BETWEEN xmin AND xmax AND {y} BETWEEN ymin AND ymax")


def distinct_shapes(shapes: DataFrame, order: str = "ord") -> tuple[DataFrame, DataFrame]:
    """(_shape, ring and bounds, order), a row for equal shapes with the smallest of their numbers, and (order, _shape) of all.

    ``_shape`` is that number with a hash of the outline, as numbers need not be unique.
    """
    outlines = shapes.groupBy(*RING).agg(F.min(order).alias(order)).withColumn("_shape", F.struct(F.col(order), F.xxhash64(*RING)))
    return outlines, shapes.select(order, *RING).join(outlines.select(*RING, "_shape"), RING).select(order, "_shape")


def counts_in_shapes(points: DataFrame, shapes: DataFrame, by: list[str], exact: Callable[[], Column] | None = None, reach: float = 0.0, order: str = "ord") -> DataFrame:
    """(order, by, n): how many points of each kind each shape holds; arguments as of ``points_in_shapes``.

    Points of one place and kind are counted before the join and equal shapes
    joined once, so work grows with distinct places and outlines.
    """
    places = points.where("x IS NOT NULL AND y IS NOT NULL").groupBy("x", "y", *by).agg(F.count("*").alias("_n"))
    outlines, members = distinct_shapes(shapes, order)
    held = points_in_shapes(places, outlines.drop(order), exact, reach).groupBy("_shape", *by).agg(F.sum("_n").alias("_n"))
    return members.join(held, "_shape").groupBy(order, *by).agg(F.sum("_n").alias("n"))


def assign_first(points: DataFrame, shapes: DataFrame, ids: list[str], unassigned: int | None = 0, order: str = "ord", exact: Callable[[], Column] | None = None, out: str = "cell") -> DataFrame:
    """Each point with the first shape that holds it, by ``order`` counted from 0.

    With ``unassigned`` = u the result is order + 1 + u, and u for points in no
    shape; with None it is the order itself, and null. ``ids`` come first in the
    result. The first shape is found once a place.
    """
    outlines = shapes.groupBy(*RING).agg(F.min(order).alias(out))
    places = points.where("x IS NOT NULL AND y IS NOT NULL").select("x", "y").distinct()
    first = points_in_shapes(places, outlines, exact).groupBy("x", "y").agg(F.min(out).alias(out))
    joined = points.join(first, ["x", "y"], "left").select(*ids, *(c for c in points.columns if c not in ids), out)
    if unassigned is None:
        return joined
    return joined.withColumn(out, F.coalesce(F.col(out) + 1 + unassigned, F.lit(unassigned)).cast("long"))


#: Relations of boxes ``a`` and ``b``.
BOX_PREDICATES = {
    "intersects": "true",
    "within": "a.xmin >= b.xmin AND a.xmax <= b.xmax AND a.ymin >= b.ymin AND a.ymax <= b.ymax",
    "contains": "b.xmin >= a.xmin AND b.xmax <= a.xmax AND b.ymin >= a.ymin AND b.ymax <= a.ymax",
    "contains_properly": "b.xmin > a.xmin AND b.xmax < a.xmax AND b.ymin > a.ymin AND b.ymax < a.ymax",
    "touches": "a.xmin = b.xmax OR b.xmin = a.xmax OR a.ymin = b.ymax OR b.ymin = a.ymax",
    "crosses": "false",
}
BOX_PREDICATES |= {"covered_by": BOX_PREDICATES["within"], "covers": BOX_PREDICATES["contains"]}
BOX_PREDICATES["overlaps"] = f"NOT ({BOX_PREDICATES['touches']}) AND NOT ({BOX_PREDICATES['within']}) AND NOT ({BOX_PREDICATES['contains']})"


def shape_pairs(left: DataFrame, right: DataFrame, exact: str = "box", predicate: str = "intersects", grid: tuple[float, int, int] | None = None) -> DataFrame:
    """Pairs of shapes that share a point; columns of both sides as structs ``a`` and ``b``.

    Shapes go to the squares of their own level and of each higher one in use,
    four at most on each, and meet on the higher level of the two, so that a huge
    shape isn't spread over all small squares. A pair is kept only in the square
    that holds the lower left corner of what both boxes share, so none comes
    twice. ``exact`` is ``box`` where all shapes are boxes, else ``polygon`` for a
    test of the rings. ``predicate`` is the left shape's relation to the right one.
    ``grid`` is ``grid_size`` of both sides, if it is known.
    """
    if predicate not in BOX_PREDICATES:
        raise ValueError(f"predicate: {predicate!r}")
    base, _, high = grid or grid_size(left.select(*BOUNDS).unionByName(right.select(*BOUNDS)))
    side = F.lit(base) * F.pow(F.lit(2.0), "_lv")

    def squares(df: DataFrame, name: str) -> DataFrame:
        s = df.select(F.struct("*").alias(name))
        size = F.greatest(F.col(f"{name}.xmax") - F.col(f"{name}.xmin"), F.col(f"{name}.ymax") - F.col(f"{name}.ymin"))
        own = F.least(F.lit(high), F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(size, F.lit(1e-300)) / base)))).cast("int")
        s = s.withColumn(f"_{name}", own).withColumn("_lv", F.explode(F.sequence(f"_{name}", F.lit(high))) if high else F.lit(0))
        span = lambda p, q: F.explode(F.sequence(F.floor(F.col(f"{name}.{p}") / side), F.floor(F.col(f"{name}.{q}") / side)))
        return s.withColumn("_gx", span("xmin", "xmax")).withColumn("_gy", span("ymin", "ymax"))

    both = squares(left, "a").join(squares(right, "b"), ["_lv", "_gx", "_gy"]).where(F.col("_lv") == F.greatest("_a", "_b")).where(G.boxes_overlap())
    both = both.where(F.floor(F.expr("greatest(a.xmin, b.xmin)") / side) == F.col("_gx")).where(F.floor(F.expr("greatest(a.ymin, b.ymin)") / side) == F.col("_gy"))
    both = both.select("a", "b")
    return both.where(BOX_PREDICATES[predicate]) if exact == "box" else kernels.filter_pairs(both, predicate)


def bundles(shapes: DataFrame, key: str, exact: str = "box", by: list[str] | None = None) -> DataFrame:
    """(by, outline, members): equal shapes, with equal ``by``, as one row of their keys; more than some ``BUNDLE`` keys are dealt over rows.

    Shapes without bounds, which meet nothing, are left out.
    """
    same = [*(by or []), *(BOUNDS if exact == "box" else RING)]
    s = shapes.select(F.col(key).alias("_key"), *same)
    crowds = s.groupBy(*same).agg(F.count("*").alias("_n")).where(F.col("_n") > BUNDLE)
    at = F.coalesce(F.pmod(F.xxhash64("_key"), F.ceil(F.col("_n") / BUNDLE)), F.lit(0))
    return s.join(crowds, same, "left").groupBy(*same, at.alias("_at")).agg(F.sort_array(F.collect_list(F.struct("_key"))).alias("members")).drop("_at")


def bundle_pairs(left: DataFrame, right: DataFrame, left_key: str = "ord", right_key: str = "ord", exact: str = "box", predicate: str = "intersects", by: list[str] | None = None) -> DataFrame:
    """``shape_pairs`` of the bundles of both sides, ``a`` and ``b``: each pair of outlines is tested once for up to ``BUNDLE`` times ``BUNDLE`` pairs."""
    grid = grid_size(left.select(*BOUNDS).unionByName(right.select(*BOUNDS)))
    return shape_pairs(bundles(left, left_key, exact, by), bundles(right, right_key, exact, by), exact, predicate, grid)


def member_pairs(pairs: DataFrame, left: str, right: str, **more: Column) -> DataFrame:
    """(left, right, more): all pairs of members of pairs of bundles; ``more`` are columns of a pair of bundles, by name.

    A row of two bundles is small and what comes of it is not, so these rows are
    dealt evenly over all tasks, which adaptive execution doesn't join again.
    """
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    p = pairs.select(F.col("a.members").alias("_a"), F.col("b.members").alias("_b"), *(c.alias(k) for k, c in more.items())).repartition(n)
    p = p.select("_b", *more, F.explode("_a").alias("_x")).select("_x", *more, F.explode("_b").alias("_y"))
    return p.select(F.col("_x._key").alias(left), F.col("_y._key").alias(right), *more)


def sjoin(left: DataFrame, right: DataFrame, how: str = "inner", exact: str = "box", left_key: str = "ord", right_key: str = "ord", predicate: str = "intersects") -> DataFrame:
    """(left key, right key) of shapes that intersect, or have the relation named; ``how`` inner, left or right keeps the rest of a side with null."""
    pairs = member_pairs(bundle_pairs(left, right, left_key, right_key, exact, predicate), "left_key", "right_key")
    if how == "inner":
        return pairs
    if how == "left":
        return left.select(F.col(left_key).alias("left_key")).join(pairs, "left_key", "left")
    if how == "right":
        return right.select(F.col(right_key).alias("right_key")).join(pairs, "right_key", "left").select("left_key", "right_key")
    raise ValueError(f"how: {how!r}")


def first_shape(left: DataFrame, right: DataFrame, exact: str = "box", unassigned: int = 0) -> DataFrame:
    """(left_key, cell): the first right shape that each left one meets, counted from ``unassigned`` + 1; else ``unassigned``."""
    met = bundle_pairs(left, right, exact=exact).select(F.col("a.members").alias("_a"), F.expr("array_min(transform(b.members, m -> m._key))").alias("cell"))
    first = met.groupBy("_a").agg(F.min("cell").alias("cell")).select(F.explode("_a").alias("_x"), "cell").groupBy(F.col("_x._key").alias("left_key")).agg(F.min("cell").alias("cell"))
    out = left.select(F.col("ord").alias("left_key")).join(first, "left_key", "left")
    return out.withColumn("cell", F.coalesce(F.col("cell") + 1 + unassigned, F.lit(unassigned)).cast("long"))


def with_ratios(pairs: DataFrame, exact: str = "box") -> DataFrame:
    """Pairs (a, b) of shapes with the share of a's area that b covers as ``ratio``."""
    if exact == "box":
        return pairs.withColumn("ratio", G.box_intersection() / F.expr("(a.xmax - a.xmin) * (a.ymax - a.ymin)"))
    return kernels.with_ratios(pairs)


def overlap_ratio(left: DataFrame, right: DataFrame, exact: str = "box") -> DataFrame:
    """(left key, right key, ratio): the share of the left shape's area that each right shape covers."""
    pairs = with_ratios(bundle_pairs(left, right, exact=exact), exact)
    return member_pairs(pairs, "left_key", "right_key", ratio=F.col("ratio"))


def covered(left: DataFrame, right: DataFrame, threshold: float, exact: str = "box") -> DataFrame:
    """Keys of left shapes of which one right shape covers the threshold or more; no pairs of equal shapes are made."""
    outlines = lambda df: df.groupBy(*RING).agg(F.min("ord").alias("ord"))
    grid = grid_size(left.select(*BOUNDS).unionByName(right.select(*BOUNDS)))
    pairs = with_ratios(shape_pairs(outlines(left), outlines(right), exact, grid=grid), exact).where(F.col("ratio") >= threshold)
    gone = pairs.select(*(F.col(f"a.{c}").alias(c) for c in RING)).distinct()
    return left.join(gone, RING, "left_semi").select("ord")


def dissolve_boxes(boxes: DataFrame, by: str) -> DataFrame:
    """(by, area): the area of the union of each group's boxes, overlaps counted once.

    Boxes are cut at all of their group's x borders; in each strip the covered
    length is summed from runs of overlapping spans. No pairs are made.
    """
    from pyspark.sql import Window

    edges = boxes.select(by, F.explode(F.array("xmin", "xmax")).alias("x")).groupBy(by).agg(F.array_sort(F.collect_set("x")).alias("xs"))
    cut = boxes.select(by, "xmin", "ymin", "xmax", "ymax").join(edges, by).withColumn("strip", F.explode(F.expr("filter(sequence(0, size(xs) - 2), i -> xs[i] >= xmin AND xs[i + 1] <= xmax)")))
    cut = cut.select(by, "strip", (F.expr("xs[strip + 1]") - F.expr("xs[strip]")).alias("w"), "ymin", "ymax")
    before = F.max("ymax").over(Window.partitionBy(by, "strip").orderBy("ymin", "ymax").rowsBetween(Window.unboundedPreceding, -1))
    gain = F.greatest(F.lit(0.0), F.col("ymax") - F.greatest(F.col("ymin"), F.coalesce("before", "ymin")))
    return cut.withColumn("before", before).groupBy(by).agg(F.sum(gain * F.col("w")).alias("area"))
