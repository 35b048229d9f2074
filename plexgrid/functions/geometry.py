"""Geometry as column expressions.

A polygon is two arrays ``xs`` and ``ys`` of its ring without a repeated last
vertex, with its bounding box beside it. All expressions stay in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_bounds(df: DataFrame) -> DataFrame:
    return df.withColumns({"xmin": F.array_min("xs"), "ymin": F.array_min("ys"), "xmax": F.array_max("xs"), "ymax": F.array_max("ys")})


def box(xmin: str, ymin: str, xmax: str, ymax: str) -> dict[str, Column]:
    """Columns of a box as a polygon."""
    a, b, c, d = (F.col(v).cast("double") for v in (xmin, ymin, xmax, ymax))
    return {"xs": F.array(a, c, c, a), "ys": F.array(b, b, d, d), "xmin": a, "ymin": b, "xmax": c, "ymax": d}


def _over_edges(term: str, xs: str, ys: str) -> Column:
    """Sum over the edges of ``term`` in x1, y1, x2, y2."""
    for k, v in (("x1", f"{xs}[i]"), ("y1", f"{ys}[i]"), ("x2", f"{xs}[(i + 1) % size({xs})]"), ("y2", f"{ys}[(i + 1) % size({xs})]")):
        term = term.replace(k, v)
    return F.expr(f"aggregate(sequence(0, size({xs}) - 1), 0D, (s, i) -> s + {term})")


def signed_area(xs: str = "xs", ys: str = "ys") -> Column:
    return _over_edges("(x1 * y2 - x2 * y1)", xs, ys) / 2


def area(xs: str = "xs", ys: str = "ys") -> Column:
    return F.abs(signed_area(xs, ys))


def perimeter(xs: str = "xs", ys: str = "ys") -> Column:
    return _over_edges("sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))", xs, ys)


def centroid(xs: str = "xs", ys: str = "ys") -> tuple[Column, Column]:
    six_areas = 6 * signed_area(xs, ys)
    return (
        _over_edges("(x1 + x2) * (x1 * y2 - x2 * y1)", xs, ys) / six_areas,
        _over_edges("(y1 + y2) * (x1 * y2 - x2 * y1)", xs, ys) / six_areas,
    )


def roundness(xs: str = "xs", ys: str = "ys") -> Column:
    length = perimeter(xs, ys)
    return 4 * F.pi() * area(xs, ys) / (length * length)


def contains(x: str = "x", y: str = "y", xs: str = "xs", ys: str = "ys") -> Column:
    """True for points inside or on the boundary. Division-free crossing test."""
    n = f"size({xs})"
    x1, y1, x2, y2 = f"{xs}[i]", f"{ys}[i]", f"{xs}[(i + 1) % {n}]", f"{ys}[(i + 1) % {n}]"
    cross = f"(({x2} - {x1}) * ({y} - {y1}) - ({y2} - {y1}) * ({x} - {x1}))"
    on = f"({cross} = 0 AND {x} BETWEEN least({x1}, {x2}) AND greatest({x1}, {x2}) AND {y} BETWEEN least({y1}, {y2}) AND greatest({y1}, {y2}))"
    crossing = f"(({y1} > {y}) <> ({y2} > {y}) AND ({cross} > 0) = ({y2} > {y1}))"
    return F.expr(
        f"exists(sequence(0, {n} - 1), i -> {on}) OR "
        f"aggregate(sequence(0, {n} - 1), 0, (s, i) -> s + CASE WHEN {crossing} THEN 1 ELSE 0 END) % 2 = 1"
    )


def is_box(xs: str = "xs", ys: str = "ys") -> Column:
    """True for rings of four vertices that are the corners of their bounds, one after the other."""
    corners = F.expr(f"size({xs}) = 4 AND forall({xs}, v -> v = xmin OR v = xmax) AND forall({ys}, v -> v = ymin OR v = ymax)")
    return F.coalesce(corners & (2 * area(xs, ys) > F.expr("(xmax - xmin) * (ymax - ymin)")), F.lit(False))


def contains_convex(x: str = "x", y: str = "y", xs: str = "xs", ys: str = "ys") -> Column:
    """As ``contains``, for convex rings given counter-clockwise: on the left of every edge or on it."""
    n = f"size({xs})"
    j = f"(i + 1) % {n}"
    return F.expr(f"forall(sequence(0, {n} - 1), i -> ({xs}[{j}] - {xs}[i]) * ({y} - {ys}[i]) >= ({ys}[{j}] - {ys}[i]) * ({x} - {xs}[i]))")


def distance_to_ring(x: str = "x", y: str = "y", xs: str = "xs", ys: str = "ys") -> Column:
    """Distance of a point to the nearest edge."""
    n = f"size({xs})"
    x1, y1 = f"{xs}[i]", f"{ys}[i]"
    dx, dy = f"({xs}[(i + 1) % {n}] - {x1})", f"({ys}[(i + 1) % {n}] - {y1})"
    t = f"greatest(0D, least(1D, (({x} - {x1}) * {dx} + ({y} - {y1}) * {dy}) / greatest({dx} * {dx} + {dy} * {dy}, 1e-300D)))"
    px, py = f"({x} - {x1} - {t} * {dx})", f"({y} - {y1} - {t} * {dy})"
    return F.expr(f"sqrt(array_min(transform(sequence(0, {n} - 1), i -> {px} * {px} + {py} * {py})))")


def within_distance(radius: Column | float, x: str = "x", y: str = "y", xs: str = "xs", ys: str = "ys") -> Column:
    """Point in the polygon grown by ``radius``, without building the grown polygon."""
    return contains(x, y, xs, ys) | (distance_to_ring(x, y, xs, ys) <= radius)


def boxes_overlap(a: str = "a", b: str = "b") -> Column:
    """Bounding boxes that share a point."""
    return F.expr(f"{a}.xmin <= {b}.xmax AND {b}.xmin <= {a}.xmax AND {a}.ymin <= {b}.ymax AND {b}.ymin <= {a}.ymax")


def box_intersection(a: str = "a", b: str = "b") -> Column:
    """Area that two bounding boxes share."""
    w = f"greatest(least({a}.xmax, {b}.xmax) - greatest({a}.xmin, {b}.xmin), 0D)"
    h = f"greatest(least({a}.ymax, {b}.ymax) - greatest({a}.ymin, {b}.ymin), 0D)"
    return F.expr(f"{w} * {h}")


def padded(n: int, xs: str = "xs", ys: str = "ys") -> dict[str, Column]:
    """Rings of up to ``n`` vertices made ``n`` long by repeating the last vertex."""
    fill = lambda c: F.concat(c, F.array_repeat(F.element_at(c, -1), F.greatest(F.lit(n) - F.size(c), F.lit(0))))
    return {"xs": fill(F.col(xs)), "ys": fill(F.col(ys))}


def outer_pixel_bounds() -> dict[str, Column]:
    """Pixels that a bounding box touches, the ends excluded."""
    return {
        "px0": F.floor("xmin").cast("int"),
        "py0": F.floor("ymin").cast("int"),
        "px1": (F.ceil("xmax") + 1).cast("int"),
        "py1": (F.ceil("ymax") + 1).cast("int"),
    }
