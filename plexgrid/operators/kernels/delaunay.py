"""Delaunay triangulation by insertion, exact where coordinates are integers."""

from __future__ import annotations


def _exact(points):
    """Coordinates as exact integers: floats are scaled by a power of two that makes all of them whole."""
    scale = 1
    for p in points:
        for v in p:
            scale = max(scale, float(v).as_integer_ratio()[1])
    return [(int(float(x).as_integer_ratio()[0] * (scale // float(x).as_integer_ratio()[1])), int(float(y).as_integer_ratio()[0] * (scale // float(y).as_integer_ratio()[1]))) for x, y in points]


def _orient(a, b, c):
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def _in_circle(a, b, c, d):
    """Positive if d is inside the circle through a, b, c (counter-clockwise)."""
    rows = [(p[0] - d[0], p[1] - d[1], (p[0] - d[0]) ** 2 + (p[1] - d[1]) ** 2) for p in (a, b, c)]
    (ax, ay, aw), (bx, by, bw), (cx, cy, cw) = rows
    return ax * (by * cw - bw * cy) - ay * (bx * cw - bw * cx) + aw * (bx * cy - by * cx)


def triangulate(points) -> list[tuple[int, int, int]]:
    """Triangles as index triples. Points that repeat are left out; with all points on a line there is none.

    A ghost vertex stands for infinity: a triangle with it is an edge of the
    hull, whose circle is the half-plane beyond the edge.
    """
    p = _exact(points)
    ghost = -1
    first: dict[tuple, int] = {}
    for i, q in enumerate(p):
        first.setdefault(q, i)
    order = sorted(first.values())
    if len(order) < 3:
        return []
    a, b = order[0], order[1]
    c = next((i for i in order[2:] if _orient(p[a], p[b], p[i]) != 0), None)
    if c is None:
        return []
    if _orient(p[a], p[b], p[c]) < 0:
        a, b = b, a
    # each triangle by its directed edges: the third corner on the left
    left: dict[tuple[int, int], int] = {}

    def add(x, y, z):
        left[x, y], left[y, z], left[z, x] = z, x, y

    add(a, b, c)
    for x, y in ((a, b), (b, c), (c, a)):
        add(y, x, ghost)

    def holds(x, y, z, q):
        """True if the circle of triangle x, y, z holds point q."""
        if ghost in (x, y, z):
            while z != ghost:
                x, y, z = y, z, x
            o = _orient(p[x], p[y], q)
            if o:
                return o > 0
            # on the hull's line: only between both ends
            return min(p[x], p[y]) < q < max(p[x], p[y])
        return _in_circle(p[x], p[y], p[z], q) > 0

    def locate(q, x, y):
        """The triangle, or the hull edge with the ghost, that q lies in: a walk from the triangle left of x, y."""
        z = left[x, y]
        if ghost in (x, y, z):
            while z != ghost:
                x, y, z = y, z, x
            x, y = y, x
            z = left[x, y]
        while True:
            for u, v in ((x, y), (y, z), (z, x)):
                if _orient(p[u], p[v], q) < 0:
                    w = left[v, u]
                    if w == ghost:
                        return v, u, ghost
                    x, y, z = v, u, w
                    break
            else:
                return x, y, z

    recent = (a, b)
    for i in order:
        if i in (a, b, c):
            continue
        q = p[i]
        bad = locate(q, *recent)
        hole, todo = set(), [bad]
        key = lambda t: frozenset(t)
        seen = {key(bad)}
        while todo:
            t = todo.pop()
            hole.add(t)
            x, y, z = t
            for u, v in ((x, y), (y, z), (z, x)):
                w = left.get((v, u))
                if w is None:
                    continue
                n = (v, u, w)
                if key(n) not in seen and holds(*n, q):
                    seen.add(key(n))
                    todo.append(n)
        edges = {(u, v) for x, y, z in hole for u, v in ((x, y), (y, z), (z, x))}
        rim = [(u, v) for u, v in edges if (v, u) not in edges]
        for e in edges:
            left.pop(e, None)
        for u, v in rim:
            add(u, v, i)
        recent = next(e for e in rim if ghost not in e)
    return sorted({tuple(sorted((x, y, z))) for (x, y), z in left.items() if ghost not in (x, y, z)})
