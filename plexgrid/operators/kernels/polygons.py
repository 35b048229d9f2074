"""Rings as lists of (x, y): tests, clipping, simplification."""

from __future__ import annotations

import math


def signed_area(ring) -> float:
    return sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True)) / 2 if ring else 0.0


def _turn(a, b, c) -> float:
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def _on(a, b, p) -> bool:
    return min(a[0], b[0]) <= p[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= p[1] <= max(a[1], b[1])


def segments_meet(a, b, c, d) -> bool:
    t = _turn(a, b, c), _turn(a, b, d), _turn(c, d, a), _turn(c, d, b)
    if (t[0] > 0) != (t[1] > 0) and (t[2] > 0) != (t[3] > 0) and 0 not in t:
        return True
    return any(v == 0 and _on(p, q, r) for v, p, q, r in ((t[0], a, b, c), (t[1], a, b, d), (t[2], c, d, a), (t[3], c, d, b)))


def ring_contains(ring, p) -> bool:
    """Inside or on the boundary."""
    odd = False
    for a, b in zip(ring, [*ring[1:], ring[0]], strict=True):
        t = _turn(a, b, p)
        if t == 0 and _on(a, b, p):
            return True
        if (a[1] > p[1]) != (b[1] > p[1]) and (t > 0) == (b[1] > a[1]):
            odd = not odd
    return odd


def rings_intersect(r, s) -> bool:
    if ring_contains(r, s[0]) or ring_contains(s, r[0]):
        return True
    edges = list(zip(s, [*s[1:], s[0]], strict=True))
    return any(segments_meet(a, b, c, d) for a, b in zip(r, [*r[1:], r[0]], strict=True) for c, d in edges)


def clip(ring, convex):
    """What of ``ring`` lies in the ring ``convex``, half-plane by half-plane."""
    if signed_area(convex) < 0:
        convex = convex[::-1]
    out = list(ring)
    for a, b in zip(convex, [*convex[1:], convex[0]], strict=True):
        if not out:
            break
        side = [_turn(a, b, p) for p in out]
        new = []
        for i, p in enumerate(out):
            j = (i + 1) % len(out)
            if side[i] >= 0:
                new.append(p)
            if (side[i] > 0 > side[j]) or (side[i] < 0 < side[j]):
                t = side[i] / (side[i] - side[j])
                new.append((p[0] + t * (out[j][0] - p[0]), p[1] + t * (out[j][1] - p[1])))
        out = new
    return out


def clip_area(ring, convex=None) -> float:
    return abs(signed_area(ring if convex is None else clip(ring, convex)))


def simplify(ring, tolerance: float):
    """Douglas-Peucker on a ring, begun at its first vertex and the one farthest from it."""
    if len(ring) < 4:
        return list(ring)

    def far(points):
        a, b = points[0], points[-1]
        length = math.hypot(b[0] - a[0], b[1] - a[1])
        best, at = -1.0, 0
        for i in range(1, len(points) - 1):
            d = abs(_turn(a, b, points[i])) / length if length else math.hypot(points[i][0] - a[0], points[i][1] - a[1])
            if d > best:
                best, at = d, i
        return best, at

    def run(points):
        kept, todo = {0, len(points) - 1}, [(0, len(points) - 1)]
        while todo:
            a, b = todo.pop()
            d, k = far(points[a : b + 1])
            if d > tolerance:
                kept.add(a + k)
                todo += [(a, a + k), (a + k, b)]
        return [points[i] for i in sorted(kept)]

    m = max(range(len(ring)), key=lambda i: math.dist(ring[0], ring[i]))
    if m == 0:
        return list(ring)
    return run(ring[: m + 1])[:-1] + run([*ring[m:], ring[0]])[:-1]


def fit_vertices(ring, n: int):
    """A ring of exactly ``n`` vertices: the last one repeated, or simplified more and more until it fits; a circle if that fails."""
    tolerance, out = 0.5, list(ring)
    while len(out) > n and tolerance <= 50:
        out = simplify(ring, tolerance)
        tolerance += 0.5
    if len(out) > n:
        cx, cy = sum(p[0] for p in ring) / len(ring), sum(p[1] for p in ring) / len(ring)
        r = math.sqrt(abs(signed_area(ring)) / math.pi)
        out = [(cx + r * math.cos(2 * math.pi * k / n), cy + r * math.sin(2 * math.pi * k / n)) for k in range(n)]
    return out + [out[-1]] * (n - len(out))


def convex_hull(points):
    pts = sorted(set(points))
    if len(pts) < 3:
        return pts

    def half(seq):
        out = []
        for p in seq:
            while len(out) > 1 and _turn(out[-2], out[-1], p) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return half(pts) + half(pts[::-1])
