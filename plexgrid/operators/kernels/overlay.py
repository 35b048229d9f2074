"""Exact overlay of polygons: union, intersection, difference, repair, relations.

All edges are cut where they meet. Each piece then knows, for every shape, on
which of its sides the shape lies (by parity, so rings that cross themselves
and rings with holes are understood), and a result's outline consists of the
pieces with the result on one side only, walked with the result on the left.
"""

from __future__ import annotations

import numpy as np

from .polygons import convex_hull, signed_area

#: Corners closer than this share of the extent are one.
SNAP = 1e-9
#: Entries of a table of edges by edges that is held at once.
CELLS = 1 << 21


def pieces(shapes: list[list]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(corners, ends of each piece as two corners, how often each shape has it) of the shapes' edges, cut where they meet."""
    start, end, owner = [], [], []
    for k, rings in enumerate(shapes):
        for r in rings:
            r = np.asarray(r, float).reshape(-1, 2)
            if len(r) >= 2:
                start.append(r)
                end.append(np.roll(r, -1, 0))
                owner.append(np.full(len(r), k))
    if not start:
        return np.zeros((0, 2)), np.zeros((0, 2), int), np.zeros((0, len(shapes)), int)
    p, q, owner = np.concatenate(start), np.concatenate(end), np.concatenate(owner)
    least = p.min(0)
    grid = max(float((p.max(0) - least).max()), 1e-300) * SNAP
    p, q = p - least, q - least
    corners = np.unique(p, axis=0)
    d = q - p
    length = np.maximum(np.hypot(*d.T), 1e-300)
    a, b, who = [], [], []
    step = max(1, CELLS // max(len(p), len(corners)))
    for i in range(0, len(p), step):
        o, v = p[i : i + step, None], d[i : i + step, None]
        cross = v[..., 0] * d[:, 1] - v[..., 1] * d[:, 0]
        w = p[None] - o
        with np.errstate(divide="ignore", invalid="ignore"):
            t = (w[..., 0] * d[:, 1] - w[..., 1] * d[:, 0]) / cross
            u = (w[..., 0] * v[..., 1] - w[..., 1] * v[..., 0]) / cross
        meet = (np.abs(cross) > 1e-14 * length[i : i + step, None] * length) & (t > 0) & (t < 1) & (u >= 0) & (u <= 1)
        c = corners[None] - o
        off = np.abs(v[..., 0] * c[..., 1] - v[..., 1] * c[..., 0]) / length[i : i + step, None]
        along = (c * v).sum(-1) / length[i : i + step, None] ** 2
        on = (off <= grid) & (along > 0) & (along < 1)
        for j in range(len(o)):
            cuts = np.unique(np.concatenate([[0.0, 1.0], t[j][meet[j]], along[j][on[j]]]))
            at = o[j] + cuts[:, None] * v[j]
            at[-1] = q[i + j]
            a.append(at[:-1])
            b.append(at[1:])
            who.append(np.full(len(at) - 1, owner[i + j]))
    a, b, who = np.concatenate(a), np.concatenate(b), np.concatenate(who)
    # corners that round to one place of the grid are one
    _, first, at = np.unique(np.round(np.concatenate([a, b]) / grid).astype(np.int64), axis=0, return_index=True, return_inverse=True)
    points = np.concatenate([a, b])[first] + least
    at = at.reshape(2, -1)
    own = at[0] != at[1]
    both = np.sort(at[:, own], 0)
    unique, at = np.unique(both, axis=1, return_inverse=True)
    times = np.zeros((unique.shape[1], len(shapes)), int)
    np.add.at(times, (at.ravel(), who[own]), 1)
    return points, unique.T, times


def sides(points: np.ndarray, ends: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which shapes lie to the left and to the right of each piece, walked from its first to its second corner."""
    p, q = points[ends[:, 0]], points[ends[:, 1]]
    middle, d = (p + q) / 2, q - p
    odd = times % 2
    right = np.zeros(times.shape, bool)
    flat = np.abs(d[:, 1]) < np.abs(d[:, 0])
    step = max(1, CELLS // max(1, len(p)))
    for axis in (0, 1):
        # pieces that are rather upright look along x, the others along y
        which = np.flatnonzero(flat == (axis == 1))
        o = 1 - axis
        for i in range(0, len(which), step):
            w = which[i : i + step]
            m = middle[w]
            crosses = (p[None, :, o] > m[:, None, o]) != (q[None, :, o] > m[:, None, o])
            with np.errstate(divide="ignore", invalid="ignore"):
                at = p[None, :, axis] + (m[:, None, o] - p[None, :, o]) / d[None, :, o] * d[None, :, axis]
            beyond = crosses & (at > m[:, None, axis])
            beyond[np.arange(len(w)), w] = False
            ahead = (beyond.astype(int) @ odd) % 2 == 1  # the shapes on the side of larger x, or y
            turned = d[w, o] > 0 if axis == 0 else d[w, o] < 0  # whether that side is the right one
            right[w] = np.where(turned[:, None], ahead, ahead ^ (odd[w] == 1))
    return right ^ (odd == 1), right


def rings_of(points: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[list]:
    """Rings from directed edges with the inside on the left; where rings touch at a corner they stay apart."""
    leaving: dict[int, list[int]] = {}
    for k, s in enumerate(start.tolist()):
        leaving.setdefault(s, []).append(k)
    angle = np.arctan2(*(points[end] - points[start]).T[::-1])
    used = np.zeros(len(start), bool)
    out = []
    for k in range(len(start)):
        if used[k]:
            continue
        ring, now = [], k
        while not used[now]:
            used[now] = True
            ring.append(tuple(points[start[now]].tolist()))
            ways = [x for x in leaving[int(end[now])] if not used[x]] if int(end[now]) in leaving else []
            if not ways:
                break
            back = angle[now] + np.pi
            now = min(ways, key=lambda x: (back - angle[x]) % (2 * np.pi) or 2 * np.pi)
        if len(ring) >= 3:
            out.append(straight(ring))
    return [r for r in out if len(r) >= 3]


def straight(ring: list) -> list:
    """A ring without corners that lie between their neighbours."""
    r = np.asarray(ring)
    a, b = r - np.roll(r, 1, 0), np.roll(r, -1, 0) - r
    keep = np.abs(a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]) > 1e-12 * np.hypot(*a.T) * np.hypot(*b.T)
    return [ring[i] for i in np.flatnonzero(keep)] if keep.sum() >= 3 else ring


def overlay(shapes: list[list], keep) -> list[list]:
    """Rings, holes clockwise, of where ``keep`` holds; it gets a row a place, a column a shape, and gives a boolean a row.

    A shape is a list of rings, a ring a list of (x, y).
    """
    points, ends, times = pieces(shapes)
    left, right = sides(points, ends, times)
    inside, outside = keep(left), keep(right)
    ahead, back = inside & ~outside, outside & ~inside
    start = np.concatenate([ends[ahead, 0], ends[back, 1]])
    end = np.concatenate([ends[ahead, 1], ends[back, 0]])
    return rings_of(points, start, end)


def union(*shapes: list) -> list[list]:
    return overlay(list(shapes), lambda x: x.any(1))


def intersection(a: list, b: list) -> list[list]:
    return overlay([a, b], lambda x: x.all(1))


def difference(a: list, b: list) -> list[list]:
    return overlay([a, b], lambda x: x[:, 0] & ~x[:, 1])


def area_of(rings: list[list]) -> float:
    return sum(signed_area(r) for r in rings)


def valid(ring: list) -> list[list]:
    """A ring that may cross itself as rings that don't; what is enclosed twice is outside."""
    return overlay([[ring]], lambda x: x[:, 0])


def largest(rings: list[list]) -> list:
    """The outer ring with the largest area, without holes; empty if there is none."""
    outer = [r for r in rings if signed_area(r) > 0]
    return max(outer, key=signed_area) if outer else []


def is_convex(ring: list) -> bool:
    return len(set(ring)) == len(ring) == len(convex_hull(ring))


def relation(a: list, b: list) -> dict[str, bool]:
    """Whether two rings' insides meet, whether each reaches outside the other, and whether their borders meet."""
    points, ends, times = pieces([[a], [b]])
    left, right = sides(points, ends, times)
    both = np.concatenate([left, right])
    corners = [set(ends[times[:, k] > 0].ravel().tolist()) for k in (0, 1)]
    return {"meet": bool(both.all(1).any()), "a_out": bool((both[:, 0] & ~both[:, 1]).any()), "b_out": bool((both[:, 1] & ~both[:, 0]).any()), "borders": bool(corners[0] & corners[1])}


#: Relations of the left shape to the right one, from what ``relation`` finds.
PREDICATES = {
    "intersects": lambda r: r["meet"] or r["borders"],
    "within": lambda r: r["meet"] and not r["a_out"],
    "covered_by": lambda r: r["meet"] and not r["a_out"],
    "contains": lambda r: r["meet"] and not r["b_out"],
    "covers": lambda r: r["meet"] and not r["b_out"],
    "contains_properly": lambda r: r["meet"] and not r["b_out"] and not r["borders"],
    "overlaps": lambda r: r["meet"] and r["a_out"] and r["b_out"],
    "touches": lambda r: r["borders"] and not r["meet"],
    "crosses": lambda r: False,  # of two areas none crosses the other
}


def split_cells(rings: list[list], partners: list[list[int]], doubled: set[int] = frozenset()) -> list[list]:
    """Each cell's ring without what is nearer to another cell that overlaps it.

    A cell's core is what no partner covers. What it shares goes to the cell
    with the nearest corner of a core. A cell without a core gets an empty ring,
    as do those of rings that several cells have, ``doubled``.
    """
    cores = [[] if i in doubled else overlay([[r], *([rings[j]] for j in own)], lambda x: x[:, 0] & ~x[:, 1:].any(1)) for i, (r, own) in enumerate(zip(rings, partners, strict=True))]
    corners = [np.concatenate([drawn_in(r) for r in core] or [np.zeros((0, 2))]) for core in cores]
    out = []
    for i, own in enumerate(partners):
        others = [corners[j] for j in own if len(corners[j])]
        if not own or not len(corners[i]):
            out.append(largest(cores[i]))
            continue
        x, y = np.array(rings[i]).T
        frame = [(x.min(), y.min()), (x.max(), y.min()), (x.max(), y.max()), (x.min(), y.max())]
        near = [r for v in corners[i] if len(r := nearest_to(frame, v, np.concatenate(others) if others else np.zeros((0, 2)))) >= 3]
        n = 1 + len(own)
        out.append(largest(overlay([[rings[i]], *([rings[j]] for j in own), *([r] for r in near)], lambda s: s[:, 0] & (~s[:, 1:n].any(1) | s[:, n:].any(1)))))
    return out


def drawn_in(ring: list, share: float = 1e-6) -> np.ndarray:
    """The corners of a ring moved a little to its inside, so that cores that touch have no corner in common."""
    r = np.asarray(ring, float)
    d = np.roll(r, -1, 0) - r
    n = np.stack([-d[:, 1], d[:, 0]], 1) / np.maximum(np.hypot(*d.T), 1e-300)[:, None]
    return r + share * float(np.ptp(r, axis=0).max()) * (n + np.roll(n, 1, 0))


def nearest_to(frame: list, v: np.ndarray, others: np.ndarray) -> list:
    """What of the convex ring ``frame`` is nearer to ``v`` than to any of ``others``."""
    ring = np.array(frame, float)
    for w in others[np.argsort(((others - v) ** 2).sum(1))]:
        side = (ring - (v + w) / 2) @ (v - w)
        if (side >= 0).all():
            continue
        then, at = np.roll(ring, -1, 0), np.roll(side, -1)
        rows = []
        for k in range(len(ring)):
            if side[k] >= 0:
                rows.append(ring[k])
            if (side[k] > 0 > at[k]) or (side[k] < 0 < at[k]):
                rows.append(ring[k] + side[k] / (side[k] - at[k]) * (then[k] - ring[k]))
        if len(rows) < 3:
            return []
        ring = np.array(rows)
    return [tuple(p) for p in ring.tolist()]
