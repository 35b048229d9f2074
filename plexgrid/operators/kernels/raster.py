"""Masks as numpy arrays: rasterising rings, contours, morphology, filters."""

from __future__ import annotations

import numpy as np


def rasterize(ring, height: int, width: int, x0: int = 0, y0: int = 0) -> np.ndarray:
    """1 at whole pixels inside the ring or on it."""
    xs, ys = np.asarray([p[0] for p in ring], float) - x0, np.asarray([p[1] for p in ring], float) - y0
    gy, gx = np.mgrid[0:height, 0:width].astype(float)
    odd, on = np.zeros((height, width), bool), np.zeros((height, width), bool)
    for x1, y1, x2, y2 in zip(xs, ys, np.roll(xs, -1), np.roll(ys, -1), strict=True):
        t = (x2 - x1) * (gy - y1) - (y2 - y1) * (gx - x1)
        on |= (np.abs(t) < 1e-9) & (gx >= min(x1, x2)) & (gx <= max(x1, x2)) & (gy >= min(y1, y2)) & (gy <= max(y1, y2))
        odd ^= ((y1 > gy) != (y2 > gy)) & ((t > 0) == (y2 > y1))
    return (odd | on).astype(np.int8)


def label(mask: np.ndarray) -> np.ndarray:
    """Numbers from 1 for regions joined by edges, in order of their first pixel."""
    out = np.where(mask > 0, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    big = mask.size + 1
    while True:
        low = np.where(out > 0, out, big)
        near = low.copy()
        near[1:] = np.minimum(near[1:], low[:-1])
        near[:-1] = np.minimum(near[:-1], low[1:])
        near[:, 1:] = np.minimum(near[:, 1:], low[:, :-1])
        near[:, :-1] = np.minimum(near[:, :-1], low[:, 1:])
        new = np.where(out > 0, near, 0)
        flat = np.concatenate([[0], new.ravel()])
        new = np.where(out > 0, flat[new], 0)  # jump to the label of the label
        if (new == out).all():
            break
        out = new
    found, inverse = np.unique(out, return_inverse=True)
    return inverse.reshape(mask.shape) + (0 if found[0] == 0 else 1)


def contours(mask: np.ndarray) -> list[list[tuple[float, float]]]:
    """Rings (x, y) at level 0.5 around regions of ``mask``, outer ones counter-clockwise in image axes, holes the other way.

    Each cell of four pixels gives the segments between the midpoints of its
    mixed sides; segments run with the region on one side and are joined end to end.
    """
    m = np.pad(np.asarray(mask) > 0, 1)
    nxt: dict[tuple[float, float], list[tuple[float, float]]] = {}
    cases = {1: "LB", 2: "BR", 3: "LR", 4: "RT", 5: "LTRB", 6: "BT", 7: "LT", 8: "TL", 9: "TB", 10: "TRBL", 11: "TR", 12: "RL", 13: "RB", 14: "BL"}
    code = m[1:, :-1] * 1 + m[1:, 1:] * 2 + m[:-1, 1:] * 4 + m[:-1, :-1] * 8
    for y, x in zip(*np.nonzero((code > 0) & (code < 15)), strict=True):
        mid = {"L": (x, y + 0.5), "R": (x + 1, y + 0.5), "T": (x + 0.5, y), "B": (x + 0.5, y + 1)}
        c = cases[int(code[y, x])]
        for a, b in zip(c[::2], c[1::2], strict=True):
            nxt.setdefault(mid[a], []).append(mid[b])
    rings = []
    while nxt:
        start = next(iter(nxt))
        ring, at = [start], start
        while True:
            to = nxt[at].pop()
            if not nxt[at]:
                del nxt[at]
            if to == start:
                break
            ring.append(to)
            at = to
        rings.append([(float(x - 1), float(y - 1)) for x, y in ring])
    return rings


def dilate(mask: np.ndarray, radius: int) -> np.ndarray:
    """The mask grown by a disc."""
    if radius < 1:
        return mask > 0
    h, w = mask.shape
    padded = np.pad(mask > 0, radius)
    out = np.zeros((h, w), bool)
    for dy in range(-radius, radius + 1):
        for dx in range(-radius, radius + 1):
            if dx * dx + dy * dy <= radius * radius:
                out |= padded[radius + dy : radius + dy + h, radius + dx : radius + dx + w]
    return out


def erode(mask: np.ndarray, radius: int) -> np.ndarray:
    """The mask shrunk by a disc; what lies beyond the border counts as mask."""
    return ~dilate(~(mask > 0), radius)


def opened(mask, radius: int):
    return dilate(erode(mask, radius), radius)


def closed(mask, radius: int):
    return erode(dilate(mask, radius), radius)


def median(image: np.ndarray, size: int = 3) -> np.ndarray:
    r = size // 2
    padded = np.pad(image, r, mode="edge")
    return np.median(np.lib.stride_tricks.sliding_window_view(padded, (size, size)), axis=(2, 3)).astype(image.dtype)


def gaussian(image: np.ndarray, sigma: float) -> np.ndarray:
    if sigma <= 0:
        return image.astype(float)
    r = max(1, int(4 * sigma + 0.5))
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    out = np.pad(image.astype(float), r, mode="symmetric" if min(image.shape) > r else "edge")
    out = np.apply_along_axis(lambda v: np.convolve(v, k, "valid"), 0, out)
    return np.apply_along_axis(lambda v: np.convolve(v, k, "valid"), 1, out)


def equalize(image: np.ndarray, tiles: int = 8, clip: float = 0.2, bins: int = 256) -> np.ndarray:
    """Contrast-limited histogram equalisation by tiles, bilinear between them; values 0..1."""
    x = image.astype(float)
    span = x.max() - x.min()
    if span == 0:
        return np.zeros_like(x)
    q = np.minimum(((x - x.min()) / span * (bins - 1)).astype(int), bins - 1)
    h, w = q.shape
    ny, nx = max(1, min(tiles, h)), max(1, min(tiles, w))
    ys, xs = np.linspace(0, h, ny + 1).astype(int), np.linspace(0, w, nx + 1).astype(int)
    maps = np.empty((ny, nx, bins))
    for i in range(ny):
        for j in range(nx):
            part = q[ys[i] : ys[i + 1], xs[j] : xs[j + 1]]
            n = np.bincount(part.ravel(), minlength=bins).astype(float)
            most = max(clip * part.size, 1.0)
            over = np.maximum(n - most, 0).sum()
            n = np.minimum(n, most) + over / bins
            maps[i, j] = np.cumsum(n) / part.size
    fy = np.clip((np.arange(h) - (ys[:-1].mean() if ny == 1 else (ys[0] + ys[1]) / 2)) / (h / ny), 0, ny - 1)
    fx = np.clip((np.arange(w) - (xs[:-1].mean() if nx == 1 else (xs[0] + xs[1]) / 2)) / (w / nx), 0, nx - 1)
    y0, x0 = np.minimum(fy.astype(int), ny - 1), np.minimum(fx.astype(int), nx - 1)
    y1, x1 = np.minimum(y0 + 1, ny - 1), np.minimum(x0 + 1, nx - 1)
    a, b = (fy - y0)[:, None], (fx - x0)[None, :]
    at = lambda i, j: maps[i[:, None], j[None, :], q]
    return (1 - a) * ((1 - b) * at(y0, x0) + b * at(y0, x1)) + a * ((1 - b) * at(y1, x0) + b * at(y1, x1))


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear resampling at pixel centres."""
    h, w = image.shape[-2:]
    y = np.clip((np.arange(height) + 0.5) * h / height - 0.5, 0, h - 1)
    x = np.clip((np.arange(width) + 0.5) * w / width - 0.5, 0, w - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    a, b = (y - y0)[:, None], (x - x0)[None, :]
    g = lambda i, j: image[..., i[:, None], j[None, :]]
    return (1 - a) * ((1 - b) * g(y0, x0) + b * g(y0, x1)) + a * ((1 - b) * g(y1, x0) + b * g(y1, x1))


def vectorize(mask: np.ndarray, tolerance: float | None = None, smooth_ratio: float = 0.1, holes: bool = False) -> list[tuple[int, list[tuple[float, float]]]]:
    """(label, ring) of each labelled region, smoothed by opening and closing and simplified.

    The tolerance is 0.03 of the mean radius, one at most, where none is given.
    """
    from .polygons import signed_area, simplify

    values, sizes = np.unique(mask[mask > 0], return_counts=True)
    if not len(values):
        return []
    radius = float(np.sqrt(sizes / np.pi).mean())
    tolerance = tolerance or min(0.03 * radius, 1.0)
    out = []
    for v in values:
        ys, xs = np.nonzero(mask == v)
        y0, x0 = ys.min(), xs.min()
        own = np.zeros((ys.max() - y0 + 1, xs.max() - x0 + 1), bool)
        own[ys - y0, xs - x0] = True
        r = int(smooth_ratio * np.sqrt(len(ys) / np.pi))
        if r:
            smooth = opened(closed(np.pad(own, r + 1), r), r)[r + 1 : -r - 1, r + 1 : -r - 1]
            own = smooth if smooth.any() else own
        rings = contours(own)
        rings.sort(key=lambda g: -abs(signed_area(g)))
        for ring in rings if holes else rings[:1]:
            out.append((int(v), [(x + float(x0), y + float(y0)) for x, y in simplify(ring, tolerance)]))
    return out
