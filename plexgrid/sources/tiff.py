"""A small reader of TIFF files: strips or tiles, plain or deflated, 8, 16 or 32 bits, several pages."""

from __future__ import annotations

import struct
import zlib

import numpy as np

_size = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 8: 2, 9: 4, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8}
_code = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q"}


class UnsupportedImage(ValueError):
    """An image of a kind that this reader doesn't know; give a decoder of your own."""


def pages(data: bytes):
    """The tags of each page as a dict from number to tuple of values, or bytes for text."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None:
        raise UnsupportedImage("not a TIFF file")
    version = struct.unpack_from(order + "H", data, 2)[0]
    if version not in (42, 43):
        raise UnsupportedImage(f"TIFF version {version}")
    big = version == 43
    at = struct.unpack_from(order + ("Q" if big else "I"), data, 8 if big else 4)[0]
    while at:
        n = struct.unpack_from(order + ("Q" if big else "H"), data, at)[0]
        at += 8 if big else 2
        tags = {}
        for _ in range(n):
            tag, kind = struct.unpack_from(order + "HH", data, at)
            count = struct.unpack_from(order + ("Q" if big else "I"), data, at + 4)[0]
            field, room = at + (12 if big else 8), 8 if big else 4
            size = _size.get(kind, 1) * count
            where = field if size <= room else struct.unpack_from(order + ("Q" if big else "I"), data, field)[0]
            if kind in _code:
                tags[tag] = struct.unpack_from(f"{order}{count}{_code[kind]}", data, where)
            else:
                tags[tag] = data[where : where + size]
            at += 20 if big else 12
        yield order, tags
        at = struct.unpack_from(order + ("Q" if big else "I"), data, at)[0]


def read(data: bytes) -> np.ndarray:
    """All full-size pages as (channel, y, x)."""
    out = []
    for order, t in pages(data):
        width, height = t[256][0], t[257][0]
        if out and out[0].shape != (height, width):
            continue  # a smaller level of a pyramid
        bits, samples = t.get(258, (1,))[0], t.get(277, (1,))[0]
        how, predictor = t.get(259, (1,))[0], t.get(317, (1,))[0]
        if how not in (1, 8, 32946) or bits not in (8, 16, 32) or predictor not in (1, 2):
            raise UnsupportedImage(f"compression {how}, {bits} bits, predictor {predictor}")
        kind = {1: "u", 2: "i", 3: "f"}[t.get(339, (1,))[0]]
        dtype = np.dtype(f"{order}{kind}{bits // 8}")
        planar = t.get(284, (1,))[0] == 2
        tiled = 322 in t
        w, h = (t[322][0], t[323][0]) if tiled else (width, min(t.get(278, (height,))[0], height))
        offsets, sizes = (t[324], t[325]) if tiled else (t[273], t[279])
        per = 1 if planar else samples
        across, down = -(-width // w), -(-height // h)
        page = np.zeros((samples, down * h, across * w), dtype.newbyteorder("="))
        for k, (o, s) in enumerate(zip(offsets, sizes, strict=True)):
            raw = data[o : o + s] if how == 1 else zlib.decompress(data[o : o + s])
            plane, k = divmod(k, across * down)
            y, x = divmod(k, across)
            rows = h if tiled else min(h, height - y * h)
            block = np.frombuffer(raw, dtype, rows * w * per).reshape(rows, w, per)
            if predictor == 2:
                block = np.cumsum(block, axis=1, dtype=dtype.newbyteorder("="))
            part = slice(plane, plane + 1) if planar else slice(0, samples)
            page[part, y * h : y * h + rows, x * w : (x + 1) * w] = block.transpose(2, 0, 1)
        out.extend(page[:, :height, :width])
    if not out:
        raise UnsupportedImage("no page")
    return np.stack(out)


def description(data: bytes) -> str:
    """The text that the first page carries, often XML."""
    for _, t in pages(data):
        return bytes(t.get(270, b"")).rstrip(b"\0").decode("utf-8", "replace")
    return ""


def write(image: np.ndarray, deflate: bool = True) -> bytes:
    """(channel, y, x) of 8 or 16 bits as pages of one strip each."""
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for page in image:
        raw = np.ascontiguousarray(page, page.dtype.newbyteorder("<")).tobytes()
        raw = zlib.compress(raw) if deflate else raw
        strip = len(out)
        out += raw + b"\0" * (len(raw) % 2)
        h, w = page.shape
        tags = [(256, 4, w), (257, 4, h), (258, 3, page.dtype.itemsize * 8), (259, 3, 8 if deflate else 1), (262, 3, 1), (273, 4, strip), (277, 3, 1), (278, 4, h), (279, 4, len(raw)), (339, 3, 1)]
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", a, k, 1, v) for a, k, v in tags)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)
