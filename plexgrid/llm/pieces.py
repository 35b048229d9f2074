"""SentencePiece vocabularies: encoding and decoding, and token counts.

Texts fall into units, stretches that pieces don't reach over: each begins with
its spaces. Both operators work on the distinct units of a batch, and relax over
the prefixes of each unit:

* Encoding indexes the concatenated units in a suffix array, finds every
  piece's range of occurrences by binary search, sorts these edges by position
  and relaxes them in that order, all units at once.
* Counting inserts the units in a trie and keeps at each node the state and the
  number of pieces of that prefix, computed once for all units that share it.

For a unigram vocabulary the state of a prefix is its best summed score. The
public vocabulary is of the BPE kind, for which the best path by summed scores is
not what the tokenizer returns. What it returns has this property instead: the
pieces before any boundary are the encoding of the text before it, and a sequence
of pieces is the encoding exactly if every two neighbours are the encoding of
their joint text. So each prefix has one last piece, the one that fits the last
piece of the prefix before it, and for BPE vocabularies the relaxation has this
test in place of a comparison of scores; results equal the library's.

Characters without a piece become one piece for each byte. A batch is handled a
few megabytes at a time, cut between units; a unit of more than LONG_UNIT bytes,
such as a text without spaces, is relaxed in windows, with five bytes of memory
for each of its own. Encoding keeps nothing from batch to batch but a bounded table
of pairs of pieces; counting keeps a trie of a bounded number of nodes, and the
counts at the ends of a bounded number of units of up to 32 bytes.
"""

from __future__ import annotations

import codecs
import sys
import types
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _power_table, blocks, mix64, small_batches

#: Pairs of pieces remembered (8 bytes each, in a table twice as large); nodes of a trie before it is begun anew.
PAIRS, NODES = 1 << 20, 400_000
#: Ends of units in the trie whose counts outlast it.
TERMINALS = 800_000
#: Bytes of text handled at once, bytes of a unit that is relaxed by itself, and of its windows.
SEGMENT, LONG_UNIT, WINDOW = 4 << 20, 256, 1 << 16
UNSEEN, START = -2, -1
#: Bytes without a piece are -10 - byte while units are relaxed.
BYTES = -10
UNKNOWN_PENALTY = 10.0  # as in the library: below the lowest score


def _fields(data: bytes):
    """(number, value) of a protocol buffer's fields; values are numbers or bytes."""
    at = 0

    def number():
        nonlocal at
        shift = value = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
        else:
            size = number() if kind == 2 else {1: 8, 5: 4}[kind]
            yield tag >> 3, data[at : at + size]
            at += size


def is_unigram(model: bytes) -> bool:
    """True if the model file's trainer settings name the unigram kind, which is also the default."""
    for number, value in _fields(model):
        if number == 2:
            for inner, kind in _fields(value):
                if inner == 3:
                    return kind == 1
    return True


class PairTable:
    """A hash table from pairs of pieces to whether they fit, read for many pairs at once."""

    def __init__(self, most: int):
        self.most = most
        self.mask = np.uint64(2 * most - 1)
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(2 * self.most, np.uint64)  # key * 2 + fits, plus 2; 0 is free
        self.count = 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """1, 0, or -1 where the pair isn't known."""
        out = np.full(len(keys), -1, np.int8)
        left = np.arange(len(keys))
        wanted = (keys.astype(np.uint64) + np.uint64(1)) << np.uint64(1)
        slot = mix64(keys.astype(np.uint64)) & self.mask
        while len(left):
            there = self.keys[slot]
            hit = (there & ~np.uint64(1)) == wanted[left]
            out[left[hit]] = (there[hit] & np.uint64(1)).astype(np.int8)
            go = ~hit & (there != 0)
            left, slot = left[go], (slot[go] + np.uint64(1)) & self.mask
        return out

    def put(self, keys: np.ndarray, fits: np.ndarray) -> None:
        """Distinct pairs that are not known yet."""
        if self.count + len(keys) > self.most:
            self.clear()
        self.count += len(keys)
        slots, mask = mix64(keys.astype(np.uint64)).tolist(), int(self.mask)
        table = self.keys
        for k, s, f in zip(keys.tolist(), slots, fits.tolist(), strict=True):
            s &= mask
            while table[s]:
                s = s + 1 & mask
            table[s] = (k + 1) * 2 + f


class Pieces:
    """A vocabulary with byte fallback, read from the model file's content."""

    def __init__(self, model: bytes):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = p.get_piece_size()
        self.unigram = is_unigram(model)
        byte_ids = {p.id_to_piece(i): i for i in range(n) if p.is_byte(i)}
        if len(byte_ids) != 256 or p.encode("  a", out_type=str)[0].count("▁") < 2 and not self.unigram:
            raise ValueError("a vocabulary with byte fallback that keeps all spaces is needed")
        self.byte_of = np.zeros(256, np.int64)
        for k, v in byte_ids.items():
            self.byte_of[int(k[3:5], 16)] = v
        self.ids = {p.id_to_piece(i).replace("▁", " "): i for i in range(n) if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i))}
        if any(" " in k.lstrip(" ") or k.startswith("  ") and k.strip(" ") or "\n" in k for k in self.ids):
            raise ValueError("pieces must not reach over spaces or lines")
        self.text = [""] * n
        for k, i in self.ids.items():
            self.text[i] = k
        raw = [t.encode() for t in self.text]
        for b in range(256):
            raw[self.byte_of[b]] = bytes([b])
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_size = np.array([len(r) for r in raw])
        self.raw_at = np.cumsum(self.raw_size) - self.raw_size
        self.score = np.array([p.get_score(i) for i in range(n)])
        self.unknown = min((self.score[i] for i in self.ids.values()), default=0.0) - UNKNOWN_PENALTY
        self.rank = {k: (-p.get_score(i), i) for k, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        self.size = n
        self.pairs = PairTable(PAIRS)
        self.fits_known: dict[int, bool] = {}
        # characters that are pieces by themselves
        self.letters = np.array(sorted(ord(k) for k in self.ids if len(k) == 1), np.uint32)

    def merged(self, text: str) -> list[str]:
        """The pieces of a text by merging neighbours, best first, leftmost first."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                r = self.rank.get(parts[k] + parts[k + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fitting(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """True where pieces ``a``, ``b`` side by side are what their joint text is encoded to; starts and bytes fit all."""
        good = np.ones(len(a), bool)
        both = np.flatnonzero((a >= 0) & (b >= 0))
        keys = a[both].astype(np.int64) * self.size + b[both]
        found = self.pairs.find(keys)
        if (found < 0).any():
            new = np.unique(keys[found < 0])
            fits = np.zeros(len(new), np.int8)
            for k, key in enumerate(new.tolist()):
                x, y = self.text[key // self.size], self.text[key % self.size]
                fits[k] = self.merged(x + y) == [x, y]
            at = np.searchsorted(new, keys[found < 0])
            found[found < 0] = fits[at]
            for i in range(0, len(new), self.pairs.most):
                self.pairs.put(new[i : i + self.pairs.most], fits[i : i + self.pairs.most])
        good[both] = found == 1
        return good

    def fits(self, a: int, b: int) -> bool:
        """As ``fitting``, for one pair of pieces."""
        key = a * self.size + b
        good = self.fits_known.get(key)
        if good is None:
            if len(self.fits_known) >= PAIRS // 2:
                self.fits_known.clear()
            x, y = self.text[a], self.text[b]
            good = self.fits_known[key] = self.merged(x + y) == [x, y]
        return good

    def strange(self, data: np.ndarray) -> np.ndarray:
        """True for each byte of a character that is no piece; of a character cut off in front, the rest is left out."""
        at = np.flatnonzero((data & 0xC0) != 0x80)
        size = np.diff(at, append=len(data))
        lead = data[at].astype(np.uint32)
        code = np.where(size == 1, lead, lead & (0xFF >> np.minimum(size + 1, 7)).astype(np.uint32))
        for k in range(1, 4):
            more = size > k
            code[more] = code[more] << 6 | data[at[more] + k] & np.uint32(63)
        known = self.letters[np.minimum(np.searchsorted(self.letters, code), len(self.letters) - 1)] == code
        return np.concatenate([np.zeros(len(data) - int(size.sum()), bool), np.repeat(~known, size)])

    def decoded(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of ids, and the number of each."""
        sizes = self.raw_size[ids]
        at = np.repeat(self.raw_at[ids] - (np.cumsum(sizes) - sizes), sizes)
        return self.raw[at + np.arange(len(at))], sizes


def prepared(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts as the model reads them: a space before each that isn't empty, and spaces for the marks U+2581."""
    begin, end = int(offsets[0]), int(offsets[-1])
    data, offsets = data[begin:end], offsets - begin
    if b"\xe2\x96\x81" in memoryview(data).tobytes():
        texts = [data[p:q].tobytes().replace(b"\xe2\x96\x81", b" ") for p, q in zip(offsets[:-1], offsets[1:], strict=True)]
        data = np.frombuffer(b"".join(texts), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    full = np.diff(offsets) > 0
    shift = np.concatenate([[0], np.cumsum(full)])
    out = np.full(len(data) + int(shift[-1]), 32, np.uint8)
    begins = offsets[:-1][full]
    keep = np.ones(len(out), bool)
    keep[begins + np.arange(len(begins))] = False
    out[keep] = data
    return out, offsets + shift


def segments(data: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of up to SEGMENT bytes cut where a unit begins, or a longer unit by itself."""
    raw, out, at, n = memoryview(data).tobytes(), [], 0, len(data)
    while at < n:
        end = min(n, at + SEGMENT)
        if end < n:
            cut = max(raw.rfind(b"\n", at + 1, end), raw.rfind(b" ", at + 1, end))
            while cut > at and raw[cut] == 32 and raw[cut - 1] == 32:
                cut -= 1
            if cut <= at:  # one unit, with its spaces
                cut = at
                while cut < n and raw[cut] == 32:
                    cut += 1
                ends = [p for p in (raw.find(b" ", cut + 1), raw.find(b"\n", cut + 1)) if p >= 0]
                cut = min(ends, default=n)
            end = cut
        out.append((at, end))
        at = end
    return out


class Units:
    """Units of a stretch of text, and its distinct ones.

    ``heads`` are positions where a unit begins besides, as at a document's start.
    """

    def __init__(self, data: np.ndarray, heads: np.ndarray):
        begin = np.zeros(len(data), bool)
        line, space = data == 10, data == 32
        begin |= line
        begin[1:] |= line[:-1] | (space[1:] & ~space[:-1])
        begin[heads[heads < len(data)]] = True
        begin[0] = True
        self.starts = np.flatnonzero(begin)
        self.sizes = np.diff(self.starts, append=len(data))
        if len(self.starts) == 1:  # which may be very long
            self.which = self.first = np.zeros(1, np.int64)
            self.begin, self.size = self.starts, self.sizes
            return
        # equal units by 64-bit hashes, then byte by byte
        within = np.arange(len(data)) - np.repeat(self.starts, self.sizes)
        value = (data.astype(np.uint64) + np.uint64(1)) * _power_table(int(self.sizes.max()))[within]
        hashes = mix64(np.add.reduceat(value, self.starts) + self.sizes.astype(np.uint64))
        del value
        _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        model = np.repeat(self.starts[first][which], self.sizes) + within
        same = self.sizes[first][which] == self.sizes
        if not same.all() or not (data[np.minimum(model, len(data) - 1)] == data).all():
            texts: dict[bytes, int] = {}  # two units of one hash: told apart by what they are
            raw = data.tobytes()
            which = np.array([texts.setdefault(raw[p : p + n], len(texts)) for p, n in zip(self.starts.tolist(), self.sizes.tolist(), strict=True)])
            first = np.unique(which, return_index=True)[1]
        self.which, self.first = which, first
        self.begin, self.size = self.starts[first], self.sizes[first]


def spread_out(flat: np.ndarray, counts: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of items that stand in ``flat`` with ``counts`` each: those numbered ``which``, one after another, and their counts."""
    at = np.cumsum(counts) - counts
    n = counts[which]
    return flat[np.repeat(at[which] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))], n


def by_digits(keys: np.ndarray) -> np.ndarray:
    """A stable order of numbers from 0, by digits of 16 bits, for which sorting takes linear time."""
    order = np.argsort(keys.astype(np.uint16), kind="stable")
    top, shift = int(keys.max()) if len(keys) else 0, 16
    while top >> shift:
        order = order[np.argsort((keys >> shift).astype(np.uint16)[order], kind="stable")]
        shift += 16
    return order


class SuffixEncoder:
    """Ids of texts by suffix-array matching and relaxation."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        raws = sorted((k.encode() for k in pieces.ids), key=lambda r: (-len(r), r))  # the longest first
        self.ids = np.array([pieces.ids[r.decode()] for r in raws])
        self.lengths = np.array([len(r) for r in raws])
        self.width = int(self.lengths[0])
        # the first eight bytes as a number, with the least and the greatest that may follow
        self.low = np.array([int.from_bytes(r[:8].ljust(8, b"\0"), "big") for r in raws], np.uint64)
        self.high = np.array([int.from_bytes(r[:8].ljust(8, b"\xff"), "big") for r in raws], np.uint64)
        self.rest = np.frombuffer(b"".join(r[8:].ljust(max(0, self.width - 8), b"\0") for r in raws), np.uint8).reshape(len(raws), -1)
        # the first two and the last two bytes of each piece
        pair = lambda b: b[0] << 8 | b[1] if len(b) > 1 else b[0] << 8
        self.begins = np.array([pair(r) for r in raws])
        self.finishes = np.array([pair(r[-2:]) for r in raws])

    def suffixes(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of ``data`` in the order of the eight bytes that begin there, and these bytes as numbers."""
        n = len(data)
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        key = np.zeros(n, np.uint64)
        for k in range(8):
            key <<= np.uint64(8)
            key |= padded[k : k + n]
        order = np.argsort(key)
        return order, key[order]

    def edges(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and id of every occurrence of a piece, by end, the longest first."""
        order, table = self.suffixes(data)
        # pieces of which two neighbouring bytes don't occur need no search
        there = np.zeros(1 << 16, bool)
        there[data[:-1].astype(np.int64) << 8 | data[1:]] = True
        there[np.unique(data).astype(np.int64) << 8] = True
        some = np.flatnonzero(there[self.begins] & there[self.finishes])
        low, high = np.searchsorted(table, self.low[some]), np.searchsorted(table, self.high[some], "right")
        counts = high - low
        at = np.repeat(low - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        start, which = order[at], np.repeat(some, counts)
        size = self.lengths[which]
        # the ninth and further bytes of longer pieces, which come first
        n_long = int(np.searchsorted(-size, -8))
        if n_long:
            ok = start[:n_long] + size[:n_long] <= len(data)
            padded = np.concatenate([data, np.zeros(self.width, np.uint8)])
            for k in range(8, int(size[0])):
                m = int(np.searchsorted(-size[:n_long], -k))
                ok[:m] &= padded[start[:m] + k] == self.rest[which[:m], k - 8]
            keep = np.concatenate([np.flatnonzero(ok), np.arange(n_long, len(start))])
            start, which, size = start[keep], which[keep], size[keep]
        end = start + size
        by = by_digits(end)
        return start[by], end[by], self.ids[which[by]]

    def all_edges(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``edges``, with one for each byte of characters without a piece."""
        start, end, ids = self.edges(data)
        odd = np.flatnonzero(self.pieces.strange(data))
        if len(odd):
            start, end, ids = np.concatenate([start, odd]), np.concatenate([end, odd + 1]), np.concatenate([ids, BYTES - data[odd].astype(np.int64)])
            by = by_digits(end)  # a character without a piece is no part of one, so lengths stay in order
            start, end, ids = start[by], end[by], ids[by]
        return start, end, ids

    def gains(self, data: np.ndarray, start: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """What each edge adds to a score; the first byte of a character without a piece bears the penalty."""
        p = self.pieces
        return np.where(ids >= 0, p.score[np.maximum(ids, 0)], np.where((data[start] & 0xC0) != 0x80, p.unknown, 0.0))

    def short(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units that stand one after another in ``data``, and the number of each, relaxed side by side."""
        p = self.pieces
        unit = np.repeat(np.arange(len(size)), size)
        start, end, ids = self.all_edges(data)
        inside = unit[start] == unit[end - 1]
        start, end, ids = start[inside], end[inside], ids[inside]
        of = unit[start]
        depth = (end - begin[of]).astype(np.uint16)
        # a unit has one place more than bytes
        s, e = start + of, end + of
        last, before = np.full(len(data) + len(size), UNSEEN, np.int64), np.zeros(len(data) + len(size), np.int64)
        last[begin + np.arange(len(size))] = START
        by = np.argsort(depth, kind="stable")
        s, e, ids, depth = s[by], e[by], ids[by], depth[by]
        levels = np.searchsorted(depth, np.arange(1, int(size.max()) + 2))
        if p.unigram:
            gain, best = self.gains(data, start[by], ids), np.zeros(len(last))
        for a, b in zip(levels[:-1].tolist(), levels[1:].tolist(), strict=True):
            if a == b:
                continue
            s1, e1, t1 = s[a:b], e[a:b], ids[a:b]
            if p.unigram:
                open_ = np.flatnonzero(last[s1] != UNSEEN)
                s1, e1, t1 = s1[open_], e1[open_], t1[open_]
                value = best[s1] + gain[a:b][open_]
                heads = np.flatnonzero(np.diff(e1, prepend=-1))
                if not len(heads):
                    continue
                top = np.repeat(np.maximum.reduceat(value, heads), np.diff(heads, append=len(e1)))
                won = np.flatnonzero(value == top)
                won = won[np.diff(e1[won], prepend=-1) != 0]
                last[e1[won]], before[e1[won]], best[e1[won]] = t1[won], s1[won], value[won]
                continue
            left = np.arange(b - a)
            while len(left):
                # the longest that is left of each place
                head = np.diff(e1[left], prepend=-1) != 0
                now = left[head]
                state = last[s1[now]]
                good = np.flatnonzero(state != UNSEEN)
                good = good[p.fitting(state[good], t1[now[good]])]
                won = now[good]
                last[e1[won]], before[e1[won]] = t1[won], s1[won]
                left = left[~head]
                left = left[last[e1[left]] == UNSEEN]
        # from the ends back to the beginnings
        base = begin + np.arange(len(size))
        at, mine = base + size, np.arange(len(size))
        tokens, units = [], []
        while len(at):
            tokens.append(last[at])
            units.append(mine)
            at = before[at]
            more = at > base[mine]
            at, mine = at[more], mine[more]
        counts = np.zeros(len(size), np.int64)
        ends = np.cumsum(np.bincount(np.concatenate(units), minlength=len(size)))
        out = np.empty(int(ends[-1]), np.int64)
        for t, u in zip(tokens, units, strict=True):
            counts[u] += 1
            out[ends[u] - counts[u]] = t
        return self.named(out), counts

    def named(self, tokens: np.ndarray) -> np.ndarray:
        return np.where(tokens >= 0, tokens, self.pieces.byte_of[np.clip(BYTES - tokens, 0, 255)])

    def long(self, data: np.ndarray) -> np.ndarray:
        """Ids of one unit, relaxed window by window."""
        p, n = self.pieces, len(data)
        token, step = np.full(n + 1, UNSEEN, np.int32), np.zeros(n + 1, np.uint8)
        token[0] = START
        best = np.zeros(self.width + 1)
        for a in range(0, n, WINDOW):
            b, low = min(n, a + WINDOW), max(0, a - self.width)
            # a character that is cut at the window's edges is found with the neighbouring bytes
            part = data[low : min(n, b + 4)]
            start, end, ids = self.all_edges(part)
            mine = (end + low > a) & (end + low <= b)
            start, end, ids = start[mine], end[mine], ids[mine]
            last = token[low : b + 1].tolist()
            back = [0] * len(last)
            if p.unigram:
                score = [0.0] * len(last)
                score[: a - low + 1] = best[len(best) - (a - low + 1) :].tolist()
                for s, e, t, g in zip(start.tolist(), end.tolist(), ids.tolist(), self.gains(part, start, ids).tolist(), strict=True):
                    if last[s] != UNSEEN and (last[e] == UNSEEN or score[s] + g > score[e]):
                        last[e], back[e], score[e] = t, e - s, score[s] + g
                best = np.array(([0.0] * (self.width + 1) + score)[-(self.width + 1) :])
            else:
                known, size, fits = p.fits_known, p.size, p.fits
                for s, e, t in zip(start.tolist(), end.tolist(), ids.tolist(), strict=True):
                    if last[e] != UNSEEN:
                        continue
                    x = last[s]
                    if x == UNSEEN:
                        continue
                    if x >= 0 and t >= 0:
                        good = known.get(x * size + t)
                        if not good and (good is False or not fits(x, t)):
                            continue
                    last[e], back[e] = t, e - s
            token[a + 1 : b + 1] = last[a + 1 - low :]
            step[a + 1 : b + 1] = back[a + 1 - low :]
        # back from the end, a window's list at a time
        out: list[np.ndarray] = []
        at = n
        while at > 0:
            low = max(0, at - WINDOW)
            steps, found, here = step[low : at + 1].tolist(), [], at
            while here > low:
                found.append(here)
                here -= steps[here - low]
            out.append(token[np.array(found[::-1])])
            at = here
        return self.named(np.concatenate(out[::-1]).astype(np.int64)) if out else np.zeros(0, np.int64)

    def distinct(self, data: np.ndarray, units: Units) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the distinct units, and the number of each."""
        counts = np.zeros(len(units.size), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        small = np.flatnonzero(units.size <= LONG_UNIT)
        # the index takes some hundred bytes a byte
        size = units.size[small]
        for i, j in blocks(np.concatenate([[0], np.cumsum(size)]), 1 << 18):
            n = size[i:j]
            at = np.repeat(units.begin[small[i:j]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            ids, counts[small[i:j]] = self.short(data[at], np.cumsum(n) - n, n)
            parts.append((small[i:j], ids))
        for k in np.flatnonzero(units.size > LONG_UNIT).tolist():
            ids = self.long(data[units.begin[k] : units.begin[k] + units.size[k]])
            counts[k] = len(ids)
            parts.append((np.array([k]), ids))
        flat = np.empty(int(counts.sum()), np.int64)
        at = np.cumsum(counts) - counts
        for which, ids in parts:
            n = counts[which]
            flat[np.repeat(at[which] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        return flat, counts

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all ``prepared`` texts, and the number of each."""
        found, totals = [], np.zeros(len(offsets) - 1, np.int64)
        for a, b in segments(data):
            units = Units(data[a:b], offsets[(offsets > a) & (offsets < b)] - a)
            flat, counts = self.distinct(data[a:b], units)
            ids, n = spread_out(flat, counts, units.which)
            found.append(ids.astype(np.int32))
            np.add.at(totals, np.searchsorted(offsets, units.starts + a, "right") - 1, n)
        return (np.concatenate(found) if found else np.zeros(0, np.int32)), totals


class TrieCounter:
    """Numbers of pieces of units, from a trie whose nodes hold a prefix's state and count."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.counted: dict[bytes, int] = {}
        self.clear()

    def clear(self) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.last = [START]
        self.count = [0]
        self.best = [0.0]

    def step(self, word: str, depth: int, state) -> tuple[int, int, float]:
        """Last piece, number of pieces and score of the first ``depth`` characters; ``state(k)`` has those of the first k."""
        p, known = self.pieces, self.pieces.fits_known
        c = word[depth - 1]
        ids = p.ids
        if p.unigram:
            out = None
            for length in range(min(p.longest, depth), 0, -1):
                t = ids.get(word[depth - length : depth])
                if t is not None:
                    _, n, score = state(depth - length)
                    if out is None or score + p.score[t] > out[2]:
                        out = t, n + 1, score + p.score[t]
            if c not in ids:
                _, n, score = state(depth - 1)
                if out is None or score + p.unknown > out[2]:
                    out = START, n + len(c.encode()), score + p.unknown
            return out
        if c in ids:
            for length in range(min(p.longest, depth), 0, -1):
                t = ids.get(word[depth - length : depth])
                if t is not None:
                    a, n, _ = state(depth - length)
                    if a < 0:
                        return t, n + 1, 0.0
                    good = known.get(a * p.size + t)
                    if good or good is None and p.fits(a, t):
                        return t, n + 1, 0.0
        return START, state(depth - 1)[1] + len(c.encode()), 0.0

    def insert(self, word: str) -> int:
        """The number of pieces of ``word``; nodes it shares with earlier words are not computed again."""
        node, path, children = 0, [0], self.children
        last, count, best = self.last, self.count, self.best
        state = lambda k: (last[path[k]], count[path[k]], best[path[k]])
        for depth, c in enumerate(word, 1):
            nxt = children[node].get(c)
            if nxt is None:
                nxt = len(last)
                children[node][c] = nxt
                children.append({})
                t, n, score = self.step(word, depth, state)
                last.append(t)
                count.append(n)
                best.append(score)
            node = nxt
            path.append(node)
        return count[node]

    def long(self, data: np.ndarray) -> int:
        """The number of pieces of one long unit: only the states of its last few prefixes are held."""
        p, state = self.pieces, {0: (START, 0, 0.0)}
        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        tail, done = "", 0  # the text's characters from done - len(tail) on
        for at in range(0, len(data), WINDOW):
            new = decoder.decode(data[at : at + WINDOW].tobytes(), at + WINDOW >= len(data))
            word = tail + new
            shift = done - len(tail)
            for depth in range(len(tail) + 1, len(word) + 1):
                state[depth + shift] = self.step(word, depth, lambda k, shift=shift: state[k + shift])
                state.pop(depth + shift - p.longest - 1, None)
            done += len(new)
            tail = word[-p.longest :]
        return state[done][1]

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The number of pieces of each ``prepared`` text."""
        totals = np.zeros(len(offsets) - 1, np.int64)
        for a, b in segments(data):
            units = Units(data[a:b], offsets[(offsets > a) & (offsets < b)] - a)
            part = data[a:b]
            raw, n = part.tobytes(), np.zeros(len(units.size), np.int64)
            small = np.flatnonzero(units.size <= LONG_UNIT)
            words = [raw[p : p + m] for p, m in zip(units.begin[small].tolist(), units.size[small].tolist(), strict=True)]
            if len(self.counted) > TERMINALS:
                self.counted = {}
            found = list(map(self.counted.get, words))
            for k, word in enumerate(words):
                if found[k] is None:
                    if len(self.last) > NODES:
                        self.clear()
                    found[k] = self.insert(word.decode())
                    if len(word) <= 32:
                        self.counted[word] = found[k]
            n[small] = found
            for k in np.flatnonzero(units.size > LONG_UNIT).tolist():
                n[k] = self.long(part[units.begin[k] : units.begin[k] + units.size[k]])
            np.add.at(totals, np.searchsorted(offsets, units.starts + a, "right") - 1, n[units.which])
        return totals


def kept_in_worker(kind: type, model: bytes):
    """One instance of ``kind`` for this vocabulary in this Python worker, kept from task to task."""
    kept = sys.modules.setdefault("_plexgrid_kept", types.ModuleType("_plexgrid_kept"))
    name = f"pieces_{kind.__name__}"
    if getattr(kept, name, (None,))[0] != model:
        setattr(kept, name, (model, kind(Pieces(model))))
    return getattr(kept, name)[1]


def _slim(documents: DataFrame) -> tuple[DataFrame, str]:
    kind = small_batches(documents).schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), kind


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and 64-bit offsets of a string column without nulls."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def encode_decode(documents: DataFrame, model_path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, n_ids, ids_crc32, decoded_ok[, ids, decoded]) of every row of ``documents``.

    ``ids_crc32`` is of the ids as little-endian unsigned 32-bit integers;
    ``decoded`` is the text decoded from the ids, ``decoded_ok`` whether it is the
    text again (the mark U+2581 counts as a space). Null texts are empty: no ids.
    """
    model = open(model_path, "rb").read()
    slim, kind = _slim(documents)
    cast = documents.sparkSession.sparkContext.broadcast(model)
    schema = f"doc_id {kind}, n_ids long, ids_crc32 long, decoded_ok boolean" + (", ids array<int>, decoded string" if with_ids else "")

    def run(batches):
        tool = kept_in_worker(SuffixEncoder, cast.value)
        for b in batches:
            texts, ends = string_buffers(b["text"])
            for i, j in blocks(ends, SEGMENT):
                data, offsets = prepared(texts, ends[i : j + 1])
                ids, n = tool.encode(data, offsets)
                at = np.concatenate([[0], np.cumsum(n)])
                decoded = []
                for k in range(j - i):
                    parts = [tool.pieces.decoded(ids[x : min(x + WINDOW, at[k + 1])])[0].tobytes() for x in range(int(at[k]), int(at[k + 1]), WINDOW)]
                    decoded.append(b"".join(parts)[1:])
                ok = [d == data[p + 1 : q].tobytes() for d, p, q in zip(decoded, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                crc = [zlib.crc32(ids[p:q]) for p, q in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                columns = [b["doc_id"].slice(i, j - i), pa.array(n), pa.array(crc, pa.int64()), pa.array(ok, pa.bool_())]
                names = ["doc_id", "n_ids", "ids_crc32", "decoded_ok"]
                if with_ids:
                    columns += [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids)), pa.array([d.decode("utf-8", "replace") for d in decoded], pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return slim.mapInArrow(run, schema)


def token_counts(documents: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, n_tokens) of every row of ``documents``; null and empty texts have none."""
    model = open(model_path, "rb").read()
    slim, kind = _slim(documents)
    cast = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        tool = kept_in_worker(TrieCounter, cast.value)
        for b in batches:
            texts, ends = string_buffers(b["text"])
            for i, j in blocks(ends, SEGMENT):
                yield pa.RecordBatch.from_arrays([b["doc_id"].slice(i, j - i), pa.array(tool.counts(*prepared(texts, ends[i : j + 1])))], ["doc_id", "n_tokens"])

    return slim.mapInArrow(run, f"doc_id {kind}, n_tokens long")
