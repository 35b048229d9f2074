"""Embedding near-dedup with randomised-rotation binary codes.

A unit vector, padded with zeros, is turned by two independent random
rotations and kept as sign bits, with one correction factor for each rotation
(the inner product of the vector and its code). The code of one vector under
the first rotation and that of the other under the second give an unbiased
estimate of their inner product; its confidence bound decides which pairs are
computed exactly, in double precision.

Candidates come from tables of further random rotations: the largest component
of a turned vector, with its sign, is one letter, and a few of them are a
vector's key in a table. The number of letters follows the logarithm of the
number of vectors, so that keys of unlike vectors seldom meet, and the number of
tables follows from the chance to miss a pair at the threshold, with the chance
that two vectors at the threshold share a letter measured on random pairs. Only
keys that occur twice take the codes along. A pair is counted in the first table
that it shares a key in, so no pairs have to be shuffled to be told apart.
Vectors of one key are dealt out in tiles.

Vectors are compared with those of the same length.
"""

from __future__ import annotations

import math
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.storage import Scratch
from .common import connected_components, mix64, of_ids, whole_groups

TILE = 512
#: Standard errors by which an estimate may fall short before a pair is dropped.
BOUND = 5.0
#: Components that a letter looks at: a letter is a byte.
WIDEST = 128
#: Bits of a rotation's code at least; shorter vectors are padded.
LEAST_BITS = 128
#: Keys that a table has for each vector.
SPARE = 8
#: Tables beyond which no letter is added.
MOST_TABLES = 128


def agreement(dim: int, width: int, threshold: float, pairs: int = 4000) -> float:
    """The chance, less two standard errors, that two vectors at the threshold share a letter of ``width`` components; measured on random pairs."""
    rng = np.random.default_rng(29)
    deep = min(dim, WIDEST)
    a, b = rng.standard_normal((2, pairs, deep))
    if dim <= WIDEST:
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        b -= (a * b).sum(1, keepdims=True) * a
        b /= np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-300)
    b = threshold * a + math.sqrt(max(0.0, 1 - threshold**2)) * b
    p = float((letters_of(a[:, :width]) == letters_of(b[:, :width])).mean())
    return min(max(p - 2 * math.sqrt(p * (1 - p) / pairs), 0.05), 0.999)


def letters_of(turned: np.ndarray) -> np.ndarray:
    """The largest component along the last axis, by size, with its sign, as a byte."""
    at = np.abs(turned).argmax(-1)
    return (2 * at + (np.take_along_axis(turned, at[..., None], -1)[..., 0] > 0)).astype(np.uint8)


class Codes:
    """Two rotations for codes and ``tables`` times ``letters`` for keys, for vectors of ``dim`` components."""

    def __init__(self, dim: int, rows: int, threshold: float, miss: float, seed: int = 3):
        self.dim, self.threshold = dim, threshold
        full = min(dim, WIDEST)
        self.widths, share, keys = [], 1.0, 1  # components that each letter looks at
        while keys < SPARE * rows:
            width = min(full, max(1, 1 << math.ceil(math.log2(SPARE * rows / keys / 2))))
            more = share * agreement(dim, width, threshold)
            if self.widths and math.log(miss) / math.log1p(-more) > MOST_TABLES:
                break
            self.widths.append(width)
            share, keys = more, keys * 2 * width
        self.widths = self.widths or [full]
        self.letters = len(self.widths)
        self.tables = math.ceil(math.log(miss) / math.log1p(-share))
        self.half = max(LEAST_BITS, -(-dim // 8) * 8)
        rng = np.random.default_rng(seed)
        # the first dim columns of a random rotation of `half` components: all that padded vectors meet
        self.turn = [np.linalg.qr(rng.standard_normal((self.half, dim)))[0].astype(np.float32) for _ in range(2)]
        self.spin = [np.linalg.qr(rng.standard_normal((dim, w)))[0].astype(np.float32) for _ in range(self.tables) for w in self.widths]

    def of(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Packed sign bits of both rotations and the correction factors."""
        turned = [unit.astype(np.float32) @ t.T for t in self.turn]
        factors = np.stack([np.abs(x).sum(1) / math.sqrt(self.half) for x in turned], 1)
        return np.packbits(np.concatenate([x > 0 for x in turned], 1), axis=1), factors.astype(np.float32)

    def marks(self, unit: np.ndarray) -> np.ndarray:
        """(vector, table, letter)."""
        x = unit.astype(np.float32)
        return np.stack([letters_of(x @ t) for t in self.spin], 1).reshape(len(x), self.tables, self.letters)

    def keys(self, marks: np.ndarray) -> np.ndarray:
        """(vector, table) hashes of the letters, the table and the vectors' length."""
        v = np.broadcast_to(np.arange(1, self.tables + 1, dtype=np.uint64) + (np.uint64(self.dim) << np.uint64(20)), marks.shape[:2]).copy()
        for k in range(self.letters):
            v = mix64(v * np.uint64(0x10001) + marks[:, :, k])
        return v.view(np.int64)

    def rebuilt(self, codes: np.ndarray, factors: np.ndarray) -> list[np.ndarray]:
        """Vectors rebuilt from each rotation's code, unbiased along the vector itself."""
        signs = np.unpackbits(codes, axis=1).astype(np.float32) * 2 - 1
        parts = signs[:, : self.half], signs[:, self.half : 2 * self.half]
        return [p @ t / (math.sqrt(self.half) * factors[:, k : k + 1]) for k, (p, t) in enumerate(zip(parts, self.turn, strict=True))]

    def spread(self, factors: np.ndarray) -> np.ndarray:
        """Standard error of an estimate that a vector brings in, from its factors."""
        return np.sqrt(np.maximum(1 / factors.astype(np.float64) ** 2 - 1, 0).sum(1) / 4 / (self.half - 1))

    def plausible(self, a, b, spread_a, spread_b) -> np.ndarray:
        """Pairs of rows whose estimate plus its bound reaches the threshold."""
        estimate = (a[0] @ b[1].T + a[1] @ b[0].T) / 2
        return estimate + BOUND * np.hypot(spread_a[:, None], spread_b[None, :]) >= self.threshold


def numbers_of(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat doubles (NaN for null) and offsets of a column of lists; a null list is empty."""
    offsets = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
    return lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False), offsets


def near_vectors(embeddings: DataFrame, threshold: float = 0.9, miss: float = 1e-4) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``embeddings`` (vec_id, embedding, ...).

    ``miss`` is the chance that a pair exactly at the threshold shares no key;
    it falls fast above. Vectors of different lengths don't link. Vectors that
    are null, empty, zero, or hold null or non-finite components link with
    nothing. Rows with a null id are kept and link with nothing; a repeated id is
    one vector (of its vectors, the one with the smallest digest). Vectors equal
    up to a factor of a power of two are linked without comparing them.
    """
    slim = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    rows = slim.count()

    def parts(b, tools):
        """Usable vectors of a batch by length: (tool, their rows, scaled vectors, digests)."""
        flat, offsets = numbers_of(b["embedding"])
        sizes = np.diff(offsets)
        known = b["vec_id"].is_valid().to_numpy(zero_copy_only=False)
        for dim in np.unique(sizes[known & (sizes > 0)]).tolist():
            at = np.flatnonzero(known & (sizes == dim))
            x = flat[offsets[at][:, None] + np.arange(dim)]
            largest = np.abs(x).max(1)
            good = np.isfinite(largest) & (largest > 0)
            if good.any():
                at, x = at[good], x[good]
                # scaled by a power of two, which is exact, so that huge and tiny vectors stay finite; 0.0 for -0.0
                x = np.ldexp(x, -np.frexp(largest[good])[1][:, None]) + 0.0
                d = np.frombuffer(b"".join(blake2b(r.tobytes(), digest_size=16).digest() for r in x), np.int64).reshape(-1, 2)
                if tools is not None and dim not in tools:
                    tools[dim] = Codes(dim, rows, threshold, miss)
                yield tools and tools[dim], at, x, d

    def digest(batches):
        for b in batches:
            for _, at, _, d in parts(b, None):
                yield pa.RecordBatch.from_arrays([b["vec_id"].take(pa.array(at)), pa.array(d[:, 0]), pa.array(d[:, 1])], ["vec_id", "d1", "d2"])

    def sketch(batches):
        tools: dict[int, Codes] = {}
        for b in batches:
            for tool, at, x, d in parts(b, tools):
                unit = x / np.linalg.norm(x, axis=1, keepdims=True)
                codes, factors = tool.of(unit)
                marks = tool.marks(unit)
                keys = tool.keys(marks)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, tool.tables, dtype=np.int32)), pa.array(keys.ravel()))
                columns = [b["vec_id"].take(pa.array(at)), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(np.full(len(at), tool.dim, np.int32))]
                columns += [pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(factors[:, 0]), pa.array(factors[:, 1]), lists]
                columns.append(pa.array([m.tobytes() for m in marks], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, ["rep", "d1", "d2", "dim", "code", "f0", "f1", "keys", "marks"])

    with Scratch(embeddings.sparkSession, "embeddings") as tmp:
        every = tmp.written(slim.mapInArrow(digest, "vec_id long, d1 long, d2 long"), "digests")
        # ids that repeat are one vector; equal vectors are one, with the smallest of their ids
        one = every.groupBy("vec_id").agg(F.min(F.struct("d1", "d2")).alias("d"), F.count("*").alias("n")).select("vec_id", "d.d1", "d.d2", "n")
        one = tmp.written(one, "ids")
        groups = tmp.written(one.groupBy("d1", "d2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "groups")
        reps = of_ids(slim, groups.select(F.col("rep").alias("vec_id")), "vec_id")
        once = reps.mapInArrow(sketch, "rep long, d1 long, d2 long, dim int, code binary, f0 float, f1 float, keys array<long>, marks binary")
        if not one.where("n > 1").isEmpty():
            once = once.join(groups.select("rep", "d1", "d2"), ["rep", "d1", "d2"], "left_semi").dropDuplicates(["rep"])
        once = tmp.written(once, "sketch")
        entries = tmp.written(once.select("rep", F.posexplode("keys").alias("table", "key")), "keys")
        sizes = tmp.written(entries.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
        shared = tmp.written(entries.join(sizes, "key"), "shared")
        ids = tmp.written(shared.select("rep").distinct(), "members")
        codes = of_ids(once, ids, "rep").select("rep", "dim", "code", "f0", "f1", "marks", (F.octet_length("marks") / F.size("keys")).cast("int").alias("letters"))
        codes = tmp.written(codes.join(groups.select("rep", "copies"), "rep"), "codes")
        t = F.ceil(F.col("size") / TILE).cast("int")
        jobs = shared.withColumn("own", F.pmod(F.xxhash64("rep"), t).cast("int")).join(codes, "rep")
        jobs = jobs.withColumn("other", F.explode(F.sequence(F.lit(0), t - 1)))
        jobs = jobs.withColumns({"ta": F.least("own", "other"), "tb": F.greatest("own", "other")})
        # of the letters, those of earlier tables, which tell whose pair a pair is
        jobs = jobs.withColumn("marks", F.expr("substring(marks, 1, table * letters)"))
        jobs = jobs.select("key", "ta", "tb", "own", "rep", "dim", "code", "f0", "f1", "marks", "copies").repartition("key", "ta", "tb").sortWithinPartitions("key", "ta", "tb")

        def tiles(batches, least):
            """Codes of one length for each tile: (tool, rows of the table, numbers)."""
            tools: dict[int, Codes] = {}
            for table, first in whole_groups(batches, ["key", "ta", "tb"], least):
                dims = table["dim"].to_numpy()
                for dim in np.unique(dims).tolist():
                    if dim not in tools:
                        tools[dim] = Codes(dim, rows, threshold, miss)
                    part = np.flatnonzero(dims == dim)
                    if len(part) < len(dims):
                        mine = table.take(pa.array(part)).combine_chunks()
                        own_first = np.unique(np.searchsorted(part, first[np.isin(first, part)]))
                    else:
                        mine, own_first = table, first
                    tool = tools[dim]
                    code = np.frombuffer(b"".join(mine["code"].to_pylist()), np.uint8).reshape(mine.num_rows, -1)
                    factors = np.stack([mine["f0"].to_numpy(), mine["f1"].to_numpy()], 1)
                    key, ta, tb, own = (mine[c].to_numpy() for c in ("key", "ta", "tb", "own"))
                    yield tool, mine, own_first, (tool.rebuilt(code, factors), tool.spread(factors), mine["marks"].to_pylist(), ta, tb, own)

        def near_pairs(tool, numbers, s):
            """Plausible pairs of a tile that are its to count: those that share no key in an earlier table."""
            both, spread, marks, ta, tb, own = numbers
            n = s.stop - s.start
            pairs = tool.plausible([x[s] for x in both], [x[s] for x in both], spread[s], spread[s])
            pairs &= np.triu(np.ones((n, n), bool), 1)
            if ta[s.start] != tb[s.start]:
                pairs &= own[s][:, None] != own[s][None, :]
            if pairs.any():
                earlier = np.frombuffer(b"".join(marks[s]), np.uint8).reshape(n, -1, tool.letters)
                words = np.zeros(earlier.shape[:2], np.uint64)
                for k in range(tool.letters):
                    words = words << np.uint64(8) | earlier[:, :, k] if tool.letters <= 8 else mix64(words + earlier[:, :, k])
                for r in range(words.shape[1]):
                    pairs &= words[:, r][:, None] != words[:, r][None, :]
                    if not pairs.any():
                        break
            return pairs

        def pick(batches):
            """The vectors of each tile that take part in a plausible pair."""
            for tool, table, first, numbers in tiles(batches, 4096):
                keep = np.zeros(table.num_rows, bool)
                for a, b in zip(first.tolist(), [*first[1:].tolist(), table.num_rows], strict=True):
                    if b - a > 1:
                        near = near_pairs(tool, numbers, slice(a, b))
                        keep[a:b] = near.any(0) | near.any(1)
                if keep.any():
                    yield from table.filter(pa.array(keep)).combine_chunks().to_batches()

        picked = tmp.written(jobs.mapInArrow(pick, jobs.schema), "picked")
        wanted = tmp.written(picked.select(F.col("rep").alias("vec_id")).distinct(), "wanted")
        def count(batches):
            """Exact cosines of the plausible pairs: link counts of each vector, and links that join components."""
            for tool, table, first, numbers in tiles(batches, 2048):
                x, offsets = numbers_of(table["x"].combine_chunks())
                x = x[offsets[:-1][:, None] + np.arange(tool.dim)]
                x = np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                rep, copies = table["rep"].to_numpy(), table["copies"].to_numpy()
                us, vs, ns = [], [], []
                for a, b in zip(first.tolist(), [*first[1:].tolist(), table.num_rows], strict=True):
                    s = slice(a, b)
                    near = near_pairs(tool, numbers, s)
                    near &= x[s] @ x[s].T >= threshold
                    if not near.any():
                        continue
                    either = near | near.T
                    us.append(rep[s])
                    ns.append(either @ copies[s])
                    # the smallest linked vector, then whatever its link doesn't reach: a forest of the tile
                    root = np.arange(b - a)
                    while True:
                        low = np.where(either, root[None, :], b - a).min(1)
                        new = np.minimum(root, low)
                        new = new[new]
                        if (new == root).all():
                            break
                        root = new
                    vs.append(rep[s][root])
                if us:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z)) for z in (us, vs, ns)], ["u", "v", "n"])

        vectors = of_ids(slim, wanted, "vec_id").where("embedding IS NOT NULL").withColumnRenamed("embedding", "x")
        if not one.where("n > 1").isEmpty():  # of a repeated id, the vector whose digest was taken

            def digests(batches):
                for b in batches:
                    for _, at, _, d in parts(b.rename_columns(["vec_id", "embedding"]), None):
                        rows_at = pa.array(at)
                        yield pa.RecordBatch.from_arrays([b["vec_id"].take(rows_at), b["x"].take(rows_at), pa.array(d[:, 0]), pa.array(d[:, 1])], ["vec_id", "x", "d1", "d2"])

            kind = embeddings.schema["embedding"].dataType.simpleString()
            vectors = vectors.mapInArrow(digests, f"vec_id long, x {kind}, d1 long, d2 long")
            vectors = vectors.join(one.select("vec_id", "d1", "d2"), ["vec_id", "d1", "d2"], "left_semi").select("vec_id", "x").dropDuplicates(["vec_id"])
        vectors = vectors.withColumnRenamed("vec_id", "rep")
        exact = picked.join(vectors, "rep").repartition("key", "ta", "tb").sortWithinPartitions("key", "ta", "tb", "rep")
        found = tmp.written(exact.mapInArrow(count, "u long, v long, n long"), "links")
        components = connected_components(found.select("u", "v"), tmp).withColumnRenamed("node", "rep")
        links = found.groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("n"))
        result = tmp.written(groups.join(links, "rep", "left").join(components, "rep", "left"), "result")
        tmp.keep(one, result)
        members = one.drop("n").join(result, ["d1", "d2"])
        out = slim.select("vec_id").join(members, "vec_id", "left")
        component = F.coalesce("component", "rep", "vec_id")
        return out.select(
            "vec_id",
            (F.coalesce("n", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).cast("long").alias("n_links"),
            component.alias("component_id"),
            F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
        )
