"""MinHash near-dedup: circulant MinHash, banding, exact Jaccard verification.

Two permutations make all coordinates of a signature: the first places each
shingle in a universe of 2^32, the second, shifted circularly by k, gives
coordinate k. Documents that agree on all rows of a band meet in a bucket.

Equal word sequences are collapsed first, so a group of copies counts once.
Every bucket's members are compared with its smallest member. Buckets whose
members still belong to different components then have their remaining pairs
looked at in tiles of bounded size; each pair that the signatures don't exclude
is verified on the full sets of words. Components come from verified links.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.storage import Scratch
from .common import blocks, byte_classes, connected_components, of_ids, shingle_hashes, sliced, small_batches, texts_of, whole_groups, word_hashes

ROWS, BANDS = 6, 32
TILE = 512
SPACES = byte_classes(b"\x20\x09\x0a\x0b\x0c\x0d")


def signatures(shingles: np.ndarray, offsets: np.ndarray, size: int = ROWS * BANDS) -> np.ndarray:
    """(document, coordinate) as 32-bit minima; documents without shingles get the largest value."""
    out = np.full((len(offsets) - 1, size), 0xFFFFFFFF, np.uint32)
    some = np.flatnonzero(np.diff(offsets))
    if not len(some):
        return out
    starts = offsets[some]
    place = (shingles >> np.uint64(32)).astype(np.uint32)  # the first permutation
    x, y = np.empty_like(place), np.empty_like(place)
    minima = np.empty((size, len(some)), np.uint32)
    for k in range(size):
        np.add(place, np.uint32(k * 0x01000193 & 0xFFFFFFFF), out=x)  # circular shift
        np.right_shift(x, 16, out=y)  # the second permutation
        np.bitwise_xor(x, y, out=x)
        np.multiply(x, np.uint32(0x7FEB352D), out=x)
        np.right_shift(x, 15, out=y)
        np.bitwise_xor(x, y, out=x)
        np.multiply(x, np.uint32(0x846CA68B), out=x)
        np.minimum.reduceat(x, starts, out=minima[k])
    out[some] = minima.T
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """(document, band) keys of 64 bits, different for different bands."""
    s = signature.reshape(len(signature), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), s.shape[:2]).copy()
    for r in range(ROWS):
        key = (key ^ s[:, :, r]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def normal_words(text: bytes) -> list[bytes]:
    """Words between the ASCII spaces, A-Z in lower case."""
    return text.lower().split()


def sketch(documents: DataFrame, n: int) -> DataFrame:
    """(doc_id, n_shingles, d1, d2, bands, low): set size, digest of the word sequence, band keys, low bytes of the signature."""

    def run(batches):
        for b in batches:
            data, offsets = texts_of(b["text"])
            sizes, digests, bands, low = [], [], [], []
            for i, j in blocks(offsets, 1 << 19):
                shingles, at = shingle_hashes(*word_hashes(data, offsets[i : j + 1], SPACES), n)
                s = signatures(shingles, at)
                bands.append(band_keys(s))
                low.append((s & 0xFF).astype(np.uint8))
                sizes += [len(np.unique(shingles[p:q])) for p, q in zip(at[:-1], at[1:], strict=True)]
            for p, q in zip(offsets[:-1], offsets[1:], strict=True):
                digests.append(blake2b(b" ".join(normal_words(data[p:q].tobytes())), digest_size=16).digest())
            d = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2) if digests else np.zeros((0, 2), np.int64)
            keys = np.concatenate(bands) if bands else np.zeros((0, BANDS), np.int64)
            lows = np.concatenate(low) if low else np.zeros((0, ROWS * BANDS), np.uint8)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys.ravel()))
            binary = pa.array([r.tobytes() for r in lows], pa.binary())
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(sizes, pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1]), lists, binary], ["doc_id", "n_shingles", "d1", "d2", "bands", "low"])

    return documents.mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>, low binary")


def packed(documents: DataFrame) -> DataFrame:
    """(id, words): the normal words of each document, compressed; they travel to wherever a pair is verified."""

    def run(batches):
        tool = zstandard.ZstdCompressor(level=1)
        for b in sliced(batches):
            data, offsets = texts_of(b["text"])
            out = [tool.compress(b" ".join(normal_words(data[p:q].tobytes()))) for p, q in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(out, pa.binary())], ["id", "words"])

    return documents.mapInArrow(run, "id long, words binary")


def shingle_set(words: bytes, n: int) -> set:
    w = words.split()
    if len(w) < n:
        return {tuple(w)} if w else set()
    return set(zip(*(w[k:] for k in range(n)), strict=False))


def verified(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (u, v) whose full shingle sets are similar enough."""
    both = pairs.join(texts.selectExpr("id AS v", "words AS words_v"), "v").join(texts.selectExpr("id AS u", "words AS words_u"), "u")

    def run(batches):
        tool = zstandard.ZstdDecompressor()
        last, own = None, set()
        for b in sliced(batches):
            u, v = b["u"].to_pylist(), b["v"].to_pylist()
            keep = np.zeros(len(u), bool)
            for k, (x, y) in enumerate(zip(b["words_u"], b["words_v"], strict=True)):
                if u[k] != last:
                    last, own = u[k], shingle_set(tool.decompress(x.as_buffer()), n)
                other = shingle_set(tool.decompress(y.as_buffer()), n)
                same = len(own & other)
                keep[k] = same > 0 and 100 * same >= percent * (len(own) + len(other) - same)
            yield pa.RecordBatch.from_arrays([b["u"], b["v"]], ["u", "v"]).filter(pa.array(keep))

    return both.select("u", "v", "words_u", "words_v").mapInArrow(run, "u long, v long")


def open_buckets(entries: DataFrame) -> DataFrame:
    """(key, largest, tm, to): buckets whose members are of several components, their largest one, and tiles of it and of the others."""
    each = entries.groupBy("key", "component").agg(F.count("*").alias("n"))
    whole = each.groupBy("key").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("size"), F.count("*").alias("parts")).where("parts > 1")
    count = lambda c: F.ceil(c / TILE).cast("int")
    return whole.select("key", F.col("top.component").alias("largest"), count(F.col("top.n")).alias("tm"), count(F.col("size") - F.col("top.n")).alias("to"))


def tiles(entries: DataFrame) -> DataFrame:
    """Rows of open buckets, repeated so that every pair that matters meets in one (key, ta, tb) of bounded size.

    What matters are pairs with a member outside the bucket's largest component:
    tiles of that component meet each tile of the others (ta >= 0), and the
    others' tiles meet each other (ta < 0). ``entries``: key, doc_id, component,
    largest, tm, to, ...
    """
    e = entries.withColumn("main", F.col("component") == F.col("largest"))
    e = e.withColumn("own", F.pmod(F.xxhash64("doc_id"), F.when(F.col("main"), F.col("tm")).otherwise(F.col("to"))).cast("int"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    at = lambda a, b: F.struct(a.cast("int").alias("ta"), b.cast("int").alias("tb"))
    own = F.col("own")
    with_others = F.transform(upto(F.col("to")), lambda j: at(own, j))
    with_main = F.transform(upto(F.col("tm")), lambda i: at(i, own))
    among = F.transform(upto(F.col("to")), lambda j: at(-1 - F.least(own, j), F.greatest(own, j)))
    e = e.withColumn("_t", F.explode(F.when(F.col("main"), with_others).otherwise(F.concat(with_main, among))))
    e = e.withColumns({"ta": F.col("_t.ta"), "tb": F.col("_t.tb")}).drop("_t", "tm", "to", "largest")
    return e.repartition("key", "ta", "tb").sortWithinPartitions("key", "ta", "tb")


def cross_pairs(entries: DataFrame, n: int, percent: int, best: bool) -> DataFrame:
    """Pairs (u, v) of one bucket and different components that may well be similar.

    ``entries``: as for ``tiles``, with n_shingles, low, and without ``best``
    also bands and words. A pair is left out if its sizes exclude it or
    its estimate is more than five standard errors below the threshold. With
    ``best``, each document gets only its likeliest partner in each tile, which
    joins most components. Else every pair is looked at in the first bucket that
    it shares, and only those whose hashed shingle sets are similar come out.
    """
    at_least = percent / 100 - 5 * np.sqrt(percent / 100 * (1 - percent / 100) / (ROWS * BANDS))
    columns = ["key", "ta", "tb", "own", "main", "doc_id", "component", "n_shingles", "low"] + ([] if best else ["bands", "words"])

    def hashed_sets(words):
        tool = zstandard.ZstdDecompressor()
        texts = [tool.decompress(w.as_buffer()) for w in words]
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        shingles, at = shingle_hashes(*word_hashes(np.frombuffer(b"".join(texts), np.uint8), offsets, SPACES), n)
        return [np.unique(shingles[p:q]) for p, q in zip(at[:-1], at[1:], strict=True)]

    def similar(sets, i, others):
        own = sets[i]
        counts = np.array([len(sets[j]) for j in others])
        joined = np.concatenate([sets[j] for j in others])
        found = own[np.minimum(np.searchsorted(own, joined), len(own) - 1)] == joined
        same = np.add.reduceat(found.astype(np.int64), np.cumsum(counts) - counts)
        return others[100 * same >= percent * (len(own) + counts - same)]

    def run(batches):
        for table, first in whole_groups(batches, ["key", "ta", "tb"], 2048):
            ids, comps, sizes = (table[c].to_numpy() for c in ("doc_id", "component", "n_shingles"))
            key, own, ta, tb, main = (table[c].to_numpy() for c in ("key", "own", "ta", "tb", "main"))
            low = np.frombuffer(b"".join(table["low"].to_pylist()), np.uint8).reshape(len(ids), -1)
            bands = None if best else table["bands"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
            us, vs = [], []
            for a, b in zip(first, [*first[1:], len(ids)], strict=True):
                sets = None
                band = 0 if best else int(np.flatnonzero(bands[a] == key[a])[0])
                o = slice(a, b)
                for i in np.flatnonzero(~main[o]) + a:
                    ok = (comps[o] != comps[i]) & (100 * np.minimum(sizes[o], sizes[i]) >= percent * np.maximum(sizes[o], sizes[i]))
                    if ta[a] >= 0:
                        ok &= main[o]
                    else:
                        if -1 - ta[a] != tb[a]:
                            ok &= own[o] != own[i]
                        if not best:  # once for both
                            ok[: i - a] = False
                    if band:
                        ok &= (bands[o, :band] != bands[i, :band]).all(1)
                    at = np.flatnonzero(ok) + o.start
                    if not len(at):
                        continue
                    share = ((low[at] == low[i]).mean(1) - 1 / 256) / (1 - 1 / 256)
                    at, share = at[share >= at_least], share[share >= at_least]
                    if best:
                        at = at[[share.argmax()]] if len(at) else at
                    elif len(at):
                        sets = sets or hashed_sets(table["words"].slice(a, b - a))
                        at = similar(sets, i - a, at - a) + a
                    us.append(np.minimum(ids[at], ids[i]))
                    vs.append(np.maximum(ids[at], ids[i]))
            if us:
                once = np.unique(np.stack([np.concatenate(us), np.concatenate(vs)], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(once[:, 0]), pa.array(once[:, 1])], ["u", "v"])

    return tiles(entries).select(columns).mapInArrow(run, "u long, v long").distinct()


def near_duplicates(documents: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``documents`` (doc_id, text, ...).

    Null and empty texts and texts without a word have no shingles and link
    with nothing; rows with a null id are their own component and kept. Ids are
    meant to be unique; rows that repeat both id and text get the same result.
    Other columns are not looked at.
    """
    slim = small_batches(documents).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with Scratch(documents.sparkSession, "minhash") as tmp:
        every = tmp.written(sketch(slim, n), "sketch")
        linked = every.where("doc_id IS NOT NULL AND n_shingles > 0")
        copies = tmp.written(linked.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep")), "copies")
        # joined by id too, so the copies of one text don't meet in a task
        once = linked.join(copies.withColumnRenamed("rep", "doc_id"), ["doc_id", "d1", "d2"]).dropDuplicates(["doc_id", "d1", "d2"])
        entries = tmp.written(once.select("doc_id", "n_shingles", F.explode("bands").alias("key")), "entries")
        heads = entries.groupBy("key").agg(F.min("doc_id").alias("u"), F.min_by("n_shingles", "doc_id").alias("nu"), F.count("*").alias("size")).where("size > 1")
        heads = tmp.written(heads, "heads")
        fits = f"100 * least(nu, n_shingles) >= {percent} * greatest(nu, n_shingles)"
        pairs = entries.join(heads, "key").where(f"doc_id <> u AND {fits}").select("u", F.col("doc_id").alias("v")).distinct()

        def links_of(pairs: DataFrame) -> DataFrame:
            """The pairs (a written table) that are similar; only documents of pairs are read again."""
            ids = tmp.written(pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct(), "ids")
            texts = tmp.written(packed(of_ids(slim, ids)), "texts")
            out = tmp.written(verified(pairs, texts, n, percent), "links")
            tmp.drop(texts)
            return out

        links = links_of(tmp.written(pairs, "pairs"))
        found = connected_components(links, tmp)
        # buckets of three or more whose members are still of several components:
        # likeliest partners first, which join most, then all pairs that are left
        buckets = tmp.written(entries.join(heads.where("size > 2").select("key"), "key"), "buckets")
        tmp.drop(entries)
        tmp.drop(heads)
        for best in (True, False):
            label = buckets.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
            label = tmp.written(label, "labelled")
            keys = tmp.written(open_buckets(label), "open")
            if keys.isEmpty():
                break
            rows = tmp.written(label.join(keys, "key"), "rows")
            tmp.drop(label)
            ids = tmp.written(rows.select("doc_id").distinct(), "ids")
            marks = of_ids(once.select("doc_id", "low", *([] if best else ["bands"])), ids)
            rows = rows.join(marks, "doc_id")
            if not best:
                rows = rows.join(packed(of_ids(slim, ids)).withColumnRenamed("id", "doc_id"), "doc_id")
            new = links_of(tmp.written(cross_pairs(rows, n, percent, best), "more"))
            if not new.isEmpty():
                links = links.unionByName(new)
                found = connected_components(links, tmp)
        # one row a text first, so that a text with very many copies is a skewed join of two written tables
        result = copies.join(found.withColumnRenamed("node", "rep"), "rep", "left")
        result = tmp.written(result.select("d1", "d2", F.coalesce("component", "rep").alias("component")), "result")
        tmp.keep(every, result)
        out = every.select("doc_id", "n_shingles", "d1", "d2").join(result, ["d1", "d2"], "left")
        component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
        out = out.select("doc_id", "n_shingles", component.alias("component_id"))
        return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
