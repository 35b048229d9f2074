"""Line dedup with content-defined chunks of lines.

A rolling hash over the hashes of the last two lines decides after which lines
a chunk ends, so the same run of lines is cut alike wherever it stands. A line
of ``LONG`` words or more is a chunk of its own, since it is a passage by
itself, and a document of several lines is one chunk besides, so that copies go
as a whole. So that a passage goes whatever its lines and surroundings are, the
shortest runs of ``LONG`` words from each line on and up to each line are chunks
too: every line of a repeated run of ``LONG`` words or more, from its first line
with words to its last, lies in such a chunk that doesn't reach beyond the run.
A chunk between boundaries counts if it has several lines with words, however
short they are. Chunks whose hash occurs more than once in the corpus are
candidates. A candidate is removed if its bytes equal those of the first
occurrence, by (doc_id, place); the first occurrence stays.
"""

from __future__ import annotations

import zlib
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StringType, StructField, StructType

from ..operators.storage import Scratch
from .common import sliced, small_batches, texts_of

#: Words of a line that is a passage by itself, and of the shortest runs of lines.
LONG = 25
WHOLE = -1


def chunks_of(lines: list[bytes]) -> dict[int, tuple[int, int]]:
    """First line and line after the last of each chunk that may be removed, by its place.

    Places follow the order of (first line, end); WHOLE is the document as one
    chunk, which is there if it has several lines that aren't one chunk already.
    A chunk that overlaps its own first occurrence in the document isn't one.
    """
    spans = set()
    begin, full_lines, before = 0, 0, 0
    n = len(lines)
    sizes = [x.count(b" ") + 1 if x else 0 for x in lines]
    for i in range(n):
        own = zlib.crc32(lines[i])
        full_lines += sizes[i] > 0
        rolling = (before * 0x9E3779B1 + own) & 0xFFFFFFFF
        before = own
        long = sizes[i] >= LONG
        if long or i + 1 == n or sizes[i + 1] >= LONG or (rolling ^ rolling >> 15) * 0x2C1B3C6D >> 17 & 1:
            if long or full_lines > 1:
                spans.add((begin, i + 1))
            begin, full_lines = i + 1, 0
    full = [i for i in range(n) if sizes[i]]
    at, words, before = 0, 0, -1
    for i in full:
        words += sizes[i]
        while words >= LONG:
            spans.add((full[at], i + 1))  # the shortest from its first line on
            words -= sizes[full[at]]
            at += 1
        if at:
            spans.add((full[at - 1], i + 1))  # the shortest up to its last line
            if 0 <= before < i - 1:
                spans.add((min(full[at - 1], before), i + 1))  # and with the empty lines before that
        before = i
    ordered = sorted(spans)
    if len(set(lines)) < n:
        first: dict[tuple[bytes, ...], int] = {}
        ordered = [(x, y) for x, y in ordered if (at := first.setdefault(tuple(lines[x:y]), x)) == x or x >= at + y - x]
    out = dict(enumerate(ordered))
    if len(full) > 1 and (0, n) not in spans:
        out[WHOLE] = (0, n)
    return out


def cover(spans: dict[int, tuple[int, int]]) -> list[int]:
    """Places of few chunks that hold the same lines as all of ``spans``."""
    out: list[int] = []
    end, best, reach = 0, None, 0
    for place, (x, y) in sorted(spans.items(), key=lambda s: s[1]):
        if x > end and best is not None:
            out.append(best)
            end, best = reach, None
        if x > end:
            end = x
        if y > max(end, reach if best is not None else end):
            best, reach = place, y
    return out if best is None else [*out, best]


def _lines(data: np.ndarray, p: int, q: int) -> list[bytes]:
    return data[p:q].tobytes().split(b"\n")


def dedup_lines(documents: DataFrame) -> DataFrame:
    """``documents`` with ``text`` without repeated chunks, and ``n_lines``, ``n_removed`` (lines).

    Every row stays; other columns are as they were, whatever their names,
    except that they lose to the two new names. Null texts stay null, with no
    lines; a text that loses all its lines is empty. Rows that repeat both id and
    text are treated as one document, so both keep what it keeps.
    """
    own = [c for c in documents.columns if c not in ("n_lines", "n_removed", "text")]
    docs = small_batches(documents).withColumn("text", F.col("text").cast("string"))
    # the documents' other columns travel as one; rows are told apart by id and text, as ids may be null or repeat
    number = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    docs = docs.select(number.alias("_id"), F.xxhash64("doc_id", "text").alias("_row"), "text", F.struct(*(F.col(f"`{c}`") for c in own)).alias("_own"))
    with Scratch(documents.sparkSession, "lines", by_workers=True) as tmp:
        out = _deduped(docs, tmp)
    return out.select(*(F.col("text") if c == "text" else F.col(f"_own.`{c}`") for c in documents.columns if c not in ("n_lines", "n_removed")), "n_lines", "n_removed")


def _deduped(docs: DataFrame, tmp: Scratch) -> DataFrame:
    """(_own, text, n_lines, n_removed) of every row of ``docs`` (_id, _row, text, _own)."""

    def find(batches):
        for b in sliced(batches):
            data, offsets = texts_of(b["text"])
            which, place, hashes = [], [], []
            for d, (p, q) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                lines = _lines(data, p, q)
                for at, (x, y) in chunks_of(lines).items():
                    which.append(d)
                    place.append(at)
                    hashes.append(blake2b(b"\n".join(lines[x:y]), digest_size=8).digest())
            rows = pa.array(np.array(which, np.int64))
            yield pa.RecordBatch.from_arrays([b["_id"].take(rows), b["_row"].take(rows), pa.array(place, pa.int32()), pa.array(np.frombuffer(b"".join(hashes), np.int64))], ["_id", "_row", "place", "h"])

    chunks = tmp.written(docs.select("_id", "_row", "text"), "chunks", find, "_id long, _row long, place int, h long")
    spot = F.struct("_id", "_row", "place")
    repeated = chunks.groupBy("h").agg(F.min(spot).alias("first"), F.count("*").alias("n")).where("n > 1").select("h", "first")
    repeated = tmp.written(repeated, "hashes")  # so that a chunk which very many documents have is a skewed join, which adaptive execution splits
    wanted = chunks.join(repeated.hint("merge"), "h").withColumn("is_first", F.col("first") == spot)
    wanted = wanted.groupBy("_id", "_row").agg(F.collect_set(F.struct("place", "h", "is_first")).alias("places"))
    wanted = tmp.written(wanted, "repeated")

    def pack(batches):
        tool = zstandard.ZstdCompressor(level=1)
        for b in sliced(batches):
            texts = [None if t is None else tool.compress(t) for t in b["text"].cast(pa.binary()).to_pylist()]
            k = b.schema.get_field_index("text")
            yield pa.RecordBatch.from_arrays([*b.columns[:k], pa.array(texts, pa.binary()), *b.columns[k + 1 :]], b.schema.names)

    def as_packed(df: DataFrame) -> DataFrame:
        return df.mapInArrow(pack, StructType([StructField("text", BinaryType()) if f.name == "text" else f for f in df.schema.fields]))

    def cut(batches):
        tool = zstandard.ZstdDecompressor()
        for b in sliced(batches):
            ids, rows, place, h, first, out = [], [], [], [], [], []
            for i, r, text, places in zip(b["_id"].to_pylist(), b["_row"].to_pylist(), b["text"], b["places"].to_pylist(), strict=True):
                lines = tool.decompress(text.as_buffer()).split(b"\n") if text.is_valid else [b""]
                spans = chunks_of(lines)
                # of repeats, those that together hold all repeated lines
                again = set(cover({x["place"]: spans[x["place"]] for x in places if not x["is_first"] and x["place"] in spans}))
                for x in places:
                    if x["place"] in again or x["is_first"] and x["place"] in spans:
                        for column, v in ((ids, i), (rows, r), (place, x["place"]), (h, x["h"]), (first, x["is_first"]), (out, b"\n".join(lines[slice(*spans[x["place"]])]))):
                            column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, pa.int64()), pa.array(place, pa.int32()), pa.array(h, pa.int64()), pa.array(first, pa.bool_()), pa.array(out, pa.binary())], ["_id", "_row", "place", "h", "is_first", "chunk"])

    texts = as_packed(docs.select("_id", "_row", "text").where("text IS NOT NULL")).join(wanted.hint("merge"), ["_id", "_row"])
    found = tmp.written(texts.mapInArrow(cut, "_id long, _row long, place int, h long, is_first boolean, chunk binary").dropDuplicates(["_id", "_row", "place"]), "candidates")
    firsts = found.where("is_first").select("h", F.col("chunk").alias("first_chunk"))
    same = found.where("NOT is_first").join(firsts, "h").where("chunk = first_chunk")
    removed = tmp.written(same.groupBy("_id", "_row").agg(F.collect_set("place").alias("_places")), "removed")

    tmp.keep(removed)
    back = as_packed(docs).join(removed.hint("merge"), ["_id", "_row"], "left").select("_own", "text", "_places")
    schema = StructType([docs.schema["_own"], StructField("text", StringType()), StructField("n_lines", IntegerType()), StructField("n_removed", IntegerType())])

    def clean(batches):
        tool = zstandard.ZstdDecompressor()
        for b in sliced(batches):
            out, n_lines, n_removed = [], [], []
            for text, places in zip(b["text"], b["_places"].to_pylist(), strict=True):
                if not text.is_valid:
                    out.append(None)
                    n_lines.append(0)
                    n_removed.append(0)
                    continue
                raw = tool.decompress(text.as_buffer())
                lines = raw.split(b"\n") if raw else []
                gone: set[int] = set()
                if places:
                    spans = chunks_of(lines)
                    for p in places:
                        gone.update(range(*spans.get(p, (0, 0))))
                out.append((b"\n".join(x for k, x in enumerate(lines) if k not in gone) if gone else raw).decode())
                n_lines.append(len(lines))
                n_removed.append(len(gone))
            columns = [b["_own"], pa.array(out, pa.string()), pa.array(n_lines, pa.int32()), pa.array(n_removed, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["_own", "text", "n_lines", "n_removed"])

    return back.mapInArrow(clean, schema)
