"""What the corpus operators share: Arrow text buffers, word
hashes, groups in sorted streams and connected components.

Text columns are handled as Arrow buffers (bytes and offsets), so that numpy
works on whole batches. A null text is treated as an empty one.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.storage import Scratch

#: Bytes of text that numpy handles at once; one document may be longer.
BLOCK_BYTES = 1 << 20


#: Rows in one Arrow batch, where the session has Spark's own default of 10,000.
BATCH_ROWS = 1000


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, after bounding what goes to a Python worker at once: whole texts can be long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if df.sparkSession.conf.get(key) == "10000":
        df.sparkSession.conf.set(key, str(BATCH_ROWS))
    return df


def held_out(doc_id: str = "doc_id"):
    """True where crc32 of the id as text leaves no remainder by five; a null id isn't held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def may_learn(doc_id: str = "doc_id"):
    """True for rows whose labels may be learned: those with an id that isn't held out."""
    return F.col(doc_id).isNotNull() & ~held_out(doc_id)


#: Rows of a table of ids that is shipped to every task: 8 bytes each.
FEW_IDS = 500_000


def of_ids(rows: DataFrame, ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """``rows`` whose ``column`` is in ``ids`` (a written table of that column, without repeats)."""
    if ids.count() <= FEW_IDS:
        ids = F.broadcast(ids)
    return rows.join(ids, column, "left_semi")


def free_kept() -> None:
    """Lets go of what a tokenizer's earlier task kept in this Python worker; other operators need the memory."""
    sys.modules.pop("_plexgrid_kept", None)


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and 64-bit offsets of a string column, nulls being empty."""
    free_kept()
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows, so that lists made from them stay small."""
    free_kept()
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def blocks(offsets: np.ndarray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``size`` bytes, one document at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = j


_P = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)


def _power_table(n: int) -> np.ndarray:
    global _powers
    if n <= len(_powers):
        return _powers
    made = np.full(n, _P, np.uint64)
    made[0] = 1
    np.multiply.accumulate(made, out=made)
    if n <= 1 << 16:
        _powers = made
    return made


def mix64(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def byte_classes(separators: bytes, lower: bool = True) -> np.ndarray:
    """A table from byte to its code in a word, 0 for separators."""
    table = np.arange(256, dtype=np.uint8)
    table[0] = 255  # which no UTF-8 text has
    if lower:
        table[65:91] += 32
    table[list(separators)] = 0
    return table


def word_hashes(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the documents, and the offsets of each document's words.

    ``data`` is what ``offsets`` cover, ``table`` comes from ``byte_classes``.
    """
    begin = int(offsets[0])
    data = table[data[begin : int(offsets[-1])]]
    offsets = offsets - begin
    at = np.flatnonzero(data)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    new = np.empty(len(at), bool)
    new[0] = True
    np.not_equal(at[1:], at[:-1] + 1, out=new[1:])
    firsts = np.searchsorted(at, offsets[:-1])
    new[firsts[firsts < len(at)]] = True  # a document's first character begins a word
    starts = np.flatnonzero(new)
    lengths = np.diff(starts, append=len(at))
    position = np.arange(len(at)) - np.repeat(starts, lengths)
    value = data[at].astype(np.uint64)
    value += np.uint64(1)
    value *= _power_table(int(lengths.max()))[position]
    hashes = mix64(np.add.reduceat(value, starts) + lengths.astype(np.uint64))
    return hashes, np.searchsorted(at[starts], offsets)


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word shingles (with fewer words, of the whole sequence), and each document's offsets.

    A document without words has none.
    """
    counts = np.diff(offsets)
    have = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    out = np.concatenate([[0], np.cumsum(have)])
    starts = np.repeat(offsets[:-1] - out[:-1], have) + np.arange(out[-1])
    hashes = np.zeros(len(starts), np.uint64)
    ends = np.repeat(offsets[1:], have)
    for k in range(n):
        inside = starts + k < ends
        word = np.where(inside, words[np.minimum(starts + k, max(len(words) - 1, 0))], np.uint64(0)) if len(words) else hashes
        hashes = (hashes ^ word) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(k + 1)
    return mix64(hashes), out


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 20_000) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups from batches sorted by ``keys``, with the first row of each group.

    A group that goes on in the next batch is held back till then; memory is
    bounded by ``least`` rows, one batch and the largest group.
    """
    held: list[pa.RecordBatch] = []
    rows = 0

    def starts(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        new[:1] = True
        for k in keys:
            x = table[k].to_numpy()
            new[1:] |= x[1:] != x[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= least:
            table = pa.Table.from_batches(held).combine_chunks()
            first = starts(table)
            if len(first) > 1:
                yield table.slice(0, first[-1]), first[:-1]
                table = table.slice(first[-1]).combine_chunks()
            held, rows = table.to_batches(), table.num_rows
    if rows:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, starts(table)


def connected_components(edges: DataFrame, tmp: Scratch, name: str = "components") -> DataFrame:
    """(node, component): the smallest node reachable, for every node of ``edges`` (u, v).

    Large-star and small-star steps in turn; every round is written by ``tmp``.
    So are the least neighbours: a node that very many others link with is then
    a skewed join, which adaptive execution splits. Nodes without an edge to
    another node don't appear.
    """
    e = edges.where("u <> v").selectExpr("greatest(u, v) AS u", "least(u, v) AS v").distinct()
    e = tmp.written(e, name)
    seen = None
    while True:
        both = e.unionByName(e.selectExpr("v AS u", "u AS v"))
        least = tmp.written(both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) AS m"), "least")
        large = both.join(least, "u").where("v > u").selectExpr("v AS u", "m AS v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").selectExpr("v AS u", "m AS v").where("u <> v").unionByName(low.selectExpr("u", "m AS v"))
        new = tmp.written(small.distinct(), name)
        tmp.drop(e)
        tmp.drop(least)
        e = new
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            found = e.selectExpr("u AS node", "v AS component").unionByName(e.selectExpr("v AS node", "v AS component").distinct())
            found = tmp.written(found, name)
            tmp.drop(e)
            return found
        seen = now
