"""Benchmark decontamination: size-partitioned MinHash containment search.

Test items are partitioned by the number of their distinct five-word shingles,
class c holding 2^c up to 2^(c+1) - 1. For each class, documents are looked at
in overlapping windows of 2^(c+2) shingles at half that stride, so a passage of
twice an item's length lies in one window and the Jaccard similarity of item
and window stays bounded below, however long the document is. Item and window
are candidates if any coordinate of their MinHash signatures agrees. Window
minima of wider classes come from those of narrower ones. Every candidate is
verified by exact shingle containment: the share of the item's distinct
shingles that the whole document holds.

Words are runs of letters and digits, in lower case, so marks and spacing
don't hide a copy. Items with fewer than five words are one shingle, their
whole sequence; they are searched as the run of words that they are.

Items go to the tasks in blocks of bounded size; more items mean more passes
over the documents, not larger broadcasts.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.storage import Scratch
from .common import blocks, byte_classes, shingle_hashes, small_batches, texts_of, word_hashes

WORDS = 5
COORDINATES = 64
#: Characters of items in one block.
BLOCK_CHARS = 16 << 20
LETTERS = byte_classes(bytes(b for b in range(128) if not chr(b).isalnum()))
_marks = re.compile(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")

MULTIPLIERS = np.random.default_rng(17).integers(1 << 20, 1 << 32, COORDINATES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)


def words_of(text: str) -> list[str]:
    return _marks.sub(" ", text.lower()).split(" ")


def shingles_of(words: list[str]) -> set[tuple]:
    w = [x for x in words if x]
    if len(w) < WORDS:
        return {tuple(w)} if w else set()
    return set(zip(*(w[k:] for k in range(WORDS)), strict=False))


def lowered(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts in lower case, letters beyond ASCII too."""
    begin, end = int(offsets[0]), int(offsets[-1])
    part = data[begin:end]
    if not (part > 127).any():
        return data, offsets  # byte classes lower ASCII letters
    texts = [data[p:q].tobytes().decode("utf-8", "replace").lower().encode() for p, q in zip(offsets[:-1], offsets[1:], strict=True)]
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


class Items:
    """A block of items: shingle sets and, by class, the items at each value of each coordinate."""

    def __init__(self, ids: list[int], texts: list[str]):
        sets = [(i, shingles_of(words_of(t))) for i, t in zip(ids, texts, strict=True)]
        self.items = [(i, s) for i, s in sets if s]
        # items of fewer than five words: the items of each run of words, by its first word
        self.short: dict[str, dict[tuple, list[int]]] = {}
        for k, (_, found) in enumerate(self.items):
            words = next(iter(found))
            if len(words) < WORDS:
                self.short.setdefault(words[0], {}).setdefault(words, []).append(k)
        raw = [" ".join(w for w in words_of(t) if w).encode() for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        hashes, at = shingle_hashes(*word_hashes(np.frombuffer(b"".join(raw), np.uint8), offsets, LETTERS), WORDS)
        kept = [k for k, (_, s) in enumerate(sets) if s]
        self.classes: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        by_class: dict[int, list[int]] = {}
        for n, k in enumerate(kept):
            if len(next(iter(self.items[n][1]))) == WORDS:
                by_class.setdefault(int(np.log2(len(self.items[n][1]))), []).append(n)
        for c, members in sorted(by_class.items()):
            low = np.array([[(self._place(hashes[at[kept[n]] : at[kept[n] + 1]]) * m).min() for m in MULTIPLIERS] for n in members], np.uint32)
            tables = []
            for k in range(COORDINATES):
                order = np.argsort(low[:, k], kind="stable")
                tables.append((low[order, k], np.array(members)[order]))
            self.classes[c] = tables
        # one bit for each value, to reject most windows at once
        self.filters = {c: self._bits(tables) for c, tables in self.classes.items()}

    @staticmethod
    def _place(shingles: np.ndarray) -> np.ndarray:
        return (shingles >> np.uint64(32)).astype(np.uint32)

    @staticmethod
    def _bits(tables) -> np.ndarray:
        bits = np.zeros((COORDINATES, 1 << 16), bool)
        for k, (values, _) in enumerate(tables):
            bits[k, values & 0xFFFF] = True
        return bits

    def candidates(self, shingles: np.ndarray, at: np.ndarray, counts: np.ndarray) -> set[tuple[int, int]]:
        """(document, item) pairs that agree in a coordinate in some window."""
        if not self.classes or not len(shingles):
            return set()
        place = self._place(shingles)
        lowest = min(self.classes)
        step = 2 << lowest  # half a window of the narrowest class
        have = np.flatnonzero(counts)
        n_steps = -(-counts[have] // step)
        first = np.concatenate([[0], np.cumsum(n_steps)])
        starts = np.repeat(at[:-1][have] - first[:-1] * step, n_steps) + np.arange(first[-1]) * step
        doc = np.repeat(have, n_steps)
        low = np.empty((COORDINATES, len(starts)), np.uint32)
        buffer = np.empty_like(place)
        for k, m in enumerate(MULTIPLIERS):
            np.multiply(place, m, out=buffer)
            np.minimum.reduceat(buffer, starts, out=low[k])
        found: set[tuple[int, int]] = set()
        for c in range(lowest, max(self.classes) + 1):
            same = np.flatnonzero(doc[1:] == doc[:-1])
            if c in self.classes:
                window = low.copy()
                window[:, same] = np.minimum(low[:, same], low[:, same + 1])
                for k, (values, members) in enumerate(self.classes[c]):
                    hit = np.flatnonzero(self.filters[c][k][window[k] & 0xFFFF])
                    for w in hit:
                        v = window[k, w]
                        for x in range(np.searchsorted(values, v), np.searchsorted(values, v, "right")):
                            found.add((int(doc[w]), int(members[x])))
            # steps twice as wide: pairs of a document's steps, from its first on
            order = np.arange(len(doc)) - np.searchsorted(doc, doc)
            even = np.flatnonzero(order % 2 == 0)
            pair = even[:, None] + [0, 1]
            ok = (pair[:, 1] < len(doc)) & (doc[np.minimum(pair[:, 1], len(doc) - 1)] == doc[pair[:, 0]])
            low = np.where(ok, np.minimum(low[:, even], low[:, np.minimum(pair[:, 1], len(doc) - 1)]), low[:, even])
            doc = doc[even]
        return found


def distinct_items(benchmark: DataFrame, tmp: Scratch) -> DataFrame:
    """(text_id, item_id, text) written, with one number for each text: items that repeat are looked for once."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    return tmp.written(items.withColumn("text_id", F.xxhash64("text")), "items")


def rows_of(documents: DataFrame) -> DataFrame:
    """(doc_id, row, text): rows are told apart by id and text, as ids may be null or repeat."""
    slim = small_batches(documents).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")


def text_matches(slim: DataFrame, items: DataFrame, percent: int) -> DataFrame:
    """(doc_id, row, text_id, n_shared, n_item) of every distinct item text that a row of ``slim`` contains.

    Item texts go to the tasks in blocks of about BLOCK_CHARS characters.
    """
    texts = items.groupBy("text_id").agg(F.min("text").alias("text"))
    total = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    n_blocks = max(1, -(-int(total) // BLOCK_CHARS))
    out = None
    for block in range(n_blocks):
        rows = sorted((r["text_id"], r["text"]) for r in texts.where(F.pmod("text_id", F.lit(n_blocks)) == block).collect())
        part = matches_of_block(slim, [r[0] for r in rows], [r[1] for r in rows], percent)
        out = part if out is None else out.unionByName(part)
    return out


def matches(documents: DataFrame, benchmark: DataFrame, percent: int = 80) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item) of every item that a row of ``documents`` contains.

    An item is contained if 100 * shared >= ``percent`` * (its distinct
    shingles). Null and empty items and texts match nothing; rows that repeat
    an item match alike, and so do rows that repeat a document. Null ids are
    kept as they are.
    """
    with Scratch(documents.sparkSession, "matches") as tmp:
        items = distinct_items(benchmark, tmp)
        tmp.keep(items)
        found = text_matches(rows_of(documents), items, percent)
        return found.join(items.select("text_id", "item_id"), "text_id").select("doc_id", "item_id", "n_shared", "n_item")


def matches_of_block(slim: DataFrame, ids: list[int], texts: list[str], percent: int) -> DataFrame:
    cast = slim.sparkSession.sparkContext.broadcast((ids, texts))

    def run(batches):
        items = Items(*cast.value)
        for b in batches:
            data, offsets = texts_of(b["text"])
            at_row, found = [], []
            for i, j in blocks(offsets):
                text, at = lowered(data, offsets[i : j + 1])
                shingles, where = shingle_hashes(*word_hashes(text, at, LETTERS), WORDS)
                by_doc: dict[int, list[int]] = {}
                for d, k in items.candidates(shingles, where, np.diff(where)):
                    by_doc.setdefault(d, []).append(k)
                for d in range(j - i) if items.short else sorted(by_doc):
                    words = [x for x in words_of(data[offsets[i + d] : offsets[i + d + 1]].tobytes().decode("utf-8", "replace")) if x]
                    candidates = by_doc.get(d, [])
                    own = shingles_of(words) if candidates else set()
                    for k in sorted(candidates):
                        item, s = items.items[k]
                        shared = len(s & own)
                        if shared and 100 * shared >= percent * len(s):
                            at_row.append(i + d)
                            found.append((item, shared, len(s)))
                    hit = set()
                    for p, x in enumerate(words) if items.short else ():
                        for run_of, members in items.short.get(x, {}).items():
                            if tuple(words[p : p + len(run_of)]) == run_of:
                                hit.update(members)
                    for k in sorted(hit):
                        at_row.append(i + d)
                        found.append((items.items[k][0], 1, 1))
            rows = pa.array(at_row, pa.int64())
            columns = list(zip(*found, strict=True)) if found else [[]] * 3
            yield pa.RecordBatch.from_arrays([b["doc_id"].take(rows), b["row"].take(rows), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", "row", "text_id", "n_shared", "n_item"])

    return slim.mapInArrow(run, "doc_id long, row long, text_id long, n_shared long, n_item long")


def contaminated_rows(documents: DataFrame, benchmark: DataFrame, percent: int = 80) -> DataFrame:
    """(_row): xxhash64 of (doc_id as long, text as string) of every row that contains an item."""
    with Scratch(documents.sparkSession, "contaminated") as tmp:
        found = text_matches(rows_of(documents), distinct_items(benchmark, tmp), percent)
        out = tmp.written(found.select(F.col("row").alias("_row")).distinct(), "rows")
        tmp.keep(out)
        return out


def contamination(documents: DataFrame, benchmark: DataFrame, percent: int = 80) -> DataFrame:
    """(doc_id, contaminated, n_items, item_id, n_shared, n_item) of every row; the item is the one best contained.

    ``n_items`` counts distinct item ids. Rows with a null id are judged by
    their own texts, and so is each of several rows with one id.
    """
    with Scratch(documents.sparkSession, "contamination") as tmp:
        items = distinct_items(benchmark, tmp)
        named = tmp.written(items.groupBy("text_id").agg(F.countDistinct("item_id").alias("ids"), F.min("item_id").alias("item_id")), "named")
        found = text_matches(rows_of(documents), items, percent).dropDuplicates(["row", "text_id"])
        # of an id that several texts have, one counts
        held = found.join(named, "text_id").join(items.select("text_id", F.col("item_id").alias("each")).distinct(), "text_id")
        best = F.max(F.struct((F.col("n_shared") / F.col("n_item")).alias("share"), "n_item", (-F.col("item_id")).alias("item"), "n_shared")).alias("best")
        by_row = tmp.written(held.groupBy("row").agg(F.countDistinct("each").alias("n_items"), best), "rows")
        tmp.keep(by_row)
        # rows without a text, or of which nothing was found, have no partner here; keys are hashes, none is common but that of copies
        out = rows_of(documents).select("doc_id", "row").join(by_row, "row", "left")
        return out.select("doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), (-F.col("best.item")).alias("item_id"), F.col("best.n_shared").alias("n_shared"), F.col("best.n_item").alias("n_item"))
