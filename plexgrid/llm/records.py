"""Token ids in length-delimited binary files with an index of offsets.

A file holds records one after another: the length of the data (8 bytes, little
endian), its masked checksum (4), the data, and the masked checksum of the data
(4). Data is a document's ids, 2 bytes each where the vocabulary allows it, else
4. The checksum is CRC-32C, masked by a rotation and a constant, so that data
which holds checksums of its own is not mistaken. Beside each file lies an index
of (doc_id, offset, ids): 24 bytes a record, for reading records in any order.

Documents are range-partitioned by doc_id; file k holds smaller ids than k + 1.
"""

from __future__ import annotations

import json
import re
import sys
import types
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.storage import keep_till_exit, shared_dir
from .common import blocks, small_batches
from .pieces import SEGMENT, Units, segments, spread_out, string_buffers

END_ID = 1
MASK_DELTA = np.uint32(0xA282EAD8)
CHUNK = 512
#: Words whose ids a worker remembers, of so many characters; beyond this it starts anew.
REMEMBERED, LONGEST = 900_000, 32


def _crc_tables() -> np.ndarray:
    """CRC-32C of each byte, followed by 0 to 3 zero bytes."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(0x82F63B78), t >> np.uint32(1))
    out = [t]
    for _ in range(3):
        out.append(t[out[-1] & 255] ^ (out[-1] >> np.uint32(8)))
    return np.stack(out)


TABLES = _crc_tables()


def _advance(crc: np.ndarray) -> np.ndarray:
    """The register after four zero bytes."""
    return TABLES[3][crc & 255] ^ TABLES[2][crc >> 8 & 255] ^ TABLES[1][crc >> 16 & 255] ^ TABLES[0][crc >> 24]


def _shift_tables(words: int) -> np.ndarray:
    """Tables for the register after ``words`` times four zero bytes."""
    t = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    for _ in range(words):
        t = _advance(t)
    return t


def _shift(crc: np.ndarray, tables: np.ndarray) -> np.ndarray:
    return tables[0][crc & 255] ^ tables[1][crc >> 8 & 255] ^ tables[2][crc >> 16 & 255] ^ tables[3][crc >> 24]


CHUNK_TABLES = _shift_tables(CHUNK // 4)


def crc32c(parts: list[bytes]) -> np.ndarray:
    """CRC-32C of each part, all at once.

    Parts are padded in front to whole chunks (leading zeros leave an empty
    register empty), chunks go through side by side, and their registers are
    joined in order. The usual start value is 0xFFFFFFFF on the first four
    bytes; parts under four bytes are done one by one.
    """
    out = np.zeros(len(parts), np.uint32)
    long = [i for i, p in enumerate(parts) if len(p) >= 4]
    for i in set(range(len(parts))) - set(long):
        c = 0xFFFFFFFF
        for b in parts[i]:
            c = int(TABLES[0][(c ^ b) & 255]) ^ c >> 8
        out[i] = c ^ 0xFFFFFFFF
    if not long:
        return out
    sizes = np.array([len(parts[i]) for i in long])
    chunks = -(-sizes // CHUNK)
    ends = np.cumsum(chunks)
    flat = np.zeros(int(ends[-1]) * CHUNK, np.uint8)
    begin = ends * CHUNK - sizes
    for i, b, n in zip(long, begin, sizes, strict=True):
        flat[b : b + n] = np.frombuffer(parts[i], np.uint8)
    for k in range(4):
        flat[begin + k] ^= 255
    columns = np.ascontiguousarray(flat.view("<u4").reshape(-1, CHUNK // 4).T)
    crc = np.zeros(columns.shape[1], np.uint32)
    for w in columns:
        crc = _advance(crc ^ w)
    first = ends - chunks
    total = np.zeros(len(long), np.uint32)
    order = np.argsort(-chunks, kind="stable")
    left = chunks[order]
    for k in range(int(left[0])):
        n = int(np.searchsorted(-left, -k, "left"))  # parts with more than k chunks
        at = order[:n]
        total[at] = _shift(total[at], CHUNK_TABLES) ^ crc[first[at] + k]
    out[long] = total ^ np.uint32(0xFFFFFFFF)
    return out


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + MASK_DELTA


def frame(parts: list[bytes]) -> list[bytes]:
    """Each part as a record."""
    heads = [len(p).to_bytes(8, "little") for p in parts]
    a, b = masked(crc32c(heads)), masked(crc32c(parts))
    return [h + x.tobytes() + p + y.tobytes() for h, x, p, y in zip(heads, a.astype("<u4"), parts, b.astype("<u4"), strict=True)]


class DamagedRecord(ValueError):
    """A record whose length or data does not fit its checksum."""


def unframe(data: bytes, offsets: list[int]) -> list[bytes]:
    """The data of the records at ``offsets``, checked."""
    heads = [data[o : o + 8] for o in offsets]
    parts = [data[o + 12 : o + 12 + int.from_bytes(h, "little")] for o, h in zip(offsets, heads, strict=True)]
    tails = [data[o + 12 + len(p) : o + 16 + len(p)] for o, p in zip(offsets, parts, strict=True)]
    for said, what in (([data[o + 8 : o + 12] for o in offsets], heads), (tails, parts)):
        if b"".join(said) != masked(crc32c(what)).astype("<u4").tobytes():
            raise DamagedRecord("a checksum does not fit")
    return parts


#: Words with one run of plain letters and at most one of marks: one or two pre-tokens.
PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,;:!?|]+)?")

# The settings of a tokenizer for which WordEncoder is right.
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
PRE_TOKENIZERS = [
    {"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]


def by_words(spec: str) -> bool:
    """True if the tokenizer drops spaces and line feeds before anything else looks at them, so that words can be encoded by themselves.

    It must lower and split texts as stated above, end pre-tokens in "</w>", and
    have no added tokens that take spaces or hold them.
    """
    d = json.loads(spec)
    model = d["model"]
    plain = lambda t: t["special"] and not (t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]))
    return (
        d.get("normalizer") == {"type": "Sequence", "normalizers": NORMALIZER}
        and d.get("pre_tokenizer") == {"type": "Sequence", "pretokenizers": PRE_TOKENIZERS}
        and d.get("post_processor") is None
        and d.get("truncation") is None
        and d.get("padding") is None
        and model["type"] == "BPE"
        and model.get("end_of_word_suffix") == "</w>"
        and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
        and all(map(plain, d.get("added_tokens", [])))
    )


class TextEncoder:
    """Ids of whole texts by the tokenizers library."""

    def __init__(self, spec: str, dtype: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tool, self.dtype = Tokenizer.from_str(spec), dtype

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """Ids of each text."""
        texts = [data[p:q].tobytes().decode() for p, q in zip(offsets[:-1], offsets[1:], strict=True)]
        return [np.array(e.ids, self.dtype) for e in self.tool.encode_batch_fast(texts, add_special_tokens=False)]


class WordEncoder(TextEncoder):
    """Ids of texts by a tokenizer that ``by_words`` admits.

    The distinct words between spaces and line feeds of a few megabytes of text
    are encoded by the tokenizers library once. Those of up to LONGEST characters
    are remembered for later texts, up to a bounded number.
    """

    def __init__(self, spec: str, dtype: str):
        super().__init__(spec, dtype)
        from tokenizers import Tokenizer, pre_tokenizers

        # the same model for plain words: in lower case, with marks set apart, they need no other preparation
        self.plain = Tokenizer(self.tool.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.known: dict[str, bytes] = {}
        vocab = self.tool.get_vocab()
        self.ends = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def ids_of(self, words: list[str]) -> dict[str, bytes]:
        """Ids of each word. Plain ones go through many at once and are told apart by the tokens that end a pre-token."""
        found: dict[str, bytes] = {}
        plain, ready, counts, rest = [], [], [], []
        for w in words:
            m = PLAIN.fullmatch(w)
            if not m:
                rest.append(w)
                continue
            plain.append(w)
            if m[2]:
                ready.append(f"{m[1].lower()} {m[2]}")
                counts.append(2)
            else:
                ready.append(w.lower())
                counts.append(1)
        parts = range(0, len(plain), 200)
        width = np.dtype(self.dtype).itemsize
        for i, e in zip(parts, self.plain.encode_batch_fast([" ".join(ready[i : i + 200]) for i in parts], add_special_tokens=False), strict=True):
            part, ids = plain[i : i + 200], np.array(e.ids)
            ends = np.flatnonzero(self.ends[ids]) if len(ids) else ids
            last = np.cumsum(counts[i : i + 200])
            if len(ends) != last[-1] or ends[-1] != len(ids) - 1:
                rest += part
                continue
            packed = ids.astype(self.dtype).tobytes()
            to = ((ends[last - 1] + 1) * width).tolist()
            found.update(zip(part, (packed[x:y] for x, y in zip([0, *to[:-1]], to, strict=True)), strict=True))
        for i in range(0, len(rest), 10_000):
            part = rest[i : i + 10_000]
            found.update((w, np.array(e.ids, self.dtype).tobytes()) for w, e in zip(part, self.tool.encode_batch_fast(part, add_special_tokens=False), strict=True))
        return found

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        begin = int(offsets[0])
        data, offsets = data[begin : int(offsets[-1])], offsets - begin
        found, totals = [], np.zeros(len(offsets) - 1, np.int64)
        width = np.dtype(self.dtype).itemsize
        for a, b in segments(data):
            at = np.flatnonzero((data[a:b] != 32) & (data[a:b] != 10))
            if not len(at):
                continue
            new = np.diff(at, prepend=-2) != 1
            heads = np.searchsorted(at, offsets[(offsets > a) & (offsets < b)] - a)
            new[heads[heads < len(at)]] = True  # a document's first character begins a word
            letters = data[a:b][at]
            units = Units(letters, np.flatnonzero(new))
            raw = letters.tobytes()
            words = [raw[p : p + n].decode() for p, n in zip(units.begin.tolist(), units.size.tolist(), strict=True)]
            if len(self.known) > REMEMBERED:
                self.known = {}
            packed = list(map(self.known.get, words))
            fresh = self.ids_of([w for w, x in zip(words, packed, strict=True) if x is None])
            packed = [fresh[w] if x is None else x for w, x in zip(words, packed, strict=True)]
            self.known.update((w, x) for w, x in fresh.items() if len(w) <= LONGEST)
            counts = np.array([len(x) // width for x in packed])
            ids, n = spread_out(np.frombuffer(b"".join(packed), self.dtype), counts, units.which)
            found.append(ids)
            np.add.at(totals, np.searchsorted(offsets, at[new] + a, "right") - 1, n)
        ids = np.concatenate(found) if found else np.zeros(0, self.dtype)
        return np.split(ids, np.cumsum(totals)[:-1])


def worker_encoder(spec: str, dtype: str) -> TextEncoder:
    """The encoder of this Python worker, kept from task to task."""
    kept = sys.modules.setdefault("_plexgrid_kept", types.ModuleType("_plexgrid_kept"))
    if getattr(kept, "spec", None) != (spec, dtype):
        kept.spec, kept.encoder = (spec, dtype), (WordEncoder if by_words(spec) else TextEncoder)(spec, dtype)
    return kept.encoder


def put(fs: pafs.FileSystem, source: str, target: str) -> None:
    """Renames, in place of what an earlier run of the task left; some file systems don't replace by themselves."""
    try:
        fs.move(source, target)
    except OSError:
        if fs.get_file_info(target).type == pafs.FileType.NotFound:
            raise
        fs.delete_file(target)
        fs.move(source, target)


def write_records(documents: DataFrame, tokenizer_path: str, folder: str, partitions: int | None = None, end_id: int = END_ID):
    """Write all documents to ``folder``; the manifest rows (part, file, records, ids) in order.

    Null texts are empty; every document ends in ``end_id``. Rows with a null
    id come first; rows that repeat an id follow each other, by text. A task
    that runs twice writes the same bytes under a name of its own and then
    renames, so retries do no harm.
    """
    from pathlib import Path

    from tokenizers import Tokenizer

    spark = documents.sparkSession
    spec = Path(tokenizer_path).read_text(encoding="utf-8")
    dtype = "<u2" if max(Tokenizer.from_str(spec).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
    slim = small_batches(documents).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    spec_cast = spark.sparkContext.broadcast(spec)

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        fs, root = pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        name, end = f"{root}/part-{part:06d}", np.array([end_id], dtype).tobytes()
        mine = f"{name}.{uuid.uuid4().hex}"
        tool, records, ids, at = worker_encoder(spec_cast.value, dtype), 0, 0, 0
        with fs.open_output_stream(f"{mine}.rec") as out, fs.open_output_stream(f"{mine}.idx") as index:
            for b in batches:
                (texts, ends), keys = string_buffers(b["text"]), b["doc_id"].to_pylist()
                for i, j in blocks(ends, SEGMENT):
                    parts = [x.tobytes() + end for x in tool.encode(texts, ends[i : j + 1])]
                    framed = frame(parts)
                    rows = np.empty((j - i, 3), "<i8")
                    rows[:, 0] = [-(1 << 63) if k is None else k for k in keys[i:j]]
                    rows[:, 2] = [len(x) // len(end) for x in parts]
                    sizes = np.array([len(f) for f in framed])
                    rows[:, 1] = at + np.cumsum(sizes) - sizes
                    out.write(b"".join(framed))
                    index.write(rows.tobytes())
                    records, ids, at = records + j - i, ids + int(rows[:, 2].sum()), at + int(sizes.sum())
        if records:
            for kind in ("rec", "idx"):
                put(fs, f"{mine}.{kind}", f"{name}.{kind}")
            yield pa.RecordBatch.from_pydict({"part": [part], "file": [f"part-{part:06d}"], "records": [records], "ids": [ids]}, pa.schema([("part", pa.int32()), ("file", pa.string()), ("records", pa.int64()), ("ids", pa.int64())]))
        else:
            for kind in ("rec", "idx"):
                fs.delete_file(f"{mine}.{kind}")

    ordered = slim.repartitionByRange(partitions, "doc_id").sortWithinPartitions("doc_id", "text")
    # one row a file, as many as partitions
    return sorted(ordered.mapInArrow(run, "part int, file string, records long, ids long").collect(), key=lambda r: r["part"]), dtype


def read_records(spark, folder: str, manifest, dtype: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every record in the files; a damaged record raises."""
    rows, start = [], 0
    for r in manifest:
        rows.append((r["file"], start))
        start += r["ids"]
    if not rows:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    files = spark.createDataFrame(rows, "file string, start long").repartition(len(rows), "file")

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        for b in batches:
            for file, start in zip(b["file"].to_pylist(), b["start"].to_pylist(), strict=True):
                with fs.open_input_file(f"{root}/{file}.idx") as index, fs.open_input_file(f"{root}/{file}.rec") as data:
                    end = data.size()
                    while raw := index.read(24 * 2048):
                        entry = np.frombuffer(raw, "<i8").reshape(-1, 3)
                        begin = int(entry[0, 1])
                        width = int(np.dtype(dtype).itemsize)
                        until = int(entry[-1, 1] + 16 + entry[-1, 2] * width)
                        if until > end:
                            raise DamagedRecord("a file is cut off")
                        block = data.read_at(until - begin, begin)
                        parts = unframe(block, [int(o) - begin for o in entry[:, 1]])
                        counts = np.array([len(p) // width for p in parts])
                        crc = [zlib.crc32(np.frombuffer(p, dtype).astype("<u4").tobytes()) for p in parts]
                        ids = pa.array(entry[:, 0], mask=entry[:, 0] == -(1 << 63))
                        yield pa.RecordBatch.from_arrays([ids, pa.array(start + np.cumsum(counts) - counts), pa.array(counts), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                        start += int(counts.sum())

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_records(documents: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write ``documents`` in this format under the shared folder and read them back."""
    spark = documents.sparkSession
    folder = f"{shared_dir(spark)}/records-{uuid.uuid4().hex}"
    fs, root = pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    fs.create_dir(root, recursive=True)
    keep_till_exit(folder)
    manifest, dtype = write_records(documents, tokenizer_path, folder)
    return read_records(spark, folder, manifest, dtype)
