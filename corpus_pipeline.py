"""The corpus pipeline: five stages from raw documents to encoded ones.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's ``docs``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from plexgrid.llm.decontaminate import contaminated_rows
from plexgrid.llm.lines import dedup_lines
from plexgrid.llm.minhash import near_duplicates
from plexgrid.llm.pieces import encode_decode
from plexgrid.llm.quality import score_quality, train_quality
from plexgrid.operators.storage import delete_folders, keep_till_exit, shared_dir

#: The classifiers and encoders are not expressible in SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def _wrapped(docs):
    """(doc_id, text, _doc): the operators see two columns, so the others of the documents keep their names and values."""
    others = [c for c in docs.columns if c != "text"]
    return docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in others)).alias("_doc"))


def _unwrapped(out, docs, **new):
    """The columns of ``docs`` from wrapped rows, with the ``new`` ones in their places."""
    return out.select(*(new.get(c, F.col("text") if c == "text" else F.col("_doc")[c]).alias(c) for c in docs.columns))


def quality_stage(spark, docs, sf_dir):
    """Documents that the quality classifier doesn't reject; it is trained on the labelled ones of ``docs``."""
    net = train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _unwrapped(score_quality(_wrapped(docs), net).where("predicted = 1"), docs)


def lines_stage(spark, docs, sf_dir):
    """Documents without repeated chunks of lines; those of which nothing is left go.

    ``n_chars``, where the documents have it, is that of the text which stays.
    """
    out = dedup_lines(_wrapped(docs)).where("text IS NULL OR text <> '' OR n_removed = 0")
    new = {"text": F.col("text").cast(docs.schema["text"].dataType)}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text").cast(kind)).otherwise(F.col("_doc")["n_chars"])
    return _unwrapped(out, docs, **new)


def near_duplicate_stage(spark, docs, sf_dir):
    """One document of each group of near-duplicates: that with the smallest id.

    Near-duplicates share four fifths of their distinct runs of five words.
    Rows without an id stay; rows that repeat an id stay or go together.
    """
    kept = near_duplicates(docs, n=5, percent=80).where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_kept")).distinct()
    held = _wrapped(docs).withColumn("_id", F.col("doc_id").cast("long"))
    without = held.where("_id IS NULL")
    return _unwrapped(held.join(kept, F.col("_id") == F.col("_kept"), "left_semi").unionByName(without), docs)


def decontamination_stage(spark, docs, sf_dir):
    """Documents that hold no benchmark item; rows without an id and rows that repeat one are judged by their own texts."""
    held = contaminated_rows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    own = _wrapped(docs).withColumn("_row", F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    return _unwrapped(own.join(held, "_row", "left_anti"), docs)


def sentencepiece_stage(spark, docs, sf_dir):
    """(doc_id, n_ids, ids_crc32, decoded_ok, ids, decoded) of every document."""
    import public_tokenizers

    return encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality", quality_stage),
    ("line dedup", lines_stage),
    ("near-duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("sentencepiece", sentencepiece_stage),
]


def run(spark, sf_dir):
    """All stages on ``documents``, in order; a stage's input goes when its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, before = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete_folders([before])
        before = path
    keep_till_exit(folder)
    return docs
