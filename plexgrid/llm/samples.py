"""Bounded samples of labelled documents for fitting classifiers on the driver.

A sample is bounded in rows and in bytes of all of them together; the texts in
it are whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import may_learn, small_batches


def sampled(rows: DataFrame, ids: list, max_bytes: int) -> list:
    """Rows of the first of ``ids`` whose texts have up to ``max_bytes`` together; texts are never cut.

    ``rows``: doc_id, text without nulls, ... ``ids`` is a short list.
    """
    kind = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}"
    of = lambda some: rows.join(F.broadcast(rows.sparkSession.createDataFrame([(i,) for i in some], kind)), "doc_id")
    sizes = {r["doc_id"]: r["size"] for r in of(ids).groupBy("doc_id").agg(F.sum(F.octet_length("text")).alias("size")).collect()}
    taken, total = [], 0
    for i in ids:
        total += sizes.get(i, 0)
        if total > max_bytes:
            break
        if i in sizes:
            taken.append(i)
    return sorted(of(taken).collect(), key=tuple) if taken else []


def labelled_texts(documents: DataFrame, labels: DataFrame, label: str, max_docs: int, max_bytes: int) -> tuple[list[bytes], list[float]]:
    """Whole texts and labels of a bounded sample of documents that are not held out.

    Documents are taken in the order of a hash of their ids, so the sample is
    the same on every run. Null labels and texts are left out; of labels that
    repeat an id the largest counts.
    """
    marked = labels.select("doc_id", F.col(label).cast("double").alias("label")).where(F.col("label").isNotNull() & may_learn())
    marked = marked.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    by_id = {r["doc_id"]: r["label"] for r in marked.collect()}
    texts = small_batches(documents).select("doc_id", F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    got = sampled(texts, list(by_id), max_bytes)
    return [r["text"].encode() for r in got], [by_id[r["doc_id"]] for r in got]
