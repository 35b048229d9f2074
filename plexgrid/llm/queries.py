"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_of

    return quality_of(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import languages_of

    return languages_of(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity_of

    return toxicity_of(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embeddings import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), n=2, percent=80)


def op10_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .records import token_records

    return token_records(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.fillna({"item_id": -1, "n_shared": 0, "n_item": 0})


def op4_decontamination_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item) of every item that a document holds."""
    from .decontaminate import matches

    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .pieces import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .pieces import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": op1_quality,
        "op2_lines": op2_lines,
        "op3_language": op3_language,
        "op4_decontamination": op4_decontamination,
        "op4_decontamination_pairs": op4_decontamination_pairs,
        "op5_toxicity": op5_toxicity,
        "op6_embeddings": op6_embeddings,
        "op7_sentencepiece": op7_sentencepiece,
        "op8_token_counts": op8_token_counts,
        "op9_minhash": op9_minhash,
        "op10_records": op10_records,
    }


_reach = "reach AS (SELECT id, id AS r FROM nodes UNION SELECT reach.id, b.v FROM reach JOIN both_ways b ON b.u = reach.r), component AS (SELECT id, min(r) AS c FROM reach GROUP BY 1)"

_op4 = r"""
WITH words AS (SELECT false AS is_item, doc_id AS id, text FROM documents UNION ALL SELECT true, item_id, text FROM benchmark),
w AS (SELECT is_item, id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM words),
s AS (SELECT DISTINCT is_item, id, unnest(list_transform(range(1, len(ws) - 3), lambda i: list_slice(ws, i, i + 4))) AS s FROM w WHERE len(ws) >= 5),
n AS (SELECT id, count(*) AS n FROM s WHERE is_item GROUP BY 1),
m AS (SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared FROM s d JOIN s i ON d.s = i.s AND i.is_item AND NOT d.is_item GROUP BY 1, 2),
f AS (SELECT doc_id, item_id, n_shared, n AS n_item FROM m JOIN n ON n.id = item_id WHERE 100 * n_shared >= 80 * n),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CAST(n_shared AS DOUBLE) / n_item DESC, n_item DESC, item_id) AS r, count(*) OVER (PARTITION BY doc_id) AS k FROM f)
SELECT d.doc_id, k IS NOT NULL AS contaminated, coalesce(k, 0) AS n_items, coalesce(item_id, -1) AS item_id, coalesce(n_shared, 0) AS n_shared, coalesce(n_item, 0) AS n_item FROM documents d LEFT JOIN b ON b.doc_id = d.doc_id AND r = 1
"""

_op4_pairs = _op4[: _op4.index(",\nb AS")] + "\nSELECT doc_id, item_id, n_shared, n_item FROM f"

_op6 = f"""
WITH RECURSIVE nodes AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
both_ways AS (SELECT a.id AS u, b.id AS v FROM nodes a JOIN nodes b ON a.id <> b.id AND list_cosine_similarity(a.e, b.e) >= 0.9),
{_reach}
SELECT id AS vec_id, (SELECT count(*) FROM both_ways WHERE u = id) AS n_links, c AS component_id, id = c AS kept FROM component
"""

_op9 = rf"""
WITH RECURSIVE w AS (SELECT doc_id AS id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
nodes AS (SELECT id FROM w),
s AS (SELECT DISTINCT id, unnest(CASE WHEN len(ws) > 1 THEN list_transform(range(1, len(ws)), lambda i: list_slice(ws, i, i + 1)) WHEN len(ws) = 1 THEN [ws] ELSE [] END) AS s FROM w),
n AS (SELECT id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.id AS u, b.id AS v, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.id < b.id GROUP BY 1, 2),
e AS (SELECT u, v FROM p JOIN n x ON x.id = u JOIN n y ON y.id = v WHERE 100 * k >= 80 * (x.n + y.n - k)),
both_ways AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
{_reach}
SELECT component.id AS doc_id, coalesce(n.n, 0) AS n_shingles, c AS component_id, component.id = c AS kept FROM component LEFT JOIN n ON n.id = component.id
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_decontamination": _op4, "op4_decontamination_pairs": _op4_pairs, "op6_embeddings": _op6, "op9_minhash": _op9}
