"""Annotation helpers: shared genes, priors, bags, embeddings and clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def shared_genes(spatial: DataFrame, reference: DataFrame, gene: str = "gene", value: str = "n") -> DataFrame:
    """(gene, reference_gene, n_cells): names that match, letter case aside, of genes seen in some cell of both."""
    seen = lambda df, name: df.where(F.col(value) > 0).groupBy(gene).agg(F.count("*").alias("n_cells")).select(F.col(gene).alias(name), F.lower(gene).alias("_k"), "n_cells")
    out = seen(spatial, "gene").join(seen(reference, "reference_gene").drop("n_cells"), "_k").drop("_k")
    return out.select("gene", "reference_gene", "n_cells")


def density_priors(counts: DataFrame, cell: str = "ord", value: str = "n") -> DataFrame:
    """(cell, uniform_density, rna_density): 1 / cells, and the share of all counts."""
    t = counts.groupBy(cell).agg(F.sum(value).alias("_t"))
    whole = t.agg(F.count("*").alias("_n"), F.sum("_t").alias("_all"))
    return t.crossJoin(F.broadcast(whole)).select(cell, (1 / F.col("_n")).alias("uniform_density"), (F.col("_t") / F.col("_all")).alias("rna_density"))


def portable_hash(key: str) -> Column:
    """A scrambling of a number that any SQL engine computes alike."""
    return (F.col(key) * 2654435761) % 4294967296


def bags(df: DataFrame, key: str, size: int) -> DataFrame:
    """Rows dealt into bags of about ``size``: ``bag`` by a portable hash, so that a row's bag depends on no other row."""
    n = max(1, -(-df.count() // size))
    return df.withColumn("bag", F.floor(portable_hash(key) * n / F.lit(4294967296)).cast("int"))


def subsample(df: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` rows of the smallest hashes."""
    return df.orderBy(portable_hash(key), key).limit(n)


def parent_consistency(df: DataFrame, child: str, parent: str) -> DataFrame:
    """(child, n_parents) of children that don't have exactly one parent."""
    return df.groupBy(child).agg(F.countDistinct(parent).alias("n_parents")).where("n_parents <> 1")


def proportions(df: DataFrame, label: str) -> DataFrame:
    """(label, n, share)."""
    n = df.groupBy(label).agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("_all")))).select(label, "n", (F.col("n") / F.col("_all")).alias("share"))


def nearest_centroid(vectors: DataFrame, centroids: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, centroid, d2): the nearest of a bounded set of centroids; of equal ones the smallest number."""
    d = F.aggregate(F.zip_with(vector, "centre", lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x)
    pairs = vectors.select(key, vector).crossJoin(F.broadcast(centroids.select("centroid", "centre")))
    best = F.min(F.struct(F.round(d, 6).alias("d2"), "centroid")).alias("b")
    return pairs.groupBy(key).agg(best).select(key, F.col("b.centroid").alias("centroid"), F.col("b.d2").alias("d2"))


def kmeans(vectors: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", seed: int = 0) -> DataFrame:
    """(key, cluster) by MLlib's k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = vectors.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    return KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(v).transform(v).select(key, F.col("cluster").cast("int").alias("cluster"))


def pca(vectors: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, pc): the first ``k`` principal components."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = vectors.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    return PCA(k=k, inputCol="features", outputCol="p").fit(v).transform(v).select(key, vector_to_array("p").alias("pc"))


def propagate_labels(edges: DataFrame, nodes: DataFrame, rounds: int = 10) -> DataFrame:
    """(node, cluster) by label propagation on a graph: each node takes the label most of its neighbours have.

    A substitute for community detection that needs a graph library; ties go to the smallest label.
    """
    from .storage import written

    label = nodes.select("node", F.col("node").alias("cluster"))
    for _ in range(rounds):
        votes = edges.join(label.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node"), "cluster").agg(F.count("*").alias("v"))
        best = votes.groupBy("node").agg(F.max(F.struct("v", (-F.col("cluster")).alias("c"))).alias("b")).select("node", (-F.col("b.c")).alias("new"))
        new = written(label.join(best, "node", "left").select("node", F.coalesce("new", "cluster").alias("cluster")), "labels")
        same = new.join(label.withColumnRenamed("cluster", "before"), "node").where("cluster <> before").isEmpty()
        label = new
        if same:
            break
    return label
