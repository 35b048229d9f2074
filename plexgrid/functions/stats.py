"""Normalisations and scores over long tables (cell, feature, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.storage import quantiles


def log1p_tpm(df: DataFrame, by: str = "cell", value: str = "n", out: str = "log_tpm") -> DataFrame:
    """log(1 + parts per million of the row's total)."""
    total = F.sum(value).over(Window.partitionBy(by))
    return df.withColumn(out, F.log1p(F.col(value) / (total + 1e-8) * 1e6))


def normalize_log1p(df: DataFrame, by: str = "cell", value: str = "n", out: str = "value") -> DataFrame:
    """Counts scaled to the median total of cells that have counts, then log(1 + x)."""
    totals = df.groupBy(by).agg(F.sum(value).alias("_total")).where("_total > 0")
    target = quantiles(totals, "_total", 0.5, out="_target")
    return df.join(totals, by).crossJoin(F.broadcast(target)).withColumn(out, F.log1p(F.col(value) / F.col("_total") * F.col("_target"))).drop("_total", "_target")


def fluorescence_scores(df: DataFrame, channel: str = "channel", value: str = "value", out: str = "z") -> DataFrame:
    """asinh of the value over five times the channel's 0.2 quantile (its largest value if that is 0), as z-score.

    The deviation is that of a sample. Statistics are taken by group and
    joined, so a channel's rows needn't meet in one task.
    """
    q = quantiles(df, value, 0.2, [channel], "_q").join(df.groupBy(channel).agg(F.max(value).alias("_m")), channel).withColumn("_d", 5 * F.col("_q"))
    q = q.select(channel, F.when(F.col("_d") == 0, F.col("_m")).otherwise(F.col("_d")).alias("_d"))
    turned = df.join(F.broadcast(q), channel).withColumn("_a", F.asinh(F.col(value) / F.col("_d")))
    stats = turned.groupBy(channel).agg(F.avg("_a").alias("_mean"), F.stddev_samp("_a").alias("_std"))
    return turned.join(F.broadcast(stats), channel).withColumn(out, (F.col("_a") - F.col("_mean")) / F.col("_std")).drop("_a", "_d", "_mean", "_std")


def highest(df: DataFrame, by: list[str], score: str, label: str, order: str, out: str = "label") -> DataFrame:
    """The label with the highest score of each group; of equal ones the first by ``order``."""
    best = F.max(F.struct(F.col(score).alias("s"), (-F.col(order)).alias("o"), F.col(label).alias("l")))
    return df.groupBy(*by).agg(best.alias("_b")).select(*by, F.col("_b.l").alias(out), F.col("_b.s").alias(score))


def higher_z_score(df: DataFrame, markers: dict[str, str], cell: str = "cell", channel: str = "channel", value: str = "value") -> DataFrame:
    """The cell type whose marker channel has the highest score; ``markers`` maps channel to type."""
    spark = df.sparkSession
    names = spark.createDataFrame([(c, t, i) for i, (c, t) in enumerate(markers.items())], f"{channel} string, cell_type string, _pos int")
    z = fluorescence_scores(df, channel, value).join(F.broadcast(names), channel)
    return highest(z, [cell], "z", "cell_type", "_pos", "cell_type")


def hvg_dispersion(df: DataFrame, n_cells: int | Column, gene: str = "gene", value: str = "value") -> DataFrame:
    """Mean, variance and dispersion of each gene over all cells, absent ones being zero."""
    n = F.lit(n_cells) if isinstance(n_cells, int) else n_cells
    sums = df.groupBy(gene).agg(F.sum(value).alias("_s"), F.sum(F.col(value) * F.col(value)).alias("_q"))
    mean = F.col("_s") / n
    variance = (F.col("_q") - F.col("_s") * F.col("_s") / n) / (n - 1)
    return sums.select(gene, mean.alias("mean"), variance.alias("variance"), (variance / mean).alias("dispersion"))


def clip_quantile_scale(df: DataFrame, channel: str = "c", value: str = "value", quantile: float | None = 0.99, out: str = "scaled") -> DataFrame:
    """Values over the channel's quantile (its maximum if none is given), clipped to 0..1, as integers 0..255."""
    if quantile is None:
        q = df.groupBy(channel).agg(F.max(value).cast("double").alias("_top"))
    else:  # pixels have few distinct values: counts of each are enough
        n = df.groupBy(channel, value).agg(F.count("*").alias("_n"))
        q = n.groupBy(channel).agg(F.percentile(value, quantile, F.col("_n")).cast("double").alias("_top"))
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(value) / F.col("_top")))
    return df.join(F.broadcast(q), channel).withColumn(out, F.floor(F.coalesce(share, F.lit(0.0)) * 255).cast("int")).drop("_top")


def scale_dtype(value: str, bits_from: int, bits_to: int) -> Column:
    """An unsigned integer rescaled to another width."""
    return F.floor(F.col(value) * (float(2**bits_to - 1) / float(2**bits_from - 1))).cast("long")


def otsu_threshold(df: DataFrame, value: str = "value", by: list[str] | None = None) -> DataFrame:
    """The value 0..255 that parts the histogram with the largest variance between both sides; the least if several do.

    Only the histogram, 256 rows a group, reaches the windows.
    """
    by = by or []
    h = df.groupBy(*by, F.col(value).cast("long").alias("v")).agg(F.count("*").alias("n"))
    upto = Window.partitionBy(*by).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    h = h.select(*by, "v", F.sum("n").over(upto).alias("w0"), F.sum(F.col("n") * F.col("v")).over(upto).alias("s0"), F.sum("n").over(whole).alias("w"), F.sum(F.col("n") * F.col("v")).over(whole).alias("s"))
    w1, gap = F.col("w") - F.col("w0"), F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / (F.col("w") - F.col("w0"))
    h = h.where("w > w0").withColumn("between", F.col("w0") * w1 * gap * gap)
    best = F.max(F.struct("between", (-F.col("v")).alias("v")))
    return h.groupBy(*by).agg(best.alias("b")).select(*by, (-F.col("b.v")).alias("threshold"))


def hard_labels(df: DataFrame, cell: str = "cell", label: str = "label", value: str = "value", order: str = "pos") -> DataFrame:
    """Scores clipped at each label's 0.95 quantile and scaled to 0..1 by label, then the highest label of each cell."""
    q = quantiles(df, value, 0.95, [label], "_q").join(df.groupBy(label).agg(F.min(value).alias("_min")), label)
    x = df.join(F.broadcast(q), label).withColumn("_x", F.least(value, "_q"))
    x = x.withColumn("_s", F.when(F.col("_q") > F.col("_min"), (F.col("_x") - F.col("_min")) / (F.col("_q") - F.col("_min"))).otherwise(F.lit(0.0)))
    return highest(x, [cell], "_s", label, order, label).withColumnRenamed("_s", "score")
