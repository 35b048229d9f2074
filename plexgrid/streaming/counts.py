"""Transcript counts over a stream of points: the same plan, kept up as points arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import spatial
from ..operators.aggregate import kept_points


def stream_counts(points: DataFrame, cells: DataFrame, pattern: str | None = T.EXCLUDED, exact=None, watermark: tuple[str, str] | None = None, window: str | None = None) -> DataFrame:
    """Counts by cell and gene (and window of event time) of a stream of points over static cells."""
    keep = ["x", "y", "gene"]
    if watermark:
        points = points.withWatermark(*watermark)
        keep.append(watermark[0])
    hits = spatial.points_in_shapes(kept_points(points, "gene", pattern).select(*keep), cells.select("ord", "xs", "ys", "xmin", "ymin", "xmax", "ymax"), exact)
    by = ["ord", "gene"]
    if watermark and window:
        by = [F.window(watermark[0], window).alias("window"), *by]
    return hits.groupBy(*by).agg(F.count("*").alias("n"))


def event_windows(events: DataFrame, ts: str = "ts", size: str = "1 hour", late: str = "10 minutes", key: str = "event_type", value: str = "value") -> DataFrame:
    """Tumbling windows of events by kind: count and sum; batch or stream."""
    e = events.withWatermark(ts, late) if events.isStreaming else events
    return e.groupBy(F.window(ts, size).alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
