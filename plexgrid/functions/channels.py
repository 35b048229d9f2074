"""Channels of images: colours, levels, presets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The viewer's colours for channels without a wavelength, and the channels that it knows.
COLORS = (400, 500, 600, 700)
KNOWN_CHANNELS = ("DAPI", "DNA1", "DNA2", "DAPI (000)")
KNOWN_COLOR = "white"
# The objectives that a resolution is compared with.
OBJECTIVES = (80, 40, 20, 10, 5)


def channel_labels(channels: DataFrame, name: str = "name", position: str = "position", image: list[str] | None = None, out: str = "label") -> DataFrame:
    """``channels`` with the name that gives the viewer a colour.

    A name with three digits alone is a wavelength already and stays. Known
    nuclear channels are white. The others, in order, share the wavelengths from
    the longest to the shortest evenly. ``image`` names the columns of an image.
    """
    from .text import wavelength

    of_image = Window.partitionBy(*(image or []))
    c = channels.withColumn("_free", wavelength(name).isNull() & ~F.col(name).isin(*KNOWN_CHANNELS))
    free = F.sum(F.col("_free").cast("int"))
    c = c.withColumns({"_share": F.ceil(free.over(of_image) / len(COLORS)), "_turn": free.over(of_image.orderBy(position).rowsBetween(Window.unboundedPreceding, 0)) - 1})
    color = F.element_at(F.array(*(F.lit(v) for v in reversed(COLORS))), (F.floor(F.col("_turn") / F.col("_share")) + 1).cast("int"))
    named = lambda v: F.concat(F.col(name), F.lit(" (color="), v.cast("string"), F.lit(")"))
    label = F.when(wavelength(name).isNotNull(), F.col(name)).when(F.col(name).isin(*KNOWN_CHANNELS), named(F.lit(KNOWN_COLOR))).otherwise(named(color))
    return c.withColumn(out, label).drop("_free", "_share", "_turn")


def nearest_objective(mpp: float) -> int:
    """The objective power whose usual resolution, ten over the power in microns a pixel, is nearest."""
    return min(OBJECTIVES, key=lambda k: abs(10 / k - mpp))


def best_level(downsamples: list[float], downsample: float) -> int:
    """The coarsest level that is at least as fine as ``downsample``; the finest if even that is finer than any."""
    fine_enough = [k for k, d in enumerate(downsamples) if d <= max(downsample, 1.0)]
    return fine_enough[-1] if fine_enough and downsample > 1 else 0


def level_for_magnification(magnification: float, downsamples: list[float], objective_power: float | None = None, mpp: float | None = None) -> tuple[int, float]:
    """The level to read for a magnification, and the factor by which its tiles must still shrink.

    The objective power is that of the slide, else the one nearest to ``mpp``
    microns a pixel. A magnification beyond it reads the finest level, enlarged.
    """
    if not objective_power and not mpp:
        raise ValueError("neither an objective power nor a resolution is known")
    downsample = (int(objective_power) if objective_power else nearest_objective(float(mpp))) / magnification
    level = best_level(downsamples, downsample)
    return level, downsamples[level] / downsample


def preset_for(columns: set[str]) -> str | None:
    """The instrument that a transcript table's columns tell of, or None."""
    if {"qv", "feature_name"} <= columns or {"qv", "cell_id", "overlaps_nucleus"} <= columns:
        return "xenium"
    if {"fov", "cell_ID", "target"} <= columns or {"CellComp"} <= columns:
        return "cosmx"
    if {"barcode_id", "global_x"} <= columns or {"transcript_id", "barcode_id"} <= columns:
        return "merscope"
    return None


def intensities(tables: dict):
    """The table of intensities: None if none were aggregated, beside counts or alone."""
    return tables.get("intensities")
