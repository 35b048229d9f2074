"""Outside tools and models behind contracts: commands by patch, scores by cell, mappings by bag."""

from __future__ import annotations

import shutil
import subprocess
import sys
import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class ToolFailed(RuntimeError):
    """An outside command that ended with an error; its last words are the message."""


def run_tool(assigned: DataFrame, command: list[str], columns: list[str], read: Callable[[Path], list[tuple]], schema: str, force: bool = False) -> DataFrame:
    """Runs ``command`` on each patch's transcripts and returns what ``read`` makes of its folder.

    Each patch's rows are written as transcripts.csv in a folder of the task's
    own, which is gone afterwards; ``{folder}`` in the command is that folder.
    ``read`` returns rows of ``schema`` without the patch, which comes first.
    With ``force`` a patch whose command fails gives no rows. A patch has a
    bounded extent, so a group is bounded as transcripts by area are.
    """

    def run(pdf):
        import pandas as pd

        patch = int(pdf["patch_id"].iloc[0])
        folder = Path(tempfile.mkdtemp())
        names = ["patch_id", *(f.split()[0] for f in schema.split(","))]
        try:
            pdf[columns].to_csv(folder / "transcripts.csv", index=False)
            done = subprocess.run([a.replace("{folder}", str(folder)) for a in command], cwd=folder, capture_output=True, text=True)
            if done.returncode:
                if force:
                    return pd.DataFrame(columns=names)
                raise ToolFailed(f"patch {patch}: {done.stderr[-500:]}")
            return pd.DataFrame([(patch, *r) for r in read(folder)], columns=names)
        finally:
            shutil.rmtree(folder, ignore_errors=True)

    return assigned.select("patch_id", *columns).groupBy("patch_id").applyInPandas(run, f"patch_id long, {schema}")


#: Commands of known tools; users set paths and options. Fixed values of their command lines.
TOOLS = {
    "baysor": ["baysor", "run", "{folder}/transcripts.csv", "-o", "{folder}", "--polygon-format", "GeometryCollectionLegacy"],
    "proseg": ["proseg", "{folder}/transcripts.csv"],
    "comseg": ["comseg", "{folder}/transcripts.csv"],
}


def baysor_config(scale: float | None = None, min_molecules: int = 10) -> dict:
    """A default configuration: thresholds on molecules a cell, and a scale if it is known."""
    out: dict = {"data": {"x": "x", "y": "y", "gene": "gene", "min_molecules_per_cell": min_molecules}, "segmentation": {"prior_segmentation_confidence": 0.8}}
    if scale is not None:
        out["segmentation"] |= {"scale": scale, "scale_std": "25%"}
    else:
        out["data"]["min_molecules_per_cell"] = 2 * min_molecules
    return out


def comseg_config(cells: DataFrame) -> dict:
    """Diameters from the mean radius of prior cells; distances 1.75 times that."""
    d = 2 * float(cells.agg(F.avg(F.sqrt(G.area() / F.pi()))).first()[0] or 0.0)
    return {"mean_cell_diameter": d, "max_cell_radius": d * 1.75}


def marker_scores(pixels: DataFrame, cells: DataFrame, model: Callable, channels: list[str], known: set[str] | None = None) -> DataFrame:
    """(ord, channel, score) by a model of the user's, called with each cell's pixels: (channels, list of values) to one score a channel."""
    unknown = set(channels) - known if known else set()
    if unknown:
        raise ValueError(f"the model does not know {sorted(unknown)}")
    from .spatial import points_in_shapes

    p = pixels.where(F.col("c").isin(channels)).withColumns({"x": F.col("x").cast("double"), "y": F.col("y").cast("double")})
    hits = points_in_shapes(p, cells.select("ord", "xs", "ys", "xmin", "ymin", "xmax", "ymax"))

    def run(pdf):
        import pandas as pd

        values = [pdf.loc[pdf["c"] == c, "value"].to_numpy() for c in channels]
        return pd.DataFrame({"ord": int(pdf["ord"].iloc[0]), "channel": channels, "score": [float(s) for s in model(channels, values)]})

    return hits.select("ord", "c", "value").groupBy("ord").applyInPandas(run, "ord long, channel string, score double")


def map_bags(counts: DataFrame, reference: DataFrame, mapper: Callable, bag_size: int = 10_000, max_reference: int = 10_000, cell: str = "ord") -> DataFrame:
    """(cell, label, value): annotation by a mapper of the user's, a bag of cells at a time against a bounded reference.

    ``reference`` (cell, label, gene, n) is cut to at most ``max_reference``
    cells by hash; ``mapper(bag, reference)`` gets pandas tables and returns
    (cell, label, value) rows.
    """
    from .annotate import bags, shared_genes

    genes = shared_genes(counts, reference)
    if genes.isEmpty():
        raise ValueError("no gene is shared")
    ids = reference.select("cell").distinct().orderBy(F.xxhash64("cell")).limit(max_reference)
    ref = reference.join(F.broadcast(ids), "cell").join(F.broadcast(genes.select(F.col("reference_gene").alias("gene"))), "gene").toPandas()
    bag = bags(counts.select(cell).distinct(), cell, bag_size)
    kind = dict(counts.dtypes)[cell]
    rows = counts.join(genes.select("gene"), "gene").join(bag, cell)
    return rows.groupBy("bag").applyInPandas(lambda pdf: mapper(pdf, ref), f"{cell} {kind}, label string, value double")


def multi_level(counts: DataFrame, reference: DataFrame, levels: list[str], mapper: Callable, cell: str = "ord", **options) -> DataFrame:
    """Annotation by levels, coarse to fine: cells of a label are mapped only to that label's parts."""
    from ..functions.stats import hard_labels
    from .annotate import parent_consistency

    out = None
    for depth, level in enumerate(levels):
        if depth and not parent_consistency(reference.select(level, levels[depth - 1]).distinct(), level, levels[depth - 1]).isEmpty():
            raise ValueError(f"a label of {level} has several parents")
        groups = [None] if depth == 0 else [r[0] for r in reference.select(levels[depth - 1]).distinct().collect()]
        labels = None
        for g in groups:
            ref = reference if g is None else reference.where(F.col(levels[depth - 1]) == g)
            own = counts if g is None else counts.join(out.where(F.col(levels[depth - 1]) == g).select(cell), cell, "left_semi")
            if own.isEmpty():
                continue
            scores = map_bags(own, ref.withColumn("label", F.col(level)), mapper, cell=cell, **options).withColumn("pos", F.xxhash64("label"))
            part = hard_labels(scores, cell).select(cell, F.col("label").alias(level))
            labels = part if labels is None else labels.unionByName(part)
        out = labels if out is None else out.join(labels, cell, "left")
    return out


def preprocess(counts: DataFrame, n_cells: int, hvg: int | None = None, components: int = 20, cell: str = "ord") -> dict[str, DataFrame]:
    """Normalised counts, variable genes and principal components; ``hvg`` is ignored up to 50 genes."""
    from ..functions.stats import hvg_dispersion, normalize_log1p
    from .annotate import pca

    norm = normalize_log1p(counts, cell)
    genes = counts.select("gene").distinct()
    out = {"normalized": norm}
    if hvg and genes.count() > 50:
        chosen = hvg_dispersion(norm, n_cells).orderBy(F.desc("dispersion"), "gene").limit(hvg)
        out["hvg"] = chosen
        norm = norm.join(F.broadcast(chosen.select("gene")), "gene")
    names = [r["gene"] for r in norm.select("gene").distinct().orderBy("gene").collect()]
    m = norm.groupBy(cell).agg(F.map_from_entries(F.collect_list(F.struct("gene", "value"))).alias("_m"))
    v = m.select(cell, F.transform(F.array(*(F.lit(g) for g in names)), lambda g: F.coalesce(F.element_at("_m", g), F.lit(0.0))).alias("vector"))
    out["pca"] = pca(v, min(components, len(names)), cell, "vector")
    return out
