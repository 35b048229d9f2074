"""Command line: ``python -m plexgrid <command> ...`` on stores of Parquet folders.

Commands: convert, patchify, segment, resolve, aggregate, overlay, annotate, preprocess, explorer, report.
"""

from __future__ import annotations

import argparse
import json
import sys

from .operators import aggregate as A
from .sources import readers, sinks


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="plexgrid", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, help: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=help)
        c.add_argument("store", help="folder with points/, shapes/, images/, tables/")
        return c

    c = command("convert", "read an instrument's output into a store")
    c.add_argument("--technology", required=True, choices=["xenium", "merscope", "cosmx", "molecular_cartography", "visium_hd", "toy"])
    c.add_argument("--input", default="")
    c.add_argument("--dataset", default="")
    c = command("aggregate", "count points or pixels by cell")
    c.add_argument("--cells", default="cells")
    c.add_argument("--points", default="transcripts")
    c.add_argument("--image")
    c.add_argument("--min-transcripts", type=int, default=0)
    c.add_argument("--min-intensity-ratio", type=float, default=0.0)
    c.add_argument("--expand-radius-ratio", type=float)
    c = command("patchify", "tile points into overlapping patches")
    c.add_argument("--points", default="transcripts")
    c.add_argument("--width", type=float, required=True)
    c.add_argument("--overlap", type=float, default=0)
    c.add_argument("--min-points", type=int, default=0)
    c = command("segment", "find cells in patches of an image")
    c.add_argument("--image", default="image")
    c.add_argument("--method", required=True, choices=["dummy", "cellpose", "stardist"])
    c.add_argument("--channels", nargs="+", required=True)
    c.add_argument("--diameter", type=float, default=35)
    c.add_argument("--model")
    c.add_argument("--width", type=float, default=2000)
    c.add_argument("--overlap", type=float, default=50)
    c.add_argument("--min-area", type=float)
    c = command("resolve", "merge cells of several patches that overlap")
    c.add_argument("--cells", default="cells")
    c.add_argument("--threshold", type=float, default=0.5)
    c = command("overlay", "lay one segmentation over another")
    c.add_argument("--old", required=True)
    c.add_argument("--new", required=True)
    c.add_argument("--threshold", type=float, default=0.25)
    c = command("annotate", "name cells by their highest marker")
    c.add_argument("--markers", required=True, help="JSON from channel to cell type")
    c = command("preprocess", "normalise counts and project them")
    c.add_argument("--hvg", type=int)
    c = command("explorer", "write viewer tables")
    c.add_argument("--cells", default="cells")
    c.add_argument("--output", required=True)
    c.add_argument("--mode")
    c = command("report", "quality figures as JSON")
    c.add_argument("--cells", default="cells")
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    args = parser().parse_args(argv)
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("plexgrid").getOrCreate()
    path = args.store.rstrip("/")
    read = lambda kind, name: spark.read.parquet(f"{path}/{kind}/{name}")
    put = lambda df, kind, name: df.write.mode("overwrite").parquet(f"{path}/{kind}/{name}")
    if args.command == "convert":
        how = {"xenium": lambda: readers.xenium(spark, args.input), "merscope": lambda: readers.merscope(spark, args.input), "cosmx": lambda: readers.cosmx(spark, args.input, args.dataset or None), "molecular_cartography": lambda: readers.molecular_cartography(spark, args.input), "visium_hd": lambda: readers.visium_hd(spark, args.input), "toy": lambda: readers.toy(spark)}
        sinks.write_store(how[args.technology](), path)
    elif args.command == "aggregate":
        points = None if args.points == "none" else read("points", args.points)
        out = A.aggregate(read("shapes", args.cells), points, pixels=read("images", args.image) if args.image else None, min_transcripts=args.min_transcripts, min_intensity_ratio=args.min_intensity_ratio, expand_radius_ratio=args.expand_radius_ratio)
        for name, df in out.items():
            put(df, "tables", {"cells": "table"}.get(name, name))
    elif args.command == "patchify":
        from .operators import tiling

        points = read("points", args.points)
        axes = tiling.transcript_axes(points, args.width, args.overlap)
        assigned = tiling.in_patches(points, *axes)
        put(tiling.patches(spark, *axes).join(tiling.valid_patches(assigned, args.min_points), "patch_id", "left_semi"), "shapes", "patches")
        put(assigned, "points", f"{args.points}_patches")
    elif args.command == "segment":
        from pyspark.sql import functions as F

        from .functions.geometry import with_bounds
        from .operators import models, staining, tiling
        from .operators.storage import ordinals

        image = read("images", args.image)
        w, h = image.agg(F.max("x") + 1, F.max("y") + 1).first()
        chosen = {"model_type": args.model} if args.model else {}
        method = {"dummy": lambda: "dummy", "cellpose": lambda: models.cellpose(args.diameter, args.channels, **chosen), "stardist": lambda: models.stardist(**chosen)}[args.method]()
        least = args.min_area if args.min_area is not None else models.default_min_area(args.diameter) if args.method == "cellpose" else 0.0
        found = staining.segment(image, tiling.image_patches(spark, w, h, args.width, args.overlap), method, args.channels, least)
        put(with_bounds(ordinals(found, ["patch_id", "k"], "ord")), "shapes", "cells")
    elif args.command == "resolve":
        from .operators.resolve import solve_conflicts

        cells = read("shapes", args.cells)
        put(solve_conflicts(cells, args.threshold, "polygon", "patch_id" if "patch_id" in cells.columns else None), "shapes", f"{args.cells}_resolved")
    elif args.command == "overlay":
        put(A.overlay_segmentation(read("shapes", args.old), read("shapes", args.new), threshold=args.threshold, exact="polygon")["cells"], "shapes", f"{args.old}_overlay_{args.new}")
    elif args.command == "annotate":
        from .functions.stats import higher_z_score

        put(higher_z_score(read("tables", "intensities"), json.loads(args.markers), cell="ord"), "tables", "cell_types")
    elif args.command == "preprocess":
        from .operators.external import preprocess

        n = read("tables", "table").count()
        for name, df in preprocess(read("tables", "counts"), n, args.hvg).items():
            put(df, "tables", name)
    elif args.command == "explorer":
        from .model import Dataset

        data = Dataset()
        data.add("points", "transcripts", read("points", "transcripts"), "transcripts")
        print(json.dumps(sinks.explorer(data, read("tables", "counts"), read("shapes", args.cells), args.output, args.mode)))
    elif args.command == "report":
        table = read("tables", "table")
        print(json.dumps(sinks.report(table, read("tables", "counts"), table.count())))
    return 0


if __name__ == "__main__":
    sys.exit(main())
