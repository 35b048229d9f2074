"""Image files, outside tools, and the command line."""

import json
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from plexgrid.__main__ import main
from plexgrid.operators import external, tiling
from plexgrid.operators.aggregate import count_transcripts
from plexgrid.sources import images, readers, tiff

IMAGE = np.random.default_rng(0).integers(0, 60_000, (3, 37, 53)).astype(np.uint16)


@pytest.mark.parametrize("deflate", [True, False])
def test_tiff_round_trip(deflate):
    assert (tiff.read(tiff.write(IMAGE, deflate)) == IMAGE).all()
    with pytest.raises(tiff.UnsupportedImage):
        tiff.read(b"no image at all")


def test_image_readers(spark, tmp_path):
    (tmp_path / "a.tif").write_bytes(tiff.write(IMAGE))
    got = images.ome_tif(spark, str(tmp_path / "a.tif"), ["x", "y", "z"]).toPandas()
    back = np.zeros_like(IMAGE)
    back[got["c"].map({"x": 0, "y": 1, "z": 2}), got["y"], got["x"]] = got["value"]
    assert (back == IMAGE).all()
    folder = tmp_path / "m"
    folder.mkdir()
    for k, n in enumerate(["1_A-CD3_C-x", "2_A-CD3_C-y", "3_A-CD4_C-z"]):
        (folder / f"{n}.tif").write_bytes(tiff.write(IMAGE[k : k + 1]))
    names = {r["c"] for r in images.macsima(spark, str(folder)).select("c").distinct().collect()}
    assert names == {"CD3", "CD3 (1)", "CD4"}
    assert images.hyperion(spark, str(folder)).agg(F.max("value")).first()[0] == 255
    tiles = images.tiles(spark, str(tmp_path / "a.tif"), tile=32)
    assert tiles.count() == 12 and images.pixels(tiles, 32).count() == IMAGE.size
    half = images.pyramid(images.ome_tif(spark, str(tmp_path / "a.tif")), 1)[1]
    assert half.where("c = '0' AND y = 0 AND x = 0").first()["value"] == IMAGE[0, :2, :2].astype(int).sum() // 4


def test_tools_by_patch(spark):
    p = spark.createDataFrame([(float(k), 0.0, "g") for k in range(10)], "x double, y double, gene string")
    assigned = tiling.in_patches(p, *tiling.transcript_axes(p, 5, 1))
    count = [sys.executable, "-c", "n = sum(1 for _ in open('transcripts.csv')) - 1; open('out.txt', 'w').write(str(n))"]
    got = external.run_tool(assigned, count, ["x", "y", "gene"], lambda f: [(int((f / "out.txt").read_text()),)], "n int")
    want = {r["patch_id"]: r["count"] for r in assigned.groupBy("patch_id").count().collect()}
    assert want and {r["patch_id"]: r["n"] for r in got.collect()} == want
    bad = [sys.executable, "-c", "raise SystemExit('no')"]
    assert external.run_tool(assigned, bad, ["x"], lambda f: [], "n int", force=True).count() == 0
    with pytest.raises(Exception, match="ToolFailed"):
        external.run_tool(assigned, bad, ["x"], lambda f: [], "n int").collect()


def test_models(spark):
    d = readers.toy(spark, side=3, per_cell=20)
    cells = d.boundaries()[1]
    pixels = spark.range(100).select(F.lit("a").alias("c"), (F.col("id") * 7 % 2048).cast("int").alias("y"), (F.col("id") * 11 % 2048).cast("int").alias("x"), F.lit(3).alias("value"))
    scores = external.marker_scores(pixels, cells, lambda names, values: [len(v) for v in values], ["a"])
    assert {r["channel"] for r in scores.collect()} <= {"a"}
    with pytest.raises(ValueError):
        external.marker_scores(pixels, cells, None, ["a"], {"b"})
    counts = count_transcripts(d.get("points")[1], cells).cache()
    ref = spark.createDataFrame([(k, "AB"[k % 2], "AB"[k % 2] + str(k % 4), f"gene_{k % 5}", 1) for k in range(40)], "cell long, top string, fine string, gene string, n long")

    def mapper(bag, reference):
        import pandas as pd

        labels = sorted(reference["label"].unique())
        return pd.DataFrame([(o, x, float((hash((int(o), x)) % 97) / 97)) for o in bag["ord"].unique() for x in labels], columns=["ord", "label", "value"])

    out = external.multi_level(counts, ref, ["top", "fine"], mapper).collect()
    assert len(out) == 9 and all(r["fine"].startswith(r["top"]) for r in out)
    prep = external.preprocess(counts, 9)
    assert prep["pca"].count() == 9
    assert external.comseg_config(cells)["mean_cell_diameter"] > 0 and external.baysor_config(2.0)["segmentation"]["scale"] == 2.0


def test_command_line(spark, tmp_path, capsys):
    s = str(tmp_path / "store")
    run = lambda *a: main([a[0], s, *a[1:]], spark)
    run("convert", "--technology", "toy")
    run("aggregate")
    run("patchify", "--width", "500", "--overlap", "50")
    run("resolve")
    run("overlay", "--old", "cells", "--new", "cells")
    run("preprocess")
    run("explorer", "--output", str(tmp_path / "x"), "--mode", "+bc")
    run("report")
    said = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert said[0]["polygons"] == 400 and said[-1]["n_cells"] == 400


def test_small_helpers(spark, tmp_path):
    from plexgrid.functions import channels
    from plexgrid.model import Dataset
    from plexgrid.sources import sinks

    level = lambda m, **k: channels.level_for_magnification(m, [1, 2.5, 6, 20], **k)
    assert level(8, objective_power=64) == (2, 6 / 8) and level(64, objective_power=64) == (0, 1.0)
    assert level(100, objective_power=50) == (0, 2.0) and level(1, objective_power=60) == (3, 20 / 60)
    assert level(7, mpp=0.26) == (1, 2.5 / (40 / 7))
    with pytest.raises(ValueError):
        level(5)
    assert channels.nearest_objective(0.11) == 80 and channels.nearest_objective(9) == 5 and channels.preset_for({"fov", "cell_ID", "target"}) == "cosmx"
    names = ["CD8", "DAPI", "405nm", "Ki67", "KRT", "SMA", "DAPI (000)", "PanCK", "dapi", "CD45"]
    df = spark.createDataFrame([("one", k, n) for k, n in enumerate(names)] + [("two", 0, "CD8")], "image string, k int, n string")
    got = [r["label"] for r in channels.channel_labels(df, "n", "k", ["image"]).orderBy("image", "k").collect()]
    # seven of the first image's channels have no colour: two of each wavelength from 700 on
    colors = ["700", "white", None, "700", "600", "600", None, "500", "500", "400"]
    assert got == [n if c is None else f"{n} (color={c})" for n, c in zip(names, colors, strict=True)] + ["CD8 (color=700)"]
    assert "<td>a, b</td>" in sinks.report_html({"low_count_genes": ["a", "b"]})
    d = Dataset()
    d.add("images", "i", df)
    sinks.align(d, "i", [[1, 0, 10], [0, 1, 20], [0, 0, 1]])
    assert d.transforms["i"]["global"].matrix == (1, 0, 10, 0, 1, 20)
    (tmp_path / "s.csv").write_text("#a\n#b\nX,Y\n0,0\n1,0\n0,1\n")
    assert sinks.add_selection(d, str(tmp_path / "s.csv")).count() == 1
