"""Folders of instruments and of outside programs, written by hand."""

import gzip
import json

import pytest

from plexgrid.__main__ import main
from plexgrid.sources import readers, tools


def square(x, y, side):
    return [[x, y], [x + side, y], [x + side, y + side], [x, y + side], [x, y]]


def test_fields_with_polygons_and_counts(spark, tmp_path):
    put = lambda name, text: (tmp_path / f"R5{name}").write_text(text)
    put("_tx_file.csv", "fov,cell_ID,x_global_px,y_global_px,x_local_px,y_local_px,target\n1,0,10,10,0,0,A\n1,2,20,10,10,0,B\n2,1,110,10,0,0,A\n")
    put("_fov_positions_file.csv", "fov,x_global_px,y_global_px\n1,10,50\n2,110,50\n")
    put("-polygons.csv", "fov,cellID,x_local_px,y_local_px,x_global_px,y_global_px\n" + "".join(f"{f},{c},{x},{y},{x + 100 * f - 90},{y + 10}\n" for f, c in ((1, 2), (2, 1)) for x, y in ((0, 0), (6, 0), (6, 6), (0, 6))))
    put("_metadata_file.csv", "fov,cell_ID,Area\n1,2,36\n2,1,36\n")
    put("_exprMat_file.csv", "fov,cell_ID,A,B\n1,0,5,5\n1,2,0,3\n2,1,4,0\n")
    d = readers.cosmx(spark, str(tmp_path), shape=(40, 100))
    # polygons begin below the positions, so these are the fields' upper edges: ymin is 10
    assert [(r["fov"], r["ymin"], r["x_offset"], r["y_offset"]) for r in d.elements["tables"]["fovs"].orderBy("fov").collect()] == [(1, 10.0, 0, 0), (2, 10.0, 100, 0)]
    cells = {r["cell"]: r for r in d.boundaries()[1].collect()}
    assert {k: (c["xmin"], c["ymin"], c["xmax"]) for k, c in cells.items()} == {1 * 3 + 2: (0.0, 0.0, 6.0), 2 * 3 + 1: (100.0, 0.0, 106.0)}
    assert cells[5]["xs"] == [0, 6, 6, 0] and cells[5]["ys"] == [0, 0, 6, 6]
    assert sorted(map(tuple, d.elements["tables"]["counts"].collect())) == [(5, "B", 3), (7, "A", 4)]
    assert [r["global_cell_id"] for r in d.elements["points"]["transcripts"].orderBy("x_global_px").collect()] == [0, 5, 7]
    one = readers.cosmx(spark, str(tmp_path), "R5", fov=2)
    assert [(r["cell"], r["xmax"]) for r in one.boundaries()[1].collect()] == [(1, 6.0)]
    put("_metadata_file.csv", "fov,cell_ID,Area\n1,2,36\n2,9,36\n")
    with pytest.raises(ValueError, match="largest"):
        readers.cosmx(spark, str(tmp_path))
    put("_metadata_file.csv", "fov,cell_ID,Area\n1,2,36\n2,2,36\n")
    with pytest.raises(ValueError, match="same cells"):
        readers.cosmx(spark, str(tmp_path))


def test_names_in_descriptions():
    told = '{"ChannelOrder": "BXG", "a": [{"ChannelId": "G", "BiologicalTarget": "PanCK/x", "q": 1}, {"ChannelId": "B", "BiologicalTarget": "DNA", "q": 1}]}'
    assert readers.morphology_channels(told) == ["DNA", "X", "PanCK.x"]
    assert readers.protein_channel('{"DisplayName": "CD3/e", "z": 0}') == "CD3.e"
    assert readers.fov_file(["a_F0012.TIF", "a_F112.tif", "a_F2.tif"], 12) == "a_F0012.TIF"
    for wrong in (lambda: readers.morphology_channels(""), lambda: readers.protein_channel(""), lambda: readers.fov_file([], 1), lambda: readers.fov_file(["a_F1.tif", "b_F01.tif"], 1)):
        with pytest.raises(ValueError):
            wrong()


@pytest.mark.parametrize("parts", [True, False])
def test_expected_counts(spark, tmp_path, parts):
    zipped = lambda name, text: (tmp_path / name).write_bytes(gzip.compress(text.encode()))
    zipped("cell-metadata.csv.gz", "cell,volume\n7,1.5\n3,2.5\n")
    zipped("expected-counts.csv.gz", "g.1,g2\n0,2.5\n1,0\n")
    rings = {7: [[square(0, 0, 1)], [square(5, 5, 3)]], 3: [[square(9, 9, 2)]]} if parts else {7: [square(5, 5, 3)], 3: [square(9, 9, 2)]}
    zipped("cell-polygons.geojson.gz", json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"cell": k}, "geometry": {"type": "x", "coordinates": v}} for k, v in rings.items()]}))
    out = tools.proseg(spark, str(tmp_path))
    assert sorted(map(tuple, out["counts"].collect())) == [(3, "g.1", 1.0), (7, "g2", 2.5)]
    assert {r["cell"]: (r["xmin"], r["xmax"]) for r in out["shapes"].collect()} == {7: (5, 8), 3: (9, 11)}
    assert sorted(r["volume"] for r in out["cells"].collect()) == [1.5, 2.5]
    zipped("expected-counts.csv.gz", "g.1,g2\n0,2.5\n")
    with pytest.raises(ValueError, match="cells"):
        tools.proseg(spark, str(tmp_path))


def test_options_from_columns():
    assert tools.proseg_options(["x", "fov_name", "qv", "CellComp"]) == "--fov-column fov_name --qv-column qv --min-qv 20.0 --compartment-column CellComp --compartment-nuclear Nuclear"
    assert tools.proseg_options(["qv", "overlaps_nucleus"], "--min-qv 5 --compartment-column k") == "--min-qv 5 --compartment-column k --qv-column qv"
    assert tools.proseg_options(["x"]) == ""


def test_patch_of_molecules(spark, tmp_path):
    cells = [{"type": "Polygon", "cell": c, "coordinates": [r]} for c, r in (("c-1", square(0, 0, 4)), ("c-2", square(5, 5, 1)), ("c-3", [[0, 0], [1, 1], [0, 0]]))]
    (tmp_path / "segmentation_polygons_2d.json").write_text(json.dumps({"type": "GeometryCollection", "geometries": cells}))
    (tmp_path / "segmentation.csv").write_text("gene,cell,is_noise\na,c-1,false\na,c-1,false\nb,c-1,true\na,c-2,false\nb,c-3,false\na,,false\n")
    out = tools.baysor(spark, str(tmp_path), min_area=2)
    assert [(r["cell"], r["area"]) for r in out["shapes"].collect()] == [("c-1", 16.0)]
    assert sorted(map(tuple, out["counts"].collect())) == [("c-1", "a", 2)]
    with pytest.raises(FileNotFoundError):
        tools.baysor(spark, str(tmp_path.parent))


def test_segment_and_resolve_commands(spark, tmp_path):
    pixels = spark.range(60 * 60).selectExpr("'DAPI' AS c", "CAST(id DIV 60 AS INT) AS y", "CAST(id % 60 AS INT) AS x", "CAST(id % 7 AS INT) AS value")
    pixels.write.parquet(str(tmp_path / "images" / "image"))
    assert main(["segment", str(tmp_path), "--method", "dummy", "--channels", "DAPI", "--width", "30", "--overlap", "0"], spark) == 0
    cells = spark.read.parquet(str(tmp_path / "shapes" / "cells"))
    assert sorted(r["ord"] for r in cells.collect()) == [0, 1, 2, 3]
    assert main(["resolve", str(tmp_path)], spark) == 0
    assert spark.read.parquet(str(tmp_path / "shapes" / "cells_resolved")).count() == 4
