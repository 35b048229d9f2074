"""Numpy kernels for what columns can't express, and their use on DataFrames."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame

from .overlay import PREDICATES, area_of, intersection, is_convex, relation
from .polygons import clip_area, rings_intersect

# executors need not have the package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _rings(shapes) -> list[list]:
    """The rings of an Arrow array of shapes."""
    return [list(zip(x, y, strict=True)) for x, y in zip(shapes.field("xs").to_pylist(), shapes.field("ys").to_pylist(), strict=True)]


def filter_pairs(pairs: DataFrame, predicate: str = "intersects") -> DataFrame:
    """Pairs (a, b) whose rings have a relation. Arrow batches, a pair at a time."""
    test = PREDICATES[predicate]

    def holds(x, y):
        return rings_intersect(x, y) if predicate == "intersects" else test(relation(x, y))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            keep = [holds(x, y) for x, y in zip(_rings(b["a"]), _rings(b["b"]), strict=True)]
            yield b.filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(run, pairs.schema)


def with_ratios(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) with ``ratio``: what the rings of each pair share, of the left one's area."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    def share(x, y):
        return (clip_area(x, y) if is_convex(y) else area_of(intersection([x], [y]))) / max(clip_area(x), 1e-300)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            ratio = [share(x, y) for x, y in zip(_rings(b["a"]), _rings(b["b"]), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ratio, pa.float64())], [*b.schema.names, "ratio"])

    return pairs.mapInArrow(run, StructType([*pairs.schema.fields, StructField("ratio", DoubleType())]))
