"""Spatial elements derived by arithmetic from the driver's tables, in Spark and as SQL.

All coordinates are small whole numbers, so both engines compute them alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.text import EXCLUDED

POINT_ID = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


class Elements:
    """Elements of one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def points(self) -> DataFrame:
        gene = F.when(F.col("l_linenumber") == 7, "BLANK_7").when(F.col("l_linenumber") == 6, F.lit(None).cast("string")).when(F.col("l_linenumber") == 5, "NegControl_5").otherwise(F.col("p_brand"))
        p = self.table("lineitem").join(self.table("part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
        y = ((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 50).cast("double")
        return p.select(*POINT_ID, F.col("l_quantity").alias("x"), y.alias("y"), gene.alias("gene"), (F.col("l_discount") > 0.09).alias("low_quality_transcript"))

    def _centres(self, dx: int = 0, dy: int = 0) -> DataFrame:
        k = F.col("s_suppkey")
        return self.table("supplier").select(k.alias("ord"), ((k * 13) % 48 + 1 + dx).cast("double").alias("cx"), ((k * 29) % 48 + 1 + dy).cast("double").alias("cy"), (1 + k % 3).cast("double").alias("r"))

    def _boxes(self, c: DataFrame) -> DataFrame:
        c = c.select("ord", (F.col("cx") - F.col("r")).alias("_a"), (F.col("cy") - F.col("r")).alias("_b"), (F.col("cx") + F.col("r")).alias("_c"), (F.col("cy") + F.col("r")).alias("_d"))
        return c.withColumns(G.box("_a", "_b", "_c", "_d")).drop("_a", "_b", "_c", "_d")

    def cells(self) -> DataFrame:
        return self._boxes(self._centres())

    def cells2(self) -> DataFrame:
        return self._boxes(self._centres(1, 2))

    def diamonds(self) -> DataFrame:
        c, x, y, r = self._centres(), F.col("cx"), F.col("cy"), F.col("r")
        return G.with_bounds(c.select("ord", F.array(x + r, x, x - r, x).alias("xs"), F.array(y, y + r, y, y - r).alias("ys")))

    def kept(self) -> DataFrame:
        from ..operators.aggregate import kept_points

        return kept_points(self.points())

    def bins(self) -> DataFrame:
        p = self.spark.range(2500)
        return p.select(F.col("id").cast("int").alias("bin_id"), (F.col("id") % 50 + 0.5).alias("x"), (F.floor(F.col("id") / 50) + 0.5).alias("y"))

    def bin_counts(self) -> DataFrame:
        b = (F.floor("y") * 50 + F.least(F.floor("x"), F.lit(49))).cast("int")
        return self.kept().groupBy(b.alias("bin_id"), "gene").agg(F.count("*").alias("n"))

    def image(self) -> DataFrame:
        li = self.table("lineitem")
        y = ((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 50).cast("int")
        return li.groupBy(F.col("l_linestatus").alias("c"), y.alias("y"), F.col("l_quantity").cast("int").alias("x")).agg(F.sum("l_linenumber").cast("int").alias("value"))

    def roi(self) -> DataFrame:
        k = F.col("r_regionkey")
        c = self.table("region").select(k.alias("roi"), (k * 10).cast("double").alias("xmin"), (k * 7).cast("double").alias("ymin"), (k * 10 + 8).cast("double").alias("xmax"), (k * 7 + 15).cast("double").alias("ymax"))
        return c

    def fovs(self) -> DataFrame:
        k = F.col("n_nationkey")
        return self.table("nation").select(k.alias("fov"), ((k % 5) * 10).cast("double").alias("x"), (F.floor(k / 5) * 10).cast("double").alias("y"))

    def nodes(self) -> DataFrame:
        k = F.col("n_nationkey")
        return self.table("nation").select(
            (F.col("n_regionkey") % 2).alias("lib"), k.cast("long").alias("node"), ((k * 37 + k * k * 3) % 101).cast("double").alias("x"), ((k * 53 + k * k * 7) % 97).cast("double").alias("y"),
            F.concat(F.lit("t"), (k % 3).cast("string")).alias("cell_type"), F.concat(F.lit("n"), F.floor(((k * 37 + k * k * 3) % 101) / 34).cast("string")).alias("niche"),
        )

    def intensities(self) -> DataFrame:
        """Whole-number sums by supplier as four channels."""
        s = self.table("lineitem").groupBy(F.col("l_suppkey").alias("cell")).agg(*(F.sum(e).cast("double").alias(c) for c, e in (("a", F.col("l_quantity")), ("b", F.col("l_linenumber").cast("double")), ("c", (F.col("l_orderkey") % 17).cast("double")), ("d", (F.col("l_partkey") % 23).cast("double")))))
        return s.unpivot(["cell"], ["a", "b", "c", "d"], "channel", "value")


GONE = f"coalesce(regexp_matches(gene, '(?i)^(?:{EXCLUDED})'), true)"
_cells = "SELECT s_suppkey AS ord, CAST((s_suppkey*13)%48+1+{dx} - (1+s_suppkey%3) AS DOUBLE) AS xmin, CAST((s_suppkey*29)%48+1+{dy} - (1+s_suppkey%3) AS DOUBLE) AS ymin, CAST((s_suppkey*13)%48+1+{dx} + (1+s_suppkey%3) AS DOUBLE) AS xmax, CAST((s_suppkey*29)%48+1+{dy} + (1+s_suppkey%3) AS DOUBLE) AS ymax FROM supplier"

#: Each element as SQL; later ones may use earlier ones.
SQL: dict[str, str] = {
    "points": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity AS x, CAST((l_orderkey*7+l_linenumber)%50 AS DOUBLE) AS y, CASE WHEN l_linenumber=7 THEN 'BLANK_7' WHEN l_linenumber=6 THEN NULL WHEN l_linenumber=5 THEN 'NegControl_5' ELSE p_brand END AS gene, l_discount > CAST(0.09 AS DOUBLE) AS low_quality_transcript FROM lineitem JOIN part ON l_partkey = p_partkey",
    "kept": f"SELECT * FROM points WHERE NOT low_quality_transcript AND NOT {GONE}",
    "cells": _cells.format(dx=0, dy=0),
    "cells2": _cells.format(dx=1, dy=2),
    "diamonds": "SELECT s_suppkey AS ord, CAST((s_suppkey*13)%48+1 AS DOUBLE) AS cx, CAST((s_suppkey*29)%48+1 AS DOUBLE) AS cy, CAST(1+s_suppkey%3 AS DOUBLE) AS r FROM supplier",
    "hits": "SELECT c.ord, p.* FROM kept p JOIN cells c ON p.x BETWEEN c.xmin AND c.xmax AND p.y BETWEEN c.ymin AND c.ymax",
    "counts": "SELECT ord, gene, count(*) AS n FROM hits GROUP BY ord, gene",
    "bins": "SELECT CAST(i AS INT) AS bin_id, CAST(i % 50 + 0.5 AS DOUBLE) AS x, CAST(i // 50 + 0.5 AS DOUBLE) AS y FROM range(2500) t(i)",
    "bin_counts": "SELECT CAST(floor(y) * 50 + least(floor(x), 49) AS INT) AS bin_id, gene, count(*) AS n FROM kept GROUP BY 1, 2",
    "bin_hits": "SELECT b.bin_id, c.ord FROM bins b JOIN cells c ON b.x BETWEEN c.xmin AND c.xmax AND b.y BETWEEN c.ymin AND c.ymax",
    "image": "SELECT l_linestatus AS c, CAST((l_orderkey*7+l_linenumber)%50 AS INT) AS y, CAST(l_quantity AS INT) AS x, CAST(sum(l_linenumber) AS INT) AS value FROM lineitem GROUP BY 1, 2, 3",
    "roi": "SELECT r_regionkey AS roi, CAST(r_regionkey*10 AS DOUBLE) AS xmin, CAST(r_regionkey*7 AS DOUBLE) AS ymin, CAST(r_regionkey*10+8 AS DOUBLE) AS xmax, CAST(r_regionkey*7+15 AS DOUBLE) AS ymax FROM region",
    "fovs": "SELECT n_nationkey AS fov, CAST((n_nationkey%5)*10 AS DOUBLE) AS x, CAST((n_nationkey//5)*10 AS DOUBLE) AS y FROM nation",
    "nodes": "SELECT n_regionkey % 2 AS lib, CAST(n_nationkey AS BIGINT) AS node, CAST((n_nationkey*37+n_nationkey*n_nationkey*3)%101 AS DOUBLE) AS x, CAST((n_nationkey*53+n_nationkey*n_nationkey*7)%97 AS DOUBLE) AS y, 't' || CAST(n_nationkey%3 AS VARCHAR) AS cell_type, 'n' || CAST(((n_nationkey*37+n_nationkey*n_nationkey*3)%101)//34 AS VARCHAR) AS niche FROM nation",
    "triangles": "SELECT p.lib, p.node AS a, q.node AS b, r.node AS c FROM nodes p JOIN nodes q ON p.lib=q.lib AND p.node<q.node JOIN nodes r ON r.lib=p.lib AND q.node<r.node WHERE (q.x-p.x)*(r.y-p.y)-(q.y-p.y)*(r.x-p.x) <> 0 AND NOT EXISTS (SELECT 1 FROM nodes d WHERE d.lib=p.lib AND d.node NOT IN (p.node,q.node,r.node) AND sign((q.x-p.x)*(r.y-p.y)-(q.y-p.y)*(r.x-p.x)) * ((p.x-d.x)*((q.y-d.y)*((r.x-d.x)**2+(r.y-d.y)**2)-((q.x-d.x)**2+(q.y-d.y)**2)*(r.y-d.y)) - (p.y-d.y)*((q.x-d.x)*((r.x-d.x)**2+(r.y-d.y)**2)-((q.x-d.x)**2+(q.y-d.y)**2)*(r.x-d.x)) + ((p.x-d.x)**2+(p.y-d.y)**2)*((q.x-d.x)*(r.y-d.y)-(q.y-d.y)*(r.x-d.x))) > 0)",
    "edges": "SELECT e.lib, e.src, e.dst, sqrt((p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y)) AS dist FROM (SELECT DISTINCT lib, src, dst FROM (SELECT lib, a AS src, b AS dst FROM triangles UNION ALL SELECT lib, a, c FROM triangles UNION ALL SELECT lib, b, c FROM triangles)) e JOIN nodes p ON p.lib=e.lib AND p.node=e.src JOIN nodes q ON q.lib=e.lib AND q.node=e.dst",
    "kept_edges": "SELECT * FROM edges WHERE dist <= 45",
    "both_edges": "SELECT lib, src, dst, dist FROM kept_edges UNION ALL SELECT lib, dst AS src, src AS dst, dist FROM kept_edges",
    "intensities": "SELECT cell, channel, value FROM (SELECT l_suppkey AS cell, CAST(sum(l_quantity) AS DOUBLE) AS a, CAST(sum(l_linenumber) AS DOUBLE) AS b, CAST(sum(l_orderkey % 17) AS DOUBLE) AS c, CAST(sum(l_partkey % 23) AS DOUBLE) AS d FROM lineitem GROUP BY 1) UNPIVOT (value FOR channel IN (a, b, c, d))",
}
NEEDS = {
    "kept": ["points"], "hits": ["kept", "cells"], "counts": ["hits"], "bin_counts": ["kept"], "bin_hits": ["bins", "cells"],
    "triangles": ["nodes"], "edges": ["triangles"], "kept_edges": ["edges"], "both_edges": ["kept_edges"],
}


def sql(elements: str, body: str, recursive: bool = False) -> str:
    """``body`` with the elements it names, and those they need, before it."""
    order: list[str] = []

    def need(name: str) -> None:
        for n in NEEDS.get(name, ()):
            need(n)
        if name not in order:
            order.append(name)

    for e in elements.split():
        need(e)
    parts = ", ".join(f"{n} AS ({SQL[n]})" for n in order)
    if not parts:
        return body
    return f"WITH {'RECURSIVE ' if recursive else ''}{parts} {', ' + body if body.lstrip().startswith('#') else body}".replace(", #", ",")
