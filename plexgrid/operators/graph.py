"""Neighbourhood graphs: Delaunay edges, hop distances, group distances, networks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernels.delaunay import triangulate
from .storage import quantiles, written


def delaunay(nodes: DataFrame, library: str = "lib") -> DataFrame:
    """(lib, a, b, c) triangles of each library's points, node numbers ascending.

    One library is one task, as its triangulation is one computation; libraries
    run side by side. Of four points on a circle, the diagonal is that which the
    order of insertion, by node, gives.
    """

    def run(key, pdf):
        import pandas as pd

        p = pdf.sort_values("node")
        ids = p["node"].to_numpy()
        tri = triangulate(p[["x", "y"]].to_numpy(float))
        rows = [(key[0], *sorted(int(ids[i]) for i in t)) for t in tri]
        return pd.DataFrame(rows, columns=[library, "a", "b", "c"]).astype({"a": "int64", "b": "int64", "c": "int64"})

    kind = dict(nodes.dtypes)[library]
    return nodes.select(library, F.col("node").cast("long").alias("node"), "x", "y").groupBy(library).applyInPandas(run, f"{library} {kind}, a long, b long, c long")


def triangle_edges(triangles: DataFrame, nodes: DataFrame, library: str = "lib") -> DataFrame:
    """(lib, src, dst, dist) once for each edge, src < dst."""
    pairs = triangles.select(library, F.explode(F.array(*(F.struct(F.col(p).alias("src"), F.col(q).alias("dst")) for p, q in ("ab", "ac", "bc")))).alias("e")).select(library, "e.src", "e.dst").distinct()
    at = lambda s: nodes.select(library, F.col("node").cast("long").alias(s), F.col("x").alias(f"{s}_x"), F.col("y").alias(f"{s}_y"))
    e = pairs.join(at("src"), [library, "src"]).join(at("dst"), [library, "dst"])
    dx, dy = F.col("src_x") - F.col("dst_x"), F.col("src_y") - F.col("dst_y")
    return e.select(library, "src", "dst", F.sqrt(dx * dx + dy * dy).alias("dist"))


def pruned(edges: DataFrame, radius: tuple[float, float] | float | None = None, percentile: float | None = None, library: str = "lib") -> DataFrame:
    """Edges of lengths within ``radius``, and up to the percentile (0..100) of their library."""
    out = edges
    if radius is not None:
        low, high = radius if isinstance(radius, tuple) else (0.0, radius)
        out = out.where(f"dist BETWEEN {low}D AND {high}D")
    if percentile is not None:
        q = quantiles(edges, "dist", percentile / 100, [library], "_q")
        out = out.join(F.broadcast(q), library).where("dist <= _q").drop("_q")
    return out


def spatial_neighbors(nodes: DataFrame, radius=None, percentile: float | None = None, library: str = "lib", set_diag: bool = False) -> DataFrame:
    """(lib, src, dst, dist) in both directions; ``set_diag`` adds each node's edge to itself."""
    e = pruned(triangle_edges(delaunay(nodes, library), nodes, library), radius, percentile, library)
    out = e.unionByName(e.select(library, F.col("dst").alias("src"), F.col("src").alias("dst"), "dist"))
    if set_diag:
        n = F.col("node").cast("long")
        out = out.unionByName(nodes.select(library, n.alias("src"), n.alias("dst"), F.lit(0.0).alias("dist")))
    return out


def cells_to_groups(nodes: DataFrame, edges: DataFrame, group: str, ignore_zeros: bool = False, max_hops: int | None = None) -> DataFrame:
    """(node, grp, hops): the least number of edges from each node to a node of each group; unreached pairs are absent.

    A node's own group is 0 hops away, or with ``ignore_zeros`` at least one.
    All groups grow together, a hop a round, until no pair is new.
    """
    own = nodes.select("node", F.col(group).alias("grp")).where("grp IS NOT NULL")
    start = own.withColumn("hops", F.lit(0))
    front, done = start, start
    hop = 0
    while max_hops is None or hop < max_hops:
        hop += 1
        step = front.join(edges.select(F.col("src").alias("node"), "dst"), "node").select(F.col("dst").alias("node"), "grp").distinct()
        seen = done.where("hops > 0") if ignore_zeros else done
        front = written(step.join(seen.select("node", "grp"), ["node", "grp"], "left_anti").withColumn("hops", F.lit(hop)), "front")
        if front.isEmpty():
            break
        done = done.unionByName(front)
    return done.where("hops > 0") if ignore_zeros else done


def mean_distance(nodes: DataFrame, hops: DataFrame, group: str) -> DataFrame:
    """(grp, target, hops): the mean of what nodes of a group are away from each target."""
    own = nodes.select("node", F.col(group).alias("own"))
    return hops.join(own, "node").where("own IS NOT NULL").groupBy("own", F.col("grp").alias("target")).agg(F.avg("hops").alias("hops")).withColumnRenamed("own", "grp")


def null_model(share: str, ignore_zeros: bool):
    """Expected hops to a group that makes up ``share`` of a grid whose d-th ring has 8 d nodes."""
    k = 0 if ignore_zeros else 1
    return F.expr(f"aggregate(sequence(1, 29), 0D, (s, d) -> s + d * (pow(1 - {share}, 4 * d * (d - 1) + {k}) - pow(1 - {share}, 4 * d * (d + 1) + {k})))")


def mean_distance_corrected(nodes: DataFrame, hops: DataFrame, group: str, target: str, ignore_zeros: bool = False, relative: bool = False) -> DataFrame:
    """Mean distances less what chance gives, over it if ``relative``; a group to itself stays 0 unless zeros are ignored."""
    m = mean_distance(nodes, hops, group)
    n = nodes.where(F.col(target).isNotNull())
    share = n.groupBy(F.col(target).alias("target")).agg(F.count("*").alias("_n")).crossJoin(F.broadcast(n.agg(F.count("*").alias("_all")))).select("target", (F.col("_n") / F.col("_all")).alias("_p"))
    out = m.join(F.broadcast(share), "target").withColumn("_e", null_model("_p", ignore_zeros))
    value = (F.col("hops") - F.col("_e")) / (F.col("_e") if relative else F.lit(1.0))
    if group == target and not ignore_zeros:
        value = F.when(F.col("grp") == F.col("target"), F.lit(0.0)).otherwise(value)
    return out.select("grp", "target", value.alias("hops"))


def prepare_network(distances: DataFrame, clip: float = 3.0) -> DataFrame:
    """(a, b, weight) from distances between all groups of both kinds: 1 / d, none to itself, at most ``clip``, the mean of both directions."""
    w = distances.where("grp <> target AND hops IS NOT NULL").select(F.col("grp").alias("a"), F.col("target").alias("b"), F.when(F.col("hops") == 0, clip).otherwise(F.least(F.lit(clip), F.greatest(F.lit(0.0), 1 / F.col("hops")))).alias("w"))
    both = w.unionByName(w.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    return both.groupBy("a", "b").agg((F.sum("w") / 2).alias("weight"))


def components(nodes: DataFrame, edges: DataFrame, key: str = "node") -> DataFrame:
    """(node, component): the smallest node reachable. Labels jump along themselves, so rounds stay few."""
    label = written(nodes.select(F.col(key).alias("node"), F.col(key).alias("component")), "labels")
    both = written(edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("dst")), F.struct(F.col("dst").alias("node"), F.col("src").alias("dst")))).alias("e")).select("e.*"), "edges")
    while True:
        near = both.join(label.withColumnRenamed("node", "dst"), "dst").groupBy("node").agg(F.min("component").alias("m"))
        new = label.join(near, "node", "left").select("node", F.least("component", "m").alias("component"))
        up = new.select(F.col("node").alias("component"), F.col("component").alias("up"))
        new = written(new.join(up, "component", "left").select("node", F.least("component", "up").alias("component")), "labels")
        moved = new.join(label.withColumnRenamed("component", "before"), "node").where("component <> before").isEmpty()
        label = new
        if moved:
            return label
