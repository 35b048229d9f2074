"""Conflicts between overlapping cells: pairs, components, merging."""

from __future__ import annotations

import math
import sys
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable
from functools import cache
from heapq import heapify, heappop, heappush

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spatial
from .aggregate import count_transcripts
from .graph import components
from .kernels import filter_pairs
from .kernels.overlay import area_of, intersection, is_convex, largest, union
from .kernels.polygons import clip_area, signed_area
from .storage import ordinals, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHAPE = ["xs", "ys", "xmin", "ymin", "xmax", "ymax"]


def conflict_pairs(cells: DataFrame, exact: str = "box", patch: str | None = None, same: str | None = None) -> DataFrame:
    """(src, dst), src < dst, of cells that share a point, of different patches if ``patch`` is named, of one group if ``same`` is."""
    held = spatial.bundles(cells, "ord", exact, [c for c in (patch, same) if c])
    pairs = spatial.shape_pairs(held, held, grid=spatial.grid_size(cells)).where("a.members <= b.members")
    if patch:
        pairs = pairs.where(f"a.{patch} <> b.{patch}")
    if same:
        pairs = pairs.where(f"a.{same} = b.{same}")
    if exact != "box":
        pairs = filter_pairs(pairs)
    each = spatial.member_pairs(pairs, "_x", "_y", _own=F.expr("a.members = b.members")).where("IF(_own, _x < _y, _x <> _y)")
    return each.select(F.least("_x", "_y").alias("src"), F.greatest("_x", "_y").alias("dst"))


def conflict_components(cells: DataFrame, pairs: DataFrame) -> DataFrame:
    """(ord, component): cells that conflicts join, by the smallest number."""
    return components(cells, pairs, "ord").withColumnRenamed("node", "ord")


def shared_area(a: list, b: list) -> float:
    """The exact area of what two rings share; half-plane by half-plane where one is convex."""
    for ring, other in ((a, b), (b, a)):
        if is_convex(other):
            return clip_area(ring, other)
    return area_of(intersection([a], [b]))


class _Group:
    """Merged cells: the smallest of their numbers, their ring, and their numbers by outline."""

    __slots__ = ("lists", "number", "ring")

    def __init__(self, number: int, ring: int, outline: int):
        self.number, self.ring, self.lists = number, ring, {outline: [number]}

    def size(self) -> int:
        return sum(map(len, self.lists.values()))


def merge(rings: dict[int, list], members: dict[int, list[int]], partners: dict[int, list[int]], threshold: float) -> list[tuple[int, list, bool]]:
    """(number, ring, merged) of one component after merging pairs in ascending order.

    ``rings`` are of outlines, each of which has the numbers of the cells that
    have it, ascending, and the outlines whose cells its own are in conflict
    with, itself included where its cells are so among each other. Each pair of
    cells is looked at from both of them, since rings grow meanwhile. It is merged
    if what its present rings share is at least ``threshold`` of the smaller one.
    The merged ring is the outline of their union (its largest part, without
    holes) and takes the place of all cells in it; it has the smallest of their
    numbers.

    The pairs themselves are not listed: a cell looks for the next number among
    those of each ring it may meet, and a ring that it doesn't merge with is
    passed over until its own ring grows.
    """
    table: list[list] = []
    known: dict[tuple, int] = {}

    def ring_id(ring):
        k = known.setdefault(tuple(ring), len(table))
        if k == len(table):
            table.append(ring)
        return k

    @cache
    def size_of(k):
        return abs(signed_area(table[k]))

    @cache
    def meets(a, b):
        small = min(size_of(a), size_of(b))
        return small > 0 and shared_area(table[a], table[b]) >= threshold * small

    @cache
    def both(a, b, low):
        return ring_id(largest(union([table[a]], [table[b]])) or table[low])

    own = {o: ring_id(r) for o, r in rings.items()}
    alone = {o: list(ns) for o, ns in members.items()}
    groups: dict[int, set[_Group]] = {o: set() for o in rings}
    group_of: dict[int, _Group] = {}
    seen: dict[int, tuple] = {}
    merges = 0

    def grouped(n, o):
        """The group of a cell that was alone."""
        alone[o].pop(bisect_left(alone[o], n))
        g = group_of[n] = _Group(n, own[o], o)
        groups[o].add(g)
        return g

    def joined(a, b, ring):
        """Two groups as one; the numbers of the smaller one move."""
        if a.size() < b.size():
            a, b = b, a
        for o, ns in b.lists.items():
            groups[o].discard(b)
            groups[o].add(a)
            group_of.update(dict.fromkeys(ns, a))
            if len(ns) == 1:
                insort(a.lists.setdefault(o, []), ns[0])
            else:
                a.lists[o] = sorted(a.lists.get(o, []) + ns)
        a.number, a.ring, b.lists = min(a.number, b.number), ring, None
        return a

    def next_alone(p, after, but=None):
        k = bisect_right(alone[p], after)
        k += k < len(alone[p]) and alone[p][k] == but
        return [(alone[p][k], p, None)] if k < len(alone[p]) else []

    def ahead(i, o, g, after):
        """The next number of each ring that cell ``i`` of group ``g`` may meet, as a heap."""
        todo = []
        for p in partners[o]:
            todo += next_alone(p, after, i)
            for t in groups[p]:
                k = bisect_right(t.lists[p], after)
                if t is not g and k < len(t.lists[p]):
                    todo.append((t.lists[p][k], p, t))
        heapify(todo)  # no number comes twice
        return todo

    for i, o in sorted((n, o) for o, ns in members.items() for n in ns):
        g = group_of.get(i)
        if g is not None and seen.get(o) == (g, merges):
            continue  # an equal cell of this group met all of these, and nothing has changed
        ring, grown = (own[o] if g is None else g.ring), False
        todo = ahead(i, o, g, -math.inf)
        while todo:
            j, p, t = heappop(todo)
            if t is not None and (t is g or t.lists is None):
                continue
            other = own[p] if t is None else t.ring
            if not meets(ring, other):
                continue
            merges += 1
            g = grouped(i, o) if g is None else g
            b = grouped(j, p) if t is None else t
            new = both(ring, other, ring if g.number < b.number else other)
            g = joined(g, b, new)
            if new != ring:
                ring, grown = new, True
                todo = ahead(i, o, g, j)
            elif t is None:
                for x in next_alone(p, j, i):
                    heappush(todo, x)
        if g is not None and not grown:
            seen[o] = (g, merges)
    whole = {g.number: g.ring for held in groups.values() for g in held}
    return sorted([(n, rings[o], False) for o, ns in alone.items() for n in ns] + [(n, table[k], True) for n, k in whole.items()], key=lambda r: r[0])


def conflict_outlines(cells: DataFrame, exact: str = "polygon", patch: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Cells in conflict, by component, with each outline held once; and the other cells.

    The first has (component, outline, ord) for cells and, with ord null,
    (component, outline, xs, ys, partners) for outlines: ``partners`` are those
    whose cells are in conflict with its own, itself included if its cells are so
    among each other. An outline's number is the smallest of its cells.
    """
    same = [*([patch] if patch else []), *SHAPE]
    held = written(cells.groupBy(*same).agg(F.min("ord").alias("ord"), F.count("*").alias("_n")), "outlines")
    pairs = written(conflict_pairs(held, exact, patch), "pairs")
    label = components(held, pairs, "ord")
    both = pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    if not patch:
        both = both.unionByName(held.where("_n > 1 AND xmin IS NOT NULL").select(F.col("ord").alias("src"), F.col("ord").alias("dst")))
    partners = both.groupBy("src").agg(F.collect_set(F.col("dst").cast("long")).alias("partners"))
    busy = held.join(partners, F.col("ord") == F.col("src")).join(label, F.col("ord") == F.col("node")).select(*same, F.col("component").cast("long").alias("component"), F.col("ord").cast("long").alias("outline"), "partners")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("xs", "array<double>"), ("ys", "array<double>"), ("partners", "array<long>"))]
    rows = cells.join(busy, same).select("component", "outline", F.col("ord").cast("long").alias("ord"), *none)
    rings = busy.select("component", "outline", F.lit(None).cast("long").alias("ord"), F.col("xs").cast("array<double>").alias("xs"), F.col("ys").cast("array<double>").alias("ys"), "partners")
    return rows.unionByName(rings), cells.join(busy, same, "left_anti")


def by_component(rows: DataFrame, solve: Callable, schema: str) -> DataFrame:
    """``solve(rings, members, partners)`` of each component of ``conflict_outlines``; it gives tuples as in ``schema``.

    Components are streamed, many a task, so that small ones cost little; one is held at a time.
    """
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"long": "int64", "boolean": "bool_", "array<double>": None}
    kinds = [kinds[c.split()[1]] for c in schema.split(", ")]

    def run(batches):
        import pyarrow as pa

        types = [getattr(pa, k)() if k else pa.list_(pa.float64()) for k in kinds]
        now, held, out = None, None, []

        def table(n):
            while len(out) > n:
                part, out[:1000] = out[:1000], []
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), types, strict=True)], names)

        def solved():
            rings, members, partners = held
            out.extend(solve(rings, {o: sorted(ns) for o, ns in members.items()}, partners))

        for b in batches:
            for c, o, n, x, y, ps in zip(*(b[k].to_pylist() for k in ("component", "outline", "ord", "xs", "ys", "partners")), strict=True):
                if held is None or c != now:
                    if held is not None:
                        solved()
                        yield from table(1000)
                    now, held = c, ({}, {}, {})
                if n is None:
                    held[0][o], held[2][o] = list(zip(x, y, strict=True)), sorted(ps)
                else:
                    held[1].setdefault(o, []).append(n)
        if held is not None:
            solved()
        yield from table(0)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "component").sortWithinPartitions("component").mapInArrow(run, schema)


def _columns_of(ring: list) -> tuple[list, list]:
    return [float(p[0]) for p in ring], [float(p[1]) for p in ring]


def solve_conflicts(cells: DataFrame, threshold: float = 0.5, exact: str = "polygon", patch: str | None = None) -> DataFrame:
    """(ord, source_ord, merged, xs, ys, bounds): no two cells share ``threshold`` of the smaller one.

    Merging depends on order only inside a component of the conflict graph, so
    components are merged side by side; one component is one task's group, as it
    is one sequence of merges. Cells without conflicts don't pass through Python.
    Cells that stay come first, in order, then merged ones by their first number.
    """
    from ..functions.geometry import with_bounds

    rows, free = conflict_outlines(cells, exact, patch)

    def solve(rings, members, partners):
        return [(n, m, *_columns_of(r)) for n, r, m in merge(rings, members, partners, threshold)]

    done = by_component(rows, solve, "source_ord long, merged boolean, xs array<double>, ys array<double>")
    free = free.select(F.col("ord").cast("long").alias("source_ord"), F.lit(False).alias("merged"), "xs", "ys")
    return with_bounds(ordinals(free.unionByName(done), ["merged", "source_ord"], "ord"))


def combine(elements: list[DataFrame], threshold: float = 0.5, exact: str = "polygon") -> DataFrame:
    """Several layers of cells as one, conflicts between any of them solved."""
    both = None
    for k, e in enumerate(elements):
        part = e.select(F.lit(k).alias("layer"), "ord", *SHAPE)
        both = part if both is None else both.unionByName(part)
    both = ordinals(both.withColumnRenamed("ord", "layer_ord"), ["layer", "layer_ord"], "ord")
    return solve_conflicts(both, threshold, exact)


def resolve(cells: DataFrame, counts: DataFrame, points: DataFrame, threshold: float = 0.5, exact: str = "polygon", patch: str = "patch_id") -> tuple[DataFrame, DataFrame]:
    """Cells of several patches without conflicts, and their counts; only merged cells are counted anew."""
    solved = solve_conflicts(cells, threshold, exact, patch).withColumn("cell_id", F.when(F.col("merged"), F.concat(F.lit("merged_cell_"), F.col("source_ord").cast("string"))).otherwise(F.col("source_ord").cast("string")))
    kept = counts.join(solved.where("NOT merged").select(F.col("source_ord").alias("_s"), F.col("ord").alias("new_ord")), F.col("ord") == F.col("_s")).select(F.col("new_ord").alias("ord"), "gene", "n")
    again = count_transcripts(points, solved.where("merged"))
    return solved, kept.unionByName(again.select("ord", "gene", "n"))
