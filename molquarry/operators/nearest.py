"""Nearest neighbours and least distances without a radius: descent through a tree of cells, level by level.

The points of a group (a structure, a channel) lie in a cube that is halved along each axis again and again. A cell with
more than LEAF points has its occupied eighths as children; each cell knows its number of points and their tight box. All
cells of all groups are one table, made with one aggregation.

Queries go down together: those of one small cell of space are a set with a box. A set begins at its group's root; in each
round its inner cells are replaced by their children, and cells whose least distance from the set's box is over the bound
leave. The bound is the least distance within which k points are sure to lie, by the cells' greatest distances. So a set
keeps a few dozen cells whatever the number of points and wherever they lie, and rounds are as many as the tree is deep.
At the end each query of a set prunes the remaining leaves with its own bound, and only then meets points.

Joins are on (group, cell), so no group is ever crossed with itself. Exact, also for far-off and crowded points. Ties go by
the columns that the caller names. Points and queries with a null or NaN coordinate, or a null group, are left out.
Points that all lie in one place are one leaf, however many there are.

The descent moves every point once a level, which a group of a few hundred points does not repay: k_nearest compares the
points and queries of a group in the task that holds them while there are at most SMALL of each, and only the other groups
go down.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import cut

#: Points of a cell that is not divided further; levels that are added for crowded places; most levels.
LEAF, EXTRA_LEVELS, MOST_LEVELS = 16, 4, 20
#: Most points, and most queries, of a group that one task compares; distances that it holds at a time.
SMALL, AT_ONCE = 2000, 1 << 20
#: Bounds are in doubles: a cell is left out only when it is clearly beyond.
SLACK = 1 + 1e-9

AXES = "xyz"


def _usable(points: DataFrame, on: Sequence[str], prefix: str = "") -> DataFrame:
    whole = [F.col(f"{prefix}{c}").isNotNull() & ~F.isnan(F.col(f"{prefix}{c}").cast("double")) for c in AXES]
    return points.filter(reduce(lambda a, b: a & b, [*whole, *(F.col(c).isNotNull() for c in on)]))


def _box(prefix: str = "") -> list[Column]:
    return [f(F.col(f"{prefix}{c}").cast("double")).alias(f"_{n}{c}") for n, f in (("lo", F.min), ("hi", F.max)) for c in AXES]


def _depth(most: int) -> int:
    """Levels below the root for groups of at most so many points."""
    depth, n = 0, most
    while n > LEAF:
        depth, n = depth + 1, n // 8
    return min(MOST_LEVELS, depth + EXTRA_LEVELS) if depth else 0


def _cell(depth: int, level: Column) -> Column:
    """The cell of a point at a level: its places along the three axes, packed."""
    places = [F.call_function("shiftright", F.col(f"_i{c}"), F.lit(depth) - level) for c in AXES]
    return places[0] * (1 << 2 * MOST_LEVELS) + places[1] * (1 << MOST_LEVELS) + places[2]


def _in_grid(points: DataFrame, boxes: DataFrame, on: Sequence[str], depth: Column, prefix: str = "") -> DataFrame:
    """points with their places (_ix, _iy, _iz) in the grid of 2^depth cells an axis over their group's cube."""
    span = F.greatest(*(F.col(f"_hi{c}") - F.col(f"_lo{c}") for c in AXES))
    cells = F.pow(F.lit(2.0), depth)
    place = lambda c: F.when(span > 0, F.least(F.floor((F.col(f"{prefix}{c}").cast("double") - F.col(f"_lo{c}")) / span * cells), cells.cast("long") - 1)).otherwise(F.lit(0).cast("long"))
    box = [f"_{n}{c}" for n in ("lo", "hi") for c in AXES]
    return points.join(boxes, list(on)).withColumns({f"_i{c}": place(c) for c in AXES}).drop(*box)


def tree(points: DataFrame, on: Sequence[str]) -> tuple[DataFrame, DataFrame, int]:
    """Cells (on, _level, _cell, _up, _n, box, _leaf), the points with their leaf (_level, _cell), and the depth."""
    on, good = list(on), _usable(points, on)
    boxes = cut(good.groupBy(*on).agg(F.count("*").alias("_m"), *_box()))
    depth = _depth(boxes.agg(F.max("_m")).first()[0] or 0)
    gridded = cut(_in_grid(good, boxes.drop("_m"), on, F.lit(depth)))
    each = gridded.select(*on, *AXES, *(f"_i{c}" for c in AXES), F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("_level"))
    cells = each.groupBy(*on, "_level", _cell(depth, F.col("_level")).alias("_cell"), _cell(depth, F.greatest(F.col("_level") - 1, F.lit(0))).alias("_up")).agg(F.count("*").alias("_n"), *_box())
    cells = cut(cells.withColumn("_leaf", (F.col("_n") <= LEAF) | (F.col("_level") == depth)))
    inner = cells.filter(~F.col("_leaf")).select(*on, (F.col("_level") + 1).alias("_level"), F.col("_cell").alias("_up"))
    nodes = cut(cells.filter("_level = 0").unionByName(cells.join(inner, [*on, "_level", "_up"], "left_semi")))
    leaves = nodes.filter("_leaf").select(*on, "_level", "_cell")
    places = gridded.select("*", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("_level")).withColumn("_cell", _cell(depth, F.col("_level"))).drop(*(f"_i{c}" for c in AXES))
    return nodes, places.join(leaves, [*on, "_level", "_cell"]), depth


def sets_of(queries: DataFrame, on: Sequence[str]) -> DataFrame:
    """queries with the set (_set) that they go down in: about LEAF of a group's queries that are near each other."""
    on, good = list(on), _usable(queries, on, "p")
    boxes = good.groupBy(*on).agg(F.count("*").alias("_m"), *_box("p"))
    level = F.least(F.greatest(F.ceil(F.log2(F.col("_m") / LEAF) / 3), F.lit(0)), F.lit(MOST_LEVELS)).cast("int")
    placed = _in_grid(good, boxes.withColumn("_depth", level), on, F.col("_depth"), "p")
    packed = F.col("_ix") * (1 << 2 * MOST_LEVELS) + F.col("_iy") * (1 << MOST_LEVELS) + F.col("_iz")
    return placed.withColumn("_set", packed).drop("_m", "_depth", *(f"_i{c}" for c in AXES))


def _least(a: str, b: str) -> Column:
    """Square of the least distance of two boxes."""
    gaps = [F.greatest(F.col(f"{a}lo{c}") - F.col(f"{b}hi{c}"), F.col(f"{b}lo{c}") - F.col(f"{a}hi{c}"), F.lit(0.0)) for c in AXES]
    return sum((g * g for g in gaps), F.lit(0.0))


def _greatest(a: str, b: str) -> Column:
    """Square of the greatest distance of two boxes."""
    spans = [F.greatest(F.col(f"{a}hi{c}") - F.col(f"{b}lo{c}"), F.col(f"{b}hi{c}") - F.col(f"{a}lo{c}")) for c in AXES]
    return sum((s * s for s in spans), F.lit(0.0))


def _pruned(rows: DataFrame, by: Sequence[str], k: int) -> DataFrame:
    """Rows (_near, _far, _n) that can hold one of the k nearest points of `by`."""
    w = Window.partitionBy(*by)
    if k == 1:
        bound = F.min("_far").over(w)
    else:
        before = F.sum("_n").over(w.orderBy("_far").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        rows = rows.withColumn("_sum", before)
        bound = F.coalesce(F.min(F.when(F.col("_sum") >= k, F.col("_far"))).over(w), F.lit(float("inf")))
    return rows.withColumn("_bound", bound).filter(F.col("_near") <= F.col("_bound") * SLACK).drop("_bound", "_sum")


def _descend(sets: DataFrame, nodes: DataFrame, on: Sequence[str], by: Sequence[str], k: int, most: float | None, depth: int) -> DataFrame:
    """Leaves that each set (box _slo, _shi) has to look into. sets are with `on`, and `by` is what bounds hold for."""
    on = list(on)
    cell = ["_level", "_cell", "_n", "_leaf", *(f"_{n}{c}" for n in ("lo", "hi") for c in AXES)]
    keys = [c for c in sets.columns if c not in cell]

    def kept(rows: DataFrame) -> DataFrame:
        rows = rows.withColumns({"_near": _least("_s", "_"), "_far": _greatest("_s", "_")})
        rows = rows if most is None else rows.filter(F.col("_near") <= most * most * SLACK)
        return cut(_pruned(rows, by, k).drop("_near", "_far"))

    found = kept(sets.join(nodes.filter("_level = 0").select(*on, *cell), on))
    for _ in range(depth):
        open_ = found.filter(~F.col("_leaf")).select(*keys, (F.col("_level") + 1).alias("_level"), F.col("_cell").alias("_up"))
        if open_.isEmpty():
            break
        below = open_.join(nodes.select(*on, *cell, "_up"), [*on, "_level", "_up"])
        found = kept(found.filter("_leaf").unionByName(below.select(found.columns)))
    return found


def _nearest_rows(q: np.ndarray, t: np.ndarray, k: int, most: float | None) -> list[np.ndarray]:
    """Queries q and points t (3 x n): places of query and point, squared distance and rank; of equally near the first point."""
    step, found = max(1, AT_ONCE // max(1, t.shape[1])), []
    for i in range(0, q.shape[1] if t.shape[1] else 0, step):
        part = q[:, i : i + step]
        d2 = sum((part[c][:, None] - t[c][None, :]) ** 2 for c in range(3))
        last = np.partition(d2, min(k, d2.shape[1]) - 1, axis=1)[:, min(k, d2.shape[1]) - 1]
        row, col = np.nonzero(d2 <= (last if most is None else np.minimum(last, most * most))[:, None])
        order = np.lexsort((col, d2[row, col], row))
        row, col = row[order], col[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row) + 1
        row, col, rank = row[rank <= k], col[rank <= k], rank[rank <= k]
        found.append((row + i, col, d2[row, col], rank))
    return [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0)] * 4


def _compared(queries: DataFrame, targets: DataFrame, k: int, on: Sequence[str], ties: Sequence[str], most: float | None) -> DataFrame:
    """k_nearest() where each group has at most SMALL queries and points: one shuffle of both brings a group together."""
    on = list(on)
    rest = [c for c in targets.columns if c not in (*on, *ties)]
    asked = queries.groupBy(*on).agg(F.collect_list(F.struct(*(c for c in queries.columns if c not in on))).alias("_qs"))
    # by ties, so that the place in the array decides between equally near points
    points = targets.groupBy(*on).agg(F.array_sort(F.collect_list(F.struct(*ties, *rest))).alias("_ts"))

    @F.pandas_udf("q array<int>, t array<int>, d array<double>, r array<int>")
    def compare(px: pd.Series, py: pd.Series, pz: pd.Series, x: pd.Series, y: pd.Series, z: pd.Series) -> pd.DataFrame:
        got = [_nearest_rows(np.array(r[:3], float), np.array(r[3:], float), k, most) for r in zip(px, py, pz, x, y, z, strict=True)]
        return pd.DataFrame({n: [r[i].astype(float if n == "d" else np.int32) for r in got] for i, n in enumerate("qtdr")}, columns=list("qtdr"), dtype=object)

    place = lambda of, c: F.transform(of, lambda r: r[c].cast("double"))
    met = asked.join(points, on).withColumn("_m", compare(*(place("_qs", f"p{c}") for c in AXES), *(place("_ts", c) for c in AXES)))
    row = lambda m: F.struct(F.get("_qs", m["q"]).alias("_q"), F.get("_ts", m["t"]).alias("_t"), m["d"].alias("_d2"), m["r"].alias("rank"))
    zipped = F.arrays_zip(*(F.col(f"_m.{n}").alias(n) for n in "qtdr"))
    each = met.select(*on, F.inline(F.transform(zipped, row)))
    return each.select(*(f"_q.{c}" for c in queries.columns if c not in on), *on, *(f"_t.{c}" for c in targets.columns if c not in on), "_d2", "rank")


def k_nearest(queries: DataFrame, targets: DataFrame, k: int, on: Sequence[str], ties: Sequence[str] = (), most: float | None = None) -> DataFrame:
    """The k targets (x, y, z) nearest to each query (px, py, pz) of the same group `on`, fewer if there are fewer.

    Columns of both (their names must differ but for `on`), _d2 (squared distance) and rank (from 1; ties by `ties`).
    With `most`, only targets at most so far away. Queries without a target give no row; repeated rows are queries each.
    """
    on = list(on)
    queries, targets = cut(_usable(queries, on, "p")), cut(_usable(targets, on))

    def large(rows: DataFrame, prefix: str) -> DataFrame:
        finite = F.max(F.greatest(*(F.abs(F.col(f"{prefix}{c}").cast("double")) for c in AXES))) < float("inf")
        return rows.groupBy(*on).agg(F.count("*").alias("_n"), finite.alias("_f")).filter((F.col("_n") > SMALL) | ~F.col("_f")).select(*on)

    many = cut(large(queries, "p").unionByName(large(targets, "")).distinct())
    if many.isEmpty():
        return _compared(queries, targets, k, on, ties, most)
    of = lambda rows, how: rows.join(many, on, how).select(rows.columns)
    few = _compared(of(queries, "left_anti"), of(targets, "left_anti"), k, on, ties, most)
    return few.unionByName(_descended(of(queries, "left_semi"), of(targets, "left_semi"), k, on, ties, most).select(few.columns))


def _descended(queries: DataFrame, targets: DataFrame, k: int, on: Sequence[str], ties: Sequence[str], most: float | None) -> DataFrame:
    """k_nearest() by descent, for groups of any size."""
    on = list(on)
    asked = cut(sets_of(queries, on).withColumn("_q", F.monotonically_increasing_id()))
    nodes, places, depth = tree(targets, on)
    sets = asked.groupBy(*on, "_set").agg(*_box("p"))
    sets = sets.select(*on, "_set", *(F.col(f"_{n}{c}").alias(f"_s{n}{c}") for n in ("lo", "hi") for c in AXES))
    leaves = _descend(sets, nodes, on, [*on, "_set"], k, most, depth).drop(*(f"_s{n}{c}" for n in ("lo", "hi") for c in AXES))
    point = asked.select(*on, "_set", "_q", *(F.col(f"p{c}").cast("double").alias(f"_p{n}{c}") for n in ("lo", "hi") for c in AXES))
    own = point.join(leaves, [*on, "_set"]).withColumns({"_near": _least("_p", "_"), "_far": _greatest("_p", "_")})
    own = own if most is None else own.filter(F.col("_near") <= most * most * SLACK)
    own = _pruned(own, ["_q"], k).select(*on, "_q", "_level", "_cell", *(F.col(f"_plo{c}") for c in AXES))
    met = own.join(places, [*on, "_level", "_cell"])
    met = met.withColumn("_d2", sum(((F.col(f"_plo{c}") - F.col(c)) ** 2 for c in AXES), F.lit(0.0))).drop("_level", "_cell", *(f"_plo{c}" for c in AXES))
    met = met if most is None else met.filter(F.col("_d2") <= most * most)
    first = met.withColumn("rank", F.row_number().over(Window.partitionBy("_q").orderBy("_d2", *ties))).filter(F.col("rank") <= k)
    return asked.drop("_set", *on).join(first, "_q").drop("_q")


def least_distances(left: DataFrame, right: DataFrame, on: Sequence[str], left_key: Sequence[str], right_key: Sequence[str], most: float | None = None) -> DataFrame:
    """The least distance of the points of each left_key (px, py, pz) from those of each right_key (x, y, z) with equal `on`:
    on, left_key, right_key, _d2. All pairs are in the result, with `most` those at most so far apart. A pair goes down as
    two boxes, and only its leaves that can hold the least distance meet point by point."""
    on, lk, rk = list(on), list(left_key), list(right_key)
    asked = cut(sets_of(left.select(*on, *lk, *(f"p{c}" for c in AXES)), [*on, *lk]))
    nodes, places, depth = tree(right.select(*on, *rk, *AXES), [*on, *rk])
    sets = asked.groupBy(*on, *lk, "_set").agg(*_box("p"))
    sets = sets.select(*on, *lk, "_set", *(F.col(f"_{n}{c}").alias(f"_s{n}{c}") for n in ("lo", "hi") for c in AXES))
    # the pairs of the result: keys of one group
    pairs = sets.join(nodes.filter("_level = 0").select(*on, *rk), on)
    leaves = _descend(pairs, nodes, [*on, *rk], [*on, *lk, *rk], 1, most, depth)
    met = leaves.select(*on, *lk, *rk, "_set", "_level", "_cell").join(asked, [*on, *lk, "_set"]).join(places, [*on, *rk, "_level", "_cell"])
    d2 = sum(((F.col(f"p{c}").cast("double") - F.col(c)) ** 2 for c in AXES), F.lit(0.0))
    out = met.groupBy(*on, *lk, *rk).agg(F.min(d2).alias("_d2"))
    return out if most is None else out.filter(F.col("_d2") <= most * most)
