"""CL1: density clusters (DBSCAN) on a graph of cells.

Points at one place are one spot with a weight. Space is cut into cells whose
points all lie within eps of each other. A cell of enough weight is core as a
whole and compares nothing; spots of lighter cells look at the 24 cells around
theirs, take those that lie within eps as a whole by their weight and compare
themselves with the rest. Clusters join cells, not points: two core cells are
linked if some core point of one is within eps of one of the other, which their
bounding boxes or two witnesses mostly settle, and else boxes that are split
until they do. So no list of near pairs is written, and a dense place costs what
its points cost.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from aerotally.operators.graph import connected_components
from aerotally.plans.storage import materialise

#: Two cells compare all their points if these are at most so many pairs; else their boxes are split in SPLIT x SPLIT.
PAIRS, SPLIT = 256, 4
#: Points of a group that is clustered in one call, as all its pairs are compared there.
SMALL = 1000
#: Sides of the blocks in which points meet cells, in eps.
BLOCK = 6
_BOX = ("x1", "x2", "y1", "y2")


def _box() -> list[Column]:
    return [F.min("x").alias("x1"), F.max("x").alias("x2"), F.min("y").alias("y1"), F.max("y").alias("y2")]


def _gap(a1: str, a2: str, b1: str, b2: str) -> Column:
    return F.greatest(F.col(a1) - F.col(b2), F.col(b1) - F.col(a2), F.lit(0.0))


def _span(a1: str, a2: str, b1: str, b2: str) -> Column:
    return F.greatest(F.col(a2) - F.col(b1), F.col(b2) - F.col(a1))


def _least2(a: str = "a_", b: str = "b_") -> Column:
    """Squared distance that no two points of the boxes fall below."""
    dx, dy = _gap(f"{a}x1", f"{a}x2", f"{b}x1", f"{b}x2"), _gap(f"{a}y1", f"{a}y2", f"{b}y1", f"{b}y2")
    return dx * dx + dy * dy


def _most2(a: str = "a_", b: str = "b_") -> Column:
    """Squared distance that no two points of the boxes exceed."""
    dx, dy = _span(f"{a}x1", f"{a}x2", f"{b}x1", f"{b}x2"), _span(f"{a}y1", f"{a}y2", f"{b}y1", f"{b}y2")
    return dx * dx + dy * dy


def _meet(rows: DataFrame, cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pairs of rows (a_ boxes no wider than a cell, ``eps2``) and cells (b_ boxes) whose boxes lie within eps.

    Space is cut into blocks of a few eps. A row is put into one of them, a cell
    into those that a row near it may be in, so that little is laid out twice.
    """
    side = F.sqrt("eps2") * BLOCK
    at = lambda c: F.floor(c / side).cast("long")
    reach = F.sqrt("eps2") * 1.000001
    span = lambda c: F.explode(F.sequence(at(F.col(f"b_{c}1") - 1.7072 * reach), at(F.col(f"b_{c}2") + reach)))  # noqa: E731  eps and a row's width
    a = rows.withColumns({"_bx": at(F.col("a_x1")), "_by": at(F.col("a_y1"))})
    b = cells.withColumn("_bx", span("x")).withColumn("_by", span("y")).drop("eps2")
    return a.join(b.hint("merge"), [*keys, "_bx", "_by"]).drop("_bx", "_by").where(_least2() <= F.col("eps2"))


def _prefixed(rows: DataFrame, prefix: str, columns: Sequence[str]) -> list[Column]:
    return [F.col(c).alias(prefix + c) for c in columns]


def linked_cells(core: DataFrame, cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(a, b)``: cells, by their smallest ids, of which some core points are within eps.

    ``core`` has ``(*keys, cx, cy, x, y, cell)``, ``cells`` the boxes, a witness
    and the number of spots of each.
    """
    mine = ["cell", *_BOX, "wx", "wy", "spots"]
    a = cells.select(*keys, "cx", "cy", "eps2", *_prefixed(cells, "a_", mine))
    b = cells.select(*keys, F.col("cx").alias("nx"), F.col("cy").alias("ny"), "eps2", *_prefixed(cells, "b_", mine))
    seen = lambda p: (F.col("a_wx") - F.col("b_wx")) * (F.col("a_wx") - F.col("b_wx")) + (F.col("a_wy") - F.col("b_wy")) * (F.col("a_wy") - F.col("b_wy"))
    linked = (_most2() <= F.col("eps2")) | (seen(None) <= F.col("eps2"))
    pairs = _meet(a, b, keys).where("nx > cx or (nx = cx and ny > cy)").withColumn("linked", linked)  # each pair once
    pairs = materialise(pairs.select("a_cell", "b_cell", "eps2", "linked", (F.col("a_spots") * F.col("b_spots")).alias("pairs")), "density-pairs")
    found = [pairs.where("linked").select("a_cell", "b_cell")]

    ends = lambda p, *more: core.select(F.col("cell").alias(f"{p}_cell"), F.col("x").alias(f"{p}_x"), F.col("y").alias(f"{p}_y"), *more)
    few = pairs.where(~F.col("linked") & (F.col("pairs") <= PAIRS))
    d2 = (F.col("a_x") - F.col("b_x")) * (F.col("a_x") - F.col("b_x")) + (F.col("a_y") - F.col("b_y")) * (F.col("a_y") - F.col("b_y"))
    found.append(few.join(ends("a"), "a_cell").join(ends("b"), "b_cell").where(d2 <= F.col("eps2")).select("a_cell", "b_cell").distinct())

    open_ = pairs.where(~F.col("linked") & (F.col("pairs") > PAIRS)).select("a_cell", "b_cell", "eps2", F.lit("").alias("a_path"), F.lit("").alias("b_path"))
    points = core.select("cell", F.lit("").alias("path"), "x", "y")
    while not open_.isEmpty():
        used = open_.select(F.col("a_cell").alias("cell"), F.col("a_path").alias("path")).unionByName(open_.select(F.col("b_cell").alias("cell"), F.col("b_path").alias("path"))).distinct()
        points = points.join(used, ["cell", "path"])
        boxes = points.groupBy("cell", "path").agg(*_box())
        at = lambda c: F.when(F.col(f"{c}2") > F.col(f"{c}1"), F.least(F.floor((F.col(c) - F.col(f"{c}1")) / ((F.col(f"{c}2") - F.col(f"{c}1")) / SPLIT)), F.lit(SPLIT - 1))).otherwise(0)
        points = points.join(boxes, ["cell", "path"]).select("cell", "path", F.concat("path", F.hex((at("x") * SPLIT + at("y")).cast("long"))).alias("next"), "x", "y")
        points = materialise(points, "density-split")
        parts = points.groupBy("cell", "path", "next").agg(*_box(), F.min(F.struct("x", "y")).alias("w")).select("cell", "path", "next", *_BOX, F.col("w.x").alias("wx"), F.col("w.y").alias("wy"))
        parts = materialise(parts, "density-parts")
        side = lambda p: parts.select(*[F.col(c).alias(f"{p}_{c}") for c in parts.columns])
        tried = open_.join(side("a"), ["a_cell", "a_path"]).join(side("b"), ["b_cell", "b_path"]).where(_least2() <= F.col("eps2")).withColumn("linked", linked)
        tried = materialise(tried.select("a_cell", "b_cell", "eps2", F.col("a_next").alias("a_path"), F.col("b_next").alias("b_path"), "linked"), "density-tried")
        now = tried.where("linked").select("a_cell", "b_cell").distinct()
        found.append(now)
        open_ = materialise(tried.where("not linked").join(now, ["a_cell", "b_cell"], "left_anti").drop("linked"), "density-open")
        points = points.select("cell", F.col("next").alias("path"), "x", "y")
    return reduce(DataFrame.unionByName, found).select(F.col("a_cell").alias("a"), F.col("b_cell").alias("b"))


def dbscan(points: DataFrame, eps: float | Column, min_points: int | Column, keys: Sequence[str] = (), id: str = "id") -> DataFrame:
    """CL1: ``(*keys, id, cluster)``; -1 is noise. A cluster is named by its smallest core id, a border point takes its smallest cluster.

    A point counts among its own neighbours. Ids are longs, unique over all
    keys. ``eps`` and ``min_points`` may be columns that the keys settle, so a
    grid of parameters is one run. Rows without a finite point or with a null
    key are noise.
    """
    value = lambda v: v if isinstance(v, Column) else F.lit(v)
    finite = F.expr("abs(x) < double('infinity') and abs(y) < double('infinity')")
    known = points.where(reduce(Column.__and__, [F.col(k).isNotNull() for k in keys], finite))
    known = known.select(*keys, F.col(id).cast("long").alias("i"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), value(eps).cast("double").alias("eps"), value(min_points).cast("long").alias("least"))
    known = materialise(known, "density-points")  # once, as sums of doubles may differ when they are taken again
    spots = known.groupBy(*keys, "x", "y").agg(F.min("i").alias("i"), F.count("*").alias("w"), F.min("eps").alias("eps"), F.min("least").alias("least"))
    cell = lambda c: F.floor(F.col(c) / (F.col("eps") / 1.4143)).cast("long")  # noqa: E731  a little under eps / sqrt 2, as quotients are rounded
    spots = materialise(spots.withColumns({"cx": cell("x"), "cy": cell("y"), "eps2": F.col("eps") * F.col("eps")}), "density-spots")
    here = [*keys, "cx", "cy"]
    cells = materialise(spots.groupBy(*here).agg(F.sum("w").alias("n"), F.min("least").alias("least"), F.max("eps2").alias("eps2"), *_box()), "density-cells")
    there = [*keys, "nx", "ny"]
    near = cells.select(*keys, F.col("cx").alias("nx"), F.col("cy").alias("ny"), F.col("n").alias("b_n"), "eps2", *_prefixed(cells, "b_", _BOX))

    # spots of light cells: weight of their cell, of cells within eps as a whole, and of what they compare with
    light = spots.join(cells.where("n < least").select(*here, "n"), here)
    at_point = light.withColumns({"a_x1": F.col("x"), "a_x2": F.col("x"), "a_y1": F.col("y"), "a_y2": F.col("y")})
    looks = _meet(at_point, near, keys).where("nx <> cx or ny <> cy").withColumn("whole", _most2() <= F.col("eps2"))
    looks = materialise(looks.select(*there, "i", "x", "y", "eps2", "least", "n", "b_n", "whole"), "density-looks")
    sure = looks.groupBy("i").agg((F.max("n") + F.sum(F.when(F.col("whole"), F.col("b_n")).otherwise(0))).alias("sure"))
    others = spots.select(*keys, F.col("cx").alias("nx"), F.col("cy").alias("ny"), F.col("x").alias("o_x"), F.col("y").alias("o_y"), "w")
    d2 = (F.col("x") - F.col("o_x")) * (F.col("x") - F.col("o_x")) + (F.col("y") - F.col("o_y")) * (F.col("y") - F.col("o_y"))
    unsure = looks.where("not whole").join(sure, "i").where(F.col("sure") < F.col("least"))
    more = unsure.join(others, there).where(d2 <= F.col("eps2")).groupBy("i").agg(F.sum("w").alias("more"))
    counted = light.select("i", "n", "least").join(sure, "i", "left").join(more, "i", "left")
    lone_core = counted.where(F.coalesce("sure", "n") + F.coalesce("more", F.lit(0)) >= F.col("least")).select("i")
    heavy = spots.join(cells.where("n >= least").select(*here), here, "left_semi")
    core = heavy.select(*here, "x", "y", "i", "eps2").unionByName(light.join(lone_core, "i", "left_semi").select(*here, "x", "y", "i", "eps2"))

    core = materialise(core, "density-core-spots")
    core_cells = core.groupBy(*here).agg(F.min("i").alias("cell"), F.count("*").alias("spots"), F.max("eps2").alias("eps2"), *_box(), F.min(F.struct("x", "y")).alias("w"))
    core_cells = materialise(core_cells.select(*here, "cell", "spots", "eps2", *_BOX, F.col("w.x").alias("wx"), F.col("w.y").alias("wy")), "density-core-cells")
    core = core.join(core_cells.select(*here, "cell"), here)
    links = materialise(linked_cells(core, core_cells, keys), "density-links")
    joined = connected_components(links, "a", "b").withColumnRenamed("node", "cell")
    named = materialise(core_cells.join(joined, "cell", "left").select(*here, "eps2", *_BOX, F.coalesce("component", "cell").alias("cluster")), "density-named")

    of_core = core.join(named.select(*here, "cluster"), here).select("i", "cluster")
    border = at_point.join(core.select("i"), "i", "left_anti")
    targets = named.select(*keys, F.col("cx").alias("nx"), F.col("cy").alias("ny"), "cluster", "eps2", *_prefixed(named, "b_", _BOX))
    own = core.select(*keys, F.col("cx").alias("nx"), F.col("cy").alias("ny"), F.col("x").alias("o_x"), F.col("y").alias("o_y"))
    reached = _meet(border.select(*keys, "i", "x", "y", "eps2", "a_x1", "a_x2", "a_y1", "a_y2"), targets, keys).select(*there, "i", "x", "y", "eps2", "cluster")
    of_border = reached.join(own, there).where(d2 <= F.col("eps2")).groupBy("i").agg(F.min("cluster").alias("cluster"))

    named_spots = spots.select(*keys, F.col("x").alias("_x"), F.col("y").alias("_y"), "i").join(of_core.unionByName(of_border), "i").drop("i")
    named_spots = materialise(named_spots, "density-found")  # written first, so that a crowded spot's rows can be split
    same = [F.col(f"p.{k}") == F.col(f"s.{k}") for k in keys] + [F.col("p.x") == F.col("s._x"), F.col("p.y") == F.col("s._y")]
    found = known.alias("p").join(named_spots.alias("s"), same).select(F.col("p.i").alias("_i"), F.col("s.cluster").alias("cluster"))
    return points.select(*keys, id).join(found, F.col(id) == F.col("_i"), "left").select(*keys, id, F.coalesce("cluster", F.lit(-1)).alias("cluster"))


def clusters_of(x: np.ndarray, y: np.ndarray, grid: Sequence[tuple[float, int]]) -> list[np.ndarray]:
    """For each (eps, least) the first core point of every point's cluster, -1 for noise; as in :func:`dbscan` if points come by id."""
    most = max(eps * eps for eps, _ in grid)
    d2 = (x[:, None] - x) ** 2 + (y[:, None] - y) ** 2
    i, j = np.nonzero(d2 <= most)
    d2, found = d2[i, j], []
    for eps, least in grid:
        near = d2 <= eps * eps
        core = np.bincount(i[near], minlength=len(x)) >= least
        near &= core[j]
        a, b = i[near], j[near]
        first = np.arange(len(x))
        within = core[a]
        at, to = a[within], b[within]
        starts = np.flatnonzero(np.diff(at, prepend=-1))
        while len(at):
            least_near = first.copy()
            least_near[at[starts]] = np.minimum.reduceat(first[to], starts)
            np.minimum.at(least_near, first[at[starts]], least_near[at[starts]])  # the root takes what its points see
            least_near = least_near[least_near]
            if (least_near == first).all():
                break
            first = least_near
        own = np.full(len(x), len(x))
        starts = np.flatnonzero(np.diff(a, prepend=-1))
        if len(a):
            own[a[starts]] = np.minimum.reduceat(first[b], starts)
        found.append(np.where(own < len(x), own, -1))
    return found


def dbscan_grid(points: DataFrame, grid: Sequence[tuple[float, int]], keys: Sequence[str], id: str = "id") -> DataFrame:
    """AGG23: ``(*keys, g, id, cluster)``, :func:`dbscan` of each group with each (eps, least), which ``g`` numbers.

    A group of SMALL rows at most is one call for the whole grid, so its points
    are shuffled once and not at all if they lie together already; larger ones
    go by their cells.
    """
    rows = points.select(*keys, F.col(id).cast("long").alias(id), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    known = reduce(Column.__and__, [F.col(k).isNotNull() for k in keys])
    large = materialise(rows.where(known).groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > SMALL).select(*keys), "density-large")
    crowded = not large.isEmpty()
    small = rows.where(known)
    if crowded:
        small = small.join(large, list(keys), "left_anti")

    def cluster(group: pa.Table) -> pa.Table:
        group = group.sort_by(id)
        x, y = (group[c].to_numpy(zero_copy_only=False).astype("float64") for c in ("x", "y"))
        fine = np.flatnonzero(np.isfinite(x) & np.isfinite(y))
        ids, parts = group[id].to_numpy(), []
        for g, first in enumerate(clusters_of(x[fine], y[fine], grid)):
            named = np.full(len(ids), -1, dtype="int64")
            named[fine] = np.where(first >= 0, ids[fine[first]], -1) if len(fine) else -1
            parts.append(pa.table({**{k: group[k] for k in keys}, "g": pa.array(np.full(len(ids), g, "int32")), id: ids, "cluster": named}))
        return pa.concat_tables(parts)

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "g int", f"`{id}` bigint", "cluster bigint"])
    found = small.groupBy(*keys).applyInArrow(cluster, schema)
    each = F.explode(F.array(*[F.struct(F.lit(g).alias("g"), F.lit(float(eps)).alias("eps"), F.lit(n).alias("least")) for g, (eps, n) in enumerate(grid)]))
    found = found.unionByName(rows.where(~known).select(*keys, each.alias("p"), id).select(*keys, "p.g", id, F.lit(-1).cast("long").alias("cluster")))
    if crowded:
        n = len(grid)
        wide = rows.join(large, list(keys), "left_semi").withColumn("p", each).select(*keys, "p.*", (F.col(id) * n + F.col("p.g")).alias(id), "x", "y")
        by_cells = dbscan(wide, F.col("eps"), F.col("least"), [*keys, "g"], id)
        found = found.unionByName(by_cells.select(*keys, "g", F.expr(f"(`{id}` - g) div {n}").alias(id), F.expr(f"if(cluster < 0, -1L, (cluster - g) div {n})").alias("cluster")))
    return found
