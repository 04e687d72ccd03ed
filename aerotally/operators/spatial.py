"""SP*: range, nearest and rectangle joins, all as bucketed equi-joins; FN geometry that they use."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from aerotally.operators.extremes import first_by, first_within
from aerotally.operators.graph import connected_components
from aerotally.plans.storage import materialise


def d2(ax: str, ay: str, bx: str, by: str) -> Column:
    """Squared planar distance."""
    dx, dy = F.col(ax) - F.col(bx), F.col(ay) - F.col(by)
    return dx * dx + dy * dy


def prefixed(df: DataFrame, prefix: str, columns: Sequence[str] | None = None) -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) for c in (columns or df.columns)])


def range_join(left: DataFrame, right: DataFrame, r: float, keys: Sequence[str] = (), *, lx: str = "l_x", ly: str = "l_y", rx: str = "r_x", ry: str = "r_y", width: float = 2.0) -> DataFrame:
    """Pairs within distance ``r`` with equal ``keys``, with their squared distance ``d2``.

    Space is cut into cells of side 2r (``width`` times r, at least 2: fewer copies
    are shuffled, and more rows are compared); the left side is put into one, the right
    side into the cells that a square of side 2r around it touches (four at
    most), so each pair meets exactly once in an equi-join. Rows without a point
    take no part. Keys have the same names on both sides, all other columns
    different ones.
    """
    reach = float(r) * (1 + 1e-6)  # sums are rounded
    cell = lambda c: F.floor(c / F.lit(max(width, 2.0) * reach)).cast("long")
    span = lambda c: F.explode(F.sequence(cell(F.col(c) - reach), cell(F.col(c) + reach)))
    a = left.where(F.col(lx).isNotNull() & F.col(ly).isNotNull()).withColumn("_cx", cell(F.col(lx))).withColumn("_cy", cell(F.col(ly)))
    b = right.where(F.col(rx).isNotNull() & F.col(ry).isNotNull()).withColumn("_cx", span(rx)).withColumn("_cy", span(ry))
    # sizes of files say little about laid out rows, so neither side is broadcast on their account
    joined = a.join(b.hint("merge"), [*keys, "_cx", "_cy"]).drop("_cx", "_cy").withColumn("d2", d2(lx, ly, rx, ry))
    return joined.where(F.col("d2") <= r * r)


def nearest_within(left: DataFrame, right: DataFrame, r: float, keys: Sequence[str], left_id: str, right_id: str, **xy: str) -> DataFrame:
    """SP5: each left row's nearest right row within ``r`` (ties to the smaller id); many-to-one allowed."""
    pairs = range_join(left, right, r, keys, **xy)
    order = Window.partitionBy(*keys, left_id).orderBy("d2", right_id)
    return pairs.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def close_pairs(points: DataFrame, r: float, id: str = "id", keys: Sequence[str] = ()) -> DataFrame:
    """SP9: pairs of points with 0 < distance < 2r, each once: ``(*keys, a, b, d2)``."""
    left = points.select(*keys, F.col(id).alias("a"), F.col("x").alias("l_x"), F.col("y").alias("l_y"))
    right = points.select(*keys, F.col(id).alias("b"), F.col("x").alias("r_x"), F.col("y").alias("r_y"))
    found = range_join(left, right, 2 * r, keys)
    return found.where((F.col("a") < F.col("b")) & (F.col("d2") > 0) & (F.col("d2") < 4 * r * r)).select(*keys, "a", "b", "d2")


def rectangle_pairs(boxes: DataFrame, cell: float, *, id: str = "id", keys: Sequence[str] = (), buffer: float = 0.0) -> DataFrame:
    """SP11, SP13, SP14: pairs of rectangles (x1, y1, x2, y2) that overlap once grown by ``buffer``, each once, with ``overlap_area``.

    Rectangles are put into every cell they touch; a pair is kept in the cell
    of the lower corner of its intersection only.
    """
    grown = boxes.select(*keys, F.col(id).alias("i"), (F.col("x1") - buffer).alias("x1"), (F.col("y1") - buffer).alias("y1"), (F.col("x2") + buffer).alias("x2"), (F.col("y2") + buffer).alias("y2"))
    at = lambda c: F.floor(F.col(c) / F.lit(float(cell))).cast("long")
    laid = grown.withColumn("cx", F.explode(F.sequence(at("x1"), at("x2")))).withColumn("cy", F.explode(F.sequence(at("y1"), at("y2"))))
    a, b = prefixed(laid, "a_"), prefixed(laid, "b_")
    on = [F.col(f"a_{k}").eqNullSafe(F.col(f"b_{k}")) for k in keys] + [F.col("a_cx") == F.col("b_cx"), F.col("a_cy") == F.col("b_cy"), F.col("a_i") < F.col("b_i")]
    joined = a.join(b, on)
    x1, y1, x2, y2 = F.greatest("a_x1", "b_x1"), F.greatest("a_y1", "b_y1"), F.least("a_x2", "b_x2"), F.least("a_y2", "b_y2")
    here = (F.floor(x1 / F.lit(float(cell))) == F.col("a_cx")) & (F.floor(y1 / F.lit(float(cell))) == F.col("a_cy"))
    kept = joined.where((x1 < x2) & (y1 < y2) & here)
    return kept.select(*[F.col(f"a_{k}").alias(k) for k in keys], F.col("a_i").alias("a"), F.col("b_i").alias("b"), ((x2 - x1) * (y2 - y1)).alias("overlap_area"))


def rectangle_groups(boxes: DataFrame, cell: float, buffer: float, *, id: str = "id") -> DataFrame:
    """SP13: ``(id, component)`` of rectangles whose buffered extents intersect; lone ones are their own component.

    Equal rectangles belong together and meet the others once.
    """
    sides = ["x1", "y1", "x2", "y2"]
    wide = (F.col("x1") - buffer < F.col("x2") + buffer) & (F.col("y1") - buffer < F.col("y2") + buffer)
    lone = F.when(F.coalesce(wide, F.lit(False)), F.lit(None)).otherwise(F.col(id))  # nothing meets these, not even a copy
    own = boxes.select(id, *sides, lone.alias("_lone"))
    first = materialise(own.groupBy(*sides, "_lone").agg(F.min(id).alias("_first")), "boxes")
    edges = rectangle_pairs(first, cell, id="_first", buffer=buffer)
    found = connected_components(edges, "a", "b").withColumnRenamed("node", "_first")
    named = first.join(found, "_first", "left").select(*[F.col(c).alias(f"_{c}") for c in [*sides, "_lone"]], F.coalesce("component", "_first").alias("component"))
    return own.join(named, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*sides, "_lone"]]).select(id, "component")


def overlaps_between(boxes: DataFrame, part: str, cell: float, *, id: str = "id", keys: Sequence[str] = ()) -> DataFrame:
    """SP11: ``(part_a, part_b, pairs, area)`` of overlapping rectangles of different parts, parts in order.

    Equal rectangles of a part meet the others once and count by their number.
    """
    some = boxes.where(F.col(part).isNotNull()).groupBy(*keys, "x1", "y1", "x2", "y2", part).agg(F.min(id).alias("_i"), F.count("*").alias("_w"))
    some = materialise(some, "boxes")
    of = lambda p: some.select(F.col("_i").alias(p), F.col(part).alias(f"_part_{p}"), F.col("_w").alias(f"_w_{p}"))
    met = rectangle_pairs(some, cell, id="_i", keys=keys).join(of("a"), "a").join(of("b"), "b").where("_part_a <> _part_b")
    n = F.col("_w_a") * F.col("_w_b")
    return met.groupBy(F.least("_part_a", "_part_b").alias("part_a"), F.greatest("_part_a", "_part_b").alias("part_b")).agg(F.sum(n).alias("pairs"), F.sum(F.col("overlap_area") * n).alias("area"))


def tile_of(df: DataFrame, size: float, x: str = "x", y: str = "y", *, edge: str = "exclude") -> DataFrame:
    """SP1 on a regular grid: ``tile_x, tile_y`` and tile-local coordinates; points on a tile edge have no tile unless ``edge="half_open"``."""
    tx, ty = F.floor(F.col(x) / F.lit(float(size))).cast("long"), F.floor(F.col(y) / F.lit(float(size))).cast("long")
    lx, ly = F.col(x) - tx * size, F.col(y) - ty * size
    out = df.withColumn("tile_x", tx).withColumn("tile_y", ty).withColumn("local_x", lx).withColumn("local_y", ly)
    return out.where((F.col("local_x") > 0) & (F.col("local_y") > 0)) if edge == "exclude" else out


def covering_tiles(df: DataFrame, tile: float, step: float, x: str = "x", y: str = "y") -> DataFrame:
    """SP1 on overlapping tiles: one row for every tile [i*step, i*step+tile) that holds the point strictly inside."""
    def cover(c: str) -> Column:
        first = F.floor((F.col(c) - F.lit(float(tile))) / F.lit(float(step))) + 1
        last = F.ceil(F.col(c) / F.lit(float(step))) - 1
        return F.filter(F.sequence(F.greatest(first, F.lit(0)).cast("long"), F.greatest(last, F.lit(0)).cast("long")), lambda i: (i * step < F.col(c)) & (F.col(c) < i * step + tile))
    return df.withColumn("tile_x", F.explode(cover(x))).withColumn("tile_y", F.explode(cover(y)))


def inside_polygon(x: Column, y: Column, ring: Column) -> Column:
    """FN15: crossing-number test against an array of (x, y) structs; the ring may be open or closed."""
    n = F.size(ring)
    edges = F.zip_with(ring, F.concat(F.slice(ring, 2, F.greatest(n - 1, F.lit(1))), F.slice(ring, 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    cross = lambda e: ((e.a.y > y) != (e.b.y > y)) & (x < (e.b.x - e.a.x) * (y - e.a.y) / (e.b.y - e.a.y) + e.a.x)
    return F.size(F.filter(edges, cross)) % 2 == 1


def polygon_area(ring: Column) -> Column:
    """FN15: shoelace area of a ring."""
    n = F.size(ring)
    turned = F.concat(F.slice(ring, 2, F.greatest(n - 1, F.lit(1))), F.slice(ring, 1, 1))
    parts = F.zip_with(ring, turned, lambda a, b: a.x * b.y - b.x * a.y)
    return F.abs(F.aggregate(parts, F.lit(0.0), lambda s, v: s + v)) / 2


def without_near(points: DataFrame, others: DataFrame, r: float, id: str, keys: Sequence[str] = ()) -> DataFrame:
    """SP10: rows of ``points`` with no row of ``others`` within r."""
    left = points.select(*keys, F.col(id), F.col("x").alias("l_x"), F.col("y").alias("l_y"))
    near = range_join(left, others.select(*keys, F.col("x").alias("r_x"), F.col("y").alias("r_y")), r, keys).select(*keys, id).distinct()
    return points.join(near, [*keys, id], "left_anti")


def points_in_polygon(points: DataFrame, ring: Sequence[tuple[float, float]], x: str = "x", y: str = "y") -> DataFrame:
    """SP4: rows whose point lies in a polygon, looked at within its box only."""
    xs, ys = zip(*ring)
    corners = F.array(*[F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in ring])
    boxed = points.where(F.col(x).between(float(min(xs)), float(max(xs))) & F.col(y).between(float(min(ys)), float(max(ys))))
    return boxed.where(inside_polygon(F.col(x), F.col(y), corners))


def box_shape(x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column, Column, Column]:
    """FN12: width, height, area, and width over height (null for flat boxes)."""
    w, h = x2 - x1, y2 - y1
    return w, h, w * h, F.when(h > 0, w / h)


def height_contrast(shots: DataFrame, r: float, id: str = "shot", group: str = "expedition", height: str = "height") -> DataFrame:
    """SP8: for every shot and other expedition the shot within r whose height differs most (ties to the smaller id): ``(s, e1, o, diff)``."""
    rows = shots.select(F.col(id).cast("long").alias("q"), F.col(group).alias("e"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col(height).cast("double").alias("h")).where("e is not null")
    # what differs most is the highest or the lowest; the smallest id counts where heights are missing
    sides = [1, -1] + ([] if shots.where(F.col(height).isNull()).isEmpty() else [0])
    found = first_within(rows, reduce(DataFrame.unionByName, [first_by(shots, id, group, height, side) for side in sides]), r)
    near = found.withColumn("diff", F.when(F.col("side") != 0, F.abs(F.col("h") - F.col("v") * F.col("side"))))
    near = near.groupBy(F.col("q").alias("s"), F.col("g").alias("e1")).agg(F.max_by("o", F.struct("diff", -F.col("o"))).alias("o"), F.max("diff").alias("diff"))
    return near.select(F.col("s").cast(shots.schema[id].dataType).alias("s"), "e1", F.col("o").cast(shots.schema[id].dataType).alias("o"), "diff")
