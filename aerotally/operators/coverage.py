"""AGG24, AGG25: lines, buffers and statistics of missions.

The area of a union of discs is summed over cells of a grid. A cell that one
disc covers counts whole; a cell with few discs is integrated exactly, as between
the places where arcs and edges meet the union's height is a sum of arcs; a cell
with many is quartered. What is still crowded when cells are a thousandth of the
radius counts by its middle, which moves no more area than such cells have.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from aerotally.operators.flights import hull_area, metrics
from aerotally.operators.ranking import numbers_within
from aerotally.plans.storage import materialise

#: Discs that a cell is integrated with, sides of the first cells in radii, and how often a cell may be quartered.
MOST_DISCS, FIRST_SIDE, QUARTERS = 48, 16, 14


def union_in_cell(cx: np.ndarray, cy: np.ndarray, r: float, x0: float, y0: float, side: float) -> float:
    """Exact area of the part of a square that discs of radius r cover."""
    cx, cy = cx - x0, cy - y0  # small numbers keep more digits
    # a strip ends where arcs meet each other or an edge, where they only touch too, so that their order holds in all of it
    cuts = [np.array([0.0, side]), cx - r, cx, cx + r]
    for y in (0.0, side):
        h = r * r - (y - cy) ** 2
        cuts += [cx[h > 0] - np.sqrt(h[h > 0]), cx[h > 0] + np.sqrt(h[h > 0])]
    i, j = np.triu_indices(len(cx), 1)
    dx, dy = cx[j] - cx[i], cy[j] - cy[i]
    d2 = dx * dx + dy * dy
    near = (d2 < 4 * r * r * (1 + 1e-9)) & (d2 > 0)
    lean = np.sqrt(np.maximum(r * r / d2[near] - 0.25, 0))
    mid = (cx[i] + cx[j])[near] / 2
    cuts += [mid - dy[near] * lean, mid, mid + dy[near] * lean]
    xs = np.unique(np.clip(np.concatenate(cuts), 0.0, side))
    # strips with some disc, a batch at a time
    m = (xs[:-1] + xs[1:]) / 2
    some = np.flatnonzero((np.abs(m[:, None] - cx) < r).any(1)) if len(m) else m
    return float(sum(_covered(xs[k], xs[k + 1], cx, cy, r, side) for k in np.array_split(some, len(some) // 512 + 1))) if len(some) else 0.0


def _covered(a: np.ndarray, b: np.ndarray, cx: np.ndarray, cy: np.ndarray, r: float, side: float) -> float:
    """Area that discs cover of strips from a to b, in which no arcs or edges meet."""

    def below(u: np.ndarray) -> np.ndarray:  # the integral of an arc's height
        u = np.clip(u, -r, r)
        h = np.sqrt((r - u) * (r + u))  # squares and arcsines lose half the digits near the ends
        return (u * h + r * r * np.arctan2(u, h)) / 2

    a, b = a[:, None], b[:, None]
    off = np.abs((a + b) / 2 - cx)
    h = np.sqrt(np.maximum((r - off) * (r + off), 0))
    arc, flat = below(b - cx) - below(a - cx), cy * (b - a)
    low, high = cy - h, cy + h
    low_area = np.where(low < 0, 0.0, flat - arc)
    high_area = np.where(high > side, side * (b - a), flat + arc)
    low, high = np.maximum(low, 0.0), np.minimum(high, side)
    on = (off < r) & (high > low)
    low, high = np.where(on, low, np.inf), np.where(on, high, -np.inf)
    up = np.argsort(low, axis=1)
    low, high, low_area, high_area = (np.take_along_axis(v, up, 1) for v in (low, high, low_area, high_area))
    # going up a strip, a disc adds what it has above the highest before it
    top = np.maximum.accumulate(np.pad(high, ((0, 0), (1, 0)), constant_values=-np.inf)[:, :-1], axis=1)
    more = high > top
    last = np.maximum.accumulate(np.where(more, np.arange(high.shape[1]), 0), axis=1)
    top_area = np.take_along_axis(high_area, np.pad(last, ((0, 0), (1, 0)))[:, :-1], 1)
    return float(np.where(more, high_area - np.where(low >= top, low_area, top_area), 0.0).sum())


def buffer_area(points: DataFrame, r: float, keys: Sequence[str] = ()) -> DataFrame:
    """AGG24: ``(*keys, buffer_area)``, the area within r of a group's points. Rows without a finite point have no disc."""
    finite = points.where("abs(x) < double('infinity') and abs(y) < double('infinity')")
    discs = finite.select(*keys, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).distinct()
    side = FIRST_SIDE * float(r)
    span = lambda c: F.explode(F.sequence(F.floor((F.col(c) - r) / F.lit(side)).cast("long"), F.floor((F.col(c) + r) / F.lit(side)).cast("long")))
    here = [*keys, "ix", "iy"]
    laid = discs.withColumn("ix", span("x")).withColumn("iy", span("y"))
    sums: list[DataFrame] = []

    @F.pandas_udf("double")
    def exact(discs: pd.Series, ix: pd.Series, iy: pd.Series, side: pd.Series) -> pd.Series:
        areas = []
        for some, i, j, s in zip(discs, ix, iy, side):
            c = np.array([(d["x"], d["y"]) for d in some])
            areas.append(union_in_cell(c[:, 0], c[:, 1], float(r), i * s, j * s, s))
        return pd.Series(areas, dtype="float64")

    for level in range(QUARTERS + 1):
        x0, y0 = F.col("ix") * side, F.col("iy") * side
        far = lambda c, lo: F.greatest(F.abs(F.col(c) - lo), F.abs(lo + side - F.col(c)))
        gap = lambda c, lo: F.greatest(lo - F.col(c), F.col(c) - lo - side, F.lit(0.0))
        fx, fy, gx, gy = far("x", x0), far("y", y0), gap("x", x0), gap("y", y0)
        touching = laid.where(gx * gx + gy * gy < r * r).withColumn("whole", fx * fx + fy * fy <= r * r)
        touching = materialise(touching, "discs")  # the next level is made of these
        cells = materialise(touching.groupBy(*here).agg(F.count("*").alias("n"), F.max("whole").alias("whole")), "disc-cells")
        sums.append(cells.where("whole").select(*keys, F.lit(side * side).alias("area")))
        few = touching.join(cells.where(F.expr("not whole") & (F.col("n") <= MOST_DISCS)).select(*here), here, "left_semi")
        lists = few.groupBy(*here).agg(F.collect_list(F.struct("x", "y")).alias("discs"))  # MOST_DISCS at most
        sums.append(lists.select(*keys, exact("discs", "ix", "iy", F.lit(side)).alias("area")))
        crowded = cells.where(F.expr("not whole") & (F.col("n") > MOST_DISCS)).select(*here)
        if crowded.isEmpty():
            break
        open_ = touching.join(crowded, here, "left_semi").drop("whole")
        if level == QUARTERS:
            mx, my = F.col("x") - (x0 + side / 2), F.col("y") - (y0 + side / 2)
            sums.append(open_.groupBy(*here).agg(F.max(mx * mx + my * my <= r * r).alias("in")).where("in").select(*keys, F.lit(side * side).alias("area")))
            break
        quarter = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))
        laid = open_.withColumn("_q", quarter).withColumns({"ix": F.col("ix") * 2 + F.col("_q.i"), "iy": F.col("iy") * 2 + F.col("_q.j")}).drop("_q")
        side /= 2
    out = sums[0]
    for s in sums[1:]:
        out = out.unionByName(s)
    return out.groupBy(*keys).agg(F.sum("area").alias("buffer_area"))


def path_pages(points: DataFrame, keys: Sequence[str], order: list[Column], per_page: int = 10_000) -> DataFrame:
    """AGG24: a group's points as a line, ``(*keys, page, n, line)``; ``line`` is an array of (x, y) in order.

    A line of many points comes in pages of a bounded length, a page beginning
    with the last point of the one before, so the pages' lengths add up. As
    multipoints the pages' points are taken without that first one.
    """
    numbered = numbers_within(points.where("x is not null and y is not null").select(*keys, "x", "y", *[o.alias(f"_order{i}") for i, o in enumerate(order)]), list(keys), [F.col(f"_order{i}") for i in range(len(order))], "_n", "_size")
    page = F.floor(F.col("_n") / per_page).cast("long")
    # the last point of a page is the first of the next, if there is one
    on = F.when((F.col("_n") % per_page == per_page - 1) & (F.col("_n") + 1 < F.col("_size")), F.array(page, page + 1)).otherwise(F.array(page))
    laid = numbered.withColumn("page", F.explode(on))
    line = F.transform(F.sort_array(F.collect_list(F.struct("_n", "x", "y"))), lambda p: F.struct(p.x.alias("x"), p.y.alias("y")))
    return laid.groupBy(*keys, "page").agg(F.count("*").alias("n"), line.alias("line"))


def line_text(line: Column) -> Column:
    """A line as well-known text."""
    return F.concat(F.lit("LINESTRING ("), F.array_join(F.transform(line, lambda p: F.concat_ws(" ", p.x.cast("string"), p.y.cast("string"))), ", "), F.lit(")"))


def mission_lines(shots: DataFrame, r: float = 15.0, keys: Sequence[str] = ("flight",)) -> DataFrame:
    """AGG24: images, first and last time, duration, mean height, length of the path and area of the buffer of each mission."""
    m = metrics(shots)
    per = m.groupBy(*keys).agg(
        F.count("*").alias("images"), F.min("t").alias("start"), F.max("t").alias("end"), (F.max("t") - F.min("t")).alias("duration"),
        F.avg("height").alias("mean_height"), F.coalesce(F.sum("distance_to_prev"), F.lit(0.0)).alias("length"),
    )
    return per.join(buffer_area(shots, r, keys), list(keys), "left").fillna(0.0, ["buffer_area"])


def mission_statistics(shots: DataFrame, keys: Sequence[str] = ("flight",)) -> DataFrame:
    """AGG25: mean height, path length, area, centroid and corners of the convex hull, first and last time and their difference."""
    m = metrics(shots)
    per = m.groupBy(*keys).agg(
        F.avg("height").alias("mean_height"), F.coalesce(F.sum("distance_to_prev"), F.lit(0.0)).alias("path_length"),
        F.min("t").alias("first_time"), F.max("t").alias("last_time"), (F.max("t") - F.min("t")).alias("duration"),
    )
    return per.join(hull_area(shots, keys), list(keys), "left")
