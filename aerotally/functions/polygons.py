"""FN13, FN14, FN20: polygon kernels that column expressions can't say, as Arrow-batched pandas UDFs."""

from __future__ import annotations

import heapq
import math
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

#: Corners up to which a ring is looked at for being convex.
CONVEX_CORNERS = 64
POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])


def _distance(p: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """Signed distance of points to a ring: positive inside."""
    a, b = ring, np.roll(ring, -1, axis=0)
    d = b - a
    t = ((p[:, None] - a[None]) * d[None]).sum(-1) / np.maximum((d * d).sum(-1), 1e-12)[None]
    near = a[None] + np.clip(t, 0, 1)[..., None] * d[None]
    dist = np.sqrt(((p[:, None] - near) ** 2).sum(-1)).min(1)
    cross = (a[None, :, 1] > p[:, None, 1]) != (b[None, :, 1] > p[:, None, 1])
    with np.errstate(divide="ignore", invalid="ignore"):
        at = d[None, :, 0] * (p[:, None, 1] - a[None, :, 1]) / d[None, :, 1] + a[None, :, 0]
    return np.where((cross & (p[:, None, 0] < at)).sum(1) % 2 == 1, dist, -dist)


def _normals(ring: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """A corner of each edge and the unit normal to the inside, if the ring is convex and short; edges without length are left out."""
    d = np.roll(ring, -1, axis=0) - ring
    length = np.sqrt((d * d).sum(-1))
    some = length > 0
    if len(ring) > CONVEX_CORNERS or not some.any():
        return None
    a, normal = ring[some], np.column_stack([-d[some, 1], d[some, 0]]) / length[some, None]
    side = ring @ normal.T - (a * normal).sum(-1)
    flat = 1e-9 * np.ptp(ring, axis=0).max()
    return (a, normal) if (side >= -flat).all() else (a, -normal) if (side <= flat).all() else None


def _bound(p: np.ndarray, found: np.ndarray, half: float, ring: np.ndarray, convex: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
    """What no point of the squares of ``half`` a side around ``p`` exceeds in distance, ``found`` being their middles'.

    A point is no farther from the boundary than half its distances to two edges.
    Where a square lies beside both edges, and everywhere in a convex ring, those
    are linear, and between parallel edges they make up for each other, so a ridge
    of equal distance is not split.
    """
    reach = half * math.sqrt(2)
    if convex:
        a, normal = convex
        away = p @ normal.T - (a * normal).sum(-1)
        off = np.broadcast_to(normal, (len(p), *normal.shape))
    else:
        d = np.roll(ring, -1, axis=0) - ring
        length = np.sqrt((d * d).sum(-1))
        d = d / np.maximum(length, 1e-12)[:, None]
        off = p[:, None] - ring[None]
        along = (off * d[None]).sum(-1)
        off = off - along[..., None] * d[None]
        away = np.sqrt((off * off).sum(-1))
        beside = (along >= reach) & (along <= length[None] - reach) & (away >= reach) & (away > 0)
        away = np.where(beside, away, np.inf)
        off = off / away[..., None]
    row, first = np.arange(len(p)), away.argmin(1)
    lean = np.sqrt(((off + off[row, first][:, None]) ** 2).sum(-1))
    two = (away + away[row, first][:, None]) / 2 + reach * lean / 2
    return np.minimum(found + reach, two.min(1))


def pole(ring: np.ndarray, precision: float = 0.01) -> tuple[float, float]:
    """The point inside farthest from the boundary, by branch and bound on squares.

    Squares are split in four, the most promising first: none of a square's
    points is farther from the boundary than its middle by more than half its
    diagonal, and less between edges that face each other. It ends when no square can be better than the best point by more
    than ``precision``, so the distance of the result is exact to that (or to a
    billionth of the ring's extent, if that is more).
    """
    lo, hi = ring.min(0), ring.max(0)
    side = float((hi - lo).max())
    if side == 0:
        return float(ring[0, 0]), float(ring[0, 1])
    precision = max(precision, side * 1e-9)
    half = max(float((hi - lo).min()), side / 64) / 2
    xs, ys = (np.arange(lo[i] + half, hi[i] + half, 2 * half) for i in (0, 1))
    todo = np.stack(np.meshgrid(xs, ys), -1).reshape(-1, 2)
    convex = _normals(ring)
    best, top = ring.mean(0), -math.inf
    todo = np.vstack([best, todo])  # its square is one more, and comes first among equals
    heap: list[tuple[float, float, float, float]] = []
    while True:
        found = _distance(todo, ring)
        i = int(found.argmax())
        if found[i] > top:
            best, top = todo[i], float(found[i])
        for (x, y), most in zip(todo.tolist(), _bound(todo, found, half, ring, convex).tolist()):
            if most > top + precision:
                heapq.heappush(heap, (-most, x, y, half))
        if not heap or -heap[0][0] <= top + precision:
            return float(best[0]), float(best[1])
        _, x, y, half = heapq.heappop(heap)
        half /= 2
        todo = np.array([(x + i * half, y + j * half) for i in (-1, 1) for j in (-1, 1)])


@F.pandas_udf(POINT)
def interior_centre(rings: pd.Series) -> pd.DataFrame:
    """FN14 on array<struct<x,y>>; fewer than three corners give their mean, an empty or null ring gives nulls."""
    out = []
    for r in rings:
        p = np.array([(q["x"], q["y"]) for q in r], float) if r is not None and len(r) else np.zeros((0, 2))
        out.append((None, None) if not len(p) else tuple(p.mean(0)) if len(p) < 3 else pole(p))
    return pd.DataFrame(out, columns=["x", "y"], dtype="float64")


def _cut(ring: list[tuple[float, float]], x1: float, y1: float, x2: float, y2: float) -> list[tuple[float, float]]:
    for axis, bound, sign in ((0, x1, 1), (0, x2, -1), (1, y1, 1), (1, y2, -1)):
        out = []
        for i, b in enumerate(ring):
            a = ring[i - 1]
            ina, inb = sign * (a[axis] - bound) >= 0, sign * (b[axis] - bound) >= 0
            if ina != inb:
                along, over = bound - a[axis], b[axis] - a[axis]
                out.append((a[0] + (b[0] - a[0]) * along / over, a[1] + (b[1] - a[1]) * along / over))
            if inb:
                out.append(b)
        ring = out
    return ring


def clip_ring(ring: np.ndarray, x1: float, y1: float, x2: float, y2: float) -> np.ndarray:
    """Sutherland-Hodgman against a rectangle; empty when nothing is left."""
    return np.array(_cut([(x, y) for x, y in ring.tolist()], x1, y1, x2, y2), float).reshape(-1, 2)


@F.pandas_udf(T.ArrayType(POINT))
def _crossing(xs: pd.Series, ys: pd.Series, x1: pd.Series, y1: pd.Series, x2: pd.Series, y2: pd.Series) -> pd.Series:
    out = []
    for px, py, a, b, c, d in zip(xs, ys, x1.tolist(), y1.tolist(), x2.tolist(), y2.tolist()):
        p = _cut(list(zip(np.asarray(px, float).tolist(), np.asarray(py, float).tolist())), a, b, c, d) if px is not None else ()
        out.append([{"x": x - a, "y": y - b} for x, y in p] if len(p) > 2 else None)
    return pd.Series(out, dtype=object)


def clipped(ring: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """FN20: the ring cut to a rectangle and moved into its frame; null when they don't meet.

    Only rings that have corners on both sides of an edge are cut in Python.
    """
    within = F.forall(ring, lambda p: (p.x >= x1) & (p.x <= x2) & (p.y >= y1) & (p.y <= y2))
    beyond = reduce(or_, [F.forall(ring, rule) for rule in (lambda p: p.x < x1, lambda p: p.x > x2, lambda p: p.y < y1, lambda p: p.y > y2)])
    cut = F.when(within | beyond, F.lit(None)).otherwise(ring)
    moved = F.transform(ring, lambda p: F.struct((p.x - x1).alias("x"), (p.y - y1).alias("y")))
    # said to be nondeterministic, so that filters on the result don't move it below where rows are dealt, to run twice
    crossing = _crossing.asNondeterministic()(F.transform(cut, lambda p: p.x), F.transform(cut, lambda p: p.y), x1, y1, x2, y2)
    return F.when(within & (F.size(ring) > 2), moved).when(within | beyond, F.lit(None)).otherwise(crossing)


def label_centre(ring: Column, kx: Column, ky: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """FN13: the polygon's interior centre, else the first keypoint, else the box's centre."""
    box = F.struct(((x1 + x2) / 2).alias("x"), ((y1 + y2) / 2).alias("y"))
    key = F.struct(kx.cast("double").alias("x"), ky.cast("double").alias("y"))
    return F.when(ring.isNotNull(), interior_centre(ring)).when(kx.isNotNull(), key).otherwise(box)
