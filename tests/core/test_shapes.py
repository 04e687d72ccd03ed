import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerotally.functions import polygons as P
from aerotally.operators import clustering as C, tiling as T
from aerotally.sources import writers as W

TWO_LOBES = [(0, 0), (10, 0), (10, 4.9), (30, 4.9), (30, -0.5), (40.3, -0.5), (40.3, 10.5), (30, 10.5), (30, 5.1), (10, 5.1), (10, 10), (0, 10)]
L_SHAPE = [(0, 0), (100, 0), (100, 8), (9, 8), (9, 60), (0, 60)]


@pytest.mark.parametrize("ring", [TWO_LOBES, L_SHAPE, [(0, 0), (7, 1), (3, 9)], [(0, 0), (1000, 0), (1000, 0.5), (0, 0.5)], [(5, 5), (9, 5), (9, 5), (5, 9)]])
def test_pole_is_as_far_from_the_edge_as_any_point(ring):
    ring = np.array(ring, float)
    own = P._distance(np.array([P.pole(ring)]), ring)[0]
    lo, hi = ring.min(0), ring.max(0)
    grid = np.stack(np.meshgrid(np.linspace(lo[0], hi[0], 400), np.linspace(lo[1], hi[1], 400)), -1).reshape(-1, 2)
    assert own > 0 and own >= max(P._distance(grid[i : i + 20000], ring).max() for i in range(0, len(grid), 20000)) - 0.01


def test_label_centres(spark):
    ring = [{"x": float(x), "y": float(y)} for x, y in TWO_LOBES]
    rows = [(1, ring, None, 2.0), (2, None, 7.0, 2.0), (3, None, None, 2.0), (4, ring[:2], 7.0, 2.0), (5, [], None, 2.0)]
    df = spark.createDataFrame(rows, "id int, ring array<struct<x:double,y:double>>, kx double, x1 double")
    c = P.label_centre(F.col("ring"), F.col("kx"), F.col("kx") + 1, F.col("x1"), F.lit(0.0), F.col("x1") + 4, F.lit(6.0))
    got = {r.id: (r.c.x, r.c.y) for r in df.select("id", c.alias("c")).collect()}
    assert abs(got[1][0] - 35.15) < 0.4 and abs(got[1][1] - 5) < 0.4
    assert got[2] == (7.0, 8.0) and got[3] == (4.0, 3.0) and got[4] == (5.0, 0.0) and got[5] == (None, None)


def brute_pairs(occupied, free):
    free, out = set(free), []
    for tx, ty in sorted(occupied, key=lambda t: (t[1], t[0])):
        if not free:
            break
        best = min(free, key=lambda f: ((f[0] - tx) ** 2 + (f[1] - ty) ** 2, f[1], f[0]))
        free.remove(best)
        out.append((tx, ty, *best))
    return out


def test_empty_tiles_are_taken_in_order_without_replacement(spark):
    r = random.Random(3)
    images = {}
    for image in range(6):
        grid = [(x - 3, y) for x in range(14) for y in range(11)]
        used = set(r.sample(grid, r.choice([1, 20, 120])))
        images[image] = (used, [g for g in grid if g not in used])
    a = spark.createDataFrame([(i, *t) for i, (used, _) in images.items() for t in used], "image int, tx long, ty long")
    b = spark.createDataFrame([(i, *t) for i, (_, free) in images.items() for t in free], "image int, tx long, ty long")
    got = sorted(map(tuple, T.paired_empty_tiles(a, b).collect()))
    assert got == sorted((i, *row) for i, (used, free) in images.items() for row in brute_pairs(used, free))
    assert T.paired_empty_tiles(a, b.limit(0)).count() == 0


def test_a_block_of_many_tiles_takes_the_ring_around_it():
    n, size = 120, 400  # 14,400 occupied tiles in the middle of 160,000
    lo, hi = (size - n) // 2, (size + n) // 2
    free = T.FreeTiles(np.array([(x, y) for x in range(size) for y in range(size) if not (lo <= x < hi and lo <= y < hi)]))
    taken = [free.take(x, y) for y in range(lo, hi) for x in range(lo, hi)]
    assert len(set(taken)) == n * n and None not in taken
    assert taken[0] == (lo, lo - 1) and all(not (lo <= x < hi and lo <= y < hi) for x, y in taken)
    assert max(math.hypot(x - size / 2, y - size / 2) for x, y in taken) < 125


def test_principal_components(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(300, 4)) @ np.diag([1, 6, 3, 0.2])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id int, embedding array<double>")
    values, vectors = np.linalg.eigh(np.cov(x.T))
    order = values.argsort()[::-1]
    got = sorted(map(tuple, C.contributions(df, 3).collect()))
    for (i, share, dimension, loading), k in zip(got, order):
        assert abs(share - values[k] / values.sum()) < 1e-9 and dimension == np.abs(vectors[:, k]).argmax() and abs(loading - np.abs(vectors[:, k]).max()) < 1e-9
    assert [g[0] for g in got] == [0, 1, 2] and [g[2] for g in got] == [1, 2, 0]
    own = np.array([row.pca for row in C.components(df, 2).orderBy("vec_id").collect()])
    assert np.allclose(np.abs(own), np.abs(x @ vectors[:, order[:2]]), atol=1e-6)


def test_pages_hold_every_row_once(spark):
    df = spark.range(0, 500, 1, 7).select(F.lit("same").alias("v"))
    sizes = [r["count"] for r in W.paged(df, "page", 50).groupBy("page").count().collect()]
    assert sum(sizes) == 500 and len(sizes) == 10 and max(sizes) < 100
