import random

import pytest

from aerotally.operators import density
from pyspark.sql import functions as F


def brute(points, eps, least):
    near = {i: [j for j, u, v in points if (x - u) * (x - u) + (y - v) * (y - v) <= eps * eps] for i, x, y in points}
    core = {i for i, n in near.items() if len(n) >= least}
    root = {}
    for i in sorted(core):
        if i not in root:
            root[i], todo = i, [i]
            while todo:
                for k in near[todo.pop()]:
                    if k in core and k not in root:
                        root[k] = i
                        todo.append(k)
    return {i: root[i] if i in core else min([root[j] for j in n if j in core], default=-1) for i, n in near.items()}


def found(spark, points, eps, least):
    df = spark.createDataFrame([(i, float(x), float(y)) for i, x, y in points], "id long, x double, y double").repartition(3)
    return {r.id: r.cluster for r in density.dbscan(df, eps, least).collect()}


@pytest.mark.parametrize("seed, eps, least, pairs", [(1, 5.0, 4, 256), (2, 3.0, 1, 4), (3, 9.0, 12, 0)])
def test_matches_brute_force(spark, monkeypatch, seed, eps, least, pairs):
    monkeypatch.setattr(density, "PAIRS", pairs)
    r = random.Random(seed)
    points = [(i, r.choice([r.randint(-200, 200) / 2, r.gauss(0, 6)]), r.choice([r.randint(-100, 100) / 2, r.gauss(0, 6)])) for i in r.sample(range(10**6), 350)]
    points += [(10**6 + i, 60.0, -60.0) for i in range(8)]
    assert found(spark, points, eps, least) == brute(points, eps, least)


def test_cells_that_only_split_boxes_can_tell(spark, monkeypatch):
    monkeypatch.setattr(density, "PAIRS", 1)
    r = random.Random(6)
    # two arcs whose boxes overlap, just over eps apart, and two that touch in one pair
    arc = [(i, 10 * (i / 60), (i % 7) / 50) for i in range(60)]
    points = arc + [(100 + i, x, y + 2.0 + r.random() / 100 + (0.0 if i != 31 else -0.2)) for i, x, y in arc] + [(300 + i, x + 40, y) for i, x, y in arc] + [(500 + i, x + 40, y + 2.13) for i, x, y in arc]
    got = found(spark, points, 2.0, 3)
    assert got == brute(points, 2.0, 3) and len(set(got.values())) == 3


def test_a_crowded_spot_is_linear(spark):
    df = spark.range(100_000).select("id", F.when(F.col("id") % 3 == 0, 1.0).otherwise(F.col("id") % 1000 / 1000).alias("x"), F.lit(2.0).alias("y"))
    assert density.dbscan(df, 5.0, 30).agg(F.count("*"), F.min("cluster"), F.max("cluster")).first()[:] == (100_000, 0, 0)


def test_keys_parameters_as_columns_and_odd_rows(spark):
    r = random.Random(7)
    points = [(i, r.randint(0, 60) / 2, r.randint(0, 60) / 2) for i in range(120)]
    rows = [(k, i * 4 + k, x, y) for k in range(3) for i, x, y in points] + [(None, 10_000, 1.0, 1.0), (1, 10_001, None, 1.0), (1, 10_003, float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "k int, id long, x double, y double")
    got = {r.id: r.cluster for r in density.dbscan(df, F.col("k") + 1.5, F.col("k") + 2, ["k"]).collect()}
    want = {10_000: -1, 10_001: -1, 10_003: -1}
    for k in range(3):
        want |= {i * 4 + k: c * 4 + k if c >= 0 else -1 for i, c in brute(points, k + 1.5, k + 2).items()}
    assert got == want
    assert density.dbscan(df.limit(0), 1.0, 2, ["k"]).count() == 0


@pytest.mark.parametrize("small", [1000, 70, 0])
def test_a_grid_of_parameters_by_groups(spark, monkeypatch, small):
    """Small groups are one call each, whose points aren't written; larger ones go by cells; both are as one run each."""
    monkeypatch.setattr(density, "SMALL", small)
    written, real = [], density.materialise
    monkeypatch.setattr(density, "materialise", lambda df, label: written.append(label) or real(df, label))
    r = random.Random(8)
    points = {k: [(k * 1000 + i, r.randint(0, 40) / 2, r.randint(0, 40) / 2) for i in range(n)] for k, n in ((0, 60), (1, 120), (2, 1))}
    chain = [(3000 + i, float(j), 0.0) for j, i in enumerate(r.sample(range(50), 50))]
    points[3] = chain
    rows = [(k, i, x, y) for k, group in points.items() for i, x, y in group] + [(None, 9000, 1.0, 1.0), (1, 9001, None, 1.0), (1, 9002, float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "k int, id long, x double, y double").repartition(3)
    grid = [(1.0, 3), (2.0, 4), (1.0, 1)]
    got = {(x.g, x.id): x.cluster for x in density.dbscan_grid(df, grid, ["k"]).collect()}
    want = {(g, i): -1 for g in range(3) for i in (9000, 9001, 9002)}
    for group in points.values():
        for g, (eps, least) in enumerate(grid):
            want |= {(g, i): c for i, c in brute(group, eps, least).items()}
    assert got == want
    assert ("density-points" in written) == (small < 1000)
