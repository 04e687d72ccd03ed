import math
import random

import numpy as np
from pyspark.sql import functions as F

from aerotally.operators import coverage, flights


def area(spark, points, r, **kw):
    rows = coverage.buffer_area(spark.createDataFrame([("f", float(x), float(y)) for x, y in points], "flight string, x double, y double"), r, ["flight"]).collect()
    return rows[0].buffer_area if rows else 0.0


def lens(d, r):
    return 2 * r * r * math.acos(d / (2 * r)) - d / 2 * math.sqrt(4 * r * r - d * d)


def test_closed_forms(spark):
    assert abs(area(spark, [(3.3, -7.1)], 15.0) - math.pi * 225) < 1e-6
    assert abs(area(spark, [(0, 0), (11, 9), (0, 0)], 15.0) - (2 * math.pi * 225 - lens(math.hypot(11, 9), 15))) < 1e-6
    # edges and discs that only touch
    assert abs(area(spark, [(386.59, 645), (386.59, 615), (416.59, 645)], 15.0) - 3 * math.pi * 225) < 1e-6
    row = [(2.0 * i, 0.1) for i in range(80)]  # a sausage of caps
    assert abs(area(spark, row, 15.0) - (80 * math.pi * 225 - 79 * lens(2.0, 15))) < 1e-5


def test_crowded_cells_are_quartered(spark, monkeypatch):
    monkeypatch.setattr(coverage, "MOST_DISCS", 3)
    monkeypatch.setattr(coverage, "QUARTERS", 9)
    r = random.Random(1)
    points = [(r.gauss(0, 9), r.gauss(0, 9)) for _ in range(60)]
    got = area(spark, points, 8.0)
    c = np.array(points)
    exact = coverage.union_in_cell(c[:, 0], c[:, 1], 8.0, -60.0, -60.0, 120.0)
    grid = (np.arange(1200) + 0.5) / 10 - 60
    seen = sum(((grid[:, None] - x) ** 2 + (grid[None] - y) ** 2 <= 64).astype(np.uint8) for x, y in points) > 0
    assert abs(exact / (seen.sum() / 100) - 1) < 1e-3 and abs(got / exact - 1) < 1e-3


def test_pages_join_to_one_line(spark):
    r = random.Random(2)
    rows = [(f, t, float(r.randint(0, 99)), float(t)) for f in ("a", "b") for t in r.sample(range(1000), 25 if f == "a" else 10)]
    df = spark.createDataFrame(rows, "flight string, t int, x double, y double").repartition(4)
    pages = coverage.path_pages(df, ["flight"], [F.col("t")], 10).orderBy("flight", "page").collect()
    for f in ("a", "b"):
        line = [(p.x, p.y) for page in pages if page.flight == f for p in (page.line if page.page == 0 else page.line[1:])]
        assert line == [(x, y) for g, t, x, y in sorted(rows) if g == f]
    own = [p for p in pages if p.flight == "a"]
    assert [p.n for p in own] == [10, 11, 6] and own[1].line[0] == own[0].line[-1]
    assert [p.n for p in pages if p.flight == "b"] == [10]
    text = df.limit(1).select(coverage.line_text(F.array(F.struct(F.lit(1.5).alias("x"), F.lit(2.0).alias("y")), F.struct(F.lit(3.0).alias("x"), F.lit(4.0).alias("y")))).alias("t")).first().t
    assert text == "LINESTRING (1.5 2.0, 3.0 4.0)"


def test_hulls_have_their_centroid(spark):
    rows = [("a", 0.0, 0.0), ("a", 4.0, 0.0), ("a", 0.0, 2.0), ("a", 1.0, 0.5), ("b", 1.0, 1.0), ("b", 3.0, 1.0), ("c", 5.0, 6.0)]
    got = {r.flight: (r.hull_area, r.centre_x, r.centre_y, r.corners) for r in flights.hull_area(spark.createDataFrame(rows, "flight string, x double, y double"), ["flight"]).collect()}
    assert np.allclose(got["a"], (4.0, 4 / 3, 2 / 3, 3)) and np.allclose(got["b"], (0, 2, 1, 2)) and np.allclose(got["c"], (0, 5, 6, 1))


def test_areas_are_exact_to_the_last_digits():
    """Ends of discs whose places are rounded: areas that are rounded to 0.001 may not be a millionth off."""
    r = random.Random(3)
    for _ in range(40):
        c = np.array([(k * 31.03 + r.randint(0, 100) / 100, r.randint(100, 900)) for k in range(12)], float)
        got = coverage.union_in_cell(c[:, 0], c[:, 1], 15.0, -100.0, -100.0, 2000.0)
        assert abs(got - 12 * math.pi * 225) < 2e-9


def test_arcs_that_touch_in_the_middle_of_a_strip():
    """A disc that just reaches a square's edge hides nothing of another, which reaches beyond it beside that point."""
    c = np.array([(17.76, 468.0), (40.99, 494.0), (10.62, 546.0), (39.0, 476.0), (36.78, 468.0), (15.27, 525.0)])
    whole = coverage.union_in_cell(c[:, 0], c[:, 1], 15.0, 0.0, 480.0, 60.0)
    parts = [coverage.union_in_cell(c[:, 0], c[:, 1], 15.0, x, y, 15.0) for x in (0.0, 15.0, 30.0, 45.0) for y in (480.0, 495.0, 510.0, 525.0)]
    assert abs(whole - 1533.339745306239) < 1e-9 and abs(whole - sum(parts)) < 1e-9
    # the lower edge, and two that only touch below a third
    low = np.array([(0.0, 15.0), (8.0, 3.0)])
    assert abs(coverage.union_in_cell(low[:, 0], low[:, 1], 15.0, -30.0, 0.0, 60.0) - coverage.union_in_cell(low[:, 0], -low[:, 1], 15.0, -30.0, -60.0, 60.0)) < 1e-9
    beside = np.array([(0.0, 0.0), (0.0, 30.0), (14.0, 15.0)])
    assert abs(coverage.union_in_cell(beside[:, 0], beside[:, 1], 15.0, -50.0, -50.0, 100.0) - coverage.union_in_cell(beside[:, 1], beside[:, 0], 15.0, -50.0, -50.0, 100.0)) < 1e-9
