import math
import random

from aerotally.operators import nearest
from pyspark.sql import functions as F


def brute(left, right, k):
    out = []
    for key, l, x, y in left:
        near = sorted(((x - u) * (x - u) + (y - v) * (y - v), r) for kk, r, u, v in right if kk == key)
        out += [(l, i + 1, r) for i, (_, r) in enumerate(near[:k])]
    return sorted(out)


def frames(spark, left, right):
    return spark.createDataFrame(left, "g int, l long, l_x double, l_y double"), spark.createDataFrame(right, "g int, r long, r_x double, r_y double")


def test_outliers_spots_and_keys_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(nearest, "LEAF", 4)
    r = random.Random(8)
    right = [(r.randint(0, 2), i, r.choice([r.gauss(0, 3), r.uniform(-500, 500), 7.0]), r.choice([r.gauss(0, 3), r.uniform(-500, 500), 7.0])) for i in r.sample(range(10**6), 500)]
    right += [(0, 10**7 + i, 7.0, 7.0) for i in range(40)] + [(1, 1, 1e9, -1e9)]
    left = [(r.randint(0, 3), i, r.uniform(-600, 600), r.gauss(0, 50)) for i in range(80)] + [(0, 900, 1e8, 1e8), (0, 901, 7.0, 7.0), (1, 902, 0.0, 0.0)]
    a, b = frames(spark, left, right)
    for k in (1, 5):
        got = sorted((x.l, x["rank"], x.r) for x in nearest.k_nearest(a, b, k, "l", "r", keys=["g"]).collect())
        assert got == brute(left, right, k)


def test_few_rows_other_columns_and_none(spark):
    a, b = frames(spark, [(0, 1, 0.0, 0.0), (0, 2, None, 1.0)], [(0, 5, 3.0, 4.0), (0, 6, float("nan"), 0.0)])
    got = nearest.k_nearest(a.withColumn("name", F.lit("n")), b.drop("g").withColumn("kind", F.lit("q")), 4, "l", "r").collect()
    assert [(x.l, x.r, x.d2, x["rank"], x.name, x.kind) for x in got] == [(1, 5, 25.0, 1, "n", "q")]
    assert nearest.k_nearest(a, b.drop("g").limit(0), 2, "l", "r").count() == 0 == nearest.k_nearest(a.limit(0), b.drop("g"), 2, "l", "r").count()


def test_one_outlier_among_many_points(spark):
    n = 200_000
    points = spark.range(n).select(F.col("id").alias("r"), (F.col("id") % 500).cast("double").alias("r_x"), F.floor(F.col("id") / 500).cast("double").alias("r_y"))
    rows = spark.createDataFrame([(1, 1e7, 200.2), (2, 250.1, 100.1)], "l long, l_x double, l_y double")
    got = sorted((x.l, x["rank"], x.r_x, x.r_y) for x in nearest.k_nearest(rows, points, 2, "l", "r").collect())
    assert got == [(1, 1, 499.0, 200.0), (1, 2, 499.0, 201.0), (2, 1, 250.0, 100.0), (2, 2, 251.0, 100.0)] and math.isfinite(got[0][2])


def test_left_rows_of_one_place_are_searched_for_once(spark, monkeypatch):
    searched = {}
    real = nearest.materialise
    monkeypatch.setattr(nearest, "materialise", lambda df, label: searched.update({label: real(df, label)}) or searched[label])
    r = random.Random(5)
    right = [(r.randint(0, 1), i, float(r.randint(0, 20)), float(r.randint(0, 20))) for i in range(150)]
    left = [(i % 3, i, float(i % 4), float(i % 2)) for i in range(600)] + [(0, 700, None, 1.0)]
    a, b = frames(spark, left, right)
    found = nearest.k_nearest(a.withColumn("name", F.col("l")), b, 3, "l", "r", keys=["g"], crowded=True)
    assert sorted((x.l, x["rank"], x.r) for x in found.collect()) == brute(left[:600], right, 3)
    assert found.where("name <> l").count() == 0
    assert searched["nearest-rows"].count() == 12


def test_pairs_of_a_leaf_are_not_shuffled(spark):
    """Between the points of a leaf and the rows that look there, only the k nearest go on."""
    r = random.Random(6)
    left = [(0, i, r.uniform(0, 100), r.uniform(0, 100)) for i in range(2000)]
    right = [(0, i, r.uniform(0, 100), r.uniform(0, 100)) for i in range(32)]
    a, b = frames(spark, left, right)
    found = nearest.k_nearest(a, b, 2, "l", "r", keys=["g"])
    sc, store = spark.sparkContext, spark._jsc.sc().statusStore()
    doubles, none = sc._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList()
    stages = lambda: store.stageList(None, False, False, doubles, none)
    before = {s.stageId() for s in (stages().apply(i) for i in range(stages().size()))}
    got = sorted((x.l, x["rank"], x.r) for x in found.collect())
    new = [s for s in (stages().apply(i) for i in range(stages().size())) if s.stageId() not in before]
    assert got == brute(left, right, 2)
    assert max(s.shuffleWriteRecords() for s in new) <= 2 * len(left)
    assert "collect_list" in found._jdf.queryExecution().executedPlan().toString()
