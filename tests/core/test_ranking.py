import random

from aerotally.operators import ranking
from pyspark.sql import functions as F


def test_row_numbers_follow_the_order(spark):
    r = random.Random(1)
    rows = [(r.randint(0, 10**6) * 1000 + i, "x") for i in range(700)]
    got = ranking.row_numbers(spark.createDataFrame(rows, "v long, `a.b` string").repartition(5), [F.col("v").desc()]).collect()
    assert [g.v for g in sorted(got, key=lambda g: g.n)] == sorted((v for v, _ in rows), reverse=True)
    assert [g.n for g in sorted(got, key=lambda g: g.n)] == list(range(700))


def test_numbers_within_groups_with_nulls_and_a_hot_group(spark):
    r = random.Random(2)
    rows = [(r.choice(["hot", "hot", "hot", "b", None]), i) for i in range(500)]
    got = ranking.numbers_within(spark.createDataFrame(rows, "g string, v long").repartition(4), ["g"], [F.col("v")], "n", "size").collect()
    want = {}
    for g, v in sorted(rows, key=lambda x: x[1]):
        want.setdefault(g, []).append(v)
    assert {(x.g, x.v, x.n, x["size"]) for x in got} == {(g, v, i, len(vs)) for g, vs in want.items() for i, v in enumerate(vs)}


def test_dense_ids_and_empty(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",), ("c",)], "v string")
    assert sorted(map(tuple, ranking.dense_ids(df, "v", "id").collect())) == [("a", 1), ("b", 2), ("c", 3)]
    assert ranking.row_numbers(df.limit(0), [F.col("v")]).count() == 0 and ranking.dense_ids(df.limit(0), "v", "id").count() == 0


def test_running_sums_with_nulls_ties_and_a_hot_group(spark):
    r = random.Random(3)
    rows = [(r.choice(["hot", "hot", "hot", "b", None]), i, r.choice([None, 1, 2, 5]), i / 2) for i in range(800)]
    df = spark.createDataFrame(rows, "g string, v long, w long, x double").repartition(6)
    got = {(x.g, x.v): (x.total, x.n, x.half) for x in ranking.running_sums(df, ["g"], [F.col("v").desc()], {"total": F.col("w"), "n": F.lit(1), "half": F.col("x")}).collect()}
    want, now = {}, {}
    for g, v, w, x in sorted(rows, key=lambda r: -r[1]):
        t, n, h = now.get(g, (None, 0, 0.0))
        now[g] = want[g, v] = (t if w is None else (t or 0) + w, n + 1, h + x)
    assert got == want
    assert ranking.running_sums(df.limit(0), ["g"], [F.col("v")], {"total": F.col("w")}).count() == 0
