import random

from aerotally.operators import agreement as G
from aerotally.operators.quantiles import grouped_quantiles
from pyspark.sql import functions as F


def test_equal_to_percentile_with_nulls_and_a_hot_group(spark):
    r = random.Random(1)
    rows = [(r.choice(["hot"] * 5 + ["b", None]), r.choice([None, r.randint(0, 20) * 1.0, r.gauss(0, 5)])) for _ in range(900)] + [("one", 3.5), ("none", None), ("two", 1.0), ("two", 2.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    wanted = {"low": 0.0, "q": 0.25, "mid": 0.5, "p95": 0.95, "top": 1.0}
    got = {x.g: x[1:] for x in grouped_quantiles(df, ["g"], F.col("v"), wanted).collect()}
    want = {x.g: x[1:] for x in df.where("v is not null").groupBy("g").agg(*[F.percentile("v", F.lit(q)).alias(n) for n, q in wanted.items()]).collect()}
    assert got.keys() == want.keys() and "none" not in got and all(abs(a - b) < 1e-12 for g in got for a, b in zip(got[g], want[g]))
    whole = grouped_quantiles(df, [], F.col("v"), {"m": 0.5}).collect()
    assert len(whole) == 1 and abs(whole[0].m - df.agg(F.percentile("v", F.lit(0.5))).first()[0]) < 1e-12
    assert grouped_quantiles(df.limit(0), [], F.col("v"), {"m": 0.5}).count() == 0


def test_error_tables_of_users(spark):
    rows = [("a", i, n, 3) for i, n in enumerate([1, 5, 3, 9])] + [("b", i, 3, 3) for i in range(2)]
    p = spark.createDataFrame(rows, "user_name string, image int, n int, ref int")
    assert sorted(map(tuple, G.cumulative_error(p).collect())) == [("a", 0, -2), ("a", 1, 0), ("a", 2, 0), ("a", 3, 6), ("b", 0, 0), ("b", 1, 0)]
    assert sorted(map(tuple, G.error_percentiles(p).collect())) == [("a", 2, 6, 6), ("b", 0, 0, 0)]
    got = {x.user_name: (x["mean"], x["median"]) for x in G.error_distribution(p).collect()}
    assert got == {"a": (1.5, 1.0), "b": (0.0, 0.0)}
    two = G.pair_agreement(p, "a", "b").first()
    assert (two.mae, two["mean"], two["median"], two.over, two.under, two.exact, two["max"]) == (2.0, 0.0, 0.0, 1, 1, 0, 2)
