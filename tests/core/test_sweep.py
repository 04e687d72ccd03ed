import random

import numpy as np
from pyspark.sql import functions as F

from aerotally.operators import sweep


def brute(points, r):
    cluster = {}
    for s, x, y in sorted(points):
        if s not in cluster:
            for t, u, v in points:
                if t not in cluster and (x - u) * (x - u) + (y - v) * (y - v) <= r * r:
                    cluster[t] = s
    return cluster


def found(spark, points, r, **kw):
    df = spark.createDataFrame([(s, float(x), float(y), "k") for s, x, y in points], "seq long, x double, y double, cluster string").repartition(3)
    return {g.seq: g.cluster for g in sweep.sweep_clusters(df.drop("cluster"), r, **kw).collect()}


def test_blocks_of_any_size_match_brute_force(spark):
    r = random.Random(4)
    points = [(i, r.choice([r.randint(0, 400) / 2, r.gauss(50, 8)]), r.randint(0, 200) / 2) for i in r.sample(range(10**6), 500)]
    points += [(10**6 + i, 30.0, 30.0) for i in range(20)] + [(-5, -40.5, 7.0), (-4, -41.0, 7.0)]
    want = brute(points, 3.0)
    for most in (100_000, 150, 20):
        assert found(spark, points, 3.0, most=most) == want


def test_waiting_cells_beyond_the_look_are_still_exact(spark, monkeypatch):
    monkeypatch.setattr(sweep, "LOOKED_AT", 2)
    r = random.Random(5)
    points = [(i, r.gauss(0, 12), r.gauss(0, 12)) for i in range(400)]
    assert found(spark, points, 4.0, most=60) == brute(points, 4.0)


def test_a_chain_of_ten_thousand_points(spark):
    n = 10_000
    chain = [(i, 0.9 * i, 0.0) for i in range(n)]
    got = found(spark, chain, 1.0, most=3000)
    # each odd point is claimed by the even one before it
    assert got == {i: i - i % 2 for i in range(n)}


def test_a_dense_spot_costs_no_pairs(spark):
    df = spark.range(100_000).select(F.col("id").alias("seq"), F.lit(5.0).alias("x"), (F.col("id") % 2 * 0.1).alias("y"))
    assert sweep.sweep_clusters(df, 1.0).agg(F.min("cluster"), F.max("cluster"), F.count("*")).first()[:] == (0, 0, 100_000)


def test_agreement_first_points_and_summary(spark):
    rows = [(1, 0.0, 0.0, "a"), (2, 0.5, 0.0, "a"), (3, 0.0, 0.5, "b"), (4, 9.0, 9.0, "a"), (5, 9.5, 9.0, "a"), (6, 20.0, 0.0, "c"), (7, 20.5, 0.0, "b"), (8, 20.0, 0.5, "a"), (9, None, 1.0, "a"), (10, float("nan"), 1.0, "a")]
    df = spark.createDataFrame(rows, "seq long, x double, y double, user_name string")
    all_ = sorted((r.cluster, r.users, r.points, r.x, r.y) for r in sweep.sweep_agreement(df, 1.0, 2).collect())
    assert [a[:3] for a in all_] == [(1, 2, 3), (6, 3, 3)] and np.allclose(all_[0][3:], (0.5 / 3, 0.5 / 3))
    first = sorted((r.cluster, r.users, r.points, r.x, r.y) for r in sweep.sweep_agreement(df, 1.0, 1, first_only=True).collect())
    assert first == [(1, 2, 2, 0.0, 0.25), (4, 1, 1, 9.0, 9.0), (6, 3, 3, sum((20.0, 20.5, 20.0)) / 3, 0.5 / 3)]
    got = sweep.agreement_summary(df, 1.0, 2).first().asDict()
    assert got == {"agreement_points": 6, "disagreement_points": 2, "points": 8, "locations": 2, "avg_users": 2.5, "max_users": 3, "min_users": 2, "agreement_rate": 0.75}
    none = sweep.agreement_summary(df.limit(0), 1.0, 2).first()
    assert (none.points, none.agreement_rate, none.avg_users) == (0, 0.0, 0.0)


def test_known_seeds_are_not_sent_to_the_last_block(spark, monkeypatch):
    """A few points wait at the edges of blocks; the block that holds them all holds nothing else."""
    sizes, real = spark.sparkContext.accumulator(0), sweep.sweep_block

    def counted(order, *args):
        sizes.add(len(order))
        return real(order, *args)

    monkeypatch.setattr(sweep, "sweep_block", counted)
    r = random.Random(6)
    points = [(i, r.uniform(0, 900), r.uniform(0, 900)) for i in r.sample(range(10**6), 3000)]
    got = found(spark, points, 3.0, most=1000)
    assert got == brute(points, 3.0)
    # each point once, what lies around blocks, and the few that wait; all seeds again would be some 2,500 more
    assert 3000 <= sizes.value < 3000 * 1.4
