import random

from aerotally.operators import graph


def brute(edges):
    root = {}

    def find(a):
        while root.setdefault(a, a) != a:
            a = root[a]
        return a

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {a: find(a) for a in root}


def test_random_graphs_chains_and_stars(spark):
    r = random.Random(1)
    stars = [(10_000 + 100 * i, 10_000 + 100 * i + j) for i in range(20) for j in range(1, r.randint(2, 40))]
    chain = [(-i, -i - 1) for i in range(1, 120)]
    loose = [(r.randint(1, 400), r.randint(1, 400)) for _ in range(260)]
    for edges in (stars, stars + chain, loose, stars + chain + loose + [(10_005, 3), (9, 9), (777_777, 777_777)]):
        df = spark.createDataFrame(edges + edges[:5], "src long, dst long").repartition(3)
        got = {x.node: x.component for x in graph.connected_components(df).collect()}
        assert got == brute(edges)
    assert graph.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0
