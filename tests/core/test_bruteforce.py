import itertools
import math
import random

import numpy as np
import pytest

from aerotally.operators import density as D, flights as L, graph, matching as M, nearest, spatial as S, sweep, tiling as T
from pyspark.sql import functions as F

GT = [("a", 1, 100.0, 100.0), ("b", 2, 200.0, 200.0), ("c", 3, 300.0, 300.0)]
PRED = [("a", 1, 100.2, 100.3), ("b", 2, 200.1, 200.2), ("c", 3, 400.0, 400.0)]
POINT = "image string, id long, x double, y double"


def frame(spark, rows, schema=POINT):
    return spark.createDataFrame(rows, schema)


def test_matching_toy(spark):
    gt, pred = frame(spark, GT), frame(spark, PRED)
    m = M.match_greedy(gt, pred, 5.0)
    assert sorted((r.image, r.gt_id, r.pred_id) for r in m.collect()) == [("a", 1, 1), ("b", 2, 2)]
    kinds = sorted((r.image, r.kind) for r in M.labelled(gt, pred, m).collect())
    assert kinds == [("a", "tp"), ("b", "tp"), ("c", "fn"), ("c", "fp")]


def test_greedy_and_optimal_differ_on_a_chain(spark):
    gt = frame(spark, [("i", 1, 0.0, 0.0), ("i", 2, 3.0, 0.0)])
    pred = frame(spark, [("i", 1, 1.4, 0.0), ("i", 2, -2.0, 0.0)])
    assert [(r.gt_id, r.pred_id) for r in M.match_greedy(gt, pred, 2.0, truncate=False).collect()] == [(1, 1)]
    assert sorted((r.gt_id, r.pred_id) for r in M.match_optimal(gt, pred, 2.0).collect()) == [(1, 2), (2, 1)]


def test_random_matching_against_brute_force(spark):
    r = random.Random(1)
    gt, pred = ([("i%d" % k, i, float(r.randint(0, 14)), float(r.randint(0, 14))) for k in range(6) for i in range(5)] for _ in range(2))
    want_g, want_o = set(), []
    for k in range(6):
        g = [p for p in gt if p[0] == f"i{k}"]
        q = [p for p in pred if p[0] == f"i{k}"]
        d = {(a[1], b[1]): math.dist(a[2:], b[2:]) for a in g for b in q}
        near = [min((d[a[1], b[1]], b[1]) for b in q) + (a[1],) for a in g]
        for b in q:
            c = sorted((x, a) for x, p, a in near if p == b[1] and x <= 4)
            if c:
                want_g.add((f"i{k}", c[0][1], b[1]))
        best = min((-sum(d[i, j] <= 4 for i, j in zip(range(5), p)), round(sum(d[i, j] for i, j in zip(range(5), p) if d[i, j] <= 4), 9)) for p in itertools.permutations(range(5)))
        want_o.append(best)
    a, b = frame(spark, gt), frame(spark, pred)
    got = {(x.image, x.gt_id, x.pred_id) for x in M.match_greedy(a, b, 4.0).collect()}
    assert got == want_g
    opt = M.match_optimal(a, b, 4.0).collect()
    for k in range(6):
        own = [x for x in opt if x.image == f"i{k}"]
        assert len({x.gt_id for x in own}) == len(own) == len({x.pred_id for x in own}) == -want_o[k][0]
        assert abs(sum(math.sqrt(x.d2) for x in own) - want_o[k][1]) < 1e-6


def test_match_edges_hold_every_point_once(spark):
    gt = frame(spark, [("i", 1, 0.0, 0.0), ("i", 2, 3.0, 0.0), ("j", 1, 50.0, 0.0)])
    pred = frame(spark, [("i", 7, 3.0, 4.0), ("i", 8, 100.0, 0.0), ("k", 9, 0.0, 0.0)])
    got = {(x.image, x.gt_id, x.pred_id): x.distance for x in M.match_edges(gt, pred, 4.5).collect()}
    assert got == {("i", 2, 7): 4.0, ("i", 1, None): None, ("j", 1, None): None, ("i", None, 8): None, ("k", None, 9): None}


def test_components_sweep_and_dbscan(spark):
    r = random.Random(2)
    pts = [(i, r.uniform(0, 60), r.uniform(0, 60), f"u{i % 4}") for i in range(150)]
    df = spark.createDataFrame(pts, "seq long, x double, y double, user_name string")
    d = lambda a, b: math.dist(a[1:3], b[1:3])
    cluster = {}
    for p in pts:
        if p[0] not in cluster:
            for q in pts:
                if q[0] not in cluster and d(p, q) <= 4:
                    cluster[q[0]] = p[0]
    assert {x.seq: x.cluster for x in sweep.sweep_clusters(df, 4.0).collect()} == cluster
    near = {p[0]: [q[0] for q in pts if d(p, q) <= 4] for p in pts}
    core = {i for i, n in near.items() if len(n) >= 4}
    root = {i: i for i in core}
    while True:
        new = {i: min(root[j] for j in near[i] if j in core) for i in core}
        if new == root:
            break
        root = new
    want = {i: root[i] if i in core else min([root[j] for j in near[i] if j in core], default=-1) for i in near}
    got = D.dbscan(df.withColumnRenamed("seq", "id"), 4.0, 4)
    assert {x.id: x.cluster for x in got.collect()} == want
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 100), (None, 3)], "src long, dst long")
    assert {(x.node, x.component) for x in graph.connected_components(chain).collect()} == {(i, 0) for i in range(61)} | {(100, 100)}


def test_nearest_rectangles_and_polygons(spark):
    r = random.Random(3)
    a = [(i, r.uniform(0, 500), r.uniform(0, 500)) for i in range(40)]
    b = [(i, r.uniform(0, 100), r.uniform(0, 500)) for i in range(60)]
    got = nearest.k_nearest(spark.createDataFrame(a, "l long, l_x double, l_y double"), spark.createDataFrame(b, "r long, r_x double, r_y double"), 3, "l", "r").collect()
    assert sorted((x.l, x["rank"], x.r) for x in got) == sorted((p[0], k + 1, q) for p in a for k, (_, q) in enumerate(sorted((math.dist(p[1:], c[1:]), c[0]) for c in b)[:3]))
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (4, 0), (4, 3), (0, 3))])
    one = spark.range(1).select(S.polygon_area(ring).alias("a"), S.inside_polygon(F.lit(1.0), F.lit(1.0), ring).alias("i"), S.inside_polygon(F.lit(5.0), F.lit(1.0), ring).alias("o")).first()
    assert (one.a, one.i, one.o) == (12.0, True, False)


def test_flight_path_fixture(spark):
    lat, lon, rows = 0.0, 0.0, []
    for i in range(13):
        rows.append((i, 1, i * 5.0, lon * 111320, lat * 111320, 1 / 500, 2.5, 5472, 3648, 0.0, -90.0))
        if i < 4 or i >= 8:
            lon += 0.0005 if i < 4 else -0.0005
        else:
            lat -= 0.0005
    m = L.metrics(spark.createDataFrame(rows, "shot long, flight int, t double, x double, y double, exposure double, gsd double, image_width int, image_height int, yaw double, pitch double")).orderBy("shot").collect()
    assert m[0].distance_to_prev is None and m[0].speed_m_per_s is None
    assert all(abs(r.distance_to_prev - 55.66) < 0.1 and r.time_diff_seconds == 5 for r in m[1:])
    assert abs(m[1].ground_width_m - 136.8) < 1e-9 and abs(m[1].ground_height_m - 91.2) < 1e-9
    assert {"E", "S", "W"} == {r.flight_direction for r in m[1:]}


def test_utm_and_hull(spark):
    e, n = L.utm(F.lit(-91.0), F.lit(-0.5), 15)
    x, y = L.utm(F.lit(-93.0), F.lit(0.0), 15)
    r = spark.range(1).select(e.alias("e"), n.alias("n"), x.alias("x"), y.alias("y")).first()
    assert abs(r.x - 500000) < 1e-6 and abs(r.y) < 1e-6
    assert 722000 < r.e < 723000 and 9944000 < r.n < 9945000
    p = spark.createDataFrame([("m", float(x), float(y)) for x in range(11) for y in range(6)], "k string, x double, y double")
    h = L.hull_area(p, ["k"]).first()
    assert h.hull_area == 50.0 and h.corners == 4


def test_polygon_kernels():
    from aerotally.functions import polygons as P

    x, y = P.pole(np.array([(0, 0), (10, 0), (10, 4), (0, 4)], float))
    assert abs(y - 2) < 0.05 and 1.9 <= x <= 8.1
    assert sorted(map(tuple, P.clip_ring(np.array([(-5, -5), (5, -5), (5, 5), (-5, 5)], float), 0, 0, 9, 9))) == [(0, 0), (0, 5), (5, 0), (5, 5)]
    assert len(P.clip_ring(np.array([(0, 0), (1, 0), (1, 1)], float), 5, 5, 9, 9)) == 0


def test_splits_and_background(spark):
    items = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(100)], "id long, c string")
    s = T.stratified_split(items, "c", "id", 0.7, cap=20).groupBy("c", "part").count().collect()
    assert sorted((r.c, r.part, r["count"]) for r in s) == [("a", "train", 14), ("a", "val", 6), ("b", "train", 14), ("b", "val", 6)]
    im = spark.createDataFrame([("i", 100, 100)], "image string, image_width int, image_height int")
    pos = spark.createDataFrame([("i", 50.0, 50.0)], "image string, x double, y double")
    bg = T.background_points(im, pos, 10, 5.0, 30.0).collect()
    assert len(bg) == 10 and all(math.dist((r.x, r.y), (50, 50)) > 30 and 5 <= r.x <= 95 for r in bg)
    with pytest.raises(ValueError):
        T.hold_out(items, 1000, "id")


def test_null_points_take_no_part(spark):
    gt = frame(spark, [("a", 1, None, 1.0), ("a", 2, 1.0, 1.0)])
    assert [(r.gt_id, r.pred_id) for r in M.match_greedy(gt, frame(spark, [("a", 9, 1.0, 1.0)]), 2.0).collect()] == [(2, 9)]
    assert M.match_optimal(gt.limit(0), gt, 2.0).count() == 0


def test_sparse_assignment_equals_the_dense_one():
    import numpy as np
    from aerotally.operators.matching import assign, assign_sparse

    r = np.random.default_rng(1)
    for turn in range(150):
        n, m = r.integers(1, 9, 2)
        rows, columns = np.nonzero(r.random((n, m)) < r.choice([0.2, 0.5, 0.9]))
        if not len(rows):
            continue
        distance = r.integers(1, 20, len(rows)).astype(float) if turn % 2 else r.random(len(rows))
        far = 1 + 2 * distance.sum()
        rows, columns = np.unique(rows, return_inverse=True)[1], np.unique(columns, return_inverse=True)[1]
        cost = np.full((rows.max() + 1, rows.max() + columns.max() + 2), far)
        cost[rows, columns] = distance
        want = [cost[i, j] for i, j in assign(cost) if cost[i, j] < far]
        got = assign_sparse(rows, columns, distance, far)
        assert len(set(rows[got])) == len(set(columns[got])) == len(got) == len(want)
        assert abs(distance[got].sum() - sum(want)) < 1e-9


def test_large_components_are_assigned(spark):
    import numpy as np
    from aerotally.operators import matching

    r = np.random.default_rng(2)
    side = lambda: spark.createDataFrame([(1, i, float(x), float(y)) for i, (x, y) in enumerate(r.random((60, 2)) * 20)], "image long, id long, x double, y double")
    gt, pred = side(), side()
    dense = matching.match_optimal(gt, pred, 4.0).selectExpr("count(*)", "round(sum(sqrt(d2)), 6)").first()
    sparse = matching.match_optimal(gt, pred, 4.0, dense_points=3).selectExpr("count(*)", "round(sum(sqrt(d2)), 6)").first()
    assert tuple(dense) == tuple(sparse) and dense[0] > 40


def test_curve_equals_matching_at_every_threshold(spark):
    import random

    from aerotally.operators import matching

    r = random.Random(4)
    rows = lambda n, extra: [(r.randrange(3), i, r.uniform(0, 60), r.uniform(0, 60), *extra()) for i in range(n)]
    gt = spark.createDataFrame(rows(80, lambda: (r.choice("ab"),)), "image long, id long, x double, y double, species string")
    pred = spark.createDataFrame(rows(120, lambda: (r.choice("ab"), r.choice([0.1, 0.3, 0.5, 0.7, 0.9]))), "image long, id long, x double, y double, species string, score double")
    levels = [0.0, 0.3, 0.45, 0.9, 0.95]
    got = {x.threshold: x.tp for x in matching.pr_curve(gt, pred, 10.0, levels).collect()}
    for t in levels:
        assert got[t] == matching.match_greedy(gt, pred.where(f"score >= {t}"), 10.0).count()
    by = {(x.threshold, x.species): x.tp for x in matching.pr_curve(gt, pred, 10.0, levels, by=["species"]).collect()}
    for t in levels:
        for s in "ab":
            assert by[t, s] == matching.match_greedy(gt.where(f"species = '{s}'"), pred.where(f"score >= {t} and species = '{s}'"), 10.0).count()
