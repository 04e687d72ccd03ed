import random

import numpy as np
from pyspark.sql import functions as F

from aerotally.operators import agreement as G, clustering as C, tiling as T


def test_crowded_images_get_their_points_where_space_is_left(spark):
    # image 1 is all but covered: a hole of 20 x 20 in the corner; image 2 is free; image 3 has no space; image 4 is all margin
    dots = [(1, float(x), float(y)) for x in range(0, 201, 10) for y in range(0, 201, 10) if not (x < 45 and y < 45)] + [(3, float(x), float(y)) for x in range(0, 201, 10) for y in range(0, 201, 10)]
    images = spark.createDataFrame([(i, 200, 15 if i == 4 else 200) for i in (1, 2, 3, 4)], "image int, image_width int, image_height int")
    positives = spark.createDataFrame(dots, "image int, x double, y double")
    got = T.background_points(images, positives, 12, 10.0, 12.0, attempts=2).collect()
    per = {i: [(r.x, r.y) for r in got if r.image == i] for i in (1, 2, 3, 4)}
    assert len(per[1]) == len(per[2]) == 12 and not per[3] and not per[4]
    for i in (1, 2):
        near = [min(np.hypot(x - u, y - v) for j, u, v in dots + [(i, -999, 0)] if j == i) for x, y in per[i]]
        assert min(near) > 12.0 and all(10 <= x <= 190 and 10 <= y <= 190 for x, y in per[i])
    again = T.background_points(images.repartition(3), positives.repartition(2), 12, 10.0, 12.0, attempts=2).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_points_are_uniform_over_the_free_part(spark):
    images = spark.range(400).select(F.col("id").cast("int").alias("image"), F.lit(100).alias("image_width"), F.lit(100).alias("image_height"))
    # the left half is covered, so that the finer grids have to be used
    dots = spark.createDataFrame([(float(x), float(y)) for x in range(0, 91, 5) for y in range(0, 101, 5)], "x double, y double").where("x <= 80")
    positives = images.select("image").crossJoin(dots)
    got = T.background_points(images, positives, 5, 0.0, 6.0, attempts=1).collect()
    ys = np.array([r.y for r in got])
    assert len(got) == 2000 and min(r.x for r in got) > 85.4
    share = np.histogram(ys, bins=5, range=(0, 100))[0] / len(ys)
    assert abs(share - 0.2).max() < 0.04


def silhouette(p, own):
    s = []
    for i in range(len(p)):
        d = np.hypot(*(p - p[i]).T)
        same = own == own[i]
        if same.sum() == 1:
            s.append(0.0)
            continue
        a = d[same].sum() / (same.sum() - 1)
        b = min(d[own == k].mean() for k in set(own) - {own[i]})
        s.append((b - a) / max(a, b))
    return float(np.mean(s))


def test_best_k_finds_the_clusters_of_clear_images(spark):
    r = random.Random(1)
    rows, want = [], {}
    for image, k in enumerate((2, 3, 4)):
        centres = [(0, 0), (500, 0), (0, 500), (500, 500)][:k]
        want[image] = k
        rows += [(image, r.gauss(x, 4), r.gauss(y, 4)) for x, y in centres for _ in range(30)]
    rows += [(9, 1.0, 1.0), (9, 1.0, 1.0)]
    got = {x.image: (x.k, x.marks) for x in C.best_k(spark.createDataFrame(rows, "image int, x double, y double"), "image", 5).collect()}
    p = np.array([(x, y) for i, x, y in rows if i == 1])
    true = np.repeat(range(3), 30)
    assert silhouette(p, true) > silhouette(p, np.where(true == 2, 1, true))
    assert {i: got[i][0] for i in want} == want and got[9] == (None, 2) or got[9][1] == 2


def test_clusters_of_vectors_and_who_disagrees(spark):
    r = np.random.default_rng(3)
    rows = [(i, (np.eye(3)[i % 3] * 10 + r.normal(size=3) * 0.1).tolist(), i % 3) for i in range(60)] + [(100, [10.0, 0.0, 0.0], 2), (101, [0.0, 10.0, 0.0], 0)]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<double>, label int")
    found = C.embedding_clusters(df, 3).collect()
    by = {x.vec_id: x for x in found}
    assert len({by[i].cluster for i in range(3)}) == 3 and all(by[i].cluster == by[i % 3].cluster and by[i].majority == i % 3 for i in range(60))
    assert abs(by[100].confidence - 20 / 21) < 1e-12 and by[2].confidence == 1.0
    assert [x.vec_id for x in C.misclassified(C.embedding_clusters(df, 3)).collect()] == [100, 101]


def test_a_forest_of_experts_beats_each_of_them(spark):
    r = random.Random(4)
    rows = []
    for image in range(300):
        ref = r.randint(0, 20)
        rows += [("a", image, ref // 2, ref), ("b", image, ref + r.choice([-3, 3]), ref)]
    found = G.expert_forest(spark.createDataFrame(rows, "user_name string, image int, n int, ref int"), ["a", "b", "nobody"]).collect()
    of = {u: np.mean([abs(n - ref) for v, _, n, ref in rows if v == u]) for u in ("a", "b")}
    assert len(found) == 300 and np.mean([abs(x.prediction - x.ref) for x in found]) < min(of.values())
