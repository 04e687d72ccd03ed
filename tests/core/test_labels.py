from pyspark.sql import functions as F

from aerotally.operators import agreement as G, annotations as A, tiling as T


def test_filters_and_defaults(spark):
    df = spark.createDataFrame([(1, "a", 0.9, 1.0), (2, " ", 0.95, 2.0), (3, None, None, 3.0), (4, "b", None, None)], "id int, species string, score double, x double")
    assert [r.id for r in A.above(df, 0.9).collect()] == [2] and [r.id for r in A.above(df, 0.9, inclusive=True).orderBy("id").collect()] == [1, 2]
    assert [r.id for r in A.complete(df, ["score", "x"]).orderBy("id").collect()] == [1, 2]
    assert [tuple(r) for r in A.verified_points(df).orderBy("id").collect()] == [(1, "a", 0.9, 1.0, 1), (4, "b", 1.0, None, 1)]
    folders = spark.createDataFrame([("FEC01_x_010223",), ("FEC01_01022023",), ("FEC01",), (None,)], "folder string")
    assert [r.renamed for r in A.stale_folders(folders).collect()] == ["FEC01_x_01022023"]


def test_attributes_and_repeated_ids(spark):
    df = spark.createDataFrame([(1, '{"k": 3, "s": "x"}'), (1, '{"k": "no"}'), (2, None), (3, "broken")], "id int, props string")
    got = [(r.id, r.k, r.s) for r in A.attributes(df, "props", {"k": "long", "s": "string"}).orderBy("id", "s").collect()]
    assert sorted(got, key=str) == sorted([(1, 3, "x"), (1, None, None), (2, None, None), (3, None, None)], key=str)
    assert [tuple(r) for r in A.repeated_ids(df, "id").collect()] == [(1, 2)]


def test_routes_and_hard_negatives(spark):
    tiles = spark.createDataFrame([(1, "t", 1.0, 2.0), (2, "t", 3.0, 4.0), (3, "u", 5.0, 6.0), (4, None, 7.0, 8.0)], "label int, tile string, x double, y double")
    crops = spark.createDataFrame([("t", 10.0, 20.0)], "tile string, ox double, oy double")
    reference, predictions = spark.createDataFrame([(1,), (2,), (2,)], "label int"), spark.createDataFrame([(2,), (9,)], "label int")
    got = sorted((r.label, r.x, r.y, r.route) for r in A.routed_labels(tiles, crops, reference, predictions).collect())
    assert got == [(1, 11.0, 22.0, "ignore"), (2, 13.0, 24.0, "shift"), (3, 5.0, 6.0, "add"), (4, 7.0, 8.0, "add")]
    labels = spark.createDataFrame([(1, "a"), (5, "b")], "label int, class string")
    both = sorted(map(tuple, A.with_hard_negatives(labels.limit(1), labels, spark.createDataFrame([(5,), (5,)], "label int")).collect()))
    assert both == [(1, "a"), (5, "hard_negative")]
    named = spark.createDataFrame([("x_il_12", "train"), ("x_il_12", "val"), ("y", "train")], "name string, split string")
    assert sorted(map(tuple, A.inventory(named, ["train", "val"]).collect())) == [("", 1, 0), ("12", 1, 1)]


def test_crops_names_and_ranks(spark):
    df = spark.createDataFrame([(0.0, 0.0, 20.0, 20.0), (90.0, 0.0, 95.0, 5.0)], "x1 double, y1 double, x2 double, y2 double")
    cut = T.box_in_crop(*[F.col(c) for c in df.columns], (10, 5, 50, 15))
    assert [tuple(r) for r in df.select(*cut).collect()] == [(0.0, 0.0, 10.0, 10.0), (None, None, None, None)]
    assert [tuple(r) for r in df.select(*T.point_in_crop(F.col("x2"), F.col("y2"), (10, 5, 50, 25))).collect()] == [(10.0, 15.0), (None, None)]
    names = spark.createDataFrame([("FEC01_21012023", "Fer_DJI_0042_x.JPG"), ("FEC01_21012023", "other.JPG")], "folder string, old string")
    assert [r[0] for r in names.select(T.planned_name(F.lit("Fer"), F.col("folder"), F.col("old"))).collect()] == ["Fer_FEC01_DJI_0042_21012023.JPG", None]
    errors = spark.createDataFrame([("a", "m", 1.0, 3.0, 0.5), ("a", "n", 1.0, 2.0, 0.7), ("b", "m", 0.5, 4.0, 0.6)], "user_name string, method string, mae double, rmse double, r2 double")
    assert sorted(map(tuple, G.method_ranks(errors).collect())) == [("a", "m", 2, 2, 3), ("a", "n", 3, 1, 1), ("b", "m", 1, 3, 2)]


def test_dataset_statistics_have_kinds_and_classes(spark):
    images = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "b"), (5, None)], "image int, dataset string")
    rows = [(1, "x", [1.0], None), (1, "x", None, [1]), (1, "y", [1.0], [1, 2]), (2, "y", [1.0], []), (2, None, None, None), (5, "x", None, [3]), (9, "x", [1.0], None)]
    labels = spark.createDataFrame(rows, "image int, class string, bbox array<double>, keypoints array<int>")
    got = {(r.dataset, r["class"]): (r.images, r.labels, r.point_labels, r.box_labels, r.max_classes) for r in A.dataset_statistics(images, labels).collect()}
    assert got == {
        ("a", None): (3, 5, 2, 3, 2), ("a", "x"): (None, 2, 1, 1, None), ("a", "y"): (None, 2, 1, 2, None), ("a", "unknown"): (None, 1, 0, 0, None),
        ("b", None): (1, 0, 0, 0, 0), ("unknown", None): (1, 1, 1, 0, 1), ("unknown", "x"): (None, 1, 1, 0, None),
    }
