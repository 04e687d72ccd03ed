import json

from pyspark.sql import functions as F

from aerotally.sources import readers as R, writers as W


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_list_files(spark, tmp_path):
    for n in ("a/x.jpg", "b/.hidden.jpg", "b/y.jpg", "b/z.txt"):
        write(tmp_path / n, "1")
    assert sorted(r.name for r in R.list_files(spark, str(tmp_path), "*.jpg").collect()) == ["x.jpg", "y.jpg"]


def test_csvs(spark, tmp_path):
    p = write(tmp_path / "d.csv", "images,labels,scores,dscores,x,y,count_1,count_2,count_3,count_4,count_5,count_6,species\na.jpg,1.0,0.9,0.1,3,4,1,0,0,0,0,0,iguana\n")
    r = R.points_csv(spark, p).first()
    assert (r.labels, r.x, r.species) == (1, 3.0, "iguana")
    h = write(tmp_path / "h.csv", "a,1\nb,2\n")
    im = spark.createDataFrame([("a", 10)], "name string, width int")
    assert sorted((x.name, x.v, x.width) for x in R.headerless_csv(spark, h, "name string, v int", im, "name").collect()) == [("a", 1, 10), ("b", 2, None)]
    box = "image,xmin,ymin,xmax,ymax\ni,0,0,5,5\nj,1,1,1,9\n"
    t = R.tagged_csvs(spark, {"train": write(tmp_path / "t.csv", box), "val": write(tmp_path / "v.csv", box)}, "image string, xmin int, ymin int, xmax int, ymax int")
    assert sorted((x.image, x.split) for x in t.collect()) == [("i", "train"), ("i", "val")]


def feature(x, y, **p):
    return {"type": "Feature", "geometry": {"type": "Point", "coordinates": [x, y]}, "properties": p}


def test_geojson_and_islands(spark, tmp_path):
    for island, name, n in (("Fer", "m1", 2), ("Isa", "m2", 1)):
        write(tmp_path / island / f"{name}.geojson", json.dumps({"type": "FeatureCollection", "features": [feature(i, i + 0.5, label=f"l{i}") for i in range(n)]}))
    got = R.geojson(spark, str(tmp_path / "*"), "label string, other int").collect()
    assert sorted((r.source_file, r.x, r.y, r.label, r.other) for r in got) == [("m1.geojson", 0.0, 0.5, "l0", None), ("m1.geojson", 1.0, 1.5, "l1", None), ("m2.geojson", 0.0, 0.5, "l0", None)]
    assert sorted((r.island, r.name) for r in R.annotation_files(spark, str(tmp_path / "*"), "label string").collect()) == [("Fer", "m1"), ("Fer", "m1"), ("Isa", "m2")]


def test_project_round_trip(spark, tmp_path):
    label = {"id": "l1", "class_name": "iguana", "bbox": [1, 2, 3, 4], "polygon": None, "z_index": 1, "attributes": {"sex": "m"}, "keypoints": [{"id": "k", "x": 1, "y": 2, "norder": 0, "visible": True}]}
    doc = {"project_name": "p", "label_classes": [], "images": [{"image_id": "i1", "image_name": "a.jpg", "dataset_name": "d", "width": 10, "height": 10, "image_status": "DONE", "tags": ["t"], "labels": [label]}, {"image_id": "i2", "image_name": "b.jpg", "dataset_name": "d", "width": 10, "height": 10, "image_status": "NEW", "tags": [], "labels": []}]}
    images, labels = R.project(spark, write(tmp_path / "p.json", json.dumps(doc, indent=1)))
    assert images.count() == 2
    r = labels.first()
    assert r.bbox == [1, 2, 3, 4] and r.attributes == {"sex": "m"} and r.keypoints[0].x == 1


def test_coco(spark, tmp_path):
    doc = {"images": [{"id": 1, "file_name": "a", "width": 9, "height": 9}], "categories": [{"id": 5, "name": "seal"}], "annotations": [{"id": 1, "image_id": 1, "category_id": 5, "bbox": [1, 2, 3, 4], "segmentation": [[1, 2, 4, 2, 4, 6]]}, {"id": 2, "image_id": 1, "category_id": 9, "bbox": [0, 0, 2, 2], "area": 3.5}, {"id": 3, "image_id": 7, "category_id": 5, "bbox": [0, 0, 1, 1]}]}
    got = sorted((r.id, r.category, r.area, r.has_segmentation) for r in R.coco(spark, write(tmp_path / "c.json", json.dumps(doc))).collect())
    assert got == [(1, "seal", 12.0, True), (2, "Unknown", 3.5, False)]


def test_volunteer_export(spark, tmp_path):
    def q(v):
        return '"' + json.dumps(v).replace('"', '""') + '"'

    head = ",".join(f"c{i}" for i in range(14))
    yes = [{"task": "T0", "value": "Yes"}, {"task": "T1", "value": [{"x": 1.5, "y": 2.5, "tool_label": "adult"}, {"x": 3, "y": 4, "tool_label": "pup"}]}]
    no = [{"task": "T0", "value": "No"}, {"task": "T1", "value": []}]
    row = lambda i, t: ",".join([str(i), "ann", "7", "ip", "w", "phase 1", "1", "2023-01-01", "", "", q({"started_at": "a", "finished_at": "b"}), q(t), q({"99": {"Filename": "f.jpg", "site": "S1"}}), "99"])
    p = write(tmp_path / "z.csv", "\n".join([head, row(1, yes), row(2, no)]) + "\n")
    got = sorted((r.user_id, r.image_name, r.flight_code, r.x, r.y, r.tool_label) for r in R.volunteer_export(spark, p).collect())
    assert got == [(7, "f.jpg", "S1", 1.5, 2.5, "adult"), (7, "f.jpg", "S1", 3.0, 4.0, "pup")]


def test_oriented_boxes_and_known(spark, tmp_path):
    p = write(tmp_path / "o.txt", "imagesource:x\ngsd:0.1\n0 0 4 0 4 3 0 3 small-vehicle 0\n1 1 2 bad\n")
    (r,) = R.oriented_boxes(spark, p).collect()
    assert (r["class"], r.area) == ("small-vehicle", 12.0)
    a, b = spark.createDataFrame([("x",), ("y",)], "filepath string"), spark.createDataFrame([("x",)], "filepath string")
    assert [r.filepath for r in R.not_yet_known(a, b).collect()] == ["y"]


def test_writers(spark, tmp_path):
    pts = spark.createDataFrame([(1, 2.0, 3.0, "a"), (2, 4.0, 5.0, "b")], "id int, x double, y double, s string")
    W.write_feature_collections(pts, str(tmp_path / "fc"), ["id"], "s")
    back = R.geojson(spark, str(tmp_path / "fc" / "*"), "id int")
    assert sorted((r.x, r.id) for r in back.collect()) == [(2.0, 1), (4.0, 2)]
    W.write_geojson(pts, str(tmp_path / "gj"), ["id"])
    assert spark.read.json(str(tmp_path / "gj")).count() == 2
    lb = spark.createDataFrame([("i2", 1, 0.0, 0.0, 10.0, 20.0, "seal", 100, 200), ("i1", 1, 5.0, 5.0, 6.0, 7.0, "seal", 100, 200), ("i1", 2, 0.0, 0.0, 1.0, 1.0, "bird", 100, 200)], "image string, label int, x1 double, y1 double, x2 double, y2 double, class string, image_width int, image_height int")
    c = W.to_coco(lb, ["seal"])
    assert sorted((r.id, r.image_id, r.bbox) for r in c.collect()) == [(1, 1, [5, 5, 1, 2]), (2, 2, [0, 0, 10, 20])]
    assert all(r.segmentation is None and r.area == r.bbox[2] * r.bbox[3] for r in c.collect()) and W.from_coco(c).count() == 0
    assert sorted(r.line for r in W.yolo_lines(lb.withColumn("class_id", F.lit(0))).collect())[1] == "0 0.050000 0.050000 0.100000 0.100000"
    docs = W.project_documents(lb.withColumn("dataset", F.lit("d")).withColumn("bbox", F.array("x1", "y1", "x2", "y2"))).first()
    assert [(i.image, len(i.labels)) for i in docs.images] == [("i1", 2), ("i2", 1)]
    s = W.serialisable(spark.createDataFrame([(1, "x")], "mode int, z string"), {"mode": {1: "AUTO"}}, ["z"])
    assert s.columns == ["z", "mode"] and s.first().mode == "AUTO"
    seg = spark.createDataFrame([("i", 0, [(0.0, 0.0), (50.0, 100.0)], 100, 200)], "image string, class_id int, ring array<struct<x:double,y:double>>, image_width int, image_height int")
    assert W.yolo_segments(seg).first().line == "0 0.0 0.0 0.5 0.5"
    old = spark.createDataFrame([(1, "a", 1.0, 1.0, {"k": "v"}), (2, "a", 2.0, 2.0, {})], "label int, class string, x double, y double, attributes map<string,string>")
    new = spark.createDataFrame([(1, "b", 0.5, 0.5, 10, 20)], "label int, class string, rx double, ry double, image_width int, image_height int")
    got = {r.label: r for r in W.reviewed(old, new).collect()}
    assert (got[1]["class"], got[1].x, got[1].y, got[1].attributes) == ("b", 5.0, 10.0, {"k": "v", "cvat": "created"}) and got[2]["class"] == "a"


def test_polygons_and_points_of_labels(spark):
    schema = "image string, label int, class string, x1 double, y1 double, x2 double, y2 double, polygon array<struct<x:double,y:double>>, kx double"
    square, ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 3.0)], [(1.5, 1.0), (9.0, 2.0), (5.0, 8.5)]
    rows = [
        ("b", 1, "seal", 0.0, 0.0, 10.0, 20.0, square, None), ("b", 2, "seal", None, None, None, None, ring, None), ("a", 1, "bird", 1.0, 1.0, 2.0, 2.0, None, None),
        ("c", 1, "seal", None, None, None, None, None, 5.0), ("c", 2, "seal", 3.9, 3.0, 5.2, 6.0, [], None), ("d", 1, "seal", 1.0, 1.0, 2.0, 2.0, None, 1.5),
    ]
    lb = spark.createDataFrame(rows, schema)
    got = sorted((r.id, r.image_id, r.category_id, r.bbox, r.segmentation, r.area) for r in W.to_coco(lb, ["seal"]).collect())
    assert got == [
        (1, 2, 1, [0, 0, 10, 20], [[0, 0, 4, 0, 4, 3, 0, 3]], 12), (2, 2, 1, [1.5, 1, 7.5, 7.5], [[1.5, 1, 9, 2, 5, 8.5]], 26.375),
        (3, 3, 1, None, None, 0), (4, 3, 1, [3.9, 3, 5.2 - 3.9, 3], None, (5.2 - 3.9) * 3), (5, 4, 1, [1, 1, 1, 1], None, 1),
    ]
    assert sorted((r.id, r.x1, r.y1, r.x2, r.y2) for r in W.from_coco(W.to_coco(lb, ["seal"])).collect()) == [(1, 0, 0, 4, 3), (2, 1, 1, 9, 8)]
    boxes = sorted((r.image_path, r.xmin, r.ymin, r.xmax, r.ymax, r.label) for r in W.to_boxes(lb).collect())
    assert boxes == [("a", 1, 1, 2, 2, "bird"), ("b", 0, 0, 4, 3, "seal"), ("b", 1, 1, 9, 8, "seal"), ("c", 3, 3, 5, 6, "seal")]


def test_documents_are_bounded(spark, tmp_path):
    pts = spark.createDataFrame([(i, float(i), 1.0, "hot") for i in range(200)], "id int, x double, y double, s string").repartition(3)
    W.write_feature_collections(pts, str(tmp_path / "fc"), ["id"], "s", per_document=20)
    assert 5 <= len(list((tmp_path / "fc" / "s=hot").glob("part-*.json"))) <= 10
    assert sorted(r.id for r in R.geojson(spark, str(tmp_path / "fc" / "*"), "id int").collect()) == list(range(200))


def test_project_documents_have_about_so_many_images_however_many_projects(spark):
    rows = [(f"p{d}" if d else None, d * 10_000 + i, i, "c", [1.0, 2.0]) for d in range(5) for i in range(100 if d else 3)]
    df = spark.createDataFrame(rows, "dataset string, image long, label int, class string, bbox array<double>")
    docs = W.project_documents(df, "dataset", per_document=50).collect()
    assert len(docs) == 9  # two for each project of 100 images, one for that of three
    assert sorted((str(d.dataset), i.image) for d in docs for i in d.images) == sorted((str(r[0]), r[1]) for r in rows)
    assert all(20 <= len(d.images) <= 80 for d in docs if d.dataset)
