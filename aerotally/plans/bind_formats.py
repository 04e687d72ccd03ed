"""Bindings of readers, writers, polygon kernels and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerotally.functions import polygons as P
from aerotally.operators import matching as M, pixels as X, spatial as S, tiling as T
from aerotally.plans.bind_matching import _M, matches
from aerotally.plans.storage import fresh_dir
from aerotally.plans.views import binding
from aerotally.sources import readers as R, writers as W
from aerotally.streaming import flights as SF, shots as ST

_R = lambda c, n=6: F.round(c, n)


def labels(v):
    return v.boxes.select("image", F.col("id").alias("label"), "class", "x1", "y1", "x2", "y2", F.lit(1000).alias("image_width"), F.lit(800).alias("image_height"))


def written(v, df, how, **options):
    path = fresh_dir(v.spark, "formats")
    getattr(df.write.options(**options), how)(path)
    return path


def src1(v):
    path = fresh_dir(v.spark, "files")
    v.boxes.select("class", F.col("id").cast("string").alias("value")).write.partitionBy("class").text(path)
    found = R.list_files(v.spark, path, "*.txt").select(F.regexp_extract("path", "class=([^/]+)/", 1).alias("folder")).distinct()
    return found.select(F.regexp_replace("folder", "%23", "#").alias("class"))


def src3(v):
    path = written(v, v.marks.select(F.col("image").cast("string").alias("images"), F.lit(1.0).alias("labels"), "score", "x", "y", "species"), "csv", header=True)
    got = R.points_csv(v.spark, path, "images string, labels double, scores double, x double, y double, species string")
    return got.groupBy("species", "labels").agg(F.count("*").alias("n"), F.round(F.sum("x"), 2).alias("sx"))


def src4(v):
    path = fresh_dir(v.spark, "geojson")
    W.write_feature_collections(v.marks.where("role = 'gt'").select("image", "id", "x", "y", "species"), path, ["id", "species"], "image")
    return R.geojson(v.spark, f"{path}/*", "id long, species string").groupBy("species").agg(F.count("*").alias("n"), F.round(F.sum("x"), 2).alias("sx"))


def src5(v):
    """Project documents for every dataset, a bounded number of images each, written, read and flattened."""
    box = F.array("x1", "y1", F.col("x1") + F.col("w"), F.col("y1") + F.col("h"))
    docs = W.project_documents(v.annotations.withColumn("bbox", box), "dataset")
    label = lambda l: F.struct(l.label.cast("string").alias("id"), l["class"].alias("class_name"), l.bbox.alias("bbox"))
    image = lambda i: F.struct(i.image.cast("string").alias("image_id"), F.col("dataset").alias("dataset_name"), F.transform(i.labels, label).alias("labels"))
    path = fresh_dir(v.spark, "projects")
    W.write_documents(docs.select(F.col("dataset").alias("folder"), F.col("dataset").alias("project_name"), F.transform("images", image).alias("images")), path, "folder")
    images, lab = R.project(v.spark, f"{path}/*")
    return lab.groupBy("dataset_name", "class_name").agg(F.count("*").alias("n"), F.round(F.sum(F.col("bbox")[0]), 2).alias("sx"))


BRANDS = [f"Brand#{i}" for i in range(1, 26)]


def src6(v):
    """All labels as documents of bounded pages, of which each has the images that it names."""
    c = W.to_coco(with_polygons(v), BRANDS)
    c = W.paged(c)
    docs = c.groupBy("page").agg(
        F.collect_list(F.struct("id", "image_id", "category_id", "bbox", "segmentation", "area")).alias("annotations"),
        F.collect_set(F.struct(F.col("image_id").alias("id"), F.col("image_id").cast("string").alias("file_name"))).alias("images"),
    )
    docs = docs.select("page", "annotations", "images", F.array(F.struct(F.lit(BRANDS.index("Brand#11") + 1).alias("id"), F.lit("b11").alias("name"))).alias("categories"))
    path = fresh_dir(v.spark, "coco")
    W.write_documents(docs, path, "page")
    return R.coco(v.spark, f"{path}/*").groupBy("category", "has_segmentation").agg(F.count("*").alias("n"), F.round(F.sum("area"), 2).alias("area"))


def with_polygons(v):
    """Labels of which every third has a triangle, and every fifth no box; every fifteenth has a triangle alone, the others of no box only a keypoint."""
    corner = lambda x, y: F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    triangle = F.when(F.col("label") % 3 == 0, F.array(corner("x1", "y1"), corner("x2", "y1"), corner("x2", "y2")))
    boxless = F.col("label") % 5 == 0
    out = labels(v).withColumn("polygon", triangle).withColumn("kx", F.when(boxless & F.col("polygon").isNull(), F.col("x1")))
    return out.withColumns({c: F.when(~boxless, F.col(c)) for c in ("x1", "y1", "x2", "y2")})


def src7(v):
    path = written(v, v.marks.select("image", "x", "y"), "csv")
    return R.headerless_csv(v.spark, path, "image long, x double, y double", v.supplier.select(F.col("s_suppkey").alias("image"), "s_name"), "image").groupBy("s_name").agg(F.count("*").alias("n"))


def src8(v):
    b = v.boxes.select("image", F.col("x1").alias("xmin"), F.col("y1").alias("ymin"), F.when(F.col("id") % 10 == 0, F.col("x1")).otherwise(F.col("x2")).alias("xmax"), F.col("y2").alias("ymax"))
    parts = {s: written(v, b.where(f"image % 2 = {i}"), "csv", header=True) for i, s in enumerate(("train", "val"))}
    return R.tagged_csvs(v.spark, parts, "image long, xmin double, ymin double, xmax double, ymax double").groupBy("split").agg(F.count("*").alias("n"))


def src10(v):
    path = fresh_dir(v.spark, "islands")
    W.write_feature_collections(v.marks.where("role = 'gt'").select("species", "id", "x", "y"), path, ["id"], "species")
    return R.annotation_files(v.spark, f"{path}/*", "id long").groupBy("island").agg(F.count("*").alias("n"))


def src9(v):
    """Conversations as a volunteer export: one classification per first turn, marks from the turns."""
    c = v.conversations.groupBy("conv_id").agg(F.count("*").alias("n"))
    marks = F.transform(F.sequence(F.lit(1), F.col("n").cast("int")), lambda i: F.struct((i * 2.0).alias("x"), (i * 3.0).alias("y"), F.lit("adult").alias("tool_label")))
    yes = F.when(F.col("conv_id") % 3 > 0, "Yes").otherwise("No")
    tasks = F.concat(F.lit('[{"task":"T0","value":"'), yes, F.lit('"},{"task":"T1","value":'), F.to_json(marks), F.lit("}]"))
    subject = F.concat(F.lit('{"7":{"Filename":"f'), F.col("conv_id"), F.lit('.jpg","site":"s1"}}'))
    none = F.lit("")
    rows = c.select("conv_id", F.lit("ann").alias("user_name"), (F.col("conv_id") % 5).alias("user_id"), *[none.alias(n) for n in ("ip", "w")], F.lit("p1").alias("phase"), *[none.alias(n) for n in ("ver", "t", "g", "e")], F.lit('{"started_at":"a","finished_at":"b"}').alias("meta"), tasks.alias("tasks"), subject.alias("subject"), F.lit(7).alias("sid"))
    path = written(v, rows, "csv", header=True, escape='"')
    return R.volunteer_export(v.spark, path).groupBy("user_id", "flight_code").agg(F.count("*").alias("marks"), F.countDistinct("image_name").alias("images"), F.sum("x").alias("sx"))


def src11(v):
    path = fresh_dir(v.spark, "missions")
    W.write_feature_collections(v.shots.select("expedition", "x", "y", "height"), f"{path}/a", ["height"], "expedition")
    W.write_feature_collections(v.shots.where("shot % 2 = 0").select("expedition", "x", "y", "drone"), f"{path}/b", ["drone"], "expedition")
    got = R.geojson(v.spark, [f"{path}/a/*", f"{path}/b/*"], "height double, drone string")
    return got.groupBy("drone").agg(F.count("*").alias("n"), F.round(F.sum("height"), 2).alias("height"))


def src12(v):
    b = v.boxes
    pts = [("x1", "y1"), ("x2", "y1"), ("x2", "y2"), ("x1", "y2")]
    line = F.concat_ws(" ", *[F.col(c).cast("string") for p in pts for c in p], F.regexp_replace("class", "#", ""), F.lit("0"))
    head = b.limit(1).select(F.explode(F.array(F.lit("imagesource:x"), F.lit("gsd:0.1"), F.lit("1 2 3"))).alias("value"))
    path = written(v, b.select(line.alias("value")).unionByName(head), "text")
    return R.oriented_boxes(v.spark, path).groupBy("class").agg(F.count("*").alias("n"), F.round(F.sum("area"), 2).alias("area"))


def src13(v):
    known = v.shots.where("shot % 3 = 0").select(F.col("name").alias("filepath"))
    return R.not_yet_known(v.shots.select(F.col("name").alias("filepath")), known)


def snk1(v):
    path = fresh_dir(v.spark, "geojson")
    W.write_geojson(v.marks.where("role = 'gt'"), path, ["image", "id"])
    got = v.spark.read.schema("geometry struct<coordinates:array<double>>, properties struct<image:long,id:long>").json(path)
    return got.select("properties.image", "properties.id", F.col("geometry.coordinates")[0].alias("x"), F.col("geometry.coordinates")[1].alias("y"))


def snk2(v):
    d = W.project_documents(v.annotations.withColumn("bbox", F.array("x1", "y1")), "dataset")
    n_labels = F.aggregate("images", F.lit(0), lambda s, i: s + F.size(i.labels)).cast("long")
    return d.groupBy("dataset").agg(F.sum(F.size("images")).alias("images"), F.sum(n_labels).alias("labels"))


def snk3(v):
    names = {0: "AUTO", 1: "MANUAL", 2: "BRACKET"}
    return W.serialisable(v.shots.select("shot", (F.col("shot") % 3).cast("int").alias("mode"), "name"), {"mode": names}, ["name", "mode"]).select("shot", "name", "mode")


def snk4(v):
    c = W.to_coco(with_polygons(v), ["Brand#11", "Brand#12"])
    flat = F.get(F.col("segmentation"), F.lit(0))
    return c.select("id", "image_id", "category_id", _R(F.col("bbox")[0]).alias("x"), _R(F.col("bbox")[2]).alias("w"), _R("area").alias("area"), F.size(flat).alias("numbers"), _R(F.get(flat, F.lit(5))).alias("last_y"))


def snk5(v):
    """Labels back from the annotations that have a segmentation, a bounding box for each ring."""
    return W.from_coco(W.to_coco(with_polygons(v), ["Brand#11", "Brand#12"])).select("id", "ring", "x1", "y1", "x2", "y2")


def snk6(v):
    xc, yc, w, h = W.yolo_columns(*[F.col(c) for c in ("x1", "y1", "x2", "y2", "image_width", "image_height")])
    return labels(v).select("label", _R(xc).alias("xc"), _R(yc).alias("yc"), _R(w).alias("w"), _R(h).alias("h"))


def snk7(v):
    path = fresh_dir(v.spark, "yolo")
    W.yolo_lines(labels(v).withColumn("class_id", F.substring("class", 7, 2).cast("int"))).write.partitionBy("image").text(path)
    got = v.spark.read.text(path).select("image", F.split("value", " ").alias("t"))
    return got.groupBy("image").agg(F.count("*").alias("n"), F.sum(F.col("t")[0].cast("long")).alias("classes"), F.round(F.sum(F.col("t")[1].cast("double")), 3).alias("xc"))


def rings(v):
    ring = F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")), F.struct(F.col("x1").alias("x"), F.col("y2").alias("y")))
    # dealt anew, as a small file is one task and what is done with a ring takes long
    return labels(v).repartition(4 * v.spark.sparkContext.defaultParallelism, "label").withColumn("ring", ring)


def snk8(v):
    return W.yolo_segments(rings(v).withColumn("class_id", F.lit(0)).withColumn("image", F.col("label"))).select(F.col("image").alias("label"), F.size(F.split("line", " ")).alias("tokens"))


def snk9(v):
    lb = labels(v).withColumn("kx", F.when(F.col("label") % 3 == 0, F.col("x1") + 1)).withColumn("ky", F.when(F.col("label") % 3 == 0, F.col("y1") + 1)).withColumn("px", F.when(F.col("label") % 3 == 1, F.col("x1") + 2)).withColumn("py", F.when(F.col("label") % 3 == 1, F.col("y1") + 2))
    return W.to_points(lb).select("label", "x", "y")


def snk12(v):
    y = labels(v).select("image", "label", *[c.alias(n) for n, c in zip(("xc", "yc", "w", "h"), W.yolo_columns(*[F.col(c) for c in ("x1", "y1", "x2", "y2", "image_width", "image_height")]))], "image_width", "image_height")
    return W.from_yolo(y).select("label", *[_R(c, 4).alias(c) for c in ("x1", "y1", "x2", "y2")])


def snk13(v):
    d = W.detection_documents(v.marks.where("role = 'pred'").withColumn("x", F.when(F.col("id") % 9 > 0, F.col("x"))))
    return d.select("image", F.size("labels").cast("long").alias("n"), F.aggregate("labels", F.lit(0).cast("long"), lambda s, l: s + l.x).alias("sx"))


def snk15(v):
    t = v.supplier.select(F.col("s_suppkey").alias("image"), (F.col("s_suppkey") * 100.0).alias("ox"), F.lit(9000.0).alias("oy"), F.lit(0.5).alias("px"), F.lit(-0.5).alias("py"))
    p = v.marks.withColumn("image_width", F.lit(1000)).withColumn("image_height", F.lit(1000))
    return W.to_world(p, t).select("image", "id", "world_x", "world_y", "on_edge")


def snk16(v):
    m = v.marks.where("species in ('A', 'R')")
    xc, yc, w, h = W.yolo_columns(F.col("x") - 20, F.col("y") - 20, F.col("x") + 20, F.col("y") + 20, F.lit(1000), F.lit(1000))
    return W.dense_ids(m, "species", "class_id").select("image", "id", F.col("class_id").cast("long").alias("class_id"), _R(xc).alias("xc"), _R(yc).alias("yc"), _R(w).alias("w"))


def snk17(v):
    return W.dense_ids(v.customer.select(F.col("c_name").alias("name")), "name", "id").select("name", F.col("id").cast("long").alias("id"))


def snk18(v):
    """Boxes in bottom-up tile rows of 256, normalised to the tile."""
    at = lambda c: F.floor(F.col(c) / 256).cast("long")
    laid = v.boxes.withColumn("tx", F.explode(F.sequence(at("x1"), at("x2")))).withColumn("ty", F.explode(F.sequence(at("y1"), at("y2"))))
    lo = lambda c, t: F.greatest(F.col(c) - F.col(t) * 256, F.lit(0.0))
    hi = lambda c, t: F.least(F.col(c) - F.col(t) * 256, F.lit(256.0))
    xc, yc, w, h = W.yolo_columns(lo("x1", "tx"), lo("y1", "ty"), hi("x2", "tx"), hi("y2", "ty"), F.lit(256), F.lit(256))
    return laid.select("id", "tx", (F.lit(3) - F.col("ty")).alias("row"), _R(xc).alias("xc"), _R(yc).alias("yc"), _R(w).alias("w"), _R(h).alias("h")).where("w > 0 and h > 0")


def snk19(v):
    t = v.nation.select((F.col("n_nationkey") % 20).alias("image")).distinct().select("image", (F.col("image") * 50.0).alias("ox"), F.lit(700.0).alias("oy"), F.lit(0.1).alias("px"), F.lit(-0.1).alias("py"))
    b = v.boxes.select("id", "image", "x1", "y1", (F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h")).join(F.broadcast(t), "image")  # 20 tiles
    return b.select("id", _R(F.col("ox") + F.col("x1") * F.col("px")).alias("wx1"), _R(F.col("oy") + F.col("y1") * F.col("py")).alias("wy1"), _R(F.col("ox") + (F.col("x1") + F.col("w")) * F.col("px")).alias("wx2"))


def snk20(v):
    lb = v.boxes.select(F.col("id").alias("label"), "class", F.col("x1").alias("x"), F.col("y1").alias("y"), F.create_map(F.lit("k"), F.lit("v")).alias("attributes"))
    rv = v.boxes.where("id % 4 = 0").select(F.col("id").alias("label"), F.lit("new").alias("class"), F.lit(0.5).alias("rx"), F.lit(0.25).alias("ry"), F.lit(1000).alias("image_width"), F.lit(800).alias("image_height"))
    return W.reviewed(lb, rv).select("label", "class", "x", "y", F.col("attributes")["cvat"].alias("cvat"))


def fn13(v):
    l = rings(v).withColumn("ring", F.when(F.col("label") % 2 == 0, F.col("ring")))
    c = P.label_centre(F.col("ring"), F.when(F.col("label") % 3 == 0, F.col("x1")), F.col("y1"), *[F.col(c) for c in ("x1", "y1", "x2", "y2")])
    return l.select("label", c.alias("c")).select("label", "c.x", "c.y")


def fn20(v):
    c = P.clipped(F.col("ring"), F.lit(100.0), F.lit(100.0), F.lit(600.0), F.lit(500.0))
    return rings(v).select("label", c.alias("ring")).where("ring is not null").select("label", _R(S.polygon_area(F.col("ring")), 4).alias("area")).where("area > 0")


def tl12(v):
    return T.tile_polygons(rings(v), 256.0).select("label", "tx", "ty", _R("area", 3).alias("area"))


def pix1(v):
    """Embedding vectors taken for grey images eight pixels wide, a grid of two by two cells."""
    return X.grid_metrics(v.embeddings.select(F.col("vec_id").alias("image_id"), F.lit(8).alias("width"), F.col("embedding").alias("pixels")), 2, 2)


def rev2(v):
    """Review result: what changed, and hard negatives of the predictions that the correction lacks, by class."""
    gt, pred, m = matches(v)
    hard = M.hard_negatives(M.labelled(gt, pred, m), 0.9)
    return gt.select("species").unionByName(hard.select("species")).groupBy("species").agg(F.count("*").alias("n"))


def _stream(v, build):
    """Run a stream over the events files to its end and return what it wrote."""
    s = v.spark
    schema = v.events.schema
    src = s.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 1).parquet(v.folder)
    return build(s, src)


def st1(v):
    out, mark = fresh_dir(v.spark, "ingest"), fresh_dir(v.spark, "ingest-state")

    def build(s, src):
        shots = src.select(F.concat(F.lit("img"), F.col("event_id").cast("string")).alias("filepath"), F.col("ts").cast("timestamp").alias("ts"), "user_id")
        twice = shots.withColumn("n", F.explode(F.array(F.lit(1), F.lit(2)))).drop("n")
        q = ST.deduplicated(twice).writeStream.option("checkpointLocation", mark).foreachBatch(lambda b, i: ST.append_new(b, i, out)).trigger(availableNow=True).start()
        q.awaitTermination()
        return s.read.parquet(out)

    return _stream(v, build).select("filepath", "user_id")


def _shot_stream(src):
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return src.select(F.col("event_id").alias("shot"), F.col("user_id").alias("flight"), F.col("value").alias("x"), (F.col("event_id") % 997).cast("double").alias("y"), t.alias("t"), F.col("ts").cast("timestamp").alias("ts"))


def st2_in_time(v):
    """ST2 with state that event time bounds; the events come in one file, so none is behind the watermark."""
    out, mark = fresh_dir(v.spark, "metrics"), fresh_dir(v.spark, "metrics-state")

    def build(s, src):
        q = SF.flight_metrics_in_time(_shot_stream(src)).writeStream.option("checkpointLocation", mark).outputMode("append").trigger(availableNow=True).format("parquet").option("path", out).start()
        q.awaitTermination()
        return s.read.schema(SF.METRICS).parquet(out)

    return _stream(v, build).select("flight", "shot", _R("distance_to_prev", 4).alias("distance"), _R("time_diff_seconds", 3).alias("dt"), "late")


def st2(v):
    out, mark = fresh_dir(v.spark, "metrics"), fresh_dir(v.spark, "metrics-state")

    def build(s, src):
        shots = src.select(F.col("event_id").alias("shot"), F.col("user_id").alias("flight"), F.col("value").alias("x"), (F.col("event_id") % 997).cast("double").alias("y"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
        q = ST.flight_metrics(shots).writeStream.option("checkpointLocation", mark).outputMode("append").trigger(availableNow=True).format("parquet").option("path", out).start()
        q.awaitTermination()
        return s.read.parquet(out)

    return _stream(v, build).select("flight", "shot", _R("distance_to_prev", 4).alias("distance"), _R("time_diff_seconds", 3).alias("dt"), "late")


_POLYGONS = "g AS (SELECT *, id%3=0 AS ring, id%5=0 AS boxless FROM boxes)"
_COCO = _POLYGONS + """, l AS (SELECT *, dense_rank() OVER (ORDER BY image) AS image_id FROM g),
  c AS (SELECT *, row_number() OVER (ORDER BY image_id, id) AS n, boxless AND NOT ring AS bare FROM l WHERE class IN ('Brand#11','Brand#12'))"""

_ST2 = "WITH s AS (SELECT *, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy, t - lag(t) OVER w AS d FROM shots WINDOW w AS (PARTITION BY flight ORDER BY t, shot)) SELECT flight, shot, round(sqrt(dx*dx+dy*dy),4) AS distance, round(d,3) AS dt, FALSE AS late FROM s"

BINDINGS = {
    "SRC1": binding(src1, "SELECT DISTINCT class FROM boxes"),
    "SRC2": binding(lambda v: v.shots.select("shot", "flight", "name"), "SELECT shot, flight, name FROM shots"),
    "SRC3": binding(src3, "SELECT species, 1 AS labels, count(*) AS n, round(sum(x),2) AS sx FROM marks GROUP BY 1"),
    "SRC4": binding(src4, "SELECT species, count(*) AS n, round(sum(x),2) AS sx FROM marks WHERE role='gt' GROUP BY 1"),
    "SRC5": binding(src5, "SELECT dataset AS dataset_name, class AS class_name, count(*) AS n, round(sum(x1),2) AS sx FROM annotations GROUP BY 1,2"),
    "SRC6": binding(
        src6,
        f"""WITH {_POLYGONS} SELECT CASE WHEN class='Brand#11' THEN 'b11' ELSE 'Unknown' END AS category, ring AS has_segmentation, count(*) AS n,
          round(sum(CASE WHEN ring THEN (x2-x1)*(y2-y1)/2 WHEN boxless THEN 0 ELSE (x2-x1)*(y2-y1) END),2) AS area FROM g GROUP BY 1,2""",
    ),
    "SRC7": binding(src7, "SELECT s_name, count(*) AS n FROM marks LEFT JOIN supplier ON image=s_suppkey GROUP BY 1"),
    "SRC8": binding(src8, "SELECT CASE WHEN image%2=0 THEN 'train' ELSE 'val' END AS split, count(*) AS n FROM boxes WHERE id%10<>0 AND x2>x1 AND y2>y1 GROUP BY 1"),
    "SRC10": binding(src10, "SELECT concat('species=',species) AS island, count(*) AS n FROM marks WHERE role='gt' GROUP BY 1"),
    "SRC9": binding(src9, "WITH c AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1) SELECT conv_id%5 AS user_id, 's1' AS flight_code, CAST(sum(n) AS BIGINT) AS marks, count(*) AS images, CAST(sum(n*(n+1)) AS DOUBLE) AS sx FROM c WHERE conv_id%3>0 GROUP BY 1"),
    "SRC11": binding(src11, "SELECT CAST(NULL AS VARCHAR) AS drone, count(*) AS n, round(sum(height),2) AS height FROM shots UNION ALL SELECT drone, count(*), NULL FROM shots WHERE shot%2=0 GROUP BY 1"),
    "SRC12": binding(src12, "SELECT replace(class,'#','') AS class, count(*) AS n, round(sum((x2-x1)*(y2-y1)),2) AS area FROM boxes GROUP BY 1"),
    "SRC13": binding(src13, "SELECT name AS filepath FROM shots WHERE shot%3<>0"),
    "SNK1": binding(snk1, "SELECT image, id, x, y FROM marks WHERE role='gt'"),
    "SNK2": binding(snk2, "SELECT dataset, count(DISTINCT image) AS images, count(*) AS labels FROM annotations GROUP BY 1"),
    "SNK3": binding(snk3, "SELECT shot, name, CASE shot%3 WHEN 0 THEN 'AUTO' WHEN 1 THEN 'MANUAL' ELSE 'BRACKET' END AS mode FROM shots"),
    "SNK4": binding(
        snk4,
        f"""WITH {_COCO} SELECT n AS id, image_id, CASE WHEN class='Brand#11' THEN 1 ELSE 2 END AS category_id, CASE WHEN NOT bare THEN round(x1,6) END AS x,
          CASE WHEN NOT bare THEN round(x2-x1,6) END AS w, CASE WHEN ring THEN round((x2-x1)*(y2-y1)/2,6) WHEN bare THEN 0 ELSE round((x2-x1)*(y2-y1),6) END AS area,
          CASE WHEN ring THEN CAST(6 AS INTEGER) END AS numbers, CASE WHEN ring THEN round(y2,6) END AS last_y FROM c""",
    ),
    "SNK5": binding(snk5, f"WITH {_COCO} SELECT n AS id, CAST(0 AS INTEGER) AS ring, CAST(x1 AS INTEGER) AS x1, CAST(y1 AS INTEGER) AS y1, CAST(x2 AS INTEGER) AS x2, CAST(y2 AS INTEGER) AS y2 FROM c WHERE ring"),
    "SNK6": binding(snk6, "SELECT id AS label, round((x1+x2)/2/1000,6) AS xc, round((y1+y2)/2/800,6) AS yc, round((x2-x1)/1000,6) AS w, round((y2-y1)/800,6) AS h FROM boxes"),
    "SNK7": binding(snk7, "SELECT image, count(*) AS n, CAST(sum(CAST(substr(class,7,2) AS BIGINT)) AS BIGINT) AS classes, round(sum((x1+x2)/2/1000),3) AS xc FROM boxes GROUP BY 1"),
    "SNK8": binding(snk8, "SELECT id AS label, 9 AS tokens FROM boxes"),
    "SNK9": binding(snk9, "SELECT id AS label, CAST(trunc(CASE id%3 WHEN 0 THEN x1+1 WHEN 1 THEN x1+2 ELSE (x1+x2)/2 END) AS INTEGER) AS x, CAST(trunc(CASE id%3 WHEN 0 THEN y1+1 WHEN 1 THEN y1+2 ELSE (y1+y2)/2 END) AS INTEGER) AS y FROM boxes"),
    "SNK10": binding(
        lambda v: W.label_boxes(with_polygons(v)).select("image", "label", "xmin", "ymin", "xmax", "ymax", "class"),
        f"WITH {_POLYGONS} SELECT image, id AS label, CAST(x1 AS INTEGER) AS xmin, CAST(y1 AS INTEGER) AS ymin, CAST(x2 AS INTEGER) AS xmax, CAST(y2 AS INTEGER) AS ymax, class FROM g WHERE ring OR NOT boxless",
    ),
    "SNK11": binding(lambda v: W.to_boxes(labels(v)), "SELECT image AS image_path, CAST(x1 AS INTEGER) AS xmin, CAST(y1 AS INTEGER) AS ymin, CAST(x2 AS INTEGER) AS xmax, CAST(y2 AS INTEGER) AS ymax, class AS label FROM boxes"),
    "SNK12": binding(snk12, "SELECT id AS label, round(x1,4) AS x1, round(y1,4) AS y1, round(x2,4) AS x2, round(y2,4) AS y2 FROM boxes"),
    "SNK13": binding(snk13, "SELECT image, count(*) AS n, CAST(sum(x) AS BIGINT) AS sx FROM marks WHERE role='pred' AND id%9>0 GROUP BY 1"),
    "SNK14": binding(lambda v: v.marks.where("role = 'pred'").select("image", F.col("id").alias("prediction"), "x", "y", F.col("species").alias("class")), "SELECT image, id AS prediction, x, y, species AS class FROM marks WHERE role='pred'"),
    "SNK15": binding(snk15, "SELECT image, id, image*100.0+x*0.5 AS world_x, 9000-y*0.5 AS world_y, x<50 OR y<50 OR x>950 OR y>950 AS on_edge FROM marks"),
    "SNK16": binding(snk16, "SELECT image, id, CASE WHEN species='A' THEN 1 ELSE 2 END AS class_id, round(x/1000,6) AS xc, round(y/1000,6) AS yc, CAST(0.04 AS DOUBLE) AS w FROM marks WHERE species IN ('A','R')"),
    "SNK17": binding(snk17, "SELECT c_name AS name, dense_rank() OVER (ORDER BY c_name) AS id FROM customer"),
    "SNK18": binding(snk18, """WITH t AS (SELECT id, i AS tx, j AS ty, greatest(x1-i*256,0) AS a, greatest(y1-j*256,0) AS b, least(x2-i*256,256) AS c, least(y2-j*256,256) AS d FROM boxes, (SELECT unnest(generate_series(0,5)) AS i) s, (SELECT unnest(generate_series(0,5)) AS j) u)
      SELECT id, tx, 3-ty AS row, round((a+c)/2/256,6) AS xc, round((b+d)/2/256,6) AS yc, round((c-a)/256,6) AS w, round((d-b)/256,6) AS h FROM t WHERE c>a AND d>b"""),
    "SNK19": binding(snk19, "SELECT id, round(image*50.0+x1*CAST(0.1 AS DOUBLE),6) AS wx1, round(700-y1*CAST(0.1 AS DOUBLE),6) AS wy1, round(image*50.0+x2*CAST(0.1 AS DOUBLE),6) AS wx2 FROM boxes"),
    "SNK20": binding(snk20, "SELECT id AS label, CASE WHEN id%4=0 THEN 'new' ELSE class END AS class, CASE WHEN id%4=0 THEN 500 ELSE x1 END AS x, CASE WHEN id%4=0 THEN 200 ELSE y1 END AS y, CASE WHEN id%4=0 THEN 'created' END AS cvat FROM boxes"),
    "FN13": binding(fn13),
    "FN14": binding(lambda v: rings(v).select("label", P.interior_centre("ring").alias("c")).select("label", "c.x", "c.y")),
    "FN20": binding(fn20, "WITH c AS (SELECT id, least(x2,600)-greatest(x1,100) AS w, least(y2,500)-greatest(y1,100) AS h FROM boxes) SELECT id AS label, round(w*h,4) AS area FROM c WHERE w>0 AND h>0"),
    "TL12": binding(tl12, """WITH t AS (SELECT id, i AS tx, j AS ty, least(x2,i*256+256)-greatest(x1,i*256) AS w, least(y2,j*256+256)-greatest(y1,j*256) AS h FROM boxes, (SELECT unnest(generate_series(0,5)) AS i) s, (SELECT unnest(generate_series(0,5)) AS j) u)
      SELECT id AS label, tx, ty, round(w*h,3) AS area FROM t WHERE w>0 AND h>0"""),
    "PIX1": binding(pix1),
    "REV2": binding(rev2, f"{_M}, u AS (SELECT species FROM gt UNION ALL SELECT 'hard_negative' FROM pred p LEFT JOIN m ON p.image=m.image AND p.id=m.pred_id WHERE m.gt_id IS NULL AND score > CAST(0.9 AS DOUBLE)) SELECT species, count(*) AS n FROM u GROUP BY 1"),
    "ST1": binding(st1, "SELECT concat('img', CAST(event_id AS VARCHAR)) AS filepath, user_id FROM events"),
    "ST2": binding(st2, _ST2),
    "ST2_in_time": binding(st2_in_time, _ST2),
}
