"""SRC*: scans of the files that surveys and annotation tools leave, as typed DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

POINTS = "images string, labels double, scores double, dscores double, x double, y double, count_1 int, count_2 int, count_3 int, count_4 int, count_5 int, count_6 int, species string"
KEYPOINT = "struct<id:string,x:int,y:int,norder:int,visible:boolean,keypoint_class_id:string>"
LABEL = f"struct<id:string,class_name:string,bbox:array<double>,polygon:array<array<double>>,z_index:int,attributes:map<string,string>,keypoints:array<{KEYPOINT}>,score:double,kind:string>"
IMAGE = f"struct<image_id:string,image_name:string,dataset_name:string,width:int,height:int,image_status:string,tags:array<string>,labels:array<{LABEL}>>"
PROJECT = f"project_name string, create_date string, export_format_version string, export_date string, label_classes array<struct<class_id:string,class_name:string,class_type:string,color:string,norder:double>>, images array<{IMAGE}>"
COCO = "images array<struct<id:long,file_name:string,width:int,height:int>>, annotations array<struct<id:long,image_id:long,category_id:long,bbox:array<double>,segmentation:array<array<double>>,area:double>>, categories array<struct<id:long,name:string>>"


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """SRC1: files below a folder, hidden ones left out; only metadata is read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder).select("path", "modificationTime", "length")
    return found.withColumn("name", F.element_at(F.split("path", "/"), -1)).where(~F.col("name").startswith("."))


def points_csv(spark: SparkSession, path: str | list[str], schema: str = POINTS) -> DataFrame:
    """SRC3: a detection or annotation CSV; a malformed line becomes nulls, labels are cut to int."""
    out = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)
    return out.withColumn("labels", F.col("labels").cast("int")) if "labels" in out.columns else out


def headerless_csv(spark: SparkSession, path: str, schema: str, images: DataFrame, key: str) -> DataFrame:
    """SRC7: a CSV without a header, joined to image metadata where there is some."""
    return spark.read.schema(schema).csv(path).join(images, key, "left")


def tagged_csvs(spark: SparkSession, parts: dict[str, str], schema: str) -> DataFrame:
    """SRC8: box CSVs of several splits in one table with ``split``; boxes without area are dropped."""
    out = None
    for split, path in parts.items():
        one = spark.read.schema(schema).option("header", True).csv(path).withColumn("split", F.lit(split))
        out = one if out is None else out.unionByName(one)
    return out.where("xmax > xmin and ymax > ymin")


def geojson(spark: SparkSession, path: str | list[str], properties: str, kind: str = "Point") -> DataFrame:
    """SRC4, SRC11: point or polygon features of many files, with ``source_file``; missing properties are null."""
    coords = "array<double>" if kind == "Point" else "array<array<array<double>>>"
    schema = f"features array<struct<geometry:struct<type:string,coordinates:{coords}>,properties:struct<{properties}>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("source_file"), F.explode("features").alias("f"))
    c = F.col("f.geometry.coordinates")
    shape = [c[0].alias("x"), c[1].alias("y")] if kind == "Point" else [F.transform(c[0], lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))).alias("ring")]
    return rows.where(F.col("f.geometry.type") == kind).select("source_file", *shape, "f.properties.*")


def annotation_files(spark: SparkSession, paths: str | list[str], properties: str) -> DataFrame:
    """SRC10: geojson annotations with the island from the parent folder and the name from the file."""
    schema = f"features array<struct<geometry:struct<type:string,coordinates:array<double>>,properties:struct<{properties}>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(paths).withColumn("_p", F.input_file_name())
    out = rows.select(F.regexp_extract("_p", r"([^/]+)/[^/]+$", 1).alias("island"), F.regexp_extract("_p", r"([^/]+)\.[^./]+$", 1).alias("name"), F.explode("features").alias("f"))
    return out.select("island", "name", F.col("f.geometry.coordinates")[0].alias("x"), F.col("f.geometry.coordinates")[1].alias("y"), "f.properties.*")


def project(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """SRC5: an annotation project as ``(images, labels)``."""
    rows = spark.read.schema(PROJECT).option("multiLine", True).json(path)
    images = rows.select("project_name", F.explode("images").alias("i")).select("project_name", "i.*")
    labels = images.select("image_id", "image_name", "dataset_name", F.explode("labels").alias("l")).select("image_id", "image_name", "dataset_name", "l.*")
    return images.drop("labels"), labels


def coco(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """SRC6: one row per annotation with its image and category (``Unknown`` without one); area defaults to w * h."""
    rows = spark.read.schema(COCO).option("multiLine", True).json(path).select(F.input_file_name().alias("f"), "*")
    part = lambda c, p: rows.select("f", F.explode(c).alias("e")).select("f", *[F.col(f"e.{n}").alias(p + n) for n in rows.schema[c].dataType.elementType.names])
    a = part("annotations", "a_").withColumnRenamed("f", "af")
    i = part("images", "i_").withColumnRenamed("f", "if_")
    c = part("categories", "c_").withColumnRenamed("f", "cf")
    j = a.join(i, (F.col("a_image_id") == F.col("i_id")) & (F.col("af") == F.col("if_"))).join(c, (F.col("a_category_id") == F.col("c_id")) & (F.col("af") == F.col("cf")), "left")
    box = F.col("a_bbox")
    return j.select(
        F.col("a_id").alias("id"), F.col("i_file_name").alias("file_name"), F.col("i_width").alias("width"), F.col("i_height").alias("height"), F.coalesce("c_name", F.lit("Unknown")).alias("category"),
        box[0].alias("x"), box[1].alias("y"), box[2].alias("w"), box[3].alias("h"), F.coalesce("a_area", box[2] * box[3]).alias("area"), (F.coalesce(F.size("a_segmentation"), F.lit(0)) > 0).alias("has_segmentation"), F.col("a_segmentation").alias("segmentation"),
    )


def volunteer_export(spark: SparkSession, path: str) -> DataFrame:
    """SRC9: a classification export with three JSON columns, one row per mark of those who answered Yes to T0."""
    names = "classification_id long, user_name string, user_id long, user_ip string, workflow string, phase string, version string, label_time string, gold string, expert string, metadata string, annotations string, subject_data string, subject_ids long"
    rows = spark.read.schema(names).option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    tasks = F.from_json("annotations", "array<struct<task:string,value:string>>")
    marks = F.flatten(F.transform(F.filter(F.col("tasks"), lambda t: t.value.startswith("[")), lambda t: F.from_json(t.value, "array<struct<x:double,y:double,tool_label:string>>")))
    subject = F.element_at(F.map_values(F.from_json("subject_data", "map<string,map<string,string>>")), 1)
    out = rows.withColumn("tasks", tasks).withColumn("s", subject).withColumn("meta", F.from_json("metadata", "struct<started_at:string,finished_at:string>"))
    out = out.where(F.exists("tasks", lambda t: (t.task == "T0") & (t.value == "Yes")))
    name = F.coalesce(F.col("s")["image_name"], F.col("s")["Image_name"], F.col("s")["Filename"])
    code = F.coalesce(F.col("s")["flight_site_code"], F.col("s")["flight_code"], F.col("s")["Flight"], F.col("s")["site"])
    return out.select("user_name", "user_id", "phase", "subject_ids", F.col("meta.started_at").alias("started_at"), F.col("meta.finished_at").alias("finished_at"), name.alias("image_name"), code.alias("flight_code"), F.explode(marks).alias("m")).select("*", "m.*").drop("m")


def oriented_boxes(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """SRC12: text rows of 8 coordinates, class and flag, as corners with their shoelace area; header lines and shorter rows are skipped."""
    t = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("source_file"), t.alias("t")).where(F.size("t") >= 10)
    c = F.transform(F.slice("t", 1, 8), lambda v: v.cast("double"))
    out = rows.select("source_file", c.alias("c"), F.col("t")[8].alias("class"), F.col("t")[9].cast("double").alias("flag"))
    twice = sum((F.col("c")[2 * i] * F.col("c")[(2 * i + 3) % 8] - F.col("c")[(2 * i + 2) % 8] * F.col("c")[2 * i + 1] for i in range(4)), F.lit(0.0))
    return out.withColumn("area", F.abs(twice) / 2)


def not_yet_known(found: DataFrame, known: DataFrame, key: str = "filepath") -> DataFrame:
    """SRC13: rows whose path the database doesn't have."""
    return found.join(known.select(key), key, "left_anti")
