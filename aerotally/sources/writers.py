"""SNK*: conversions between annotation formats (tables in, tables out) and the writers of nested text formats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from aerotally.operators import ranking
from aerotally.operators.spatial import polygon_area
from aerotally.plans.storage import materialise


#: Features or labels that one nested document holds at most, on average.
PER_DOCUMENT = 20_000


def dense_ids(df: DataFrame, column: str, name: str) -> DataFrame:
    """SNK17: dense 1-based ids of the distinct values of a column, in order; rows without a value have none."""
    return df.join(ranking.dense_ids(df, column, name), column, "left")


def paged(df: DataFrame, name: str = "page", per_page: int = PER_DOCUMENT, by: Sequence[str] = ()) -> DataFrame:
    """``df`` with a page number for each row that leaves about ``per_page`` rows to a page, however the rows' values repeat.

    With ``by`` each value has pages of its own, so a value of few rows has one.
    The rows are written first, as only rows of files come in the same order
    when a task runs again.
    """
    written = materialise(df, "paged")
    at = F.xxhash64(F.monotonically_increasing_id())
    if not by:
        n = max(1, -(-written.count() // per_page))
        return written.withColumn(name, F.pmod(at, F.lit(n)).cast("int"))
    sizes = written.groupBy(*by).agg(F.ceil(F.count("*") / per_page).alias("_pages")).select(*[F.col(c).alias(f"_of_{c}") for c in by], "_pages")
    dealt = written.withColumn("_at", at).join(sizes, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by])
    return dealt.select(*written.columns, F.pmod("_at", "_pages").cast("int").alias(name))


def write_geojson(points: DataFrame, path: str, properties: Sequence[str]) -> None:
    """SNK1: one point feature per line, in as many files as there are partitions."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array("x", "y").alias("coordinates"))
    points.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties"))).alias("value")).write.text(path)


def write_documents(docs: DataFrame, path: str, by: str) -> None:
    """One JSON document per file, in a folder per value of ``by``: readers of nested documents take whole files."""
    docs.write.option("maxRecordsPerFile", 1).partitionBy(by).json(path)


def write_feature_collections(points: DataFrame, path: str, properties: Sequence[str], by: str, per_document: int = PER_DOCUMENT) -> None:
    """SNK1: FeatureCollection documents, one per value of ``by`` and page of its points."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array("x", "y").alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties"))
    docs = paged(points, "_page", per_document, [by]).groupBy(by, "_page").agg(F.collect_list(feature).alias("features"))
    write_documents(docs.select(by, F.lit("FeatureCollection").alias("type"), "features"), path, by)


def project_documents(labels: DataFrame, by: str = "dataset", per_document: int = 2_000) -> DataFrame:
    """SNK2: nested documents from flat labels: per project documents of about ``per_document`` images each, ``page`` by hash of the image, images and labels in order.

    The images are written first, as their numbers by project say how many pages each has.
    """
    per_image = labels.groupBy(by, "image").agg(F.sort_array(F.collect_list(F.struct("label", "class", "bbox"))).alias("labels"))
    per_image = materialise(per_image, "project-images")
    pages = materialise(per_image.groupBy(F.col(by).alias("_of")).agg(F.ceil(F.count("*") / per_document).alias("_pages")), "project-pages")
    page = F.pmod(F.xxhash64("image"), F.col("_pages")).cast("int")
    dealt = per_image.join(pages, F.col(by).eqNullSafe(F.col("_of")))
    return dealt.groupBy(by, page.alias("page")).agg(F.sort_array(F.collect_list(F.struct("image", "labels"))).alias("images"))


def serialisable(df: DataFrame, codes: dict[str, dict[int, str]], order: Sequence[str]) -> DataFrame:
    """SNK3: enum codes by name and columns in a fixed order; columns not named follow."""
    for column, names in codes.items():
        df = df.withColumn(column, F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col(column)])
    return df.select(*order, *[c for c in df.columns if c not in order])


def polygon_bounds(ring: Column) -> tuple[Column, ...]:
    """x1, y1, x2, y2 of an array of (x, y) structs; null without points."""
    xs, ys = F.transform(ring, lambda p: p.x), F.transform(ring, lambda p: p.y)
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


def to_coco(labels: DataFrame, classes: Sequence[str]) -> DataFrame:
    """SNK4: annotations with dense 1-based ids in order of image and label; labels of other classes are skipped.

    ``labels`` has ``image, label, class, x1, y1, x2, y2`` (null for labels
    without a box) and may have ``polygon``, an array of (x, y) structs. The box
    is x, y, width, height, from the polygon's bounds where there is none, and
    null for labels with neither; segmentation is the polygon, flat, or null; the
    area is the polygon's, else the box's, else 0. Images are numbered over all
    labels, of other classes too.
    """
    if "polygon" not in labels.columns:
        labels = labels.withColumn("polygon", F.lit(None).cast("array<struct<x:double,y:double>>"))
    cat = F.create_map(*[F.lit(x) for i, c in enumerate(classes, 1) for x in (c, i)])[F.col("class")]
    some = dense_ids(labels, "image", "image_id").where(F.col("class").isin(list(classes))).withColumn("category_id", cat)
    numbered = ranking.row_numbers(some, [F.col("image_id"), F.col("label")], "_n")
    ring = F.when(F.size("polygon") > 0, F.col("polygon"))
    x1, y1, x2, y2 = [F.when(F.col("x1").isNotNull(), F.col(c)).otherwise(b).cast("double") for c, b in zip(("x1", "y1", "x2", "y2"), polygon_bounds(ring))]
    box = F.when(x1.isNotNull(), F.array(x1, y1, x2 - x1, y2 - y1))
    flat = F.when(ring.isNotNull(), F.array(F.flatten(F.transform(ring, lambda p: F.array(p.x.cast("double"), p.y.cast("double"))))))
    area = F.coalesce(polygon_area(ring), (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")), F.lit(0.0))
    return numbered.select((F.col("_n") + 1).alias("id"), "image_id", "category_id", box.alias("bbox"), flat.alias("segmentation"), area.alias("area"))


def from_coco(annotations: DataFrame) -> DataFrame:
    """SNK5: a label per segmentation ring with its integer bounds."""
    ring = annotations.select("id", "image_id", "category_id", F.posexplode("segmentation").alias("ring", "s"))
    odd = lambda k: F.filter(F.col("s"), lambda _, i: i % 2 == k)
    whole = lambda c: c.cast("int")
    return ring.select("id", "image_id", "category_id", "ring", whole(F.array_min(odd(0))).alias("x1"), whole(F.array_min(odd(1))).alias("y1"), whole(F.array_max(odd(0))).alias("x2"), whole(F.array_max(odd(1))).alias("y2"))


def yolo_columns(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> tuple[Column, ...]:
    """SNK6, SNK7: normalised centre and size."""
    return (x1 + x2) / 2 / width, (y1 + y2) / 2 / height, (x2 - x1) / width, (y2 - y1) / height


def yolo_lines(labels: DataFrame, digits: int = 6) -> DataFrame:
    """SNK7: ``(image, line)`` text rows ``class xc yc w h``; write with ``partitionBy('image').text``."""
    xc, yc, w, h = yolo_columns(*[F.col(c) for c in ("x1", "y1", "x2", "y2", "image_width", "image_height")])
    return labels.select("image", F.concat_ws(" ", F.col("class_id").cast("string"), *[F.format_string(f"%.{digits}f", c.cast("double")) for c in (xc, yc, w, h)]).alias("line"))


def yolo_segments(labels: DataFrame, digits: int = 4) -> DataFrame:
    """SNK8: ``(image, line)`` with the normalised vertices of a ring of (x, y) structs."""
    flat = F.flatten(F.transform("ring", lambda p: F.array(F.round(p.x / F.col("image_width"), digits), F.round(p.y / F.col("image_height"), digits))))
    return labels.select("image", F.concat_ws(" ", F.col("class_id").cast("string"), F.array_join(F.transform(flat, lambda v: v.cast("string")), " ")).alias("line"))


def from_yolo(rows: DataFrame) -> DataFrame:
    """SNK12: pixel boxes from normalised ones."""
    x, y = F.col("xc") * F.col("image_width"), F.col("yc") * F.col("image_height")
    w, h = F.col("w") * F.col("image_width"), F.col("h") * F.col("image_height")
    return rows.select("image", "label", (x - w / 2).alias("x1"), (y - h / 2).alias("y1"), (x + w / 2).alias("x2"), (y + h / 2).alias("y2"))


def to_points(labels: DataFrame) -> DataFrame:
    """SNK9: the first keypoint, else the polygon's centre, else the box's, cut to integers."""
    x = F.coalesce(F.col("kx"), F.col("px"), (F.col("x1") + F.col("x2")) / 2)
    y = F.coalesce(F.col("ky"), F.col("py"), (F.col("y1") + F.col("y2")) / 2)
    return labels.select("image", "label", x.cast("int").alias("x"), y.cast("int").alias("y"), "class")


def label_boxes(labels: DataFrame) -> DataFrame:
    """SNK10: ``labels`` with integer bounds ``xmin, ymin, xmax, ymax``: the polygon's where there is one, else the box.

    Labels with a keypoint (``kx`` not null, if there is such a column), and those
    with neither polygon nor box, are skipped: a point gives no box.
    """
    columns = set(labels.columns)
    ring = F.when(F.size("polygon") > 0, F.col("polygon")) if "polygon" in columns else F.lit(None).cast("array<struct<x:double,y:double>>")
    bounds = [F.coalesce(b, F.col(c).cast("double")).cast("int").alias(n) for b, c, n in zip(polygon_bounds(ring), ("x1", "y1", "x2", "y2"), ("xmin", "ymin", "xmax", "ymax"))]
    some = labels.where("kx is null") if "kx" in columns else labels
    return some.select("*", *bounds).where("xmin is not null")


def to_boxes(labels: DataFrame) -> DataFrame:
    """SNK11: six-column box rows ``image_path, xmin, ymin, xmax, ymax, label`` by the rules of :func:`label_boxes`."""
    return label_boxes(labels).select(F.col("image").alias("image_path"), "xmin", "ymin", "xmax", "ymax", F.col("class").alias("label"))


def detection_documents(points: DataFrame) -> DataFrame:
    """SNK13: detections nested by image; rows without a point are skipped."""
    label = F.struct("id", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), "species", "score")
    return points.where("x is not null and y is not null").groupBy("image").agg(F.sort_array(F.collect_list(label)).alias("labels"))


def to_world(points: DataFrame, transforms: DataFrame, key: str = "image", *, edge: float = 50.0) -> DataFrame:
    """SNK15, SNK19, REV3: world coordinates by each raster's affine transform (ox, oy, px, py), with ``on_edge``."""
    j = points.join(transforms, key)
    near = (F.col("x") < edge) | (F.col("y") < edge) | (F.col("x") > F.col("image_width") - edge) | (F.col("y") > F.col("image_height") - edge)
    return j.withColumn("world_x", F.col("ox") + F.col("x") * F.col("px")).withColumn("world_y", F.col("oy") + F.col("y") * F.col("py")).withColumn("on_edge", near)


def reviewed(labels: DataFrame, review: DataFrame) -> DataFrame:
    """SNK20: review rows (relative coordinates) onto labels: a known label keeps its fields, with class and point replaced."""
    r = review.select("label", F.col("class").alias("_c"), (F.col("rx") * F.col("image_width")).alias("_x"), (F.col("ry") * F.col("image_height")).alias("_y"))
    j = labels.join(r, "label", "left")
    mark = F.when(F.col("_c").isNotNull(), F.map_concat(F.col("attributes"), F.create_map(F.lit("cvat"), F.lit("created")))).otherwise(F.col("attributes"))
    return j.withColumn("class", F.coalesce("_c", "class")).withColumn("x", F.coalesce("_x", "x")).withColumn("y", F.coalesce("_y", "y")).withColumn("attributes", mark).drop("_c", "_x", "_y")
