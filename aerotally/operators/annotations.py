"""FIL*, SET*, JN* and AGG11-AGG17: filters, edits and statistics of label tables.

``labels`` has one row per label with ``image`` and ``label`` ids; ``images`` one
row per image. Everything returns a new DataFrame.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from aerotally.functions.draws import drawn
from aerotally.operators.ranking import row_numbers
from aerotally.plans.storage import materialise

#: Images that are taken by a sort with a limit.
MOST_TAKEN = 10_000


def by_dataset(images: DataFrame, names: Sequence[str] | None) -> DataFrame:
    """FIL1: images of the named datasets; None passes all."""
    return images if names is None else images.where(F.col("dataset").isin(list(names)))


def by_status(images: DataFrame, names: Sequence[str] | None) -> DataFrame:
    """FIL2: images of the named statuses; None passes all."""
    return images if names is None else images.where(F.col("status").isin(list(names)))


def by_class(labels: DataFrame, names: Sequence[str]) -> DataFrame:
    """FIL3: labels of the named classes; images aren't touched."""
    return labels.where(F.col("class").isin(list(names)))


def by_tags(images: DataFrame, tags: Sequence[str], logic: str = "or", column: str = "tags") -> DataFrame:
    """FIL4: images with any (``or``) or all (``and``) of the tags."""
    wanted = F.array(*[F.lit(t) for t in tags])
    return images.where(F.arrays_overlap(column, wanted) if logic == "or" else F.size(F.array_intersect(F.col(column), wanted)) == len(set(tags)))


def by_name(images: DataFrame, names: DataFrame, *, exclude: bool = False, column: str = "image") -> DataFrame:
    """FIL5: images whose name is, or with ``exclude`` is not, in a table of names."""
    return images.join(names.select(column).distinct(), column, "left_anti" if exclude else "left_semi")


def by_kind(labels: DataFrame, kind: str) -> DataFrame:
    """FIL6: labels of an annotation kind: a ``box`` has no polygon; ``polygon`` and ``keypoint`` have one."""
    rule = {"box": "bbox is not null and polygon is null", "polygon": "polygon is not null", "keypoint": "keypoints is not null and size(keypoints) > 0"}
    return labels.where(rule[kind])


def with_labels(images: DataFrame, labels: DataFrame) -> DataFrame:
    """FIL7: images that have a label."""
    return images.join(labels.select("image").distinct(), "image", "left_semi")


def prepare(images: DataFrame, labels: DataFrame, *, datasets=None, statuses=None, classes=None, include: DataFrame | None = None, exclude: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """FIL8: the filters in their fixed order; image names become ``dataset___image``."""
    images = by_dataset(images, datasets)
    labels = by_class(labels, classes) if classes is not None else labels
    images = by_status(images, statuses)
    images = by_name(images, include) if include is not None else images
    images = by_name(images, exclude, exclude=True) if exclude is not None else images
    images = materialise(images, "prepared-images")  # read three times, as labels are twice
    labels = materialise(labels.join(images.select("image"), "image", "left_semi"), "prepared-labels")
    images = with_labels(images, labels)
    return images.withColumn("ds_image_name", F.concat_ws("___", "dataset", F.col("image").cast("string"))), labels


def by_attributes(labels: DataFrame, allowed: dict[str, Sequence[str]], *, keep_unlabelled: bool = False, column: str = "attributes") -> DataFrame:
    """FIL9: every named attribute has one of its allowed values; labels without it stay only on request."""
    for name, values in allowed.items():
        value = F.col(column)[name]
        rule = value.isin(list(values))
        labels = labels.where(F.coalesce(rule, F.lit(keep_unlabelled)) if keep_unlabelled else rule)
    return labels


def sample_images(images: DataFrame, n: int | float, mode: str, *, seed: int = 1, count: str = "n_labels") -> DataFrame:
    """FIL10-FIL12: n images: ``first``, ``random``, ``percentage`` (a share of them), ``ordered_asc`` or ``ordered_desc`` by label count.

    Many images are numbered by ranges, as a limit brings its rows into one task.
    """
    if mode == "percentage":
        images = materialise(images, "sampled-from")  # counted, dealt by ranges and read
        n = int(images.count() * n)
        mode = "random"
    order = {"first": [F.col("image")], "random": [drawn(seed, "image"), F.col("image")], "ordered_asc": [F.col(count), F.col("image")], "ordered_desc": [F.desc(count), F.col("image")]}[mode]
    if n > MOST_TAKEN:
        return row_numbers(images, order, "_number_sampled").where(F.col("_number_sampled") < int(n)).drop("_number_sampled")
    return images.orderBy(*order).limit(int(n))


def label_budget(counts: DataFrame, budget: int, order: str = "image", key: str = "dataset") -> DataFrame:
    """FIL13: images in order until the first one whose predecessors hold at least budget plus its own count; per key."""
    w = Window.partitionBy(key).orderBy(order)
    before = F.coalesce(F.sum("n_labels").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    stops = counts.withColumn("_stop", (before >= F.col("n_labels") + budget).cast("int"))
    return stops.withColumn("_stopped", F.max("_stop").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_stopped = 0").drop("_stop", "_stopped")


def images_with_more(labels: DataFrame, cls: str, t: int) -> DataFrame:
    """FIL14: images with more than t labels of a class."""
    return labels.where(F.col("class") == cls).groupBy("image").agg(F.count("*").alias("n")).where(F.col("n") > t)


def inside_margin(labels: DataFrame, patch: float) -> DataFrame:
    """FIL16: labels whose centre is farther than half a patch from the border, strictly."""
    h, cx, cy = patch / 2, F.col("x1") + F.col("w") / 2, F.col("y1") + F.col("h") / 2
    return labels.where((cx > h) & (cx < F.col("image_width") - h) & (cy > h) & (cy < F.col("image_height") - h))


def sane(labels: DataFrame) -> DataFrame:
    """FIL17: labels whose centre lies in the image."""
    cx, cy = F.col("x1") + F.col("w") / 2, F.col("y1") + F.col("h") / 2
    return labels.where((cx >= 0) & (cx < F.col("image_width")) & (cy >= 0) & (cy < F.col("image_height")))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """SET3: rows of ``new`` replace those of ``old`` with the same keys."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def merge_projects(parts: Sequence[DataFrame], key: str = "image") -> DataFrame:
    """SET2: images of many projects, each once, the earliest project first."""
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("_turn", F.lit(i))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    n = F.row_number().over(Window.partitionBy(key).orderBy("_turn"))
    return out.withColumn("_n", n).where("_n = 1").drop("_n", "_turn")


def append_labels(images: DataFrame, labels: DataFrame, extra: DataFrame) -> DataFrame:
    """SET5: labels appended to known images; an unknown image raises."""
    if not extra.join(images.select("image"), "image", "left_anti").isEmpty():
        raise ValueError("labels for an image that isn't there")
    return labels.unionByName(extra, allowMissingColumns=True)


def duplicates(df: DataFrame, key: str, id: str) -> DataFrame:
    """SET7: rows that share a hash with one of smaller id: the redundant ones."""
    first = df.groupBy(key).agg(F.min(id).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    return df.join(first, key).where(F.col(id) > F.col("_first")).select(id, key)


def drop_duplicates(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """SET8: the first row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def moved(old: DataFrame, new: DataFrame, tolerance: float, id: str = "label", *, across: bool = False) -> DataFrame:
    """JN2: labels of both frames that moved farther than the tolerance; ``across`` looks at x only."""
    both = old.select(id, F.col("x").alias("x_old"), F.col("y").alias("y_old")).join(new.select(id, "x", "y"), id)
    dx, dy = F.col("x") - F.col("x_old"), F.col("y") - F.col("y_old")
    return both.withColumn("distance", F.abs(dx) if across else F.hypot(dx, dy)).where(F.col("distance") > tolerance)


def added_removed(old: DataFrame, new: DataFrame, id: str = "label") -> DataFrame:
    """JN3: ids that only one frame has, as ``change``."""
    added = new.select(id).join(old.select(id), id, "left_anti").withColumn("change", F.lit("added"))
    return added.unionByName(old.select(id).join(new.select(id), id, "left_anti").withColumn("change", F.lit("removed")))


def change_summary(old: DataFrame, new: DataFrame, id: str = "label") -> DataFrame:
    """JN4: totals of both frames and of what was deleted and added."""
    j = old.select(F.col(id), F.lit(1).alias("o")).join(new.select(F.col(id), F.lit(1).alias("n")), id, "full_outer")
    n = lambda rule: F.count(F.when(rule, 1))
    o, w = F.col("o").isNotNull(), F.col("n").isNotNull()
    return j.agg(n(o & ~w).alias("deleted"), n(w & ~o).alias("added"), n(o).alias("old_total"), n(w).alias("new_total"), F.count("*").alias("total"))


def shift(labels: DataFrame, offsets: DataFrame, deletes: DataFrame, id: str = "label") -> DataFrame:
    """JN6: labels moved by an offset table, less those to delete."""
    kept = labels.join(deletes.select(id), id, "left_anti").join(offsets.select(id, "dx", "dy"), id, "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return kept.withColumn("x", F.col("x") + zero(F.col("dx"))).withColumn("y", F.col("y") + zero(F.col("dy"))).drop("dx", "dy")


def dataset_statistics(images: DataFrame, labels: DataFrame) -> DataFrame:
    """AGG11: images, labels, point labels and box labels of each dataset, and labels of each of its classes; images without labels count.

    A row without a class has the dataset's totals, with the most classes of an
    image. A label with a ``bbox`` is a box and one with ``keypoints`` a point;
    it may be both or neither. What has no dataset or class counts as ``unknown``.
    """
    point = F.coalesce(F.size("keypoints"), F.lit(0)) > 0
    sums = ["labels", "point_labels", "box_labels"]
    known = lambda c: F.coalesce(F.col(c), F.lit("unknown")).alias(c)
    per = labels.groupBy("image", known("class")).agg(F.count("*").alias("labels"), F.count(F.when(point, 1)).alias("point_labels"), F.count("bbox").alias("box_labels"))
    classes = per.groupBy("image").agg(F.count("*").alias("k"), *[F.sum(c).alias(c) for c in sums], F.collect_list(F.struct("class", *sums)).alias("classes"))
    j = images.select(known("dataset"), "image").distinct().join(classes, "image", "left").fillna(0, ["k", *sums])
    none = F.lit(None).cast("long")
    total = F.struct(F.lit(None).cast("string").alias("class"), *sums, F.lit(1).cast("long").alias("images"), F.col("k").alias("max_classes"))
    of_class = F.transform("classes", lambda c: F.struct(c["class"].alias("class"), *[c[s].alias(s) for s in sums], none.alias("images"), none.alias("max_classes")))
    rows = j.select("dataset", F.inline(F.concat(F.array(total), F.coalesce(of_class, F.array()))))
    return rows.groupBy("dataset", "class").agg(F.sum("images").alias("images"), *[F.sum(c).alias(c) for c in sums], F.max("max_classes").alias("max_classes"))


def distribution(labels: DataFrame, group: str, column: str, values: Sequence[str]) -> DataFrame:
    """AGG13: group by class pivot with zeros and a total."""
    wide = labels.groupBy(group).pivot(column, list(values)).count().fillna(0)
    total = sum((F.col(v) for v in values), F.lit(0))
    return wide.withColumn("total", total)


def box_statistics(labels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """AGG14: count, images, means and sample deviations of area, width and height, labels per image."""
    area = F.col("w") * F.col("h")
    out = labels.withColumn("area", area).groupBy(*keys).agg(F.count("*").alias("n"), F.countDistinct("image").alias("images"), *[f(c).alias(f"{c}_{k}") for c in ("area", "w", "h") for k, f in (("mean", F.avg), ("std", F.stddev_samp))])
    return out.withColumn("per_image", F.col("n") / F.col("images"))


def majority_class(images: DataFrame, labels: DataFrame) -> DataFrame:
    """AGG17: the most frequent class of each image, ties to the class of the smallest label id; ``empty`` where there is none."""
    n = labels.groupBy("image", "class").agg(F.count("*").alias("n"), F.min("label").alias("first"))
    top = n.groupBy("image").agg(F.max_by("class", F.struct("n", -F.col("first"))).alias("class"))
    return images.select("image").distinct().join(top, "image", "left").fillna("empty", ["class"])


def above(predictions: DataFrame, threshold: float, score: str = "score", *, inclusive: bool = False) -> DataFrame:
    """FIL23: rows whose score is above the threshold, or at it with ``inclusive``, as curves take it."""
    return predictions.where(F.col(score) >= threshold if inclusive else F.col(score) > threshold)


def complete(predictions: DataFrame, required: Sequence[str] = ("score", "x", "y")) -> DataFrame:
    """FIL24: rows that lack none of the required values."""
    return predictions.dropna(subset=list(required))


def verified_points(points: DataFrame, *, species: str = "species", defaults: dict[str, object] | None = None) -> DataFrame:
    """FIL25: rows with a species that isn't blank; missing columns and null values get their defaults (score and labels 1)."""
    out = points.where(F.col(species).isNotNull() & (F.trim(species) != ""))
    for column, value in (defaults or {"score": 1.0, "labels": 1}).items():
        out = out.withColumn(column, F.coalesce(F.col(column), F.lit(value)) if column in out.columns else F.lit(value))
    return out


def stale_folders(folders: DataFrame, folder: str = "folder", century: str = "20") -> DataFrame:
    """FIL26: folders whose name ends in a date of six digits (ddmmyy), with ``renamed``, the same with a year of four."""
    date = F.element_at(F.split(folder, "_"), -1)
    stale = folders.where(date.rlike(r"^\d{6}$"))
    start = F.expr(f"substring(`{folder}`, 1, length(`{folder}`) - 2)")
    return stale.withColumn("renamed", F.concat(start, F.lit(century), F.substring(date, 5, 2)))


def attributes(rows: DataFrame, json: str, kinds: dict[str, str]) -> DataFrame:
    """SET9: keys of a flat JSON object as columns of the given types; absent keys are null."""
    out = rows.withColumn("_attributes", F.from_json(F.col(json), "map<string,string>"))
    return out.withColumns({key: F.col("_attributes")[key].try_cast(kind) for key, kind in kinds.items()}).drop("_attributes")


def repeated_ids(rows: DataFrame, id: str) -> DataFrame:
    """SET9: ids that more than one row has, with their number of rows."""
    return rows.groupBy(id).agg(F.count("*").alias("n")).where("n > 1")


def routed_labels(tiles: DataFrame, crops: DataFrame, reference: DataFrame, predictions: DataFrame, *, tile: str = "tile", id: str = "label") -> DataFrame:
    """JN5: labels of tiles in the frame of their parent image, with where they go.

    ``crops`` has the offset (ox, oy) of each tile, none counting as 0. A label
    that the reference doesn't have is to ``add``, one that was predicted to
    ``shift``, any other to ``ignore``.
    """
    known = reference.select(id).distinct().withColumn("_known", F.lit(True))
    predicted = predictions.select(id).distinct().withColumn("_predicted", F.lit(True))
    j = tiles.join(crops.select(tile, "ox", "oy"), tile, "left").join(known, id, "left").join(predicted, id, "left")
    route = F.when(F.col("_known").isNull(), "add").when(F.col("_predicted"), "shift").otherwise("ignore")
    moved = {"x": F.col("x") + F.coalesce("ox", F.lit(0.0)), "y": F.col("y") + F.coalesce("oy", F.lit(0.0)), "route": route}
    return j.withColumns(moved).drop("ox", "oy", "_known", "_predicted")


def with_hard_negatives(corrected: DataFrame, labels: DataFrame, false_positives: DataFrame, *, id: str = "label", cls: str = "class", name: str = "hard_negative") -> DataFrame:
    """JN7: the corrected labels, and those of ``labels`` that are listed as false positives with their class rewritten."""
    wrong = labels.join(false_positives.select(id).distinct(), id, "left_semi").withColumn(cls, F.lit(name))
    return corrected.select(id, cls).unionByName(wrong.select(id, cls))


def inventory(labels: DataFrame, splits: Sequence[str], *, name: str = "name", split: str = "split") -> DataFrame:
    """AGG30: labels by iteration (the digits after ``_il_`` in the dataset's name, else empty) and split, 0 where there are none."""
    iteration = F.regexp_extract(name, "_il_([0-9]+)", 1)
    return labels.groupBy(iteration.alias("iteration")).pivot(split, list(splits)).count().fillna(0)


def missions_with(images: DataFrame, chosen: DataFrame, more_than: int, *, mission: str = "dataset", image: str = "image") -> DataFrame:
    """FIL15: missions with more than so many of the chosen images, with their number."""
    own = images.join(chosen.select(image).distinct(), image, "left_semi")
    return own.groupBy(mission).agg(F.count("*").alias("images")).where(F.col("images") > more_than)


def mean_by_cell(rows: DataFrame, grid: str, keys: Sequence[str]) -> DataFrame:
    """AGG28: mean of each cell of the rows' grids (arrays), by group: ``(*keys, cell, mean)``."""
    cells = rows.select(*keys, F.posexplode(grid).alias("cell", "_value"))
    return cells.groupBy(*keys, "cell").agg(F.avg(F.col("_value").cast("double")).alias("mean"))


def score_stats(rows: DataFrame, keys: Sequence[str], score: str = "score", least: int = 5) -> DataFrame:
    """AGG29: mean, sample deviation and number of the scores of each group that has at least ``least`` rows."""
    found = rows.groupBy(*keys).agg(F.avg(score).alias("mean"), F.stddev_samp(score).alias("std"), F.count("*").alias("n"))
    return found.where(F.col("n") >= least)


def detectability(predictions: DataFrame, key: str, threshold: float, score: str = "score") -> DataFrame:
    """AGG31: by group the number of predictions, the share with a score of the threshold or more, and the mean score."""
    return predictions.groupBy(key).agg(F.count("*").alias("n"), F.avg((F.col(score) >= threshold).cast("double")).alias("detectable"), F.avg(score).alias("score"))
