"""TL*, SPL*, NEG*, FN16-FN21: tiles, crops, splits and background samples as table jobs."""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from aerotally.functions.draws import drawn
from aerotally.functions.polygons import clipped
from aerotally.operators.ranking import numbers_within
from aerotally.operators.spatial import polygon_area, range_join
from aerotally.plans.storage import materialise


def world_grid(rasters: DataFrame, size: float, *, overlap: float = 0.0, clip: bool = False) -> DataFrame:
    """TL1, TL2 (``clip``): tiles of ``size`` over each raster's bounds (x1, y1, x2, y2), named by their truncated corner."""
    step = size * (1 - overlap)
    start = lambda lo, hi: F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil((F.col(hi) - F.col(lo)) / step) - 1, F.lit(0)).cast("long")), lambda i: F.col(lo) + i * step)
    out = rasters.withColumn("tx1", F.explode(start("x1", "x2"))).withColumn("ty1", F.explode(start("y1", "y2")))
    end = lambda c, hi: F.least(F.col(c) + size, F.col(hi)) if clip else F.col(c) + size
    out = out.withColumn("tx2", end("tx1", "x2")).withColumn("ty2", end("ty1", "y2"))
    return out.withColumn("tile_name", F.concat_ws("_", "raster", F.col("tx1").cast("long").cast("string"), F.col("ty1").cast("long").cast("string")))


def pixel_grid(images: DataFrame, size: int, overlap: int = 0) -> DataFrame:
    """TL3: whole tiles only; a row or column stops at an exact fit."""
    step = size - overlap
    xs = lambda c: F.filter(F.sequence(F.lit(0), F.greatest(F.col(c) - 1, F.lit(0)), F.lit(step)), lambda i: i + size <= F.col(c))
    out = images.withColumn("x", F.explode(xs("image_width"))).withColumn("y", F.explode(xs("image_height")))
    return out.withColumn("key", F.concat_ws("_", F.col("x").cast("string"), F.col("y").cast("string"), F.lit(str(step))))


def centre_grid(images: DataFrame, size: int) -> DataFrame:
    """TL4: tiles laid from the centre outward, ``position`` by distance to the centre."""
    def axis(c: str) -> Column:
        first = F.floor(F.col(c) / 2 - size / 2)
        k = F.floor(first / size)
        return F.filter(F.transform(F.sequence(-k, k), lambda i: first + i * size), lambda x: (x >= 0) & (x + size <= F.col(c)))
    out = images.withColumn("x", F.explode(axis("image_width"))).withColumn("y", F.explode(axis("image_height")))
    dx, dy = F.col("x") + size / 2 - F.col("image_width") / 2, F.col("y") + size / 2 - F.col("image_height") / 2
    return out.withColumn("position", F.row_number().over(Window.partitionBy("image").orderBy(dx * dx + dy * dy, "y", "x")))


def object_tiles(points: DataFrame, size: float, id: str = "id", keys: Sequence[str] = ("image",)) -> DataFrame:
    """TL5: a tile centred on each object; two objects at one place raise."""
    if not points.groupBy(*keys, "x", "y").count().where("count > 1").isEmpty():
        raise ValueError("two objects share a location")
    h = size / 2
    return points.select(*keys, id, (F.col("x") - h).alias("tx1"), (F.col("y") - h).alias("ty1"), (F.col("x") + h).alias("tx2"), (F.col("y") + h).alias("ty2"))


def empty_tiles(tiles: DataFrame, points: DataFrame, buffer: float, keys: Sequence[str], *, most: int | None = None, seed: int = 3, id: str = "tile_name") -> DataFrame:
    """TL6: tiles without a point within the buffer of their rectangle; with ``most``, that many per key in seeded order."""
    size = F.greatest(F.col("tx2") - F.col("tx1"), F.col("ty2") - F.col("ty1"))
    reach = float(tiles.agg(F.max(size)).first()[0] or 1.0) + 2 * buffer
    cx, cy = (F.col("tx1") + F.col("tx2")) / 2, (F.col("ty1") + F.col("ty2")) / 2
    a = tiles.select(*keys, id, "tx1", "ty1", "tx2", "ty2", cx.alias("l_x"), cy.alias("l_y"))
    near = range_join(a, points.select(*keys, F.col("x").alias("r_x"), F.col("y").alias("r_y")), reach, keys)
    dx = F.greatest(F.col("tx1") - F.col("r_x"), F.lit(0.0), F.col("r_x") - F.col("tx2"))
    dy = F.greatest(F.col("ty1") - F.col("r_y"), F.lit(0.0), F.col("r_y") - F.col("ty2"))
    hit = near.where(dx * dx + dy * dy <= buffer * buffer).select(*keys, id).distinct()
    free = tiles.join(hit, [*keys, id], "left_anti")
    if most is None:
        return free
    order = Window.partitionBy(*keys).orderBy(drawn(seed, id), id)
    return free.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def padding(size: Column, tile: int, overlap: int = 0) -> Column:
    """TL8: what to add so that tiles with this overlap fit."""
    step = tile - overlap
    return F.pmod(F.lit(step) - size % step, F.lit(step))


def tile_boxes(boxes: DataFrame, size: float, keys: Sequence[str] = ("image",)) -> DataFrame:
    """TL9, SP14: boxes in the tiles that they meet: ``full`` or ``partial`` with the share kept; only tiles with a full box."""
    at = lambda c: F.floor(F.col(c) / size).cast("long")
    laid = boxes.withColumn("tx", F.explode(F.sequence(at("x1"), at("x2")))).withColumn("ty", F.explode(F.sequence(at("y1"), at("y2"))))
    lo = lambda c, t: F.greatest(F.col(c), F.col(t) * size) - F.col(t) * size
    hi = lambda c, t: F.least(F.col(c), F.col(t) * size + size) - F.col(t) * size
    out = laid.withColumns({"lx1": lo("x1", "tx"), "ly1": lo("y1", "ty"), "lx2": hi("x2", "tx"), "ly2": hi("y2", "ty")}).where("lx2 > lx1 and ly2 > ly1")
    kept = (F.col("lx2") - F.col("lx1")) * (F.col("ly2") - F.col("ly1")) / ((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")))
    out = out.withColumn("kept_box_size", kept).withColumn("edge_partial", kept < 1)
    for c in ("lx1", "ly1", "lx2", "ly2"):
        out = out.withColumn(c, F.when(F.col("edge_partial"), F.col(c).cast("long").cast("double")).otherwise(F.col(c)))
    whole = F.max((~F.col("edge_partial")).cast("int")).over(Window.partitionBy(*keys, "tx", "ty"))
    return out.withColumn("_whole", whole).where("_whole = 1").drop("_whole")


def tile_points(points: DataFrame, boxes: DataFrame, size: float, keys: Sequence[str] = ("image",), id: str = "id") -> DataFrame:
    """TL10, TL11: points strictly inside tiles, without those under a box that its tile cuts."""
    own = points.withColumn("tx", F.floor(F.col("x") / size).cast("long")).withColumn("ty", F.floor(F.col("y") / size).cast("long"))
    own = own.withColumn("lx", F.col("x") - F.col("tx") * size).withColumn("ly", F.col("y") - F.col("ty") * size).where("lx > 0 and ly > 0")
    at = lambda c: F.floor(F.col(c) / size).cast("long")
    cut = boxes.where((at("x1") != at("x2")) | (at("y1") != at("y2"))).withColumn("tx", F.explode(F.sequence(at("x1"), at("x2")))).withColumn("ty", F.explode(F.sequence(at("y1"), at("y2"))))
    masks = cut.select(*keys, "tx", "ty", F.col("x1").alias("mx1"), F.col("y1").alias("my1"), F.col("x2").alias("mx2"), F.col("y2").alias("my2"))
    hidden = own.join(masks, [*keys, "tx", "ty"]).where("x between mx1 and mx2 and y between my1 and my2").select(*keys, id).distinct()
    return own.join(hidden, [*keys, id], "left_anti")


class FreeTiles:
    """Nearest free tile with deletion: free tiles counted on a pyramid of squares of 1, 2, 4, ... tiles."""

    def __init__(self, tiles: np.ndarray):
        self.counts: list[dict[tuple[int, int], int]] = []
        self.start = tiles.min(0).tolist()  # numbers below zero would never be halved to one square
        at = tiles.astype(np.int64) - self.start
        while True:
            cells, n = np.unique(at, axis=0, return_counts=True)
            self.counts.append(dict(zip(map(tuple, cells.tolist()), n.tolist())))
            if len(cells) <= 1:
                return
            at = at >> 1

    def take(self, tx: int, ty: int) -> tuple[int, int] | None:
        """The nearest tile that is left, which then is not; ties to the smaller (ty, tx). None if there is none."""
        top = len(self.counts) - 1
        tx, ty = tx - self.start[0], ty - self.start[1]
        # by distance; squares come before tiles, so that all tiles at a distance are there when one is taken
        heap = [(0, 0, y, x, top) for (x, y), n in self.counts[top].items() if n]
        while heap:
            _, tile, y, x, level = heapq.heappop(heap)
            if tile:
                for up, cells in enumerate(self.counts):
                    cells[x >> up, y >> up] -= 1
                return x + self.start[0], y + self.start[1]
            if level == 0:
                d = (x - tx) * (x - tx) + (y - ty) * (y - ty)
                heapq.heappush(heap, (d, 1, y, x, 0))
                continue
            for i in (2 * x, 2 * x + 1):
                for j in (2 * y, 2 * y + 1):
                    if self.counts[level - 1].get((i, j)):
                        size = 1 << (level - 1)
                        dx, dy = max(i * size - tx, tx - (i + 1) * size + 1, 0), max(j * size - ty, ty - (j + 1) * size + 1, 0)
                        heapq.heappush(heap, (dx * dx + dy * dy, 0, j, i, level - 1))
        return None


def paired_empty_tiles(occupied: DataFrame, empty: DataFrame, key: str = "image") -> DataFrame:
    """SP15: for each occupied tile in tile order (ty, tx) the nearest empty one that is left, ties to the first in tile order.

    Each choice hangs on those before it, so an image is one group: its tiles,
    not its pixels or pairs. A tile takes some steps down a pyramid of counts.
    """

    def pair(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values(["ty", "tx"])
        free = FreeTiles(right[["tx", "ty"]].to_numpy(np.int64)) if len(right) else None
        out = []
        for tx, ty in zip(left["tx"].tolist(), left["ty"].tolist()):
            if free is None or (found := free.take(tx, ty)) is None:
                break
            out.append((left[key].iloc[0], tx, ty, *found))
        return pd.DataFrame(out, columns=[key, "tx", "ty", "empty_tx", "empty_ty"])

    kind = occupied.schema[key].dataType.simpleString()
    return occupied.groupBy(key).cogroup(empty.groupBy(key)).applyInPandas(pair, f"{key} {kind}, tx long, ty long, empty_tx long, empty_ty long")


def point_box(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> tuple[Column, ...]:
    """FN17: a fixed-size box round a point, moved inward at the border and keeping its size."""
    x1 = F.greatest(F.lit(0.0), F.least(x - w / 2, width - w))
    y1 = F.greatest(F.lit(0.0), F.least(y - h / 2, height - h))
    return x1, y1, x1 + w, y1 + h


def padded_box(x1: Column, y1: Column, x2: Column, y2: Column, pad: float, width: Column, height: Column) -> tuple[Column, ...]:
    """FN18: a box grown by ``pad`` and clipped to the image."""
    return F.greatest(F.lit(0.0), x1 - pad), F.greatest(F.lit(0.0), y1 - pad), F.least(width, x2 + pad), F.least(height, y2 + pad)


def box_in_crop(x1: Column, y1: Column, x2: Column, y2: Column, crop: tuple[float, float, float, float]) -> tuple[Column, ...]:
    """FN19: a box in the frame of a crop (x1, y1, x2, y2): clipped to it, null where they don't meet."""
    a, b, c, d = (F.lit(float(v)) for v in crop)
    meets = (x1 < c) & (x2 > a) & (y1 < d) & (y2 > b)
    cut = lambda v, lo, hi: F.when(meets, F.least(F.greatest(v, lo), hi) - lo)
    return cut(x1, a, c), cut(y1, b, d), cut(x2, a, c), cut(y2, b, d)


def point_in_crop(x: Column, y: Column, crop: tuple[float, float, float, float]) -> tuple[Column, Column]:
    """FN19: a point in the frame of a crop, null outside."""
    a, b, c, d = (F.lit(float(v)) for v in crop)
    inside = (x >= a) & (x < c) & (y >= b) & (y < d)
    return F.when(inside, x - a), F.when(inside, y - b)


def planned_name(island: Column, folder: Column, old: Column) -> Column:
    """FN22: ``island_site_DJI_nnnn_ddmmyyyy.JPG`` from a folder ``site_ddmmyyyy`` and any name that holds ``DJI_nnnn``; null without it."""
    part, shot = F.split(folder, "_"), F.regexp_extract(old, r"(DJI_\d{4})", 1)
    return F.when(shot != "", F.concat(island, F.lit("_"), F.element_at(part, 1), F.lit("_"), shot, F.lit("_"), F.element_at(part, 2), F.lit(".JPG")))


def balanced_tiles(tiles: DataFrame, points: DataFrame, size: float, buffer: float, most: int, keys: Sequence[str] = ("image",)) -> DataFrame:
    """TL7: a tile around each place that holds a point, and at most ``most`` empty tiles per key, told apart by ``has_object``."""
    places = points.dropDuplicates([*keys, "x", "y"])
    full = object_tiles(places, size, keys=keys).select(*keys, "tx1", "ty1", F.lit(True).alias("has_object"))
    free = empty_tiles(tiles, places, buffer, list(keys), most=most).select(*keys, "tx1", "ty1", F.lit(False).alias("has_object"))
    return full.unionByName(free)


def tile_polygons(labels: DataFrame, size: float, ring: str = "ring") -> DataFrame:
    """TL12: polygons (with their box x1, y1, x2, y2) cut to the tiles that they meet, in the tile's frame, with their ``area``."""
    at = lambda c: F.floor(F.col(c) / size).cast("long")
    laid = labels.withColumn("tx", F.explode(F.sequence(at("x1"), at("x2")))).withColumn("ty", F.explode(F.sequence(at("y1"), at("y2"))))
    edge = lambda c, d: ((F.col(c) + d) * size).cast("double")
    cut = laid.withColumn(ring, clipped(F.col(ring), edge("tx", 0), edge("ty", 0), edge("tx", 1), edge("ty", 1))).where(F.col(ring).isNotNull())
    return cut.withColumn("area", polygon_area(F.col(ring))).where("area > 0")


def tile_labels(boxes: DataFrame, points: DataFrame, size: float, keys: Sequence[str] = ("image",)) -> DataFrame:
    """TL13: how many boxes and points an image's tiles hold, together."""
    b = tile_boxes(boxes, size, keys).groupBy(*keys).agg(F.count("*").alias("boxes"))
    p = tile_points(points, boxes, size, keys).groupBy(*keys).agg(F.count("*").alias("points"))
    return b.join(p, list(keys), "full_outer").fillna(0, ["boxes", "points"])


def _share(n: Column, ratio: float) -> Column:
    """Rows that a share given in decimals makes of n, rounded down: 0.7 of 10 are 7, whatever doubles say."""
    return F.floor(n * F.lit(Decimal(str(ratio)))).cast("long")


def stratified_split(items: DataFrame, cls: str, id: str, ratio: float, *, cap: int | None = None, total: int | None = None, seed: int = 9) -> DataFrame:
    """SPL1: train and val by class in seeded order; at most min(cap, total // classes) of a class, int(n * ratio) of them train."""
    limit = F.lit(1 << 60) if cap is None else F.lit(cap)
    if total is not None:
        limit = F.least(limit, F.lit(total // max(1, items.select(cls).distinct().count())))
    ranked = numbers_within(items, [cls], [drawn(seed, id), F.col(id)], "_r", "_n").withColumn("_n", F.least("_n", limit))
    return ranked.where(F.col("_r") < F.col("_n")).withColumn("part", F.when(F.col("_r") < _share(F.col("_n"), ratio), "train").otherwise("val")).drop("_r", "_n")


def three_way_split(items: DataFrame, stratum: str, id: str, train: float, val: float, *, seed: int = 9) -> DataFrame:
    """SPL2: train, val and test of each stratum in seeded order."""
    ranked = numbers_within(items, [stratum], [drawn(seed, id), F.col(id)], "_r", "_n")
    first, second = _share(F.col("_n"), train), _share(F.col("_n"), val)
    part = F.when(F.col("_r") < first, "train").when(F.col("_r") < first + second, "val").otherwise("test")
    return ranked.withColumn("part", part).drop("_r", "_n")


def k_folds(items: DataFrame, k: int, order: str, group: str) -> DataFrame:
    """SPL3: contiguous folds per group, the first n mod k one larger; every fold with its role of each item."""
    ranked = numbers_within(items, [group], [F.col(order)], "_r", "_n")
    least, larger = F.floor(F.col("_n") / k), F.col("_n") % k
    in_larger = larger * (least + 1)  # rows of the folds that are one larger
    own = F.when(F.col("_r") < in_larger, F.floor(F.col("_r") / (least + 1))).otherwise(larger + F.floor((F.col("_r") - in_larger) / F.greatest(least, F.lit(1)))) + 1
    fold = ranked.withColumn("own", own).withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(k))))
    return fold.withColumn("role", F.when(F.col("own") == F.col("fold"), "val").otherwise("train")).drop("own", "_r", "_n")


def hold_out(items: DataFrame, n: int, id: str, *, seed: int = 9) -> DataFrame:
    """SPL4: n items in seeded order; fewer than n raise."""
    if items.limit(n).count() < n:
        raise ValueError(f"fewer than {n} items")
    return items.orderBy(drawn(seed, id), id).limit(n)


#: Levels at which space is quartered to find what is free, and draws in a level for each point that is missing.
FREE_LEVELS, DRAWS_PER_POINT = (3, 5, 7, 9), 4


def background_points(images: DataFrame, positives: DataFrame, n: int, margin: float, distance: float, *, attempts: int = 20, seed: int = 5, strict: bool = False) -> DataFrame:
    """NEG3: per image n seeded random points inside the margin that keep away from every positive; ``try`` numbers the draws.

    The first n free ones of ``n * attempts`` draws over the whole frame. Images
    that lack points after that go on in the squares of ever finer grids that no
    positive covers as a whole, as many draws a level as points are missing
    times DRAWS_PER_POINT: a draw takes a square, then a place in it, so points
    stay uniform over what is free. An image whose last squares are all covered,
    or nearly so, has fewer points (``n_free`` says how many); ``strict`` raises
    where that is so.
    """
    seen = positives.select("image", F.col("x").alias("r_x"), F.col("y").alias("r_y"))

    def free(tries: DataFrame) -> DataFrame:
        a = tries.select("image", "try", F.col("x").alias("l_x"), F.col("y").alias("l_y"))
        return tries.join(range_join(a, seen, distance, ["image"]).select("image", "try").distinct(), ["image", "try"], "left_anti")

    def first(found: DataFrame) -> DataFrame:
        w = Window.partitionBy("image")  # a bounded number of draws for each image
        return found.withColumn("_n", F.row_number().over(w.orderBy("try"))).withColumn("n_free", F.count("*").over(w)).where(F.col("_n") <= n).drop("_n")

    roomy = images.where((F.col("image_width") > 2 * margin) & (F.col("image_height") > 2 * margin))
    tries = roomy.withColumn("try", F.explode(F.sequence(F.lit(0), F.lit(n * attempts - 1))))
    at = lambda c, s: F.lit(margin) + drawn(seed + s, "image", "try") * (F.col(c) - 2 * margin)
    found = materialise(first(free(tries.withColumn("x", at("image_width", 0)).withColumn("y", at("image_height", 1)))), "background-points")
    start = n * attempts
    for level in FREE_LEVELS:
        got = found.groupBy("image").agg(F.count("*").alias("_got"))
        short = materialise(roomy.join(got, "image", "left").withColumn("_missing", n - F.coalesce("_got", F.lit(0))).where("_missing > 0"), "background-short")
        if short.isEmpty():
            break
        cells = 1 << level
        side = lambda c: (F.col(c) - 2 * margin) / cells
        grid = short.select("image", side("image_width").alias("_w"), side("image_height").alias("_h"), F.explode(F.sequence(F.lit(0), F.lit(cells * cells - 1))).alias("_cell"))
        grid = grid.withColumns({"_x": F.lit(margin) + F.floor(F.col("_cell") / cells) * F.col("_w"), "_y": F.lit(margin) + F.col("_cell") % cells * F.col("_h")})
        # a positive covers a square if its middle is so near that the corners are too near
        middles = grid.select("image", "_cell", (F.col("_x") + F.col("_w") / 2).alias("l_x"), (F.col("_y") + F.col("_h") / 2).alias("l_y"), (F.sqrt(F.col("_w") * F.col("_w") + F.col("_h") * F.col("_h")) / 2).alias("_half"))
        covered = range_join(middles, seen, distance, ["image"]).where(F.sqrt("d2") + F.col("_half") <= distance).select("image", "_cell").distinct()
        left = numbers_within(grid.join(covered, ["image", "_cell"], "left_anti"), ["image"], [F.col("_cell")], "_at", "_cells")
        size = left.groupBy("image").agg(F.first("_cells").alias("_cells"))
        more = short.join(size, "image").withColumn("try", F.explode(F.expr(f"sequence({start}, {start} + _missing * {DRAWS_PER_POINT} * {level * level} - 1)")))
        more = more.withColumn("_at", F.floor(drawn(seed + 2, "image", "try") * F.col("_cells"))).join(left.select("image", "_at", "_x", "_y", "_w", "_h"), ["image", "_at"])
        more = more.withColumn("x", F.col("_x") + drawn(seed, "image", "try") * F.col("_w")).withColumn("y", F.col("_y") + drawn(seed + 1, "image", "try") * F.col("_h"))
        more = free(more.select(*images.columns, "try", "x", "y"))
        found = materialise(first(found.drop("n_free").unionByName(more)), "background-points")
        start += n * DRAWS_PER_POINT * level * level
    if strict:
        full = found.groupBy("image").agg(F.count("*").alias("_got")).where(F.col("_got") >= n).count()
        if lacking := images.select("image").distinct().count() - full:
            raise ValueError(f"{lacking} images have fewer than {n} free points")
    return found


def add_background(background: DataFrame, share: float, valid: float, id: str, *, seed: int = 4) -> DataFrame:
    """NEG4: a share of the background images, each for train or valid, by hash."""
    u = drawn(seed, id)
    return background.where(u < share).withColumn("part", F.when(drawn(seed + 1, id) < valid, "valid").otherwise("train"))
