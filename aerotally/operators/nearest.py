"""SP6: exact k nearest neighbours by descent of a quadtree, for all rows at once.

The right side's cells are counted level by level, sixteen to a cell, as long as
they hold more than LEAF points. All left rows go down together: a level's cells
are replaced by their children, and what can't hold one of a row's k nearest is
dropped, by the distances to the children's bounding boxes and the counts in
them. So each row finds its own radius, an outlier on either side costs what any
row costs, and no task compares more than a leaf.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from aerotally.operators.spatial import d2
from aerotally.plans.storage import materialise

#: Points of a cell that isn't split; a cell is split so often at most, in SPLIT x SPLIT.
LEAF, LEVELS, SPLIT = 32, 13, 4


def _finite(x: str, y: str) -> Column:
    return F.expr(f"abs({x}) < double('infinity') and abs({y}) < double('infinity')")


def k_nearest(left: DataFrame, right: DataFrame, k: int, left_id: str, right_id: str, *, keys: Sequence[str] = (), crowded: bool = False) -> DataFrame:
    """k nearest right rows (r_x, r_y) of each left row (l_x, l_y), of equal ``keys`` if there are any, with ``d2`` and ``rank``.

    Ties go to the smaller ``right_id``; fewer than k rows if there are fewer.
    Ids are unique within the keys, all other columns have different names on
    both sides. Rows without a finite point take no part. With ``crowded`` the
    left rows of one place are searched for once.
    """
    keys = list(keys)
    if crowded:
        here = left.where(_finite("l_x", "l_y"))
        spots = here.groupBy(*keys, "l_x", "l_y").agg(F.min(left_id).alias(left_id))
        found = k_nearest(spots, right, k, left_id, right_id, keys=keys).drop(left_id)
        return here.join(found, [*keys, "l_x", "l_y"])
    at_spot = Window.partitionBy(*keys, "r_x", "r_y").orderBy(right_id)
    points = right.where(_finite("r_x", "r_y")).withColumn("_nth", F.row_number().over(at_spot)).where(F.col("_nth") <= k).drop("_nth")
    points = materialise(points, "nearest-points")  # of equal points the first k are enough
    rows = materialise(left.where(_finite("l_x", "l_y")), "nearest-rows")
    box = points.agg(F.min("r_x").alias("x"), F.min("r_y").alias("y"), F.max("r_x").alias("x2"), F.max("r_y").alias("y2")).first()
    if box.x is None or not k:
        return rows.limit(0).join(points.limit(0), keys or F.lit(True)).withColumn("d2", F.lit(0.0)).withColumn("rank", F.lit(0))
    side = max(box.x2 - box.x, box.y2 - box.y) or 1.0

    def cell(level: int, c: str, start: float) -> Column:
        n = SPLIT**level
        return F.least(F.floor((F.col(c) - start) / (side / n)).cast("long"), F.lit(n - 1)).alias({"r_x": "cx", "r_y": "cy"}[c])

    def dealt(some: DataFrame, level: int) -> DataFrame:
        return some.select("*", cell(level, "r_x", box.x), cell(level, "r_y", box.y))

    tree, open_ = [], points.select(*keys, "r_x", "r_y")
    while True:
        level = len(tree)
        cells = dealt(open_, level).groupBy(*keys, "cx", "cy").agg(F.count("*").alias("n"), F.min("r_x").alias("x1"), F.max("r_x").alias("x2"), F.min("r_y").alias("y1"), F.max("r_y").alias("y2"))
        leaf = (F.col("n") <= LEAF) | ((F.col("x1") == F.col("x2")) & (F.col("y1") == F.col("y2"))) | F.lit(level == LEVELS)
        tree.append(materialise(cells.withColumn("leaf", leaf), "nearest-cells"))
        inner = tree[-1].where("not leaf").select(*keys, "cx", "cy")
        if inner.isEmpty():
            break
        open_ = dealt(open_, level).join(inner, [*keys, "cx", "cy"], "left_semi").select(*keys, "r_x", "r_y")

    me = [*keys, left_id]
    by_far = Window.partitionBy(*me).orderBy("most2", "level", "cx", "cy").rowsBetween(Window.unboundedPreceding, 0)
    all_mine = Window.partitionBy(*me)

    def looked(found: DataFrame, level: int) -> DataFrame:
        """Rows with a cell each, and the least and most that a point of the cell can be away."""
        gap = lambda c, lo, hi: F.greatest(F.col(lo) - F.col(c), F.col(c) - F.col(hi), F.lit(0.0))
        far = lambda c, lo, hi: F.greatest(F.abs(F.col(c) - F.col(lo)), F.abs(F.col(c) - F.col(hi)))
        gx, gy, fx, fy = gap("l_x", "x1", "x2"), gap("l_y", "y1", "y2"), far("l_x", "x1", "x2"), far("l_y", "y1", "y2")
        return found.select(*me, "l_x", "l_y", F.lit(level).alias("level"), "cx", "cy", "n", "leaf", (gx * gx + gy * gy).alias("least2"), (fx * fx + fy * fy).alias("most2"))

    def pruned(found: DataFrame) -> DataFrame:
        """Without cells that lie beyond k points for sure."""
        summed = found.withColumn("_sum", F.sum("n").over(by_far))
        bound = F.min(F.when(F.col("_sum") >= k, F.col("most2"))).over(all_mine)
        return summed.withColumn("_bound", bound).where(F.col("_bound").isNull() | (F.col("least2") <= F.col("_bound"))).drop("_sum", "_bound")

    ends = rows.select(*me, "l_x", "l_y")
    now = looked(ends.join(tree[0], keys) if keys else ends.crossJoin(F.broadcast(tree[0])), 0)  # the root is one row
    for level in range(1, len(tree)):
        now = materialise(now, "nearest-state")
        children = tree[level].withColumns({"up_x": F.floor(F.col("cx") / SPLIT), "up_y": F.floor(F.col("cy") / SPLIT)})
        down = now.where("not leaf").select(*me, "l_x", "l_y", F.col("cx").alias("up_x"), F.col("cy").alias("up_y")).join(children, [*keys, "up_x", "up_y"])
        now = pruned(now.where("leaf").unionByName(looked(down, level)))
    now = materialise(now, "nearest-state")
    away = lambda p: (F.col("l_x") - p["r_x"]) * (F.col("l_x") - p["r_x"]) + (F.col("l_y") - p["r_y"]) * (F.col("l_y") - p["r_y"])
    seen = F.transform("_points", lambda p, i: F.struct(away(p).alias("d2"), p[right_id].alias("id"), i.alias("at")))
    best = F.array(F.array_min(seen)) if k == 1 else F.slice(F.sort_array(seen), 1, k)
    nearest = F.transform(best, lambda b: F.col("_points")[b["at"]])  # k of a list, so that no pair beyond them is sorted or shuffled
    out = None
    for level, cells in enumerate(tree):
        own = now.where((F.col("level") == level) & F.col("leaf")).select(*me, "l_x", "l_y", "cx", "cy")
        # only points of leaves, in lists of about LEAF; those of split cells are met further down
        leaves = cells.where("leaf").select(*keys, "cx", "cy", F.ceil(F.col("n") / LEAF).alias("_lists"))
        here = dealt(points, level).join(leaves, [*keys, "cx", "cy"])
        point = F.struct(*[c for c in points.columns if c not in keys])
        lists = here.groupBy(*keys, "cx", "cy", F.pmod(F.xxhash64(right_id), "_lists").alias("_list")).agg(F.collect_list(point).alias("_points"))
        some = own.join(lists, [*keys, "cx", "cy"]).select(*me, "l_x", "l_y", F.explode(nearest).alias("_point")).select(*me, "l_x", "l_y", "_point.*")
        out = some if out is None else out.unionByName(some)
    ranked = out.withColumn("d2", d2("l_x", "l_y", "r_x", "r_y")).withColumn("rank", F.row_number().over(Window.partitionBy(*me).orderBy("d2", right_id))).where(F.col("rank") <= k)
    more = [c for c in left.columns if c not in (*me, "l_x", "l_y")]
    return ranked.join(rows.select(*me, *more), me) if more else ranked
