"""The sweep of AG1-AG3: in the order of points, the first unclaimed one claims all unclaimed points within a radius.

Its seeds are a greedy independent set. A point is a seed if no earlier point
within the radius is one, so long chains of points hang on each other; what
hangs together in space is decided together. Space is cut into blocks of as many
undecided points as a task takes, a task sweeps its block with a grid of cells
of which each holds one seed at most, and a point is left undecided only if it
hangs on one of a neighbouring block. Known seeds aren't sent along: a round's
seeds claim what they reach by a join, and only points that stay open are dealt
again. They become few and blocks wide, until one block holds all of them. No
pair of points is written.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from aerotally.operators.spatial import range_join
from aerotally.plans.storage import materialise

MOST_PER_BLOCK = 100_000
#: Sides of the smallest blocks in radii, and how many times they may be doubled, in steps of LEVEL_STEP.
LEAST_SIDE, LEVELS, LEVEL_STEP = 8, 40, 2
#: Undecided points of a cell that are looked at one by one; where a cell has more, a later point near it waits.
LOOKED_AT = 64


def sweep_block(order: np.ndarray, x: np.ndarray, y: np.ndarray, kind: np.ndarray, r: float) -> np.ndarray:
    """1 for seeds, 0 for claimed points and -1 for those that stay undecided.

    ``kind`` is 0 for the block's own points and 1 for undecided points around
    it, which decide nothing here.
    """
    side, r2 = r / 1.4143, r * r  # a little under r / sqrt 2, as quotients are rounded
    cx, cy = np.floor(x / side).astype(np.int64).tolist(), np.floor(y / side).astype(np.int64).tolist()
    state = np.full(len(x), -1)
    seeds: dict[tuple[int, int], list[tuple[float, float]]] = {}
    waiting: dict[tuple[int, int], list[tuple[float, float]]] = {}
    around = [(i, j) for i in range(-2, 3) for j in range(-2, 3)]
    xs, ys, kinds = x.tolist(), y.tolist(), kind.tolist()
    for i in np.argsort(order, kind="stable").tolist():
        px, py, a, b = xs[i], ys[i], cx[i], cy[i]
        claimed = held = False
        for u, v in around:
            cell = a + u, b + v
            for qx, qy in seeds.get(cell, ()):
                if (px - qx) * (px - qx) + (py - qy) * (py - qy) <= r2:
                    claimed = True
                    break
            if claimed:
                break
            if not held and (near := waiting.get(cell)):
                held = len(near) > LOOKED_AT or any((px - qx) * (px - qx) + (py - qy) * (py - qy) <= r2 for qx, qy in near)
        if claimed:
            state[i] = 0
        elif held or kinds[i] == 1:
            waiting.setdefault((a, b), []).append((px, py))
        else:
            state[i] = 1
            seeds.setdefault((a, b), []).append((px, py))
    return state


def _block_side(open_: DataFrame, r: float, most: int) -> float | None:
    """The widest blocks that hold at most ``most`` points each (or the least side); None if one block does."""
    n = open_.count()
    if n <= most:
        return None
    at = lambda c: F.floor(F.col(c) / F.lit(LEAST_SIDE * r)).cast("long")
    cells = open_.groupBy(at("x").alias("bx"), at("y").alias("by")).agg(F.count("*").alias("n"))
    levels = cells.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(LEVELS), F.lit(LEVEL_STEP))))
    full = levels.groupBy("k", F.expr("shiftright(bx, k)").alias("x"), F.expr("shiftright(by, k)").alias("y")).agg(F.sum("n").alias("n")).groupBy("k").agg(F.max("n").alias("n"))
    fit = [row.k for row in full.where(F.col("n") <= most).collect()]  # a row per level
    return LEAST_SIDE * r * 2.0 ** max(fit, default=0)


def _unclaimed(open_: DataFrame, seeds: DataFrame, r: float) -> DataFrame:
    """Rows of ``open_`` that none of the seeds claims; seeds are r apart, so a row meets a handful."""
    near = range_join(open_.select("a", F.col("x").alias("l_x"), F.col("y").alias("l_y")), seeds.select(F.col("x").alias("r_x"), F.col("y").alias("r_y")), r)
    return open_.join(near.select("a").distinct(), "a", "left_anti")


def sweep_seeds(points: DataFrame, r: float, order: str = "seq", most: int = MOST_PER_BLOCK) -> DataFrame:
    """``(cluster, x, y)``: the seeds of the sweep, by their place in the order."""
    known = points.select(F.col(order).cast("long").alias("a"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("abs(x) < double('infinity') and abs(y) < double('infinity')")
    # of equal points only the first can be a seed, and what claims it claims all
    open_ = materialise(known.groupBy("x", "y").agg(F.min("a").alias("a")), "sweep-open")
    out, schema = None, "a long, x double, y double, state int"

    def resolve(pdf: pd.DataFrame) -> pd.DataFrame:
        state = sweep_block(*(pdf[c].to_numpy() for c in ("a", "x", "y", "kind")), r)
        own = (pdf["kind"].to_numpy() == 0) & (state != 0)
        return pd.DataFrame({"a": pdf["a"][own], "x": pdf["x"][own], "y": pdf["y"][own], "state": state[own].astype("int32")})

    while True:
        side = _block_side(open_, r, most)
        own = open_.withColumn("kind", F.lit(0))
        if side is None:
            dealt = own.withColumns({"bx": F.lit(0).cast("long"), "by": F.lit(0).cast("long")})
        else:
            reach = r * (1 + 1e-6)
            at = lambda c: F.floor(c / F.lit(side)).cast("long")
            span = lambda c: F.explode(F.sequence(at(F.col(c) - reach), at(F.col(c) + reach)))
            dealt = own.withColumn("bx", span("x")).withColumn("by", span("y"))
            home = (F.col("bx") == at(F.col("x"))) & (F.col("by") == at(F.col("y")))
            dealt = dealt.withColumn("kind", F.when(home, 0).otherwise(1))
        found = materialise(dealt.groupBy("bx", "by").applyInPandas(resolve, schema), "sweep-round")
        latest = found.where("state = 1").select("a", "x", "y")
        out = latest if out is None else out.unionByName(latest)
        waiting = found.where("state = -1").select("a", "x", "y")
        if not waiting.isEmpty():
            waiting = materialise(_unclaimed(waiting, latest, r), "sweep-open")
        open_ = waiting
        if open_.isEmpty():
            return out.withColumnRenamed("a", "cluster")


def sweep_clusters(points: DataFrame, r: float, order: str = "seq", most: int = MOST_PER_BLOCK) -> DataFrame:
    """AG1: ``(order, cluster)``; a point belongs to the first seed within r, and a seed to itself.

    ``order`` is a long that tells points apart. Rows without a finite point are
    dropped. A point meets the seeds near it only, which are r apart at least.
    """
    seeds = sweep_seeds(points, r, order, most)
    left = points.select(F.col(order), F.col("x").cast("double").alias("l_x"), F.col("y").cast("double").alias("l_y")).where("abs(l_x) < double('infinity') and abs(l_y) < double('infinity')")
    right = seeds.select("cluster", F.col("x").alias("r_x"), F.col("y").alias("r_y"))
    return range_join(left, right, r).groupBy(order).agg(F.min("cluster").alias("cluster"))


def sweep_agreement(points: DataFrame, r: float, min_users: int, *, order: str = "seq", user: str = "user_name", first_only: bool = False) -> DataFrame:
    """AG1, and AG2 with ``first_only`` (a user's first point in a cluster stands for all of theirs): clusters with enough users and their mean point."""
    own = points.join(sweep_clusters(points, r, order), order)
    if first_only:
        own = own.groupBy("cluster", user).agg(F.min_by("x", order).alias("x"), F.min_by("y", order).alias("y"))
    found = own.groupBy("cluster").agg(F.countDistinct(user).alias("users"), F.count("*").alias("points"), F.avg("x").alias("x"), F.avg("y").alias("y"))
    return found.where(F.col("users") >= min_users)


def agreement_summary(points: DataFrame, r: float, min_users: int, *, order: str = "seq", user: str = "user_name") -> DataFrame:
    """AG3: one row on the clusters of AG1: points in and out of agreement, agreed locations, users per location, and the share of points in agreement (0 without points)."""
    found = sweep_agreement(points, r, 1, order=order, user=user)
    agreed = F.col("users") >= min_users
    n, all_ = F.coalesce(F.sum(F.when(agreed, F.col("points"))), F.lit(0)), F.coalesce(F.sum("points"), F.lit(0))
    over = lambda f: F.coalesce(f(F.when(agreed, F.col("users"))), F.lit(0))
    return found.agg(
        n.alias("agreement_points"), (all_ - n).alias("disagreement_points"), all_.alias("points"), F.count(F.when(agreed, 1)).alias("locations"),
        over(F.avg).cast("double").alias("avg_users"), over(F.max).alias("max_users"), over(F.min).alias("min_users"), F.when(all_ > 0, n / all_).otherwise(0.0).alias("agreement_rate"),
    )

