"""MT*, EV*: one-to-one point matching and what is measured on it."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from aerotally.operators.graph import connected_components
from aerotally.operators.spatial import range_join
from aerotally.plans.storage import materialise

#: Points of a component up to which its assignment uses a dense cost matrix.
DENSE_POINTS = 2000


def candidates(gt: DataFrame, pred: DataFrame, r: float, keys: Sequence[str] = ("image",), *, truncate: bool = False, width: float = 2.0, of_gt: Sequence[Column] = (), of_pred: Sequence[Column] = ()) -> DataFrame:
    """``(*keys, gt_id, pred_id, d2)`` of all pairs within r, and named columns of either side; ``truncate`` cuts coordinates to integers first."""
    cut = (lambda c: F.col(c).cast("long").cast("double")) if truncate else F.col
    a = gt.select(*keys, F.col("id").alias("gt_id"), cut("x").alias("l_x"), cut("y").alias("l_y"), *of_gt)
    b = pred.select(*keys, F.col("id").alias("pred_id"), cut("x").alias("r_x"), cut("y").alias("r_y"), *of_pred)
    return range_join(a, b, r, keys, width=width).drop("l_x", "l_y", "r_x", "r_y")


def greedy(pairs: DataFrame, keys: Sequence[str] = ("image",)) -> DataFrame:
    """MT1: a ground truth's only candidate is its nearest prediction; a prediction goes to its nearest claimant. Ties to smaller ids."""
    first = Window.partitionBy(*keys, "gt_id").orderBy("d2", "pred_id")
    second = Window.partitionBy(*keys, "pred_id").orderBy("d2", "gt_id")
    nearest = pairs.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return nearest.withColumn("_n", F.row_number().over(second)).where("_n = 1").drop("_n")


def match_greedy(gt: DataFrame, pred: DataFrame, r: float, keys: Sequence[str] = ("image",), *, truncate: bool = True, crowded: bool = False) -> DataFrame:
    """MT1 (truncating), MT2 (``truncate=False``) and MT3 (a constant key).

    Of the points at one place only that of the smallest id is ever matched; with
    ``crowded`` the others are left out before pairs are made.
    """
    if crowded:
        at = lambda c: (F.col(c).cast("long").cast("double") if truncate else F.col(c)).alias(c)
        gt, pred = (d.select(*keys, "id", at("x"), at("y")).groupBy(*keys, "x", "y").agg(F.min("id").alias("id")) for d in (gt, pred))
    return greedy(candidates(gt, pred, r, keys, truncate=truncate), keys)


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Least-cost assignment of every row to a column (rows <= columns) by shortest augmenting paths."""
    n, m = cost.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    row_of = np.zeros(m + 1, int)
    for i in range(1, n + 1):
        row_of[0], j0 = i, 0
        least, used, way = np.full(m + 1, np.inf), np.zeros(m + 1, bool), np.zeros(m + 1, int)
        while True:
            used[j0] = True
            i0 = row_of[j0]
            gap = cost[i0 - 1] - u[i0] - v[1:]
            better = ~used[1:] & (gap < least[1:])
            least[1:][better] = gap[better]
            way[1:][better] = j0
            j1 = int(np.argmin(np.where(used, np.inf, least)))
            step = least[j1]
            u[row_of[used]] += step
            v[used] -= step
            least[~used] -= step
            j0 = j1
            if row_of[j0] == 0:
                break
        while j0:
            row_of[j0] = row_of[way[j0]]
            j0 = way[j0]
    return [(row_of[j] - 1, j - 1) for j in range(1, m + 1) if row_of[j]]


def assign_sparse(rows: np.ndarray, columns: np.ndarray, cost: np.ndarray, far: float) -> list[int]:
    """Positions of the pairs of a least-cost assignment, where a row left out costs ``far``; memory follows the pairs.

    Shortest augmenting paths with potentials, from one row after another; a
    path ends at a free column or at a row that is then left out.
    """
    n, m = int(rows.max()) + 1, int(columns.max()) + 1
    near: list[list[tuple[int, float, int]]] = [[] for _ in range(n)]
    for at, (i, j, c) in enumerate(zip(rows.tolist(), columns.tolist(), cost.tolist())):
        near[i].append((j, c, at))
    u, v = [0.0] * n, [0.0] * m
    row_of, pair_of = [-1] * m, [-1] * n
    for start in range(n):
        reach, before = {}, {}  # of columns: distance, and (row, pair) that it is reached from
        seen: dict[int, float] = {}  # settled columns
        heap: list[tuple[float, int]] = []
        row_at = {start: 0.0}
        end, best = None, far - u[start]  # leaving the start row out
        out_row = start
        i, base = start, 0.0
        while True:
            for j, c, at in near[i]:
                d = base + c - u[i] - v[j]
                if j not in seen and d < reach.get(j, math.inf):
                    reach[j], before[j] = d, (i, at)
                    heapq.heappush(heap, (d, j))
            while heap and (heap[0][1] in seen or heap[0][0] > reach[heap[0][1]]):
                heapq.heappop(heap)
            if not heap or heap[0][0] >= best:
                break  # the cheapest is to leave out_row out
            d, j = heapq.heappop(heap)
            seen[j] = d
            if row_of[j] < 0:
                end, best = j, d
                break
            i, base = row_of[j], d
            row_at[i] = d
            if d + far - u[i] < best:
                best, out_row = d + far - u[i], i
        for r, d in row_at.items():
            u[r] += best - d if d < best else 0.0
        for j, d in seen.items():
            if d < best:
                v[j] -= best - d
        j = end
        if j is None:  # out_row gives its column up
            if out_row == start:
                continue
            j = next(c for c in seen if row_of[c] == out_row)
            pair_of[out_row] = -1
        while True:
            i, at = before[j]
            row_of[j] = i
            last = pair_of[i]
            pair_of[i] = at
            if i == start:
                break
            j = int(columns[last])
    return [at for at in pair_of if at >= 0]


def match_optimal(gt: DataFrame, pred: DataFrame, r: float, keys: Sequence[str] = ("image",), *, dense_points: int = DENSE_POINTS) -> DataFrame:
    """MT4, MT5: most pairs within r, then the least total distance.

    Pairs whose two points have no other candidate are done. For the rest the
    optimum falls apart into the connected components of the pair graph, which
    are assigned one by one, many of them to a batch that Python gets, with a
    dense cost matrix up to ``dense_points`` points and on lists of pairs beyond.
    """
    pairs = materialise(candidates(gt, pred, r, keys), "match-pairs")
    columns = pairs.columns
    degree = lambda c, name: pairs.groupBy(*keys, c).agg(F.count("*").alias(name))
    known = pairs.join(degree("gt_id", "_of_gt"), [*keys, "gt_id"]).join(degree("pred_id", "_of_pred"), [*keys, "pred_id"])
    known = materialise(known, "match-degrees")
    single = known.where("_of_gt = 1 and _of_pred = 1").select(columns)
    rest = known.where("_of_gt > 1 or _of_pred > 1").select(columns)
    gid, pid = F.xxhash64(F.lit("g"), *keys, "gt_id"), F.xxhash64(F.lit("p"), *keys, "pred_id")
    comps = connected_components(rest.select(gid.alias("src"), pid.alias("dst")))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in single.schema)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        a, ai = np.unique(pdf["gt_id"], return_inverse=True)
        b, bi = np.unique(pdf["pred_id"], return_inverse=True)
        distance = np.sqrt(pdf["d2"].to_numpy(float))
        far = 1.0 + 2 * distance.sum()  # one pair more is always better
        if len(a) + len(b) > dense_points:
            return pdf.iloc[assign_sparse(ai, bi, distance, far)][columns]
        cost = np.full((len(a), max(len(a), len(b))), far)
        cost[ai, bi] = distance
        chosen = {(i, j) for i, j in assign(cost) if cost[i, j] < far}
        return pdf[[(i, j) in chosen for i, j in zip(ai, bi)]][columns]

    def solve_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Components come one after another, several to a batch; the last of a batch may go on in the next."""
        held: list[pd.DataFrame] = []
        for pdf in batches:
            component = pdf["component"].to_numpy()
            starts = np.flatnonzero(component[1:] != component[:-1]) + 1
            if held and len(component) and held[-1]["component"].iloc[-1] != component[0]:
                yield solve(pd.concat(held))
                held = []
            ends = [0, *starts.tolist(), len(pdf)]
            parts = [pdf.iloc[i:j] for i, j in zip(ends, ends[1:]) if i < j]
            if held and len(parts) > 1:
                yield solve(pd.concat([*held, parts.pop(0)]))
                held = []
            if len(parts) > 1:
                yield pd.concat([solve(part) for part in parts[:-1]])
            held += parts[-1:]
        if held:
            yield solve(pd.concat(held))

    dealt = rest.withColumn("node", gid).join(comps, "node").select(*columns, "component").repartition("component").sortWithinPartitions("component")
    return single.unionByName(dealt.mapInPandas(solve_all, schema))


def match_edges(gt: DataFrame, pred: DataFrame, r: float, keys: Sequence[str] = ("image",)) -> DataFrame:
    """MT7: ``(*keys, gt_id, pred_id, distance)`` of the matches of MT4, and a row with nulls for every point that has none."""
    m = match_optimal(gt, pred, r, keys).withColumn("distance", F.sqrt("d2")).drop("d2")
    free_g = gt.select(*keys, F.col("id").alias("gt_id")).join(m, [*keys, "gt_id"], "left_anti")
    free_p = pred.select(*keys, F.col("id").alias("pred_id")).join(m, [*keys, "pred_id"], "left_anti")
    return m.unionByName(free_g, allowMissingColumns=True).unionByName(free_p, allowMissingColumns=True)


def labelled(gt: DataFrame, pred: DataFrame, matches: DataFrame, keys: Sequence[str] = ("image",)) -> DataFrame:
    """MT6: every point as ``tp``, ``fp`` or ``fn``; a missed ground truth has score 0."""
    hit_p = matches.select(*keys, F.col("pred_id").alias("id"), F.lit(True).alias("_hit"))
    hit_g = matches.select(*keys, F.col("gt_id").alias("id"))
    of_pred = pred.join(hit_p, [*keys, "id"], "left").withColumn("kind", F.when(F.col("_hit"), "tp").otherwise("fp")).drop("_hit")
    of_gt = gt.join(hit_g, [*keys, "id"], "left_anti").withColumn("kind", F.lit("fn"))
    if "score" in pred.columns:
        of_gt = of_gt.withColumn("score", F.lit(0.0))
    return of_pred.unionByName(of_gt, allowMissingColumns=True)


def image_errors(gt: DataFrame, pred: DataFrame, matches: DataFrame, keys: Sequence[str] = ("image",)) -> DataFrame:
    """MT6: ``num_gt, num_pred, tp, fp, fn, err`` per image over the union of images; err = fp - fn."""
    n = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    out = n(gt, "num_gt").join(n(pred, "num_pred"), list(keys), "full_outer").join(n(matches, "tp"), list(keys), "left").fillna(0, ["num_gt", "num_pred", "tp"])
    return out.withColumn("fp", F.col("num_pred") - F.col("tp")).withColumn("fn", F.col("num_gt") - F.col("tp")).withColumn("err", F.col("fp") - F.col("fn"))


def rates(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """FN29: precision, recall and F1; 0 where a denominator is 0."""
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, q = share(tp, tp + fp), share(tp, tp + fn)
    return p, q, F.when(p + q > 0, 2 * p * q / (p + q)).otherwise(0.0)


def evaluation(gt: DataFrame, pred: DataFrame, matches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """EV1: tp, fp, fn, precision, recall and F1, over all rows or ``by`` columns that all three frames have."""
    n = lambda df, g, p, m: df.select(*by, F.lit(g).alias("g"), F.lit(p).alias("p"), F.lit(m).alias("m"))
    total = n(gt, 1, 0, 0).unionByName(n(pred, 0, 1, 0)).unionByName(n(matches, 0, 0, 1)).groupBy(*by).agg(F.sum("g").alias("num_gt"), F.sum("p").alias("num_pred"), F.sum("m").alias("tp"))
    return scored(total, by)


def scored(total: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The columns of :func:`evaluation` from the counts ``num_gt``, ``num_pred`` and ``tp``."""
    out = total.select(*by, "tp", (F.col("num_pred") - F.col("tp")).alias("fp"), (F.col("num_gt") - F.col("tp")).alias("fn"))
    p, q, f1 = rates(F.col("tp"), F.col("fp"), F.col("fn"))
    return out.withColumn("precision", F.round(p, 6)).withColumn("recall", F.round(q, 6)).withColumn("f1", F.round(f1, 6))


def pr_curve(gt: DataFrame, pred: DataFrame, r: float, thresholds: Sequence[float], keys: Sequence[str] = ("image",), by: Sequence[str] = ()) -> DataFrame:
    """EV2 (EV4 with ``by``): matching again at every threshold, in one job.

    Candidate pairs are made once, with all that is needed of their points, in
    wide cells, so that fewer copies of a prediction are shuffled. A ground truth's nearest prediction at a
    threshold is the first of its pairs, by distance, whose score reaches it: so
    a pair counts for thresholds above the best score of the nearer ones up to
    its own. A prediction is a true positive at the thresholds of any of its
    pairs, which all end at its score. Recall 0 gives precision 1 and F1 0.
    Images are those of the ground truth.
    """
    levels = F.array(*[F.lit(float(t)) for t in thresholds])
    known = pred.join(gt.select(*keys).distinct(), list(keys), "left_semi")
    of_gt = [F.col(c).alias(f"_gt_{c}") for c in by]
    scored = candidates(gt, pred, r, keys, truncate=True, width=4.0, of_gt=of_gt, of_pred=[F.col(c) for c in ("score", *by)])
    passing = F.explode(F.filter(levels, lambda t: t <= F.col("score")))
    if by:
        scored = scored.where(" and ".join(f"{c} <=> _gt_{c}" for c in by)).drop(*[f"_gt_{c}" for c in by])
    nearer = Window.partitionBy(*keys, "gt_id").orderBy("d2", "pred_id").rowsBetween(Window.unboundedPreceding, -1)
    claims = scored.where("score is not null").withColumn("_above", F.coalesce(F.max("score").over(nearer), F.lit(float("-inf")))).where("score > _above")
    won = claims.groupBy(*keys, "pred_id", *by).agg(F.first("score").alias("score"), F.min("_above").alias("_above"))
    reached = F.explode(F.filter(levels, lambda t: (t <= F.col("score")) & (t > F.col("_above"))))
    hits = won.withColumn("threshold", reached).groupBy("threshold", *by).agg(F.count("*").alias("tp"))
    found = known.withColumn("threshold", passing).groupBy("threshold", *by).agg(F.count("*").alias("num_pred"))
    wanted = gt.groupBy(*by).agg(F.count("*").alias("num_gt")).withColumn("threshold", F.explode(levels))
    out = wanted.join(hits, ["threshold", *by], "left").join(found, ["threshold", *by], "left").fillna(0, ["tp", "num_pred"])
    tp, fp, fn = F.col("tp"), F.col("num_pred") - F.col("tp"), F.col("num_gt") - F.col("tp")
    p, q, f1 = rates(tp, fp, fn)
    none = tp == 0
    return out.select("threshold", *by, "tp", fp.alias("fp"), fn.alias("fn"), F.round(F.when(none, 1.0).otherwise(p), 6).alias("precision"), F.round(q, 6).alias("recall"), F.round(F.when(none, 0.0).otherwise(f1), 6).alias("f1"))


def average_precision(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """EV4: area under precision over recall (trapezoids by ascending recall, ties by threshold) and the first best F1."""
    order = Window.partitionBy(*by).orderBy("recall", F.desc("threshold"))
    area = (F.col("recall") - F.lag("recall").over(order)) * (F.col("precision") + F.lag("precision").over(order)) / 2
    best = F.max_by("threshold", F.struct("f1", -F.col("threshold")))
    return curve.withColumn("_area", area).groupBy(*by).agg(F.round(F.coalesce(F.sum("_area"), F.lit(0.0)), 6).alias("ap"), F.max("f1").alias("best_f1"), best.alias("best_threshold"))


def counting_errors(errors: DataFrame) -> DataFrame:
    """EV3: ME, MAE, MSE and RMSE of ``err`` over the images with ground truth."""
    e = F.col("err").cast("double")
    return errors.where("num_gt > 0").agg(F.count("*").alias("images"), F.round(F.avg(e), 6).alias("me"), F.round(F.avg(F.abs(e)), 6).alias("mae"), F.round(F.avg(e * e), 6).alias("mse"), F.round(F.sqrt(F.avg(e * e)), 6).alias("rmse"))


def confidence_histogram(points: DataFrame, bins: int = 20) -> DataFrame:
    """EV5: counts of tp and fp by score bin."""
    b = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("long")
    return points.where("kind in ('tp', 'fp')").groupBy(b.alias("bin"), "kind").agg(F.count("*").alias("n"))


def hard_negatives(points: DataFrame, min_score: float, name: str = "hard_negative") -> DataFrame:
    """NEG1: false positives above a score, as rows of a class of their own."""
    return points.where((F.col("kind") == "fp") & (F.col("score") > min_score)).withColumn("species", F.lit(name))
