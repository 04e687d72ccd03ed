"""Bindings of spatial joins, matching and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerotally.operators import matching as M, spatial as S
from aerotally.operators.nearest import k_nearest
from aerotally.plans.views import Views, binding

R = 25.0
THRESHOLDS = [round(0.5 + 0.025 * i, 3) for i in range(21)]
_ROLES = "gt AS (SELECT * FROM marks WHERE role = 'gt'), pred AS (SELECT * FROM marks WHERE role = 'pred')"


def sides(v: Views):
    """Ground truth and predictions; the view numbers its rows, so it is written once for both."""
    m = v.once("marks")
    return m.where("role = 'gt'").drop("role"), m.where("role = 'pred'").drop("role")


def _greedy(gt: str, pred: str, where: str = "TRUE", r: float = R) -> str:
    """MT1 in SQL over two relations (image, id, x, y)."""
    return f"""c AS (SELECT g.image, g.id AS gt_id, p.id AS pred_id, (g.x-p.x)*(g.x-p.x)+(g.y-p.y)*(g.y-p.y) AS d2
      FROM {gt} g JOIN {pred} p ON g.image = p.image AND {where} AND abs(g.x-p.x) <= {r} AND abs(g.y-p.y) <= {r}),
    n1 AS (SELECT *, row_number() OVER (PARTITION BY image, gt_id ORDER BY d2, pred_id) AS k FROM c WHERE d2 <= {r * r}),
    n2 AS (SELECT image, gt_id, pred_id, d2, row_number() OVER (PARTITION BY image, pred_id ORDER BY d2, gt_id) AS k2 FROM n1 WHERE k = 1),
    m AS (SELECT image, gt_id, pred_id, d2 FROM n2 WHERE k2 = 1)"""


_M = f"WITH {_ROLES}, {_greedy('gt', 'pred')}"
_RATES = """tp, fp, fn, round(CASE WHEN tp+fp > 0 THEN tp/CAST(tp+fp AS DOUBLE) ELSE 0 END, 6) AS "precision",
  round(CASE WHEN tp+fn > 0 THEN tp/CAST(tp+fn AS DOUBLE) ELSE 0 END, 6) AS recall,
  round(CASE WHEN tp > 0 THEN 2*(tp/CAST(tp+fp AS DOUBLE))*(tp/CAST(tp+fn AS DOUBLE))/((tp/CAST(tp+fp AS DOUBLE))+(tp/CAST(tp+fn AS DOUBLE))) ELSE 0 END, 6) AS f1"""


def matches(v: Views, truncate: bool = True):
    gt, pred = sides(v)
    return gt, pred, M.match_greedy(gt, pred, R, truncate=truncate)


def mt1(v):
    return matches(v)[2]


def mt2(v):
    gt, pred = sides(v)
    pred = pred.join(gt.select("image").distinct(), "image", "left_semi")
    return M.match_greedy(gt, pred, R, truncate=False)


def mt3(v):
    """The whole table as one image: ids are made unique first."""
    def one(df):
        return df.withColumn("image", F.lit(1)).withColumn("id", F.col("image0") * 100000 + F.col("id"))
    gt, pred = (one(d.withColumnRenamed("image", "image0")) for d in sides(v))
    return M.match_greedy(gt.withColumn("x", F.col("x") + 0.0), pred, 5.0, crowded=True)


def mt4(v):
    gt, pred = sides(v)
    return M.match_optimal(gt, pred, 10.0).groupBy("image").agg(F.count("*").alias("pairs"), F.round(F.sum(F.sqrt("d2")), 6).alias("distance"))


def mt5(v):
    gt, pred = (d.withColumn("x", F.col("x") + 10000 * F.col("image")).withColumn("id", F.col("image") * 100000 + F.col("id")).withColumn("image", F.lit(1)) for d in sides(v))
    return M.match_optimal(gt, pred, 5.0)


def mt6(v):
    gt, pred, m = matches(v)
    return M.labelled(gt, pred, m).select("image", "id", "kind", F.round("score", 6).alias("score"))


def mt6_errors(v):
    gt, pred, m = matches(v)
    return M.image_errors(gt, pred, m)


def mt7(v):
    return M.match_edges(*sides(v), 10.0)


def ev1(v):
    return M.evaluation(*matches(v))


def ev2(v):
    return M.pr_curve(*sides(v), R, THRESHOLDS)


def ev3(v):
    return M.counting_errors(M.image_errors(*matches(v)))


def ev4(v):
    curve = M.pr_curve(*sides(v), R, THRESHOLDS[::4], by=["species"])
    return M.average_precision(curve, ["species"])


def ev5(v):
    return M.confidence_histogram(M.labelled(*matches(v)))


def ev6(v):
    gt, pred = sides(v)
    m = M.match_greedy(gt, pred, R, ["image", "species"])
    return M.evaluation(gt, pred, m, ["species"])


def neg1(v):
    return M.hard_negatives(M.labelled(*matches(v)), 0.93).select("image", "id", "species", F.round("score", 6).alias("score"))


def sp5(v):
    gt, pred = sides(v)
    a = gt.select("image", F.col("id").alias("gt_id"), F.col("x").alias("l_x"), F.col("y").alias("l_y"))
    b = pred.select("image", F.col("id").alias("pred_id"), F.col("x").alias("r_x"), F.col("y").alias("r_y"))
    return S.nearest_within(a, b, R, ["image"], "gt_id", "pred_id").select("image", "gt_id", "pred_id", "d2")


def sp6(v):
    shots = v.shots.select(F.col("shot"), F.col("x").alias("r_x"), F.col("y").alias("r_y"))
    boxes = v.boxes.select(F.col("id").alias("box"), (F.col("x1") / 10).alias("l_x"), F.col("y1").alias("l_y"))
    return k_nearest(boxes, shots, 3, "box", "shot", crowded=True).select("box", "shot", F.round("d2", 6).alias("d2"), F.col("rank").cast("long").alias("rank"))


def sp9(v):
    points = v.marks.where("role = 'gt'")
    return S.close_pairs(points, 4.0, keys=["image"])


def sp10(v):
    gt, pred = sides(v)
    return S.without_near(pred, gt, R, "id", ["image"]).select("image", "id", "species")


def sp1(v):
    return S.tile_of(v.marks, 256).select("image", "id", "tile_x", "tile_y", "local_x", "local_y")


def sp1_overlap(v):
    return S.covering_tiles(v.marks.where("role = 'gt'"), 300.0, 200.0).select("image", "id", "tile_x", "tile_y")


def sp2(v):
    return v.marks.select("image", "id", (F.col("x") - 128).alias("x1"), (F.col("y") - 128).alias("y1"), (F.col("x") + 128).alias("x2"), (F.col("y") + 128).alias("y2"), F.lit(128.0).alias("local_x"), F.lit(128.0).alias("local_y"))


def sp3(v):
    """Occupied and empty tiles of every image's 4 x 4 grid."""
    tiles = v.marks.select("image").distinct().withColumn("tile_x", F.explode(F.expr("sequence(0L, 3L)"))).withColumn("tile_y", F.explode(F.expr("sequence(0L, 3L)")))
    used = S.tile_of(v.marks.where("species = 'A' and score > 0.95"), 256).select("image", "tile_x", "tile_y").distinct().withColumn("occupied", F.lit(True))
    return tiles.join(used, ["image", "tile_x", "tile_y"], "left").fillna(False, ["occupied"])


def sp4(v):
    return S.points_in_polygon(v.shots, [(10, 10), (120, 40), (90, 700), (20, 500)]).select("shot", "flight")


_RING = [(10, 10), (120, 40), (90, 700), (20, 500)]
_CROSS = " + ".join(
    f"CASE WHEN ({y2} > y) <> ({y1} > y) AND x < CAST({x2 - x1} AS DOUBLE) * (y - {y1}) / ({y2 - y1}) + {x1} THEN 1 ELSE 0 END"
    for (x1, y1), (x2, y2) in zip(_RING, _RING[1:] + _RING[:1])
)


def sp7(v):
    """Nearest site centre (from the customers' nations) of each supplier: a small side in a broadcast nested loop."""
    sites = v.nation.select(F.col("n_nationkey").alias("site"), (F.col("n_nationkey") * 40).cast("double").alias("sx"), ((F.col("n_nationkey") * 173) % 1000).cast("double").alias("sy"))
    points = v.supplier.select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") * 7 % 1000).cast("double").alias("x"), (F.col("s_suppkey") * 31 % 1000).cast("double").alias("y"))
    d = S.d2("x", "y", "sx", "sy")
    near = F.min_by(F.struct("site", d.alias("d2")), F.struct(d, "site"))
    return points.crossJoin(F.broadcast(sites)).groupBy("id").agg(near.alias("n")).select("id", F.col("n.site").alias("site"), F.col("n.d2").alias("d2"))  # 25 nations


def sp8(v):
    return S.height_contrast(v.shots, 15.0)


def sp11(v):
    split = v.boxes.withColumn("part", F.expr("case id % 3 when 0 then 'train' when 1 then 'val' else 'test' end"))
    return S.overlaps_between(split, "part", 128.0, keys=["image"]).withColumn("area", F.round("area", 3))


def sp12(v):
    """Per tile, how far its ground truth is from the nearest prediction in it."""
    gt, pred = sides(v)
    tile = ["image", "tile_x", "tile_y"]
    left = S.tile_of(gt, 250).select(*tile, F.col("id").alias("gt_id"), F.col("x").alias("l_x"), F.col("y").alias("l_y"))
    right = S.tile_of(pred, 250).select(*tile, F.col("id").alias("pred_id"), F.col("x").alias("r_x"), F.col("y").alias("r_y"))
    near = k_nearest(left, right, 1, "gt_id", "pred_id", keys=tile)
    d = F.sqrt("d2")
    return near.groupBy(*tile).agg(F.round(F.avg(d), 6).alias("mean_distance"), F.round(F.max(d), 6).alias("max_distance"), F.round(F.min(d), 6).alias("min_distance"))


def sp13(v):
    found = S.rectangle_groups(v.boxes.withColumn("x1", F.col("x1") + 2000 * F.col("image")).withColumn("x2", F.col("x2") + 2000 * F.col("image")), 128.0, 5.0)
    return found


def sp14(v):
    """Boxes against a 256-pixel grid: overlap share, full or partial."""
    at = lambda c: F.floor(F.col(c) / 256).cast("long")
    laid = v.boxes.withColumn("tx", F.explode(F.sequence(at("x1"), at("x2")))).withColumn("ty", F.explode(F.sequence(at("y1"), at("y2"))))
    w = F.least(F.col("x2"), F.col("tx") * 256 + 256) - F.greatest(F.col("x1"), F.col("tx") * 256)
    h = F.least(F.col("y2"), F.col("ty") * 256 + 256) - F.greatest(F.col("y1"), F.col("ty") * 256)
    share = w * h / ((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")))
    return laid.where((w > 0) & (h > 0)).select("id", "tx", "ty", F.round(share, 6).alias("share"), F.when(share >= 1, "full").otherwise("partial").alias("kind"))


_PAIR = "(a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)"


def _cells(table: str, r: float) -> str:
    """``home``: rows of a table with their cell of side r, and ``around``: the same in the nine cells about theirs."""
    nine = "(SELECT unnest([-1, 0, 1]) AS i) di, (SELECT unnest([-1, 0, 1]) AS j) dj"
    return f"home AS (SELECT *, floor(x/{r}) AS cx, floor(y/{r}) AS cy FROM {table}), around AS (SELECT h.* REPLACE (cx+i AS cx, cy+j AS cy) FROM home h, {nine})"


_BOX_PAIRS = """p AS (SELECT a.image, a.id AS a, b.id AS b, (least(a.x2,b.x2)-greatest(a.x1,b.x1))*(least(a.y2,b.y2)-greatest(a.y1,b.y1)) AS area
  FROM boxes a JOIN boxes b ON a.image = b.image AND a.id < b.id AND a.x1 < b.x2 AND b.x1 < a.x2 AND a.y1 < b.y2 AND b.y1 < a.y2)"""



def _image_cells(table: str, r: float) -> str:
    """As :func:`_cells`, within images and with one number ``k`` for image and cell, so that there is one way to join."""
    k = "(CAST(image AS BIGINT)*100000+CAST(floor(x/{r}) AS BIGINT){i})*100000+CAST(floor(y/{r}) AS BIGINT){j}"
    return f"""home AS MATERIALIZED (SELECT image, id, x, y, {k.format(r=r, i='', j='')} AS k FROM {table}),
      around AS MATERIALIZED (SELECT image, id, x, y, {k.format(r=r, i='+i', j='+j')} AS k FROM {table}, (SELECT unnest([-1, 0, 1]) AS i) di, (SELECT unnest([-1, 0, 1]) AS j) dj)"""


BINDINGS = {
    "MT1": binding(mt1, f"{_M} SELECT * FROM m"),
    "MT2": binding(mt2, f"{_M} SELECT * FROM m"),
    "MT3": binding(mt3, f"""WITH gt AS (SELECT 1 AS image, image*100000+id AS id, x, y FROM marks WHERE role='gt'), pred AS (SELECT 1 AS image, image*100000+id AS id, x, y FROM marks WHERE role='pred'),
      {_greedy('gt', 'pred', r=5.0)} SELECT * FROM m"""),
    "MT4": binding(mt4),
    "MT5": binding(mt5),
    "MT6": binding(mt6, f"{_M} SELECT p.image, p.id, CASE WHEN m.gt_id IS NULL THEN 'fp' ELSE 'tp' END AS kind, round(score, 6) AS score FROM pred p LEFT JOIN m ON p.image = m.image AND p.id = m.pred_id UNION ALL SELECT g.image, g.id, 'fn', 0.0 FROM gt g LEFT JOIN m ON g.image = m.image AND g.id = m.gt_id WHERE m.gt_id IS NULL"),
    "MT6_image_errors": binding(mt6_errors, f"""{_M}, e AS (SELECT image, count(*) FILTER (WHERE role='gt') AS num_gt, count(*) FILTER (WHERE role='pred') AS num_pred FROM marks GROUP BY 1), t AS (SELECT image, count(*) AS n FROM m GROUP BY 1)
      SELECT e.image, num_gt, num_pred, coalesce(n,0) AS tp, num_pred-coalesce(n,0) AS fp, num_gt-coalesce(n,0) AS fn, num_pred-num_gt AS err FROM e LEFT JOIN t ON e.image=t.image"""),
    "MT7": binding(mt7),
    "EV1": binding(ev1, f"{_M}, t AS (SELECT (SELECT count(*) FROM m) AS tp, (SELECT count(*) FROM pred)-(SELECT count(*) FROM m) AS fp, (SELECT count(*) FROM gt)-(SELECT count(*) FROM m) AS fn) SELECT {_RATES} FROM t"),
    "EV2": binding(ev2, f"""WITH {_ROLES}, th AS (SELECT CAST(unnest({THRESHOLDS}) AS DOUBLE) AS threshold),
      c AS (SELECT g.image, g.id AS gt_id, p.id AS pred_id, (g.x-p.x)*(g.x-p.x)+(g.y-p.y)*(g.y-p.y) AS d2, p.score FROM gt g JOIN pred p ON g.image=p.image AND abs(g.x-p.x) <= {R} AND abs(g.y-p.y) <= {R}),
      n1 AS (SELECT *, row_number() OVER (PARTITION BY threshold, image, gt_id ORDER BY d2, pred_id) AS k FROM c, th WHERE d2 <= {R * R} AND score >= threshold),
      n2 AS (SELECT *, row_number() OVER (PARTITION BY threshold, image, pred_id ORDER BY d2, gt_id) AS k2 FROM n1 WHERE k = 1),
      t AS (SELECT threshold, (SELECT count(*) FROM n2 WHERE k2=1 AND n2.threshold=th.threshold) AS tp, (SELECT count(*) FROM pred WHERE score >= th.threshold AND image IN (SELECT image FROM gt)) AS np, (SELECT count(*) FROM gt) AS ng FROM th),
      u AS (SELECT threshold, tp, np-tp AS fp, ng-tp AS fn FROM t)
      SELECT threshold, tp, fp, fn, round(CASE WHEN tp=0 THEN 1.0 ELSE tp/CAST(tp+fp AS DOUBLE) END,6) AS "precision", round(tp/CAST(tp+fn AS DOUBLE),6) AS recall,
        round(CASE WHEN tp=0 THEN 0.0 ELSE 2*(tp/CAST(tp+fp AS DOUBLE))*(tp/CAST(tp+fn AS DOUBLE))/((tp/CAST(tp+fp AS DOUBLE))+(tp/CAST(tp+fn AS DOUBLE))) END,6) AS f1 FROM u"""),
    "EV3": binding(ev3, f"""{_M}, e AS (SELECT image, CAST(count(*) FILTER (WHERE role='pred')-count(*) FILTER (WHERE role='gt') AS DOUBLE) AS e, count(*) FILTER (WHERE role='gt') AS g FROM marks GROUP BY 1)
      SELECT count(*) AS images, round(avg(e),6) AS me, round(avg(abs(e)),6) AS mae, round(avg(e*e),6) AS mse, round(sqrt(avg(e*e)),6) AS rmse FROM e WHERE g > 0"""),
    "EV4": binding(ev4, f"""WITH {_ROLES}, th AS (SELECT CAST(unnest({THRESHOLDS[::4]}) AS DOUBLE) AS threshold),
      c AS (SELECT g.species, g.image, g.id AS gt_id, p.id AS pred_id, (g.x-p.x)*(g.x-p.x)+(g.y-p.y)*(g.y-p.y) AS d2, p.score FROM gt g JOIN pred p ON g.image=p.image AND g.species=p.species AND abs(g.x-p.x) <= {R} AND abs(g.y-p.y) <= {R}),
      n1 AS (SELECT *, row_number() OVER (PARTITION BY threshold, species, image, gt_id ORDER BY d2, pred_id) AS k FROM c, th WHERE d2 <= {R * R} AND score >= threshold),
      n2 AS (SELECT *, row_number() OVER (PARTITION BY threshold, species, image, pred_id ORDER BY d2, gt_id) AS k2 FROM n1 WHERE k = 1),
      s AS (SELECT DISTINCT species FROM gt),
      t AS (SELECT s.species, threshold, (SELECT count(*) FROM n2 WHERE k2=1 AND n2.threshold=th.threshold AND n2.species=s.species) AS tp, (SELECT count(*) FROM pred WHERE score >= th.threshold AND pred.species=s.species AND image IN (SELECT image FROM gt)) AS np, (SELECT count(*) FROM gt WHERE gt.species=s.species) AS ng FROM th, s),
      u AS (SELECT species, threshold, round(CASE WHEN tp=0 THEN 1.0 ELSE tp/CAST(np AS DOUBLE) END,6) AS p, round(tp/CAST(ng AS DOUBLE),6) AS r, round(CASE WHEN tp=0 THEN 0.0 ELSE 2*(tp/CAST(np AS DOUBLE))*(tp/CAST(ng AS DOUBLE))/((tp/CAST(np AS DOUBLE))+(tp/CAST(ng AS DOUBLE))) END,6) AS f1 FROM t),
      w AS (SELECT *, (r-lag(r) OVER o)*(p+lag(p) OVER o)/2 AS area, row_number() OVER (PARTITION BY species ORDER BY f1 DESC, threshold) AS b FROM u WINDOW o AS (PARTITION BY species ORDER BY r, threshold DESC))
      SELECT species, round(coalesce(sum(area),0.0),6) AS ap, max(f1) AS best_f1, max(CASE WHEN b=1 THEN threshold END) AS best_threshold FROM w GROUP BY 1"""),
    "EV5": binding(ev5, f"""{_M}, k AS (SELECT score, CASE WHEN m.gt_id IS NULL THEN 'fp' ELSE 'tp' END AS kind FROM pred p LEFT JOIN m ON p.image=m.image AND p.id=m.pred_id)
      SELECT CAST(least(floor(score*20),19) AS BIGINT) AS bin, kind, count(*) AS n FROM k GROUP BY 1, 2"""),
    "EV6": binding(ev6, f"""WITH {_ROLES}, {_greedy('gt', 'pred', 'g.species = p.species')}, t AS (SELECT g.species, count(m.gt_id) AS tp, count(*) AS ng FROM gt g LEFT JOIN m ON g.image=m.image AND g.id=m.gt_id GROUP BY 1),
      q AS (SELECT species, count(*) AS np FROM pred GROUP BY 1), u AS (SELECT t.species, tp, np-tp AS fp, ng-tp AS fn FROM t JOIN q ON t.species=q.species) SELECT species, {_RATES} FROM u"""),
    "NEG1": binding(neg1, f"{_M} SELECT p.image, p.id, 'hard_negative' AS species, round(score,6) AS score FROM pred p LEFT JOIN m ON p.image=m.image AND p.id=m.pred_id WHERE m.gt_id IS NULL AND score > 0.93"),
    "SP1": binding(sp1, "SELECT image, id, CAST(floor(x/256) AS BIGINT) AS tile_x, CAST(floor(y/256) AS BIGINT) AS tile_y, x-floor(x/256)*256 AS local_x, y-floor(y/256)*256 AS local_y FROM marks WHERE x-floor(x/256)*256 > 0 AND y-floor(y/256)*256 > 0"),
    "SP1_overlap": binding(sp1_overlap, "SELECT image, id, i AS tile_x, j AS tile_y FROM marks, (SELECT unnest(generate_series(0,5)) AS i) a, (SELECT unnest(generate_series(0,5)) AS j) b WHERE role='gt' AND i*200 < x AND x < i*200+300 AND j*200 < y AND y < j*200+300"),
    "SP2": binding(sp2, "SELECT image, id, x-128 AS x1, y-128 AS y1, x+128 AS x2, y+128 AS y2, CAST(128 AS DOUBLE) AS local_x, CAST(128 AS DOUBLE) AS local_y FROM marks"),
    "SP3": binding(sp3, """WITH t AS (SELECT * FROM (SELECT DISTINCT image FROM marks) m, (SELECT unnest(generate_series(0,3)) AS tile_x) a, (SELECT unnest(generate_series(0,3)) AS tile_y) b),
      u AS (SELECT DISTINCT image, CAST(floor(x/256) AS BIGINT) AS tx, CAST(floor(y/256) AS BIGINT) AS ty FROM marks WHERE species='A' AND score > 0.95 AND x-floor(x/256)*256 > 0 AND y-floor(y/256)*256 > 0)
      SELECT t.image, tile_x, tile_y, tx IS NOT NULL AS occupied FROM t LEFT JOIN u ON t.image=u.image AND tile_x=tx AND tile_y=ty"""),
    "SP4": binding(sp4, f"SELECT shot, flight FROM shots WHERE ({_CROSS}) % 2 = 1 AND x BETWEEN 10 AND 120 AND y BETWEEN 10 AND 700"),
    "SP5": binding(sp5, f"{_M} SELECT image, gt_id, pred_id, d2 FROM n1 WHERE k = 1"),
    "SP6": binding(sp6, "WITH r AS (SELECT b.id AS box, s.shot, (b.x1/10-s.x)*(b.x1/10-s.x)+(b.y1-s.y)*(b.y1-s.y) AS d2 FROM boxes b, shots s), k AS (SELECT *, row_number() OVER (PARTITION BY box ORDER BY d2, shot) AS rank FROM r) SELECT box, shot, round(d2,6) AS d2, rank FROM k WHERE rank <= 3"),
    "SP7": binding(sp7, """WITH s AS (SELECT n_nationkey AS site, CAST(n_nationkey*40 AS DOUBLE) AS sx, CAST((n_nationkey*173)%1000 AS DOUBLE) AS sy FROM nation), p AS (SELECT s_suppkey AS id, CAST(s_suppkey*7%1000 AS DOUBLE) AS x, CAST(s_suppkey*31%1000 AS DOUBLE) AS y FROM supplier),
      r AS (SELECT id, site, (x-sx)*(x-sx)+(y-sy)*(y-sy) AS d2 FROM p, s), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, site) AS n FROM r) SELECT id, site, d2 FROM k WHERE n = 1"""),
    "SP8": binding(
        sp8,
        f"""WITH {_cells("shots", 15)}, r AS (SELECT a.shot AS s, b.expedition AS e1, b.shot AS o, abs(a.height-b.height) AS diff FROM home a JOIN around b ON a.cx=b.cx AND a.cy=b.cy AND a.expedition <> b.expedition AND {_PAIR} <= 225),
          k AS (SELECT *, row_number() OVER (PARTITION BY s, e1 ORDER BY diff DESC, o) AS n FROM r) SELECT s, e1, o, diff FROM k WHERE n = 1""",
    ),
    "SP9": binding(
        sp9,
        f"""WITH gt AS (SELECT * FROM marks WHERE role='gt'), {_image_cells("gt", 8)}
          SELECT a.image, a.id AS a, b.id AS b, {_PAIR} AS d2 FROM home a JOIN around b ON a.k=b.k WHERE a.id < b.id AND {_PAIR} > 0 AND {_PAIR} < 64""",
    ),
    "SP10": binding(
        sp10,
        f"""WITH gt AS (SELECT * FROM marks WHERE role='gt'), {_image_cells("gt", R)}, pred AS MATERIALIZED (SELECT image, id, species, x, y, (CAST(image AS BIGINT)*100000+CAST(floor(x/{R}) AS BIGINT))*100000+CAST(floor(y/{R}) AS BIGINT) AS k FROM marks WHERE role='pred'),
          near AS (SELECT DISTINCT a.image*100000+a.id AS key FROM pred a JOIN around b ON a.k=b.k WHERE {_PAIR} <= {R * R})
          SELECT p.image, p.id, p.species FROM pred p WHERE p.image*100000+p.id NOT IN (SELECT key FROM near)""",
    ),
    "SP11": binding(sp11, f"WITH {_BOX_PAIRS}, q AS (SELECT area, CASE a%3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS pa, CASE b%3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS pb FROM p) SELECT least(pa,pb) AS part_a, greatest(pa,pb) AS part_b, count(*) AS pairs, round(sum(area),3) AS area FROM q WHERE pa <> pb GROUP BY 1, 2"),
    "SP12": binding(sp12, """WITH t AS (SELECT *, floor(x/250) AS tx, floor(y/250) AS ty FROM marks WHERE x-floor(x/250)*250 > 0 AND y-floor(y/250)*250 > 0), n AS (SELECT a.image, a.tx, a.ty, a.id, min((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) AS d2 FROM t a JOIN t b ON a.image=b.image AND a.tx=b.tx AND a.ty=b.ty AND a.role='gt' AND b.role='pred' GROUP BY 1,2,3,4)
      SELECT image, CAST(tx AS BIGINT) AS tile_x, CAST(ty AS BIGINT) AS tile_y, round(avg(sqrt(d2)),6) AS mean_distance, round(max(sqrt(d2)),6) AS max_distance, round(min(sqrt(d2)),6) AS min_distance FROM n GROUP BY 1,2,3"""),
    "SP13": binding(sp13, """WITH RECURSIVE e AS (SELECT a.id AS a, b.id AS b FROM boxes a JOIN boxes b ON a.image=b.image AND a.id <> b.id AND a.x1-5 < b.x2+5 AND b.x1-5 < a.x2+5 AND a.y1-5 < b.y2+5 AND b.y1-5 < a.y2+5),
      r(id, root) AS (SELECT id, id FROM boxes UNION SELECT e.b, r.root FROM r JOIN e ON r.id = e.a AND r.root < e.b) SELECT id, min(root) AS component FROM r GROUP BY 1"""),
    "SP14": binding(sp14, """WITH t AS (SELECT id, i AS tx, j AS ty, least(x2,i*256+256)-greatest(x1,i*256) AS w, least(y2,j*256+256)-greatest(y1,j*256) AS h, (x2-x1)*(y2-y1) AS area FROM boxes, (SELECT unnest(generate_series(0,5)) AS i) a, (SELECT unnest(generate_series(0,5)) AS j) b)
      SELECT id, tx, ty, round(w*h/area,6) AS share, CASE WHEN w*h/area >= 1 THEN 'full' ELSE 'partial' END AS kind FROM t WHERE w > 0 AND h > 0"""),
}
