"""Bindings of tiles, splits, background samples, crops and clustering."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerotally.functions.draws import drawn_sql
from aerotally.operators import clustering as C, density as D, flights as L, graph, matching as M, spatial as S, tiling as T
from aerotally.plans.bind_matching import _M, _RATES, R, _greedy, matches, sides
from aerotally.plans.views import binding

_R = lambda c, n=6: F.round(c, n)


def rasters(v):
    return v.supplier.select(F.col("s_suppkey").alias("raster"), (F.col("s_suppkey") * 10).cast("double").alias("x1"), (F.col("s_suppkey") * 7).cast("double").alias("y1"), (F.col("s_suppkey") * 10 + 500 + F.col("s_nationkey") * 30).cast("double").alias("x2"), (F.col("s_suppkey") * 7 + 400).cast("double").alias("y2"))


_RASTERS = "rasters AS (SELECT s_suppkey AS raster, CAST(s_suppkey*10 AS DOUBLE) AS x1, CAST(s_suppkey*7 AS DOUBLE) AS y1, CAST(s_suppkey*10+500+s_nationkey*30 AS DOUBLE) AS x2, CAST(s_suppkey*7+400 AS DOUBLE) AS y2 FROM supplier)"
_GRID = "g AS (SELECT raster, x1, y1, x2, y2, x1+i*{0} AS tx1, y1+j*{0} AS ty1 FROM rasters, (SELECT unnest(generate_series(0,40)) AS i) a, (SELECT unnest(generate_series(0,40)) AS j) b WHERE i < ceil((x2-x1)/{0}) AND j < ceil((y2-y1)/{0}))"


def sizes(v):
    return v.part.select(F.col("p_partkey").alias("image"), (F.col("p_size") * 40 + 300).cast("int").alias("image_width"), (F.col("p_size") * 25 + 300).cast("int").alias("image_height"))


_SIZES = "sizes AS (SELECT p_partkey AS image, p_size*40+300 AS image_width, p_size*25+300 AS image_height FROM part)"


def tl1(v):
    return T.world_grid(rasters(v), 128.0, overlap=0.25).select("raster", "tx1", "ty1", "tx2", "ty2", "tile_name")


def tl2(v):
    return T.world_grid(rasters(v), 128.0, clip=True).select("raster", "tx1", "ty1", "tx2", "ty2")


def tl3(v):
    return T.pixel_grid(sizes(v), 256, 32).select("image", "x", "y", "key")


def tl4(v):
    return T.centre_grid(sizes(v), 256).select("image", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.col("position").cast("long").alias("position"))


def tl5(v):
    points = v.marks.where("role = 'gt'").dropDuplicates(["image", "x", "y"])
    return T.object_tiles(points, 64.0).groupBy("image").agg(F.count("*").alias("tiles"), F.sum("tx1").alias("sum_x1"), F.sum("ty2").alias("sum_y2"))


def grid_of_images(v):
    frame = v.marks.select(F.col("image").alias("raster")).distinct().select("raster", *[F.lit(float(c)).alias(n) for n, c in (("x1", 0), ("y1", 0), ("x2", 1000), ("y2", 1000))])
    return T.world_grid(frame, 100.0).withColumnRenamed("raster", "image")


def tl6(v):
    return T.empty_tiles(grid_of_images(v), v.marks.where("role = 'gt'").where("species = 'R'"), 8.0, ["image"]).select("image", F.col("tx1"), F.col("ty1"))


def tl7(v):
    return T.balanced_tiles(grid_of_images(v), v.marks.where("role = 'gt' and species = 'R'"), 64.0, 8.0, 20)


def tl8(v):
    return sizes(v).select("image", T.padding(F.col("image_width"), 256, 32).cast("int").alias("pad_w"), T.padding(F.col("image_height"), 256, 32).cast("int").alias("pad_h"))


def tl9(v):
    return T.tile_boxes(v.boxes, 256.0).select("image", "id", "tx", "ty", "lx1", "ly1", "lx2", "ly2", "edge_partial", _R("kept_box_size").alias("kept"))


def tl10(v):
    points = v.marks.where("role = 'gt'")
    return T.tile_points(points, v.boxes, 256.0).select("image", "id", "tx", "ty", "lx", "ly")


def tl11(v):
    """The tiles of a given list only."""
    known = v.boxes.select("image", F.floor(F.col("x1") / 256).cast("long").alias("tx"), F.floor(F.col("y1") / 256).cast("long").alias("ty")).distinct()
    return T.tile_points(v.marks.where("role = 'gt'"), v.boxes.limit(0), 256.0).join(known, ["image", "tx", "ty"], "left_semi").select("image", "id", "tx", "ty")


def tl13(v):
    return T.tile_labels(v.boxes, v.marks.where("role = 'gt'"), 256.0)


def jn8(v):
    """Quality cells by content hash onto shots, a left join."""
    q = v.documents.select(F.sha2(F.col("doc_id").cast("string"), 256).alias("hash"), "n_chars")
    shots = v.shots.select("shot", F.sha2(F.col("shot").cast("string"), 256).alias("hash"))
    return shots.join(q, "hash", "left").select("shot", F.coalesce("n_chars", F.lit(0)).alias("quality"))


def jn9(v):
    facts = v.shots.groupBy("flight").agg(F.count("*").alias("n"))
    means = v.shots.where("pitch < -45").groupBy("flight").agg(_R(F.avg("height")).alias("height"))
    return facts.join(means, "flight", "left")


def sp15(v):
    used = S.tile_of(v.marks.where("species = 'A' and score > 0.97"), 128).select("image", F.col("tile_x").alias("tx"), F.col("tile_y").alias("ty")).distinct()
    grid = v.marks.select("image").distinct().withColumn("tx", F.explode(F.expr("sequence(0L, 7L)"))).withColumn("ty", F.explode(F.expr("sequence(0L, 7L)")))
    return T.paired_empty_tiles(used, grid.join(used, ["image", "tx", "ty"], "left_anti"))


def tl14(v):
    """Preparation end to end: filter, tile, count."""
    points = v.marks.where("role = 'gt' and species <> 'R'").withColumn("name", F.concat_ws("___", "species", F.col("image").cast("string")))
    tiled = T.tile_points(points, v.boxes, 256.0)
    return tiled.groupBy("species").agg(F.count("*").alias("points"), F.countDistinct("name").alias("images"), F.countDistinct("image", "tx", "ty").alias("tiles"))


def tl15(v):
    w, h = F.lit(1000.0), F.lit(1000.0)
    x1, y1, x2, y2 = T.padded_box(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), 20.0, w, h)
    return v.boxes.select("id", x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


def fn17(v):
    x1, y1, x2, y2 = T.point_box(F.col("x"), F.col("y"), F.lit(64.0), F.lit(48.0), F.lit(1000.0), F.lit(1000.0))
    return v.marks.select("image", "id", x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


def fn9(v):
    """World to pixel and back by each nation's affine transform, a table of six numbers per raster."""
    g = v.nation.select((F.col("n_nationkey") % 20).alias("image"), "n_nationkey").groupBy("image").agg(F.min("n_nationkey").alias("k"))
    g = g.select("image", (F.col("k") * 100.0).alias("ox"), (F.lit(5000.0) + F.col("k")).alias("oy"), F.lit(0.25).alias("px"), F.lit(-0.5).alias("py"))
    j = v.boxes.join(F.broadcast(g), "image")  # one row per raster of a 20-image set
    at = [F.col(c) for c in ("ox", "oy", "px", "py")]
    col, row = L.to_pixel(F.col("x1") + 3000, F.col("y1"), *at)
    wx, wy = L.to_world(col, row, *at)
    return j.select("id", col.alias("col"), row.alias("row"), wx.alias("wx"), wy.alias("wy"))


def fn15(v):
    ring = F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y1").alias("y")), F.struct(((F.col("x1") + F.col("x2")) / 2).alias("x"), F.col("y2").alias("y")))
    return v.boxes.select("id", _R(S.polygon_area(ring), 4).alias("area"), S.inside_polygon((F.col("x1") + F.col("x2")) / 2, F.col("y1") + 1, ring).alias("inside"))


def fn12(v):
    w, h, area, aspect = S.box_shape(*[F.col(c) for c in ("x1", "y1", "x2", "y2")])
    return v.boxes.select("id", w.alias("w"), h.alias("h"), area.alias("area"), _R(aspect).alias("aspect"))


def fn16(v):
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return v.boxes.select("id", F.bround(F.col("x1") + w / 2).cast("long").alias("xc"), F.bround(F.col("y1") + h / 2).cast("long").alias("yc"), w.cast("long").alias("w"), h.cast("long").alias("h"))


def fn19(v):
    names = ("x1", "y1", "x2", "y2")
    cut = T.box_in_crop(*[F.col(c) for c in names], (100, 100, 600, 500))
    return v.boxes.select("id", *[c.alias(n) for c, n in zip(cut, names)])


def fn21(v):
    n = v.boxes.select("id", (F.col("x1") / 2000).alias("nx"), (F.col("y1") / 2000).alias("ny"))
    return n.select("id", _R("nx", 9).alias("nx"), _R("ny", 9).alias("ny"), F.round(F.col("nx") * 2000).cast("long").alias("x"))


def fn11(v):
    zone = F.concat((F.col("n_nationkey") % 60 + 1).cast("string"), F.when(F.col("n_nationkey") % 2 == 0, "N").otherwise("S"))
    return v.nation.select("n_nationkey", L.epsg(zone).alias("epsg"))


def fn22(v):
    names = v.shots.select("shot", F.concat(F.lit("FEC0"), F.col("flight") % 9, F.lit("_21012023")).alias("folder"), F.when(F.col("shot") % 3 == 0, F.format_string("DJI_%04d.JPG", F.col("shot") % 10000)).when(F.col("shot") % 3 == 1, F.format_string("Fer_FEC01_DJI_%04d_21012023_condor.JPG", F.col("shot") % 10000)).otherwise(F.format_string("Fer_FEC01_DJI_%04d_21012023.JPG", F.col("shot") % 10000)).alias("old"))
    return names.select("shot", T.planned_name(F.lit("Fer"), F.col("folder"), F.col("old")).alias("name"))


def fn23(v):
    d = v.shots.select("shot", F.when(F.col("shot") % 2 == 0, F.date_format("ts", "ddMMyy")).otherwise(F.date_format("ts", "ddMMyyyy")).alias("d"))
    return d.select("shot", F.when(F.length("d") == 6, F.concat(F.substring("d", 1, 4), F.lit("20"), F.substring("d", 5, 2))).otherwise(F.col("d")).alias("d"))


def fn24(v):
    code = F.create_map(F.lit("I0"), F.lit("Fer"), F.lit("I1"), F.lit("Isa"), F.lit("I2"), F.lit("Flo"))
    drone = F.create_map(F.lit("D0"), F.lit("Hawk"), F.lit("D1"), F.lit("Owl"))
    return v.shots.select("shot", F.coalesce(code[F.col("island")], F.lit("unknown")).alias("island_code"), F.coalesce(drone[F.col("drone")], F.lit("Falcon")).alias("drone_name"), F.date_format("ts", "yyyyMMdd").alias("day"))


def fn25(v):
    return v.documents.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("hash"))


def fn26(v):
    s = v.boxes.groupBy("image").agg(F.avg("x1").alias("m1"), F.stddev_pop("x1").alias("s1"), F.avg("y1").alias("m2"), F.stddev_pop("y1").alias("s2"))
    d = F.col("m1") - F.col("m2")
    return s.select("image", _R(F.abs(d) / F.sqrt(F.col("s1") * F.col("s1") + F.col("s2") * F.col("s2"))).alias("cnr"), _R(F.abs(d) / (F.col("m1") + F.col("m2"))).alias("michelson"), _R(d / F.col("m2")).alias("weber"))


def fn27(v):
    rules = [("x1 > 500", 2.0), ("y1 > 300", 1.5), ("x2 - x1 > 20", 1.0), ("y2 - y1 > 40", 1.0), ("id % 2 = 0", 1.5), ("id % 3 = 0", 1.5), ("id % 5 = 0", 1.0)]
    score = sum((F.when(F.expr(r), w).otherwise(0.0) for r, w in rules), F.lit(0.0)) / 9.5
    return v.boxes.select("id", _R(score).alias("score"), F.when(score >= 0.7, "high").when(score >= 0.4, "detectable").otherwise("hidden").alias("class"))


def fn28(v):
    null = v.marks.where("role = 'gt'").groupBy("image").agg(F.avg("y").alias("m"), F.stddev_pop("y").alias("s"))
    j = v.marks.where("role = 'pred'").join(null, "image")
    z = F.when(F.col("s") > 0, (F.col("y") - F.col("m")) / F.col("s")).otherwise(0.0)
    return j.select("image", "id", _R(z).alias("z"), (z >= 1.5).alias("detectable"), _R(1 / (1 + F.exp(-z))).alias("score"))


def spl1(v):
    return T.stratified_split(v.docs.select("doc_id", "quality"), "quality", "doc_id", 0.8, cap=1000).groupBy("quality", "part").agg(F.count("*").alias("n"))


def spl2(v):
    items = v.docs.select("doc_id", F.when(F.col("toxic") == 1, "annotated").otherwise("empty").alias("stratum"))
    return T.three_way_split(items, "stratum", "doc_id", 0.7, 0.2).groupBy("stratum", "part").agg(F.count("*").alias("n"))


def spl3(v):
    return T.k_folds(v.docs.select("doc_id", "lang"), 4, "doc_id", "lang").groupBy("lang", "fold", "role").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


def spl4(v):
    return T.hold_out(v.docs.select("doc_id"), 50, "doc_id")


def spl5(v):
    held = T.hold_out(v.docs.select("doc_id", "lang"), 50, "doc_id")
    rest = v.docs.select("doc_id", "lang").join(held.select("doc_id"), "doc_id", "left_anti")
    return T.k_folds(rest, 3, "doc_id", "lang").groupBy("fold", "role").agg(F.count("*").alias("n"))


def neg3(v):
    """How many background points each image got; images that are full of positives have fewer."""
    im = v.marks.select("image").distinct().withColumn("image_width", F.lit(1000)).withColumn("image_height", F.lit(1000))
    found = T.background_points(im, v.marks.where("role = 'gt' and species = 'A'"), 5, 50.0, 20.0)
    return im.select("image").join(found.groupBy("image").agg(F.count("*").alias("n")), "image", "left").select("image", F.coalesce("n", F.lit(0)).alias("n"))


def neg4(v):
    return T.add_background(v.documents.select("doc_id"), 0.3, 0.2, "doc_id")


def neg2(v):
    """Points in object tiles as a training table, with hard negatives as a class of their own."""
    gt, pred, m = matches(v)
    hard = M.hard_negatives(M.labelled(gt, pred, m), 0.95).select("image", "id", "species", "x", "y")
    both = gt.select("image", "id", "species", "x", "y").unionByName(hard)
    return S.tile_of(both, 256).select(F.concat_ws("_", F.lit("tile"), "image", "tile_x", "tile_y").alias("file"), "species", F.col("local_x").alias("x"), F.col("local_y").alias("y"))


def rev1(v):
    """Review package: labelled union of both sides on occupied tiles."""
    gt, pred, m = matches(v)
    pts = S.tile_of(M.labelled(gt, pred, m).select("image", "id", "kind", "x", "y"), 256)
    return pts.groupBy("image", "tile_x", "tile_y").pivot("kind", ["tp", "fp", "fn"]).count().fillna(0)


def rev3(v):
    p = v.marks.where("role = 'pred' and score > 0.9")
    t = v.nation.select(F.col("n_nationkey").alias("k"), (F.col("n_nationkey") * 10.0).alias("ox"))
    j = p.withColumn("k", F.col("image") % 25).join(F.broadcast(t), "k")  # 25 rasters
    return j.select("image", "id", (F.col("ox") + F.col("x") * 0.25).alias("wx"), (F.lit(100.0) - F.col("y") * 0.25).alias("wy"))


def gr1(v):
    """Parts linked through the orders that hold them."""
    ends = v.lineitem.groupBy("l_orderkey").agg(F.min("l_partkey").alias("a"), F.max("l_partkey").alias("b"))
    return graph.connected_components(ends, "a", "b")


def _dense(v):
    return v.marks.where("role = 'gt'").withColumn("id", F.col("image") * 100000 + F.col("id"))


def cl1(v):
    return D.dbscan(_dense(v), 40.0, 4, ["image"])


def cl2(v):
    n = v.shots.where("pitch <= -80").groupBy("flight").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names"))
    return n.where("n >= 5")


def cl3(v):
    found = D.dbscan(C.standardised(_dense(v), ["image"]), 0.12, 4, ["image"])
    return found.groupBy("image").agg(F.countDistinct(F.when(F.col("cluster") >= 0, F.col("cluster"))).alias("clusters"), F.count(F.when(F.col("cluster") < 0, 1)).alias("noise"))


def cl4(v):
    return C.best_k(v.marks.where("role = 'gt' and species = 'A'"), "image")


def cl9(v):
    """Every vector beside those whose id is divisible by 50."""
    right = v.embeddings.where("vec_id % 50 = 0")
    return C.similarity(v.embeddings, right).select("a", "b", _R("cosine", 5).alias("cosine"))


_PARAMETERS = [(eps, n) for eps in (0.08, 0.12) for n in (3, 4)]


def agg23(v):
    """CL3 over a grid of parameters in one run."""
    found = D.dbscan_grid(C.standardised(_dense(v), ["image"]), _PARAMETERS, ["image"])
    k = found.groupBy("image", "g").agg(F.countDistinct(F.when(F.col("cluster") >= 0, F.col("cluster"))).alias("k"))
    gold = v.marks.where("role = 'pred' and species = 'A'").groupBy("image").agg(F.count("*").alias("ref"))
    e = F.col("k") - F.col("ref")
    pick = lambda at: F.element_at(F.array(*[F.lit(p[at]) for p in _PARAMETERS]), F.col("g") + 1)
    errors = k.join(gold, "image").groupBy("g").agg(F.count("*").alias("images"), _R(F.sqrt(F.avg(e * e))).alias("rmse"), _R(F.avg(F.abs(e))).alias("mae"))
    return errors.select(pick(0).alias("eps"), pick(1).alias("min_points"), "images", "rmse", "mae")


def agg36(v):
    centre = v.shots.select("flight", "x", "y").distinct().groupBy("flight").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    isl = v.region.select("r_regionkey", (F.col("r_regionkey") * 25.0).alias("ix"), (F.col("r_regionkey") * 200.0).alias("iy"))
    d = S.d2("cx", "cy", "ix", "iy")
    near = centre.crossJoin(F.broadcast(isl)).groupBy("flight").agg(F.min_by("r_regionkey", F.struct(d, "r_regionkey")).alias("island"))  # five regions
    return v.shots.select("shot", "flight").join(near, "flight")


def cf4(v):
    """Grid comparison end to end: threshold, cells, compare, match, factor by mission."""
    gt, pred = sides(v)
    pred = pred.where("score > 0.85")
    m = M.match_greedy(gt, pred, R)
    e = M.image_errors(gt, pred, m).withColumn("mission", F.col("image") % 5)
    return e.groupBy("mission").agg(F.sum("num_gt").alias("ref"), F.sum("num_pred").alias("pred"), F.sum("tp").alias("tp"), _R(F.sum("num_gt") / F.sum("num_pred")).alias("factor"))


def ev7(v):
    """Each species taken for an expert, against all marks of role gt.

    An expert comes from the prediction of a pair, so no mark is repeated for the
    experts, however many there are, and only the number of gt is broadcast.
    """
    gt, pred = sides(v)
    expert = F.col("species").alias("expert")
    m = M.greedy(M.candidates(gt, pred, 10.0, truncate=True, of_pred=[expert]), ["image", "expert"])
    n = lambda df, p, t: df.select("expert", F.lit(p).alias("p"), F.lit(t).alias("t"))
    total = n(pred.select(expert), 1, 0).unionByName(n(m, 0, 1)).groupBy("expert").agg(F.sum("p").alias("num_pred"), F.sum("t").alias("tp"))
    return M.scored(total.crossJoin(F.broadcast(gt.agg(F.count("*").alias("num_gt")))), ["expert"])


_Z = [f"CASE WHEN stddev_pop({c}) OVER w > 0 THEN ({c} - avg({c}) OVER w) / stddev_pop({c}) OVER w ELSE {c} - avg({c}) OVER w END" for c in ("x", "y")]


def _dbscan(x: str, y: str, eps: float, min_points: int) -> str:
    """``found`` (image, id, cluster) by labels that spread over links of core points; cluster is null for noise."""
    return f"""WITH RECURSIVE d AS (SELECT image, image*100000+id AS id, {x} AS x, {y} AS y FROM marks WHERE role='gt' WINDOW w AS (PARTITION BY image)),
      near AS (SELECT a.image, a.id AS a, b.id AS b FROM d a JOIN d b ON a.image=b.image AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) <= CAST({eps} AS DOUBLE)*CAST({eps} AS DOUBLE)),
      core AS (SELECT a AS id FROM near GROUP BY a HAVING count(*) >= {min_points}),
      e AS (SELECT a, b FROM near SEMI JOIN core ON near.a=core.id WHERE b IN (SELECT id FROM core)),
      r(id, cluster) USING KEY (id) AS (SELECT id, id FROM core UNION
        SELECT e.b, min(r.cluster) FROM r JOIN e ON r.id=e.a JOIN recurring.r AS o ON o.id=e.b WHERE r.cluster < o.cluster GROUP BY 1),
      near_core AS (SELECT near.a AS id, min(r.cluster) AS cluster FROM near JOIN r ON near.b=r.id GROUP BY 1),
      found AS (SELECT d.image, d.id, coalesce(r.cluster, near_core.cluster) AS cluster FROM d LEFT JOIN r ON d.id=r.id LEFT JOIN near_core ON d.id=near_core.id)"""


def _dbscan_grid(x: str, y: str, grid: list[tuple[float, int]]) -> str:
    """As :func:`_dbscan` for each of several parameters ``g``: ``found`` (image, g, id, cluster)."""
    values = ", ".join(f"({i}, CAST({eps} AS DOUBLE), {n})" for i, (eps, n) in enumerate(grid))
    return f"""WITH RECURSIVE grid(g, eps, least) AS (VALUES {values}),
      z AS (SELECT image, image*100000+id AS id, {x} AS x, {y} AS y FROM marks WHERE role='gt' WINDOW w AS (PARTITION BY image)),
      d AS (SELECT image, g, id*{len(grid)}+g AS id, x, y, eps, least FROM z, grid),
      pairs AS (SELECT a.image, a.id AS a, b.id AS b, (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) AS d2 FROM z a JOIN z b ON a.image=b.image AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) <= {max(e for e, _ in grid) ** 2 * 1.01}),
      near AS (SELECT a*{len(grid)}+g AS a, b*{len(grid)}+g AS b, least FROM pairs, grid WHERE d2 <= eps*eps),
      core AS (SELECT a AS id FROM near GROUP BY a, least HAVING count(*) >= least),
      e AS (SELECT a, b FROM near SEMI JOIN core ON near.a=core.id WHERE b IN (SELECT id FROM core)),
      r(id, cluster) USING KEY (id) AS (SELECT id, id FROM core UNION
        SELECT e.b, min(r.cluster) FROM r JOIN e ON r.id=e.a JOIN recurring.r AS o ON o.id=e.b WHERE r.cluster < o.cluster GROUP BY 1),
      near_core AS (SELECT near.a AS id, min(r.cluster) AS cluster FROM near JOIN r ON near.b=r.id GROUP BY 1),
      found AS (SELECT d.image, d.g, d.id, coalesce(r.cluster, near_core.cluster) AS cluster FROM d LEFT JOIN r ON d.id=r.id LEFT JOIN near_core ON d.id=near_core.id)"""


_UNION = "a AS (SELECT g.image, g.id, CASE WHEN m.pred_id IS NULL THEN 'fn' END AS kind, x, y FROM gt g LEFT JOIN m ON g.image=m.image AND g.id=m.gt_id UNION ALL SELECT p.image, p.id, CASE WHEN m.gt_id IS NULL THEN 'fp' ELSE 'tp' END, x, y FROM pred p LEFT JOIN m ON p.image=m.image AND p.id=m.pred_id)"
_CUT = "floor(x1/256)<>floor(x2/256) OR floor(y1/256)<>floor(y2/256)"
_TL10 = f"own AS (SELECT *, floor(x/256) AS tx, floor(y/256) AS ty, x-floor(x/256)*256 AS lx, y-floor(y/256)*256 AS ly FROM marks WHERE role='gt' AND x-floor(x/256)*256>0 AND y-floor(y/256)*256>0), t10 AS (SELECT * FROM own o WHERE NOT EXISTS (SELECT 1 FROM boxes b WHERE b.image=o.image AND o.x BETWEEN x1 AND x2 AND o.y BETWEEN y1 AND y2 AND ({_CUT})))"

BINDINGS = {
    "TL1": binding(tl1, f"WITH {_RASTERS}, {_GRID.format('96.0')} SELECT raster, tx1, ty1, tx1+128 AS tx2, ty1+128 AS ty2, concat(CAST(raster AS VARCHAR),'_',CAST(CAST(trunc(tx1) AS BIGINT) AS VARCHAR),'_',CAST(CAST(trunc(ty1) AS BIGINT) AS VARCHAR)) AS tile_name FROM g"),
    "TL2": binding(tl2, f"WITH {_RASTERS}, {_GRID.format('128.0')} SELECT raster, tx1, ty1, least(tx1+128,x2) AS tx2, least(ty1+128,y2) AS ty2 FROM g"),
    "TL3": binding(tl3, f"WITH {_SIZES} SELECT image, i*224 AS x, j*224 AS y, concat(CAST(i*224 AS VARCHAR),'_',CAST(j*224 AS VARCHAR),'_224') AS key FROM sizes, (SELECT unnest(generate_series(0,20)) AS i) a, (SELECT unnest(generate_series(0,20)) AS j) b WHERE i*224+256 <= image_width AND j*224+256 <= image_height"),
    "TL4": binding(tl4, f"""WITH {_SIZES}, g AS (SELECT image, image_width, image_height, floor(image_width/2.0-128)+i*256 AS x, floor(image_height/2.0-128)+j*256 AS y FROM sizes, (SELECT unnest(generate_series(-10,10)) AS i) a, (SELECT unnest(generate_series(-10,10)) AS j) b)
      SELECT image, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, row_number() OVER (PARTITION BY image ORDER BY (x+128-image_width/2.0)*(x+128-image_width/2.0)+(y+128-image_height/2.0)*(y+128-image_height/2.0), y, x) AS position FROM g WHERE x>=0 AND y>=0 AND x+256<=image_width AND y+256<=image_height"""),
    "TL5": binding(tl5, "WITH d AS (SELECT DISTINCT image, x, y FROM marks WHERE role='gt') SELECT image, count(*) AS tiles, sum(x-32) AS sum_x1, sum(y+32) AS sum_y2 FROM d GROUP BY 1"),
    "TL6": binding(tl6, """WITH g AS (SELECT image, i*100.0 AS tx1, j*100.0 AS ty1 FROM (SELECT DISTINCT image FROM marks) m, (SELECT unnest(generate_series(0,9)) AS i) a, (SELECT unnest(generate_series(0,9)) AS j) b), p AS (SELECT * FROM marks WHERE role='gt' AND species='R')
      SELECT image, CAST(tx1 AS DOUBLE) AS tx1, CAST(ty1 AS DOUBLE) AS ty1 FROM g WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.image=g.image AND pow(greatest(tx1-x,0,x-tx1-100),2)+pow(greatest(ty1-y,0,y-ty1-100),2) <= 64)"""),
    "TL7": binding(
        tl7,
        f"""WITH p AS (SELECT DISTINCT image, x, y FROM marks WHERE role='gt' AND species='R'),
          g AS (SELECT image, i*100.0 AS tx1, j*100.0 AS ty1, concat_ws('_', image, i*100, j*100) AS tile_name FROM (SELECT DISTINCT image FROM marks) m, (SELECT unnest(generate_series(0,9)) AS i) a, (SELECT unnest(generate_series(0,9)) AS j) b),
          hit AS (SELECT DISTINCT g.image, tile_name FROM g JOIN p ON g.image=p.image AND pow(greatest(tx1-p.x, 0, p.x-tx1-100), 2) + pow(greatest(ty1-p.y, 0, p.y-ty1-100), 2) <= 64),
          f AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY {drawn_sql(3, 'tile_name')}, tile_name) AS k FROM g ANTI JOIN hit USING (image, tile_name))
          SELECT image, x-32 AS tx1, y-32 AS ty1, TRUE AS has_object FROM p UNION ALL SELECT image, tx1, ty1, FALSE FROM f WHERE k <= 20""",
    ),
    "TL8": binding(tl8, f"WITH {_SIZES} SELECT image, (224-image_width%224)%224 AS pad_w, (224-image_height%224)%224 AS pad_h FROM sizes"),
    "TL9": binding(tl9, """WITH t AS (SELECT image, id, i AS tx, j AS ty, greatest(x1,i*256)-i*256 AS a, greatest(y1,j*256)-j*256 AS b, least(x2,i*256+256)-i*256 AS c, least(y2,j*256+256)-j*256 AS d, (x2-x1)*(y2-y1) AS area FROM boxes, (SELECT unnest(generate_series(0,5)) AS i) s, (SELECT unnest(generate_series(0,5)) AS j) u),
      k AS (SELECT *, (c-a)*(d-b)/area AS kept FROM t WHERE c>a AND d>b), w AS (SELECT *, max(CASE WHEN kept >= 1 THEN 1 ELSE 0 END) OVER (PARTITION BY image, tx, ty) AS whole FROM k)
      SELECT image, id, tx, ty, trunc(a) AS lx1, trunc(b) AS ly1, trunc(c) AS lx2, trunc(d) AS ly2, kept < 1 AS edge_partial, round(kept,6) AS kept FROM w WHERE whole=1"""),
    "TL10": binding(tl10, f"WITH {_TL10} SELECT image, id, CAST(tx AS BIGINT) AS tx, CAST(ty AS BIGINT) AS ty, lx, ly FROM t10"),
    "TL11": binding(tl11, "WITH k AS (SELECT DISTINCT image, floor(x1/256) AS tx, floor(y1/256) AS ty FROM boxes) SELECT m.image, m.id, CAST(floor(x/256) AS BIGINT) AS tx, CAST(floor(y/256) AS BIGINT) AS ty FROM marks m JOIN k ON m.image=k.image AND floor(x/256)=tx AND floor(y/256)=ty WHERE role='gt' AND x-floor(x/256)*256>0 AND y-floor(y/256)*256>0"),
    "TL13": binding(tl13, f"""WITH {_TL10}, bt AS (SELECT image, id, i AS tx, j AS ty, (least(x2,i*256+256)-greatest(x1,i*256))*(least(y2,j*256+256)-greatest(y1,j*256))/((x2-x1)*(y2-y1)) AS kept FROM boxes, (SELECT unnest(generate_series(0,5)) AS i) s, (SELECT unnest(generate_series(0,5)) AS j) u WHERE least(x2,i*256+256)>greatest(x1,i*256) AND least(y2,j*256+256)>greatest(y1,j*256)),
      bw AS (SELECT *, max(CASE WHEN kept>=1 THEN 1 ELSE 0 END) OVER (PARTITION BY image, tx, ty) AS w FROM bt), b AS (SELECT image, count(*) AS n FROM bw WHERE w=1 GROUP BY 1), p AS (SELECT image, count(*) AS n FROM t10 GROUP BY 1) SELECT coalesce(b.image,p.image) AS image, coalesce(b.n,0) AS boxes, coalesce(p.n,0) AS points FROM b FULL OUTER JOIN p ON b.image=p.image"""),
    "JN8": binding(jn8, "SELECT shot, coalesce(n_chars,0) AS quality FROM shots LEFT JOIN documents ON shot=doc_id"),
    "JN9": binding(jn9, "WITH m AS (SELECT flight, round(avg(height),6) AS height FROM shots WHERE pitch < -45 GROUP BY 1) SELECT s.flight, count(*) AS n, max(m.height) AS height FROM shots s LEFT JOIN m ON s.flight=m.flight GROUP BY 1"),
    "TL14": binding(tl14, f"WITH {_TL10} SELECT species, count(*) AS points, count(DISTINCT image) AS images, count(DISTINCT image*10000+tx*100+ty) AS tiles FROM t10 WHERE species <> 'R' GROUP BY 1"),
    "TL15": binding(tl15, "SELECT id, greatest(0,x1-20) AS x1, greatest(0,y1-20) AS y1, least(1000,x2+20) AS x2, least(1000,y2+20) AS y2 FROM boxes"),
    "SP15": binding(
        sp15,
        """WITH RECURSIVE t AS (SELECT DISTINCT image, CAST(floor(x/128) AS BIGINT) AS tx, CAST(floor(y/128) AS BIGINT) AS ty FROM marks WHERE species='A' AND score > CAST(0.97 AS DOUBLE) AND x%128 > 0 AND y%128 > 0),
          o AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY ty, tx) AS i FROM t),
          g AS (SELECT image, tx, ty FROM (SELECT DISTINCT image FROM marks) m, (SELECT unnest(generate_series(0,7)) AS tx) a, (SELECT unnest(generate_series(0,7)) AS ty) b),
          e AS (SELECT image, tx, ty FROM g ANTI JOIN t USING (image, tx, ty)),
          s(image, i, taken, last) AS (SELECT DISTINCT image, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST(-1 AS BIGINT) FROM o
            UNION ALL SELECT image, i+1, list_append(taken, best), best FROM (SELECT s.image, s.i, s.taken, min(((o.tx-e.tx)*(o.tx-e.tx)+(o.ty-e.ty)*(o.ty-e.ty))*64+e.ty*8+e.tx)%64 AS best
              FROM s JOIN o ON o.image=s.image AND o.i=s.i+1 JOIN e ON e.image=s.image AND NOT list_contains(s.taken, e.ty*8+e.tx) GROUP BY 1, 2, 3) q)
          SELECT o.image, o.tx, o.ty, last%8 AS empty_tx, last//8 AS empty_ty FROM s JOIN o ON o.image=s.image AND o.i=s.i""",
    ),
    "FN9": binding(fn9, "WITH g AS (SELECT n_nationkey%20 AS image, min(n_nationkey) AS k FROM nation GROUP BY 1), p AS (SELECT id, k*100.0 AS ox, 5000.0+k AS oy, trunc((x1+3000-k*100.0)/0.25) AS c, trunc((y1-5000-k)/(-0.5)) AS r FROM boxes b JOIN g ON b.image=g.image) SELECT id, CAST(c AS INTEGER) AS col, CAST(r AS INTEGER) AS row, CAST(ox+c*0.25 AS DOUBLE) AS wx, CAST(oy-r*0.5 AS DOUBLE) AS wy FROM p"),
    "FN11": binding(fn11, "SELECT n_nationkey, CASE WHEN n_nationkey%2=0 THEN 32600 ELSE 32700 END + n_nationkey%60+1 AS epsg FROM nation"),
    "FN12": binding(fn12, "SELECT id, x2-x1 AS w, y2-y1 AS h, (x2-x1)*(y2-y1) AS area, round((x2-x1)/(y2-y1),6) AS aspect FROM boxes"),
    "FN15": binding(fn15, "SELECT id, round((x2-x1)*(y2-y1)/2,4) AS area, TRUE AS inside FROM boxes"),
    "FN16": binding(fn16, "SELECT id, CAST(round_even((x1+x2)/2,0) AS BIGINT) AS xc, CAST(round_even((y1+y2)/2,0) AS BIGINT) AS yc, CAST(x2-x1 AS BIGINT) AS w, CAST(y2-y1 AS BIGINT) AS h FROM boxes"),
    "FN17": binding(fn17, "WITH p AS (SELECT image, id, greatest(0,least(x-32,936)) AS x1, greatest(0,least(y-24,952)) AS y1 FROM marks) SELECT image, id, x1, y1, x1+64 AS x2, y1+48 AS y2 FROM p"),
    "FN18": binding(tl15, "SELECT id, greatest(0,x1-20) AS x1, greatest(0,y1-20) AS y1, least(1000,x2+20) AS x2, least(1000,y2+20) AS y2 FROM boxes"),
    "FN19": binding(fn19, "WITH b AS (SELECT *, x1<600 AND x2>100 AND y1<500 AND y2>100 AS m FROM boxes) SELECT id, CASE WHEN m THEN least(greatest(x1,100),600)-100 END AS x1, CASE WHEN m THEN least(greatest(y1,100),500)-100 END AS y1, CASE WHEN m THEN least(greatest(x2,100),600)-100 END AS x2, CASE WHEN m THEN least(greatest(y2,100),500)-100 END AS y2 FROM b"),
    "FN21": binding(fn21, "SELECT id, round(x1/2000,9) AS nx, round(y1/2000,9) AS ny, CAST(x1 AS BIGINT) AS x FROM boxes"),
    "FN22": binding(fn22, "SELECT shot, concat('Fer_FEC0',CAST(flight%9 AS VARCHAR),'_DJI_',lpad(CAST(shot%10000 AS VARCHAR),4,'0'),'_21012023.JPG') AS name FROM shots"),
    "FN23": binding(fn23, "SELECT shot, strftime(ts,'%d%m%Y') AS d FROM shots"),
    "FN24": binding(fn24, "SELECT shot, CASE island WHEN 'I0' THEN 'Fer' WHEN 'I1' THEN 'Isa' WHEN 'I2' THEN 'Flo' ELSE 'unknown' END AS island_code, CASE drone WHEN 'D0' THEN 'Hawk' WHEN 'D1' THEN 'Owl' ELSE 'Falcon' END AS drone_name, strftime(ts,'%Y%m%d') AS day FROM shots"),
    "FN25": binding(fn25, "SELECT doc_id, sha256(text) AS hash FROM documents"),
    "FN26": binding(fn26, "WITH s AS (SELECT image, avg(x1) AS m1, stddev_pop(x1) AS s1, avg(y1) AS m2, stddev_pop(y1) AS s2 FROM boxes GROUP BY 1) SELECT image, round(abs(m1-m2)/sqrt(s1*s1+s2*s2),6) AS cnr, round(abs(m1-m2)/(m1+m2),6) AS michelson, round((m1-m2)/m2,6) AS weber FROM s"),
    "FN27": binding(fn27, "WITH s AS (SELECT id, (CASE WHEN x1>500 THEN 2 ELSE 0 END+CASE WHEN y1>300 THEN 1.5 ELSE 0 END+CASE WHEN x2-x1>20 THEN 1 ELSE 0 END+CASE WHEN y2-y1>40 THEN 1 ELSE 0 END+CASE WHEN id%2=0 THEN 1.5 ELSE 0 END+CASE WHEN id%3=0 THEN 1.5 ELSE 0 END+CASE WHEN id%5=0 THEN 1 ELSE 0 END)/CAST(9.5 AS DOUBLE) AS s FROM boxes) SELECT id, round(s,6) AS score, CASE WHEN s>=0.7 THEN 'high' WHEN s>=0.4 THEN 'detectable' ELSE 'hidden' END AS class FROM s"),
    "FN28": binding(fn28, "WITH n AS (SELECT image, avg(y) AS m, stddev_pop(y) AS s FROM marks WHERE role='gt' GROUP BY 1), z AS (SELECT p.image, p.id, (y-m)/s AS z FROM marks p JOIN n ON p.image=n.image WHERE role='pred') SELECT image, id, round(z,6) AS z, z>=1.5 AS detectable, round(1/(1+exp(-z)),6) AS score FROM z"),
    "FN29": binding(lambda v: M.evaluation(*matches(v), by=["image"]).select("image", "precision", "recall", "f1"), f"""{_M}, e AS (SELECT image, count(*) FILTER (WHERE role='gt') AS g, count(*) FILTER (WHERE role='pred') AS n FROM marks GROUP BY 1), k AS (SELECT image, count(*) AS t FROM m GROUP BY 1), r AS (SELECT e.image, coalesce(t,0)/CAST(n AS DOUBLE) AS p, coalesce(t,0)/CAST(g AS DOUBLE) AS q FROM e LEFT JOIN k ON e.image=k.image)
      SELECT image, round(p,6) AS "precision", round(q,6) AS recall, round(CASE WHEN p+q>0 THEN 2*p*q/(p+q) ELSE 0 END,6) AS f1 FROM r"""),
    "SPL1": binding(spl1, "WITH n AS (SELECT quality, least(count(*),1000) AS n FROM docs GROUP BY 1) SELECT quality, 'train' AS part, CAST(floor(n*0.8) AS BIGINT) AS n FROM n UNION ALL SELECT quality, 'val', n-CAST(floor(n*0.8) AS BIGINT) FROM n"),
    "SPL2": binding(spl2, "WITH n AS (SELECT CASE WHEN toxic=1 THEN 'annotated' ELSE 'empty' END AS stratum, count(*) AS n FROM docs GROUP BY 1), k AS (SELECT *, CAST(floor(n*0.7) AS BIGINT) AS a, CAST(floor(n*0.2) AS BIGINT) AS b FROM n) SELECT stratum, 'train' AS part, a AS n FROM k UNION ALL SELECT stratum, 'val', b FROM k UNION ALL SELECT stratum, 'test', n-a-b FROM k"),
    "SPL3": binding(spl3, "WITH f AS (SELECT doc_id, lang, ntile(4) OVER (PARTITION BY lang ORDER BY doc_id) AS own FROM docs) SELECT lang, CAST(fold AS INTEGER) AS fold, CASE WHEN own=fold THEN 'val' ELSE 'train' END AS role, count(*) AS n, min(doc_id) AS first FROM f, (SELECT unnest(generate_series(1,4)) AS fold) s GROUP BY 1,2,3"),
    "SPL4": binding(spl4, f"SELECT doc_id FROM docs ORDER BY {drawn_sql(9, 'doc_id')}, doc_id LIMIT 50"),
    "SPL5": binding(
        spl5,
        f"""WITH h AS (SELECT doc_id FROM docs ORDER BY {drawn_sql(9, 'doc_id')}, doc_id LIMIT 50),
          f AS (SELECT lang, ntile(3) OVER (PARTITION BY lang ORDER BY doc_id) AS own FROM docs ANTI JOIN h USING (doc_id))
          SELECT CAST(fold AS INTEGER) AS fold, CASE WHEN own=fold THEN 'val' ELSE 'train' END AS role, count(*) AS n FROM f, (SELECT unnest(generate_series(1,3)) AS fold) s GROUP BY 1,2""",
    ),
    "NEG2": binding(neg2, f"{_M}, u AS (SELECT image, species, x, y FROM gt UNION ALL SELECT p.image, 'hard_negative', x, y FROM pred p LEFT JOIN m ON p.image=m.image AND p.id=m.pred_id WHERE m.gt_id IS NULL AND score > 0.95) SELECT concat('tile_',CAST(image AS VARCHAR),'_',CAST(CAST(floor(x/256) AS BIGINT) AS VARCHAR),'_',CAST(CAST(floor(y/256) AS BIGINT) AS VARCHAR)) AS file, species, x-floor(x/256)*256 AS x, y-floor(y/256)*256 AS y FROM u WHERE x-floor(x/256)*256>0 AND y-floor(y/256)*256>0"),
    "NEG3": binding(
        neg3,
        f"""WITH im AS (SELECT DISTINCT image FROM marks), tries AS (SELECT image, try FROM im, (SELECT unnest(generate_series(0, 99)) AS try) s),
          t AS (SELECT image, try, 50 + {drawn_sql(5, 'image', 'try')} * 900 AS x, 50 + {drawn_sql(6, 'image', 'try')} * 900 AS y FROM tries),
          p AS (SELECT image, x, y FROM marks WHERE role='gt' AND species='A'),
          near AS (SELECT DISTINCT a.image, a.try FROM t a JOIN p b ON a.image=b.image AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) <= 400),
          free AS (SELECT image, least(count(*), 5) AS n FROM t ANTI JOIN near USING (image, try) GROUP BY 1)
          SELECT im.image, coalesce(n, 0) AS n FROM im LEFT JOIN free USING (image)""",
    ),
    "NEG4": binding(neg4, f"SELECT doc_id, CASE WHEN {drawn_sql(5, 'doc_id')} < CAST(0.2 AS DOUBLE) THEN 'valid' ELSE 'train' END AS part FROM documents WHERE {drawn_sql(4, 'doc_id')} < CAST(0.3 AS DOUBLE)"),
    "REV1": binding(rev1, f"{_M}, {_UNION}, z AS (SELECT *, CAST(floor(x/256) AS BIGINT) AS tile_x, CAST(floor(y/256) AS BIGINT) AS tile_y FROM a WHERE kind IS NOT NULL AND x-floor(x/256)*256>0 AND y-floor(y/256)*256>0) SELECT image, tile_x, tile_y, " + ", ".join(f"count(*) FILTER (WHERE kind='{k}') AS {k}" for k in ("tp", "fp", "fn")) + " FROM z GROUP BY 1,2,3"),
    "REV3": binding(rev3, "SELECT image, id, image%25*10.0+x*0.25 AS wx, 100-y*0.25 AS wy FROM marks WHERE role='pred' AND score > CAST(0.9 AS DOUBLE)"),
    "GR1": binding(
        gr1,
        """WITH RECURSIVE g AS (SELECT l_orderkey, min(l_partkey) AS a, max(l_partkey) AS b FROM lineitem GROUP BY 1), e AS (SELECT a, b FROM g UNION SELECT b, a FROM g),
          r(node, root) USING KEY (node) AS (SELECT DISTINCT a, a FROM e UNION
            SELECT e.b, min(r.root) FROM r JOIN e ON r.node=e.a JOIN recurring.r AS o ON o.node=e.b WHERE r.root < o.root GROUP BY 1)
          SELECT node, root AS component FROM r""",
    ),
    "CL1": binding(cl1, f"{_dbscan('x', 'y', 40.0, 4)} SELECT image, id, coalesce(cluster, -1) AS cluster FROM found"),
    "CL2": binding(cl2, "SELECT flight, count(*) AS n, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM shots WHERE pitch <= -80 GROUP BY 1 HAVING count(*) >= 5"),
    "CL3": binding(cl3, f"{_dbscan(*_Z, 0.12, 4)} SELECT image, count(DISTINCT cluster) AS clusters, count(*) - count(cluster) AS noise FROM found GROUP BY 1"),
    "CL4": binding(cl4),
    "CL5": binding(lambda v: C.embedding_clusters(v.embeddings, 8).select("vec_id", "label", "cluster", "majority", "correct", _R("confidence").alias("confidence"))),
    "CL6": binding(lambda v: C.misclassified(C.embedding_clusters(v.embeddings, 8))),
    "CL7": binding(lambda v: C.components(v.embeddings, 3)),
    "CL7_contributions": binding(lambda v: C.contributions(v.embeddings, 3)),
    "CL9": binding(
        cl9,
        """WITH a AS (SELECT vec_id, generate_subscripts(embedding,1) AS d, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), n AS (SELECT vec_id, sqrt(sum(x*x)) AS n FROM a GROUP BY 1)
          SELECT a.vec_id AS a, b.vec_id AS b, round(sum(a.x*b.x)/(max(na.n)*max(nb.n)),5) AS cosine
          FROM a JOIN a b ON a.d=b.d AND b.vec_id % 50 = 0 JOIN n na ON na.vec_id=a.vec_id JOIN n nb ON nb.vec_id=b.vec_id GROUP BY 1,2""",
    ),
    "AGG23": binding(
        agg23,
        f"""{_dbscan_grid(*_Z, _PARAMETERS)}, k AS (SELECT image, g, count(DISTINCT cluster) AS k FROM found GROUP BY 1, 2), o AS (SELECT image, count(*) AS ref FROM marks WHERE role='pred' AND species='A' GROUP BY 1)
          SELECT grid.eps, grid.least AS min_points, count(*) AS images, round(sqrt(avg((k-ref)*(k-ref))),6) AS rmse, round(avg(abs(k-ref)),6) AS mae FROM k JOIN o ON k.image=o.image JOIN grid ON k.g=grid.g GROUP BY 1, 2""",
    ),
    "AGG36": binding(agg36, "WITH c AS (SELECT flight, avg(x) AS cx, avg(y) AS cy FROM (SELECT DISTINCT flight, x, y FROM shots) d GROUP BY 1), k AS (SELECT flight, r_regionkey, row_number() OVER (PARTITION BY flight ORDER BY (cx-r_regionkey*25.0)*(cx-r_regionkey*25.0)+(cy-r_regionkey*200.0)*(cy-r_regionkey*200.0), r_regionkey) AS n FROM c, region) SELECT shot, s.flight, r_regionkey AS island FROM shots s JOIN k ON s.flight=k.flight AND n=1"),
    "CF4": binding(cf4, f"WITH gt AS (SELECT * FROM marks WHERE role='gt'), pred AS (SELECT * FROM marks WHERE role='pred' AND score > CAST(0.85 AS DOUBLE)), {_greedy('gt', 'pred')}, e AS (SELECT image%5 AS mission, count(*) AS ref FROM gt GROUP BY 1), f AS (SELECT image%5 AS mission, count(*) AS pred FROM pred GROUP BY 1), k AS (SELECT image%5 AS mission, count(*) AS tp FROM m GROUP BY 1) SELECT e.mission, ref, pred, tp, round(ref/CAST(pred AS DOUBLE),6) AS factor FROM e JOIN f ON e.mission=f.mission JOIN k ON e.mission=k.mission"),
    "EV7": binding(
        ev7,
        f"""WITH experts AS (SELECT DISTINCT species AS expert FROM marks WHERE role='pred'), gt AS (SELECT image, id, x, y, expert FROM marks, experts WHERE role='gt'), pred AS (SELECT image, id, x, y, species AS expert FROM marks WHERE role='pred'),
          c AS (SELECT g.image, g.expert, g.id AS gt_id, p.id AS pred_id, (g.x-p.x)*(g.x-p.x)+(g.y-p.y)*(g.y-p.y) AS d2 FROM gt g JOIN pred p ON g.image=p.image AND g.expert=p.expert AND abs(g.x-p.x) <= 10 AND abs(g.y-p.y) <= 10),
          n1 AS (SELECT *, row_number() OVER (PARTITION BY image, expert, gt_id ORDER BY d2, pred_id) AS k FROM c WHERE d2 <= 100),
          n2 AS (SELECT expert, row_number() OVER (PARTITION BY image, expert, pred_id ORDER BY d2, gt_id) AS k2 FROM n1 WHERE k=1),
          t AS (SELECT e.expert, (SELECT count(*) FROM n2 WHERE k2=1 AND n2.expert=e.expert) AS tp, (SELECT count(*) FROM pred WHERE pred.expert=e.expert) AS np, (SELECT count(*) FROM gt WHERE gt.expert=e.expert) AS ng FROM experts e),
          r AS (SELECT expert, tp, np-tp AS fp, ng-tp AS fn FROM t)
          SELECT expert, {_RATES} FROM r""",
    ),
}
