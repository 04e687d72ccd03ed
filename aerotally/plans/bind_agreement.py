"""Bindings of agreement, count correction, crowd statistics and calibration."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from aerotally.operators import agreement as G, annotations as A, sweep as S
from aerotally.operators.quantiles import grouped_quantiles
from aerotally.plans.views import binding

_R = lambda c, n=6: F.round(c, n)


def pairs(v):
    ref = v.consensus.select("image", F.col("n").alias("ref"))
    return v.counts.join(ref, "image").select("user_name", "image", "n", "ref")


_PAIRS = "p AS (SELECT c.user_name, c.image, c.n, k.n AS ref FROM counts c JOIN consensus k ON c.image=k.image)"
_MODE = "f AS (SELECT image, n, count(*) AS users FROM counts GROUP BY 1,2), k AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY users DESC, n) AS r FROM f)"


def ag7(v):
    agreed = G.exact_agreement(v.counts, 3).select("image")
    return v.counts.join(agreed, "image", "left_anti")


def _swept(marks):
    """Marks of all images in one space, far apart, with their place in the sweep."""
    return marks.withColumn("seq", F.col("image") * 100000 + F.col("id")).withColumn("x", F.col("x") + 5000 * F.col("image"))


def _placed(c):
    return c.select("cluster", "users", "points", _R(F.col("x") - 5000 * F.floor(F.col("cluster") / 100000)).alias("x"), _R("y").alias("y"))


def ag1(v):
    return _placed(S.sweep_agreement(_swept(v.marks.where("role = 'gt'")), 15.0, 2, user="species"))


def ag2(v):
    return _placed(S.sweep_agreement(_swept(v.marks.where("role = 'gt'")), 15.0, 1, user="species", first_only=True))


def ag3(v):
    c = S.agreement_summary(_swept(v.marks), 15.0, 2, user="species")
    return c.withColumn("avg_users", _R("avg_users")).withColumn("agreement_rate", _R("agreement_rate"))


def _sweep_sql(where: str) -> str:
    """The sweep of each image as a list of seeds that grows with its marks, and each mark's first seed (``swept``)."""
    return f"""WITH RECURSIVE p AS (SELECT image, id, x, y, species, row_number() OVER (PARTITION BY image ORDER BY id) AS i FROM marks WHERE {where}),
      s(image, i, seeds) AS (SELECT image, CAST(0 AS BIGINT), CAST([] AS STRUCT(id BIGINT, x DOUBLE, y DOUBLE)[]) FROM p WHERE i = 1
        UNION ALL SELECT p.image, p.i, CASE WHEN len(list_filter(s.seeds, lambda q: (q.x-p.x)*(q.x-p.x)+(q.y-p.y)*(q.y-p.y) <= 225)) > 0 THEN s.seeds ELSE list_append(s.seeds, struct_pack(id := p.id, x := p.x, y := p.y)) END
        FROM s JOIN p ON p.image = s.image AND p.i = s.i + 1),
      f AS (SELECT image, unnest(seeds) AS q FROM (SELECT image, arg_max(seeds, i) AS seeds FROM s GROUP BY 1) z),
      swept AS (SELECT p.image, p.id, p.x, p.y, p.species, p.image*100000+min(f.q.id) AS cluster FROM p JOIN f ON p.image = f.image AND (f.q.x-p.x)*(f.q.x-p.x)+(f.q.y-p.y)*(f.q.y-p.y) <= 225 GROUP BY p.image, p.id, p.x, p.y, p.species)"""


def ag8(v):
    p = G.pairwise(v.counts)
    return p.select("user_a", "user_b", _R("mae").alias("mae"), _R("exact_pct").alias("exact_pct"), (F.row_number().over(Window.orderBy(F.desc("mae"), "user_a", "user_b")) == 1).alias("most_disagreeing"))


def cf1(v):
    t = v.marks.groupBy("image").agg(F.count(F.when(F.col("role") == "pred", 1)).alias("pred"), F.count(F.when(F.col("role") == "gt", 1)).alias("ref"))
    return G.scaled_to_totals(t).withColumn("factor", _R("factor")).withColumn("calibrated", _R("calibrated"))


def cells(v):
    t = v.marks.withColumn("tx", F.floor(F.col("x") / 100).cast("long"))
    ref = t.where("role = 'gt'").groupBy("image", "tx").agg(F.count("*").alias("ref"))
    pred = t.where("role = 'pred'").groupBy("image", "tx").agg(F.count("*").alias("pred"), F.avg("score").alias("avg_score"))
    grid = v.marks.select("image").distinct().withColumn("tx", F.explode(F.expr("sequence(0L, 11L)")))
    return grid.join(ref, ["image", "tx"], "left").join(pred, ["image", "tx"], "left").fillna(0, ["ref", "pred", "avg_score"])


_CELLS = """t AS (SELECT *, CAST(floor(x/100) AS BIGINT) AS tx FROM marks), a AS (SELECT image, tx, count(*) AS ref FROM t WHERE role='gt' GROUP BY 1,2), b AS (SELECT image, tx, count(*) AS pred, avg(score) AS avg_score FROM t WHERE role='pred' GROUP BY 1,2),
  g AS (SELECT image, tx FROM (SELECT DISTINCT image FROM marks) i, (SELECT unnest(generate_series(0,11)) AS tx) s), c AS (SELECT g.image, g.tx, coalesce(ref,0) AS ref, coalesce(pred,0) AS pred, coalesce(avg_score,0) AS avg_score FROM g LEFT JOIN a ON g.image=a.image AND g.tx=a.tx LEFT JOIN b ON g.image=b.image AND g.tx=b.tx)"""


def jn1(v):
    return cells(v).select("image", "tx", "ref", "pred", _R("avg_score").alias("avg_score"), (F.col("pred") - F.col("ref")).alias("diff"), _R(F.when(F.col("ref") > 0, (F.col("pred") - F.col("ref")) / F.col("ref") * 100).otherwise(0.0), 4).alias("pct_diff"))


def cf2(v):
    c = cells(v)
    medians = grouped_quantiles(c, ["ref"], F.col("pred"), {"median_pred": 0.5})
    means = c.groupBy("ref").agg(F.count("*").alias("n"), _R(F.avg("avg_score")).alias("score"), _R(F.avg("pred")).alias("mean_pred"), _R(F.avg("pred") - F.col("ref")).alias("diff"))
    return means.join(medians, "ref").withColumn("median_pred", _R("median_pred"))


def cf2_pred(v):
    return cells(v).groupBy("pred").agg(F.count("*").alias("n"), _R(F.avg("avg_score")).alias("score"), _R(F.avg("ref")).alias("mean_ref"), _R(F.col("pred") - F.avg("ref")).alias("diff"))


def cf3(v):
    d = F.col("diff")
    return cf2(v).agg(_R(F.avg(F.abs(d)), 5).alias("mae"), _R(F.avg(d), 5).alias("me"), _R(F.sqrt(F.avg(d * d)), 5).alias("rmse"))


def cf5(v):
    f = G.corrections(pairs(v))
    return f.select("user_name", *[_R(c).alias(c) for c in f.columns[1:]])


def cf6(v):
    p = pairs(v)
    e = G.fit_errors(G.corrected(p, G.corrections(p)), ["user_name", "method"])
    return e.select("user_name", "method", _R("mae", 5).alias("mae"), _R("rmse", 5).alias("rmse"), _R("r2", 5).alias("r2"))


_FACTORS = """q AS (SELECT user_name, CASE WHEN sum(n)>0 THEN CAST(sum(ref) AS DOUBLE)/sum(n) ELSE 1 END AS ratio, regr_slope(ref, n) FILTER (WHERE n>0) AS slope, regr_intercept(ref, n) FILTER (WHERE n>0) AS intercept, quantile_cont(CASE WHEN n>0 THEN CAST(ref AS DOUBLE)/n END, 0.5) AS median_ratio,
  """ + ", ".join(f"CAST(sum(ref) FILTER (WHERE n>0 AND n BETWEEN {a} AND {b}) AS DOUBLE)/sum(n) FILTER (WHERE n>0 AND n BETWEEN {a} AND {b}) AS r{a}" for a, b in ((0, 2), (3, 5), (6, 10), (11, 1000))) + """ FROM p GROUP BY 1),
  f AS (SELECT user_name, ratio, slope, intercept, median_ratio, coalesce(r0,ratio) AS ratio_0, coalesce(r3,ratio) AS ratio_3, coalesce(r6,ratio) AS ratio_6, coalesce(r11,ratio) AS ratio_11 FROM q)"""
_CORRECTED = """m AS (SELECT p.user_name, image, ref, 'ratio' AS method, n*ratio AS value FROM p JOIN f ON p.user_name=f.user_name UNION ALL SELECT p.user_name, image, ref, 'linear', greatest(0, n*slope+intercept) FROM p JOIN f ON p.user_name=f.user_name
  UNION ALL SELECT p.user_name, image, ref, 'median', n*median_ratio FROM p JOIN f ON p.user_name=f.user_name
  UNION ALL SELECT p.user_name, image, ref, 'range', CASE WHEN n=0 THEN 0 WHEN n<=2 THEN n*ratio_0 WHEN n<=5 THEN n*ratio_3 WHEN n<=10 THEN n*ratio_6 WHEN n<=1000 THEN n*ratio_11 ELSE n END FROM p JOIN f ON p.user_name=f.user_name)"""
_FIT = "round(avg(abs(value-ref)),5) AS mae, round(sqrt(avg((value-ref)*(value-ref))),5) AS rmse, round(1-sum((value-ref)*(value-ref))/(var_pop(ref)*count(*)),5) AS r2"


def cf7(v):
    p = pairs(v)
    found = G.ensembles(G.corrected(p, G.corrections(p)).where("method = 'ratio'"))
    return found.select("image", *[_R(c, 5).alias(c) for c in ("mean", "weighted", "median", "best")])


def cf9(v):
    return G.method_ranks(cf6(v))


def cf10(v):
    p = pairs(v)
    fitted = G.corrections(p.where("image % 2 = 0"))
    return G.corrected(p.where("image % 2 = 1"), fitted).groupBy("method").agg(_R(F.sum("value"), 4).alias("total"))


def cf8(v):
    return G.expert_forest(pairs(v), ["A0", "A1", "N0", "N1", "R0", "R1"])


def cf11(v):
    e = G.fit_errors(pairs(v), ["user_name"], "n")
    return e.select("user_name", _R("mae").alias("mae"), _R("rmse").alias("rmse"), _R("r2").alias("r2"))


def cf12(v):
    return G.pair_totals(v.counts, "A0", "N0").withColumn("pct_a", _R("pct_a", 4)).withColumn("ratio", _R("ratio"))


def cf13(v):
    c = G.pair_agreement(v.counts, "A0", "N0")
    return c.select(*[_R(n).alias(n) if t == "double" else n for n, t in c.dtypes])


def cf14(v):
    e = F.col("n") - F.col("ref")
    return pairs(v).groupBy("user_name").agg(_R(F.avg(F.abs(e))).alias("mae"), _R(F.avg(e)).alias("me"), _R(F.stddev_pop(e)).alias("std"), F.count(F.when(e == 0, 1)).alias("exact"))


def cf15(v):
    e, r = (F.col("n") - F.col("ref")).cast("double"), F.col("ref").cast("double")
    return pairs(v).groupBy("user_name").agg(_R(F.corr(e, r)).alias("r"), _R(F.regr_slope(e, r)).alias("slope"), _R(F.regr_intercept(e, r)).alias("intercept"), _R(F.corr(F.abs(e), r)).alias("abs_r"))


def cf15_bins(v):
    e = F.col("n") - F.col("ref")
    return pairs(v).groupBy(G.count_level(F.col("ref")).alias("level")).agg(F.count("*").alias("n"), _R(F.avg(e)).alias("mean"), _R(F.stddev_samp(e)).alias("std"))


def cf16(v):
    return G.error_distribution(pairs(v)).select("user_name", *[_R(c).alias(c) for c in ("mean", "std", "median")], _R("kurtosis", 5).alias("kurtosis"))


def cf17(v):
    c = G.compensation(pairs(v))
    return c.select("user_name", "total", "ref_total", "over", "under", _R("compensation").alias("compensation"), _R("correlation").alias("correlation"))


def cf18(v):
    c = G.compensation(pairs(v))
    bias = F.col("total") / F.col("ref_total") - 1
    return c.select("user_name", _R(bias).alias("bias"), F.when(F.abs(bias) < 0.05, "balanced").when(bias > 0, "overcounts").otherwise("undercounts").alias("pattern"))


def cf19(v):
    return G.difficult_images(pairs(v)).withColumn("share", _R("share"))


def cf20(v):
    m = v.marks.groupBy((F.col("image") % 10).alias("mission")).agg(F.count(F.when((F.col("role") == "pred") & (F.col("score") > 0.85), 1)).alias("model"), F.count(F.when(F.col("role") == "gt", 1)).alias("human"))
    return m.withColumn("ratio", _R(F.col("human") / F.col("model")))


def wn10(v):
    return G.cumulative_error(pairs(v))


def wn11(v):
    return G.error_percentiles(pairs(v))


def agg18(v):
    c = v.crowd.where("user_id > 0 and marks >= 1")
    per = c.groupBy("phase", "image").agg(F.countDistinct("user_id").alias("u"))
    a = c.groupBy("phase").agg(F.countDistinct("image").alias("images"), F.countDistinct("user_id").alias("users"), F.sum("marks").alias("marks"), _R(F.avg("marks")).alias("mean_marks"), _R(F.max("t") - F.min("t"), 2).alias("seconds_live"))
    return a.join(per.groupBy("phase").agg(F.count(F.when(F.col("u") > 2, 1)).alias("over_two"), F.count(F.when(F.col("u") <= 2, 1)).alias("up_to_two")), "phase")


def agg19(v):
    return v.crowd.groupBy(F.to_date("started_at").cast("string").alias("day"), "phase").agg(F.count("*").alias("n"))


def agg20(v):
    u = v.crowd.groupBy("image", "user_id").agg(F.sum("marks").alias("n"), F.min("id").alias("first"))
    mode = u.groupBy("image", "n").agg(F.count("*").alias("f"), F.min("first").alias("first")).groupBy("image").agg(F.max_by("n", F.struct("f", -F.col("first"))).alias("mode"))
    s = u.groupBy("image").agg(F.count("*").alias("users"), _R(F.percentile("n", F.lit(0.5))).alias("median"), F.round(F.avg("n"), 4).alias("mean")).where("users > 20")
    return s.join(mode, "image")


def agg21(v):
    """The marks of an image in lists of bounded length, in order of their classifications."""
    lists = G.compacted(v.crowd.select("image", "id", F.array("user_id", "marks").alias("m")), "image", "id", "m", 500)
    return lists.select("image", "page", F.size("all").cast("long").alias("n"), F.aggregate("all", F.lit(0).cast("long"), lambda s, x: s + x).alias("checksum"))


def agg22(v):
    e = F.col("n") - F.col("ref")
    return pairs(v).groupBy("user_name").agg(F.sum("n").alias("counted"), F.sum("ref").alias("gold"), F.sum(e).alias("diff"), _R(F.sqrt(F.avg(e * e))).alias("rmse"))


def jn10(v):
    images = v.part.select(F.col("p_partkey").alias("image"), "p_name")
    return v.crowd.where("phase in ('click', 'view') and marks > 0").join(images, "image", "left").select("id", "image", F.coalesce("p_name", F.lit("")).alias("path"))


def jn11(v):
    crowd = v.crowd.groupBy("image").agg(F.sum("marks").alias("crowd"))
    return crowd.join(v.consensus.select("image", F.col("n").alias("gold")), "image", "left").fillna(0, ["gold"])


def jn13(v):
    a = v.marks.where("role = 'gt' and species = 'A'").groupBy("image").agg(F.count("*").alias("gt"))
    b = v.marks.where("role = 'pred' and score > 0.97").groupBy("image").agg(F.count("*").alias("pred"))
    return a.join(b, "image", "full_outer").fillna(0, ["gt", "pred"]).withColumn("diff", F.col("pred") - F.col("gt"))


def agg34(v):
    p = v.marks.where("score > 0.98").groupBy("image", "role").agg(F.array_join(F.sort_array(F.collect_list("id")).cast("array<string>"), ",").alias("ids"))
    return p.groupBy("image").pivot("role", ["gt", "pred"]).agg(F.first("ids"))


def agg31(v):
    s = A.detectability(v.marks.where("role = 'pred'"), "species", 0.9)
    return s.withColumn("detectable", _R("detectable")).withColumn("score", _R("score"))


def agg32(v):
    h = v.crowd.select(F.col("image").alias("epoch"), "id", F.when(F.col("marks") > 0, F.col("marks")).alias("metric"))
    per = h.groupBy("epoch").agg(F.min_by("metric", F.when(F.col("metric").isNotNull(), F.col("id"))).alias("metric"))
    return per.agg(F.max_by("epoch", F.struct("metric", -F.col("epoch"))).alias("best_epoch"), F.max("metric").alias("metric"))


def cl8(v):
    d = v.docs.select("doc_id", F.col("quality").alias("truth"), (F.col("toxic") == 0).cast("int").alias("pred"))
    kind = F.when((F.col("truth") == 1) & (F.col("pred") == 1), "TP").when((F.col("truth") == 0) & (F.col("pred") == 1), "FP").when(F.col("truth") == 1, "FN").otherwise("TN")
    return d.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


_GT = "role='gt'"

BINDINGS = {
    "AG1": binding(ag1, f"{_sweep_sql(_GT)} SELECT cluster, count(DISTINCT species) AS users, count(*) AS points, round(avg(x),6) AS x, round(avg(y),6) AS y FROM swept GROUP BY 1 HAVING count(DISTINCT species) >= 2"),
    "AG2": binding(ag2, f"{_sweep_sql(_GT)}, first AS (SELECT cluster, species, arg_min(x, id) AS x, arg_min(y, id) AS y FROM swept GROUP BY 1, 2) SELECT cluster, count(*) AS users, count(*) AS points, round(avg(x),6) AS x, round(avg(y),6) AS y FROM first GROUP BY 1"),
    "AG3": binding(
        ag3,
        f"""{_sweep_sql("true")}, c AS (SELECT cluster, count(DISTINCT species) AS u, count(*) AS n FROM swept GROUP BY 1),
          t AS (SELECT CAST(coalesce(sum(n) FILTER (WHERE u >= 2), 0) AS BIGINT) AS a, CAST(sum(n) AS BIGINT) AS n, count(*) FILTER (WHERE u >= 2) AS k, avg(u) FILTER (WHERE u >= 2) AS m, max(u) FILTER (WHERE u >= 2) AS hi, min(u) FILTER (WHERE u >= 2) AS lo FROM c)
          SELECT a AS agreement_points, n-a AS disagreement_points, n AS points, k AS locations, round(coalesce(m,0),6) AS avg_users, coalesce(hi,0) AS max_users, coalesce(lo,0) AS min_users, round(a/CAST(n AS DOUBLE),6) AS agreement_rate FROM t""",
    ),
    "AG4": binding(lambda v: G.exact_agreement(v.counts, 3), f"WITH {_MODE} SELECT image, n AS count, users FROM k WHERE r=1 AND users >= 3"),
    "AG5": binding(lambda v: G.tolerance_agreement(v.counts, 1, 4), "WITH f AS (SELECT DISTINCT image, n FROM counts), t AS (SELECT f.image, f.n AS centre, count(*) AS users FROM f JOIN counts c ON f.image=c.image AND abs(c.n-f.n) <= 1 GROUP BY 1,2), k AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY users DESC, centre) AS r FROM t) SELECT image, centre, users FROM k WHERE r=1 AND users >= 4"),
    "AG6": binding(lambda v: G.majority_agreement(v.counts), f"WITH {_MODE} SELECT image, n AS count, users, CAST(6 AS BIGINT) AS n_users, users*2 > 6 AS true_majority FROM k WHERE r=1"),
    "AG7": binding(ag7, f"WITH {_MODE} SELECT image, user_name, n FROM counts WHERE image NOT IN (SELECT image FROM k WHERE r=1 AND users >= 3)"),
    "AG8": binding(ag8, "WITH p AS (SELECT a.user_name AS user_a, b.user_name AS user_b, avg(abs(a.n-b.n)) AS mae, avg(CASE WHEN a.n=b.n THEN 1 ELSE 0 END)*100 AS e FROM counts a JOIN counts b ON a.image=b.image AND a.user_name < b.user_name GROUP BY 1,2) SELECT user_a, user_b, round(mae,6) AS mae, round(e,6) AS exact_pct, row_number() OVER (ORDER BY mae DESC, user_a, user_b)=1 AS most_disagreeing FROM p"),
    "AG9": binding(lambda v: G.disagreement(v.counts).withColumn("std", _R("std")), "SELECT image, round(stddev_pop(n),6) AS std, max(n)-min(n) AS spread, CASE WHEN max(n)=min(n) THEN 'none' WHEN max(n)-min(n) <= 2 THEN 'low' ELSE 'high' END AS level FROM counts GROUP BY 1"),
    "AGG18": binding(agg18, "WITH c AS (SELECT * FROM crowd WHERE user_id > 0 AND marks >= 1), u AS (SELECT phase, image, count(DISTINCT user_id) AS u FROM c GROUP BY 1,2), a AS (SELECT phase, count(DISTINCT image) AS images, count(DISTINCT user_id) AS users, CAST(sum(marks) AS BIGINT) AS marks, round(avg(marks),6) AS mean_marks, round(max(t)-min(t),2) AS seconds_live FROM c GROUP BY 1) SELECT a.*, (SELECT count(*) FROM u WHERE u.phase=a.phase AND u > 2) AS over_two, (SELECT count(*) FROM u WHERE u.phase=a.phase AND u <= 2) AS up_to_two FROM a"),
    "AGG19": binding(agg19, "SELECT CAST(CAST(started_at AS DATE) AS VARCHAR) AS day, phase, count(*) AS n FROM crowd GROUP BY 1,2"),
    "AGG20": binding(agg20, "WITH u AS (SELECT image, user_id, sum(marks) AS n, min(id) AS first FROM crowd GROUP BY 1,2), m AS (SELECT image, n, count(*) AS f, min(first) AS first FROM u GROUP BY 1,2), k AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY f DESC, first) AS r FROM m), s AS (SELECT image, count(*) AS users, round(median(n),6) AS median, round(avg(n),4) AS mean FROM u GROUP BY 1 HAVING count(*) > 20) SELECT s.*, CAST(k.n AS BIGINT) AS mode FROM s JOIN k ON s.image=k.image AND r=1"),
    "AGG21": binding(
        agg21,
        "WITH p AS (SELECT *, (row_number() OVER (PARTITION BY image ORDER BY id)-1)//500 AS page FROM crowd) SELECT image, CAST(page AS BIGINT) AS page, 2*count(*) AS n, CAST(sum(user_id)+sum(marks) AS BIGINT) AS checksum FROM p GROUP BY 1,2",
    ),
    "AGG22": binding(agg22, f"WITH {_PAIRS} SELECT user_name, CAST(sum(n) AS BIGINT) AS counted, CAST(sum(ref) AS BIGINT) AS gold, CAST(sum(n-ref) AS BIGINT) AS diff, round(sqrt(avg((n-ref)*(n-ref))),6) AS rmse FROM p GROUP BY 1"),
    "AGG31": binding(agg31, "SELECT species, count(*) AS n, round(avg(CASE WHEN score >= CAST(0.9 AS DOUBLE) THEN 1 ELSE 0 END),6) AS detectable, round(avg(score),6) AS score FROM marks WHERE role='pred' GROUP BY 1"),
    "AGG32": binding(agg32, "WITH h AS (SELECT image AS epoch, id, CASE WHEN marks>0 THEN marks END AS m FROM crowd), p AS (SELECT epoch, arg_min(m, id) AS metric FROM h WHERE m IS NOT NULL GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY metric DESC, epoch) AS r FROM p) SELECT epoch AS best_epoch, metric FROM k WHERE r=1"),
    "AGG34": binding(agg34, "SELECT image, string_agg(CASE WHEN role='gt' THEN CAST(id AS VARCHAR) END, ',' ORDER BY id) AS gt, string_agg(CASE WHEN role='pred' THEN CAST(id AS VARCHAR) END, ',' ORDER BY id) AS pred FROM marks WHERE score > CAST(0.98 AS DOUBLE) GROUP BY 1"),
    "CF1": binding(cf1, "WITH t AS (SELECT image, count(*) FILTER (WHERE role='pred') AS pred, count(*) FILTER (WHERE role='gt') AS ref FROM marks GROUP BY 1), f AS (SELECT CAST(sum(ref) AS DOUBLE)/sum(pred) AS factor FROM t) SELECT image, pred, ref, round(factor,6) AS factor, round(pred*factor,6) AS calibrated FROM t, f"),
    "CF2": binding(cf2, f"WITH {_CELLS} SELECT ref, count(*) AS n, round(avg(avg_score),6) AS score, round(avg(pred),6) AS mean_pred, round(median(pred),6) AS median_pred, round(avg(pred)-ref,6) AS diff FROM c GROUP BY 1"),
    "CF2_by_pred": binding(cf2_pred, f"WITH {_CELLS} SELECT pred, count(*) AS n, round(avg(avg_score),6) AS score, round(avg(ref),6) AS mean_ref, round(pred-avg(ref),6) AS diff FROM c GROUP BY 1"),
    "CF3": binding(cf3, f"WITH {_CELLS}, d AS (SELECT avg(pred)-ref AS d FROM c GROUP BY ref) SELECT round(avg(abs(d)),5) AS mae, round(avg(d),5) AS me, round(sqrt(avg(d*d)),5) AS rmse FROM d"),
    "CF5": binding(cf5, f"WITH {_PAIRS}, {_FACTORS} SELECT user_name, " + ", ".join(f"round({c},6) AS {c}" for c in ("ratio", "slope", "intercept", "median_ratio", "ratio_0", "ratio_3", "ratio_6", "ratio_11")) + " FROM f"),
    "CF6": binding(cf6, f"WITH {_PAIRS}, {_FACTORS}, {_CORRECTED} SELECT user_name, method, {_FIT} FROM m GROUP BY 1,2"),
    "CF7": binding(cf7, f"WITH {_PAIRS}, {_FACTORS}, {_CORRECTED}, c AS (SELECT * FROM m WHERE method='ratio'), e AS (SELECT user_name, avg(abs(value-ref)) AS mae, greatest(0, 1-sum((value-ref)*(value-ref))/(var_pop(ref)*count(*))) AS w FROM c GROUP BY 1), z AS (SELECT user_name, CASE WHEN sum(w) OVER () > 0 THEN w/sum(w) OVER () ELSE 1.0/count(*) OVER () END AS w, row_number() OVER (ORDER BY round(mae,9), user_name)=1 AS b FROM e) SELECT image, round(avg(value),5) AS mean, round(sum(value*w),5) AS weighted, round(median(value),5) AS median, round(max(CASE WHEN b THEN value END),5) AS best FROM c JOIN z ON c.user_name=z.user_name GROUP BY 1"),
    "CF8": binding(cf8),
    "CF9": binding(cf9, f"WITH {_PAIRS}, {_FACTORS}, {_CORRECTED}, e AS (SELECT user_name, method, {_FIT} FROM m GROUP BY 1,2) SELECT user_name, method, row_number() OVER (ORDER BY mae, user_name, method) AS by_mae, row_number() OVER (ORDER BY rmse, user_name, method) AS by_rmse, row_number() OVER (ORDER BY r2 DESC, user_name, method) AS by_r2 FROM e"),
    "CF10": binding(cf10, f"WITH a AS (SELECT c.user_name, c.image, c.n, k.n AS ref FROM counts c JOIN consensus k ON c.image=k.image), p AS (SELECT * FROM a WHERE image%2=0), {_FACTORS}, {_CORRECTED.replace('FROM p JOIN', 'FROM o p JOIN').replace('m AS (', 'o AS (SELECT * FROM a WHERE image%2=1), m AS (', 1)} SELECT method, round(sum(value),4) AS total FROM m GROUP BY 1"),
    "CF11": binding(cf11, f"WITH {_PAIRS} SELECT user_name, round(avg(abs(n-ref)),6) AS mae, round(sqrt(avg((n-ref)*(n-ref))),6) AS rmse, round(1-sum((n-ref)*(n-ref))/(var_pop(ref)*count(*)),6) AS r2 FROM p GROUP BY 1"),
    "CF12": binding(cf12, "WITH c AS (SELECT image, sum(n) FILTER (WHERE user_name='A0') AS a, sum(n) FILTER (WHERE user_name='N0') AS b FROM counts GROUP BY 1) SELECT CAST(sum(a) AS BIGINT) AS total_a, CAST(sum(b) AS BIGINT) AS total_b, round(sum(a)*100/CAST(sum(a)+sum(b) AS DOUBLE),4) AS pct_a, round(sum(a)/CAST(sum(b) AS DOUBLE),6) AS ratio, count(CASE WHEN a>0 AND b>0 THEN 1 END) AS both FROM c"),
    "CF13": binding(cf13, "WITH c AS (SELECT image, CAST(sum(n) FILTER (WHERE user_name='A0')-sum(n) FILTER (WHERE user_name='N0') AS BIGINT) AS e FROM counts GROUP BY 1) SELECT round(avg(abs(e)),6) AS mae, round(sqrt(avg(e*e)),6) AS rmse, round(avg(e),6) AS mean, round(stddev_pop(e),6) AS std, round(median(e),6) AS median, max(abs(e)) AS max, count(*) FILTER (WHERE e>0) AS over, count(*) FILTER (WHERE e<0) AS under, count(*) FILTER (WHERE e=0) AS exact, " + ", ".join(f"round(avg(CASE WHEN abs(e)<={k} THEN 1 ELSE 0 END),6) AS within_{k}" for k in (0, 1, 2, 5)) + ", round(quantile_cont(abs(e),0.95),6) AS p95 FROM c"),
    "CF14": binding(cf14, f"WITH {_PAIRS} SELECT user_name, round(avg(abs(n-ref)),6) AS mae, round(avg(n-ref),6) AS me, round(stddev_pop(n-ref),6) AS std, count(CASE WHEN n=ref THEN 1 END) AS exact FROM p GROUP BY 1"),
    "CF15": binding(cf15, f"WITH {_PAIRS} SELECT user_name, round(corr(n-ref,ref),6) AS r, round(regr_slope(n-ref,ref),6) AS slope, round(regr_intercept(n-ref,ref),6) AS intercept, round(corr(abs(n-ref),ref),6) AS abs_r FROM p GROUP BY 1"),
    "CF15_bins": binding(cf15_bins, f"WITH {_PAIRS} SELECT CASE WHEN ref<=2 THEN '0-2' WHEN ref<=5 THEN '3-5' WHEN ref<=10 THEN '6-10' ELSE '11+' END AS level, count(*) AS n, round(avg(n-ref),6) AS mean, round(stddev_samp(n-ref),6) AS std FROM p GROUP BY 1"),
    "CF16": binding(cf16, f"WITH {_PAIRS} SELECT user_name, round(avg(n-ref),6) AS mean, round(stddev_samp(n-ref),6) AS std, round(median(n-ref),6) AS median, round(kurtosis_pop(n-ref),5) AS kurtosis FROM p GROUP BY 1"),
    "CF17": binding(cf17, f"WITH {_PAIRS}, s AS (SELECT user_name, CAST(sum(n) AS BIGINT) AS total, CAST(sum(ref) AS BIGINT) AS ref_total, CAST(sum(greatest(n-ref,0)) AS BIGINT) AS over, CAST(sum(greatest(ref-n,0)) AS BIGINT) AS under, round(corr(n-ref,ref),6) AS correlation FROM p GROUP BY 1) SELECT *, round(CASE WHEN greatest(over,under)>0 THEN least(over,under)/CAST(greatest(over,under) AS DOUBLE) ELSE 0 END,6) AS compensation FROM s"),
    "CF18": binding(cf18, f"WITH {_PAIRS}, s AS (SELECT user_name, CAST(sum(n) AS DOUBLE)/sum(ref)-1 AS b FROM p GROUP BY 1) SELECT user_name, round(b,6) AS bias, CASE WHEN abs(b) < 0.05 THEN 'balanced' WHEN b > 0 THEN 'overcounts' ELSE 'undercounts' END AS pattern FROM s"),
    "CF19": binding(cf19, f"WITH {_PAIRS}, s AS (SELECT image, round(avg(CASE WHEN abs(n-ref)>=3 THEN 1 ELSE 0 END),6) AS share FROM p GROUP BY 1) SELECT * FROM s WHERE share >= 0.7"),
    "CF20": binding(cf20, "SELECT image%10 AS mission, count(*) FILTER (WHERE role='pred' AND score > CAST(0.85 AS DOUBLE)) AS model, count(*) FILTER (WHERE role='gt') AS human, round(count(*) FILTER (WHERE role='gt')/CAST(count(*) FILTER (WHERE role='pred' AND score > CAST(0.85 AS DOUBLE)) AS DOUBLE),6) AS ratio FROM marks GROUP BY 1"),
    "CL8": binding(cl8, "SELECT CASE WHEN quality=1 AND toxic=0 THEN 'TP' WHEN quality=0 AND toxic=0 THEN 'FP' WHEN quality=1 THEN 'FN' ELSE 'TN' END AS kind, count(*) AS n FROM docs GROUP BY 1"),
    "JN1": binding(jn1, f"WITH {_CELLS} SELECT image, tx, ref, pred, round(avg_score,6) AS avg_score, pred-ref AS diff, round(CASE WHEN ref>0 THEN (pred-ref)/CAST(ref AS DOUBLE)*100 ELSE 0 END,4) AS pct_diff FROM c"),
    "JN10": binding(jn10, "SELECT id, image, coalesce(p_name,'') AS path FROM crowd LEFT JOIN part ON image=p_partkey WHERE phase IN ('click','view') AND marks > 0"),
    "JN11": binding(jn11, "WITH c AS (SELECT image, CAST(sum(marks) AS BIGINT) AS crowd_n FROM crowd GROUP BY 1) SELECT c.image, crowd_n AS crowd, coalesce(n,0) AS gold FROM c LEFT JOIN consensus k ON c.image=k.image"),
    "JN13": binding(jn13, "WITH a AS (SELECT image, count(*) FILTER (WHERE role='gt' AND species='A') AS gt, count(*) FILTER (WHERE role='pred' AND score > CAST(0.97 AS DOUBLE)) AS pred FROM marks GROUP BY 1) SELECT image, gt, pred, pred-gt AS diff FROM a WHERE gt+pred > 0"),
    "WN10": binding(wn10, f"WITH {_PAIRS} SELECT user_name, image, CAST(sum(n-ref) OVER (PARTITION BY user_name ORDER BY image ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM p"),
    "WN11": binding(wn11, f"WITH {_PAIRS}, r AS (SELECT user_name, abs(n-ref) AS e, row_number() OVER (PARTITION BY user_name ORDER BY abs(n-ref), image)*100/CAST(count(*) OVER (PARTITION BY user_name) AS DOUBLE) AS pct FROM p) SELECT user_name, min(CASE WHEN pct>=50 THEN e END) AS p50, min(CASE WHEN pct>=80 THEN e END) AS p80, min(CASE WHEN pct>=95 THEN e END) AS p95 FROM r GROUP BY 1"),
}
