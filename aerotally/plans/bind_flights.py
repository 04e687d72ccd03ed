"""Bindings of flight windows, mission aggregates and their filters."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from aerotally.operators import coverage as V, flights as L
from aerotally.operators.quantiles import grouped_quantiles
from aerotally.plans.views import binding

_W = "WINDOW w AS (PARTITION BY flight ORDER BY t, shot)"
_BEAR = "CASE WHEN dist > 0 THEN ((degrees(atan2(dx, dy)) + 360) % 360 + 360) % 360 END"
_A = f"s0 AS (SELECT *, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy, t - lag(t) OVER w AS dt FROM shots {_W}), s1 AS (SELECT *, sqrt(dx*dx+dy*dy) AS dist FROM s0), s2 AS (SELECT *, {_BEAR} AS b, CASE WHEN dt <> 0 THEN dist/dt END AS speed FROM s1)"


def _r(c, n=6):
    return F.round(c, n)


def wn1(v):
    m = L.metrics(v.shots)
    return m.select("shot", _r("distance_to_prev").alias("distance_to_prev"), _r("time_diff_seconds", 3).alias("dt"), _r("speed_m_per_s", 4).alias("speed"), _r("risk_score", 4).alias("risk"), _r("shift_pixels", 3).alias("shift_px"), _r("ground_width_m").alias("gw"), _r("bearing_to_prev", 4).alias("bearing"), "flight_direction", "flight_mode", "oblique", _r("forward_overlap_pct", 3).alias("overlap"))


_WN1 = f"""WITH {_A}, s3 AS (SELECT *, image_width*gsd/100 AS gw, image_height*gsd/100 AS gh,
    CASE WHEN abs(b-yaw) <= 180 THEN abs(b-yaw) ELSE abs(((b-yaw+180) % 360 + 360) % 360 - 180) END AS a FROM s2),
  s4 AS (SELECT *, CASE WHEN b IS NULL THEN NULL WHEN a < 30 OR a > 150 THEN 'forward' WHEN abs(a-90) < 30 THEN 'sideways' ELSE 'diagonal' END AS mode FROM s3)
  SELECT shot, round(dist,6) AS distance_to_prev, round(dt,3) AS dt, round(speed,4) AS speed, round(speed*exposure*1500,4) AS risk, round(speed*exposure*1000/(gsd*10),3) AS shift_px, round(gw,6) AS gw, round(b,4) AS bearing,
    CASE CAST(floor((b+22.5) % 360 / 45) AS INTEGER) WHEN 0 THEN 'N' WHEN 1 THEN 'NE' WHEN 2 THEN 'E' WHEN 3 THEN 'SE' WHEN 4 THEN 'S' WHEN 5 THEN 'SW' WHEN 6 THEN 'W' WHEN 7 THEN 'NW' END AS flight_direction,
    mode AS flight_mode, pitch >= -70 AS oblique, CASE WHEN pitch < -70 AND mode = 'forward' THEN round((gh-dist)/gh*100,3) WHEN pitch < -70 AND mode = 'diagonal' THEN round((least(gw,gh)-dist)/least(gw,gh)*100,3) END AS overlap FROM s4"""


def wn2(v):
    return L.near_centre(v.shots, ["flight"], 400.0).select("shot", "flight")


def wn3(v):
    return L.path_length(v.shots).select("flight", _r("length_m", 4).alias("length_m"))


def wn4(v):
    return L.route_type(L.metrics(v.shots))


def wn5(v):
    return L.route_type_old(L.metrics(v.shots))


def wn6(v):
    m = L.cumulative(L.metrics(v.shots), "distance_to_prev", "total", ["flight"], ["t", "shot"])
    return m.select("shot", _r("total", 3).alias("total"))


def wn7(v):
    return L.rolling_mean(v.shots, "height", "smooth", 5, ["flight"], ["t", "shot"]).select("shot", _r("smooth").alias("smooth"))


def wn8(v):
    return L.rolling_mean(v.shots, "height", "smooth", 6, ["flight"], ["t", "shot"], centred=True).select("shot", _r("smooth").alias("smooth"))


def wn9(v):
    m = L.rolling_mean(L.cumulative(L.metrics(v.shots), "distance_to_prev", "total", ["flight"], ["t", "shot"]), "height", "smooth", 5, ["flight"], ["t", "shot"])
    return m.groupBy("flight").agg(_r(F.max("smooth")).alias("peak"), F.max_by("shot", F.struct(F.round("smooth", 9), -F.col("shot"))).alias("peak_shot"), _r(F.avg("smooth"), 3).alias("mean"), _r(F.max("total"), 3).alias("total"))


def agg1(v):
    return L.frequency(v.shots, "expedition", "program")


def agg2(v):
    s = v.shots.groupBy("drone").agg(F.min(F.to_date("ts")).cast("string").alias("first_day"), F.count("*").alias("n"))
    total = s.agg(F.sum("n").alias("t"))
    return s.crossJoin(F.broadcast(total)).select("drone", "first_day", "n", F.round(F.col("n") * 100 / F.col("t"), 2).alias("pct"))


def agg3(v):
    by = ["expedition", "island"]
    m = L.metrics(v.once("shots"))
    means = m.groupBy(*by).agg(F.count("*").alias("n"), *[_r(F.avg(c), 4).alias(c) for c in ("height", "gsd", "exposure")], _r(F.avg("distance_to_prev"), 4).alias("step"), F.array_join(F.array_sort(F.collect_set("program")), ",").alias("programs"))
    return means.join(grouped_quantiles(m, by, F.col("forward_overlap_pct"), {"overlap": 0.5}), by, "left").withColumn("overlap", _r(F.col("overlap"), 2))


def agg4(v):
    return L.lower_quantile_mean(v.shots, "height", ["flight"]).select("flight", _r("height_low_mean").alias("low"))


def agg5(v):
    s = v.shots.withColumn("year", F.year("ts"))
    return s.groupingSets([[F.col("expedition"), F.col("island")], [F.col("island"), F.col("year")], [F.col("year")]], "expedition", "island", "year").agg(F.count("*").alias("n"), _r(F.avg("height")).alias("height"))


def agg6(v):
    """Mission facts of flights with at least 10 shots."""
    m = L.metrics(v.shots)
    return m.groupBy("flight").agg(F.count("*").alias("n"), _r(F.sum("distance_to_prev"), 3).alias("length"), _r(F.max("t") - F.min("t"), 3).alias("duration"), _r(F.avg(F.col("oblique").cast("int"))).alias("oblique_share")).where("n >= 10").withColumn("survey_type", F.when(F.col("oblique_share") > 0.5, "oblique").otherwise("nadir"))


def agg6_mode(v):
    n = v.shots.groupBy("flight", "drone").agg(F.count("*").alias("n"))
    return n.groupBy("flight").agg(F.max_by("drone", F.struct("n", F.lit(0) - F.substring("drone", 2, 9).cast("int"))).alias("drone"))


def agg7(v):
    m = L.metrics(v.shots).where("shift_pixels is not null")
    b = F.when(F.col("shift_pixels") <= 0.0001, "a").when(F.col("shift_pixels") <= 0.001, "b").when(F.col("shift_pixels") <= 0.01, "c").otherwise("d")
    return m.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.min_by("name", F.struct("t", "shot")).alias("first_name"), _r(F.avg("height"), 4).alias("height"))


def agg8(v):
    m = v.shots.groupBy("flight").agg(F.avg(L.oblique(F.col("pitch")).cast("int")).alias("o"))
    return m.select("flight", F.when(F.col("o") > 0.5, "oblique").otherwise("nadir").alias("mission_type"))


def agg9(v):
    return v.shots.groupBy("flight").agg(_r(F.max("t") - F.min("t"), 3).alias("duration"))


def agg10(v):
    return v.shots.groupBy(F.to_date(F.date_trunc("month", F.col("ts"))).cast("string").alias("month")).pivot("drone", ["D0", "D1", "D2", "D3"]).count().fillna(0)


def agg24(v):
    m = V.mission_lines(v.once("shots"))
    return m.select("flight", "images", _r("duration", 3).alias("duration"), _r("mean_height").alias("mean_height"), _r("length", 3).alias("length"), _r("buffer_area", 3).alias("buffer_area"))


def agg24_lines(v):
    return V.path_pages(v.shots, ["flight"], [F.col("t"), F.col("shot")], 50).select("flight", "page", "n", V.line_text(F.col("line")).alias("line"))


def agg25(v):
    m = V.mission_statistics(v.once("shots"))
    return m.select("flight", _r("mean_height").alias("mean_height"), _r("path_length", 2).alias("path_length"), *[_r(c, 3).alias(c) for c in ("first_time", "last_time", "duration", "hull_area", "centre_x", "centre_y")], "corners")


#: Area of a union of discs by its edge: of each circle the arcs that no other disc covers, by Green's theorem.
_UNION_AREA = """c AS (SELECT flight, x, y, row_number() OVER () AS i FROM (SELECT DISTINCT flight, x, y FROM shots) q),
  n AS (SELECT a.i, atan2(b.y-a.y, b.x-a.x) AS phi, acos(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))/30) AS half FROM c a JOIN c b ON a.flight=b.flight AND a.i<>b.i AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) < 900),
  w AS (SELECT i, CASE WHEN phi-half < 0 THEN phi-half+2*pi() ELSE phi-half END AS lo, 2*half AS span FROM n),
  o AS (SELECT i, lo, least(lo+span, 2*pi()) AS hi FROM w UNION ALL SELECT i, 0, lo+span-2*pi() FROM w WHERE lo+span > 2*pi() UNION ALL SELECT i, 2*pi(), 2*pi() FROM c),
  g AS (SELECT i, lo AS b, coalesce(max(hi) OVER (PARTITION BY i ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM o),
  area AS (SELECT flight, sum((225*(b-a) + 15*(x*(sin(b)-sin(a)) - y*(cos(b)-cos(a))))/2) AS area FROM g JOIN c ON g.i=c.i WHERE b > a GROUP BY 1)"""

#: A hull's edges: ordered pairs of places that have all others on their left, or on the line between them.
_HULL = """d AS (SELECT DISTINCT flight, x, y FROM shots),
  e AS (SELECT p.flight, p.x AS px, p.y AS py, q.x AS qx, q.y AS qy FROM d p JOIN d q ON p.flight=q.flight AND (p.x<>q.x OR p.y<>q.y)),
  h AS (SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM d k WHERE k.flight=e.flight AND ((qx-px)*(k.y-py)-(qy-py)*(k.x-px) < 0 OR ((qx-px)*(k.y-py)-(qy-py)*(k.x-px) = 0 AND ((k.x-px)*(k.x-qx)+(k.y-py)*(k.y-qy)) > 0)))),
  hull AS (SELECT flight, sum(px*qy-qx*py)/2 AS area, sum((px+qx)*(px*qy-qx*py))/6 AS mx, sum((py+qy)*(px*qy-qx*py))/6 AS my, count(*) AS corners FROM h GROUP BY 1)"""


def agg26(v):
    per = L.metrics(v.shots).groupBy("expedition", "flight").agg(F.sum("distance_to_prev").alias("d"), (F.max("t") - F.min("t")).alias("s"), F.count("*").alias("n"))
    return per.groupBy("expedition").agg(F.count("*").alias("flights"), F.sum("n").alias("images"), _r(F.sum("d"), 2).alias("distance"), _r(F.sum("s"), 2).alias("duration"))


def fil18(v):
    text = F.when(F.col("shot") % 2 == 0, F.date_format("ts", "yyyy:MM:dd HH:mm:ss")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return L.located(v.shots).select("shot", L.taken_at(text).cast("string").alias("taken"))


def fil19(v):
    return L.near_median_time(v.shots, 17 * 3600).select("shot", "flight")


def fil20(v):
    return v.shots.where("program <> 'error'").select("shot", L.finite(F.when(F.col("seq") % 7 == 0, F.lit(float("inf"))).otherwise(F.col("x"))).alias("x"))


def fil21(v):
    return L.shots_between(v.shots, {"expedition": "E1"}, {"height": (40, 60)}).select("shot", "flight", "height")


def fil22(v):
    return L.anomalous(L.metrics(v.shots), speed=0.05).select("shot", _r("risk_score", 5).alias("risk"))


def fn1(v):
    c = F.col
    return v.shots.select("shot", _r(L.decimal_degrees(c("seq") % 90, c("seq") % 60, c("seq") % 50, F.when(c("seq") % 3 == 0, "S").otherwise("N")), 9).alias("lat"))


def fn2(v):
    w, h, a = L.gsd(F.col("height"))
    return v.shots.select("shot", _r(w).alias("w"), _r(h).alias("h"), _r(a).alias("a"))


def fn3(v):
    return v.shots.select("shot", (_r(L.bearing(F.col("y") / 20, F.col("x") / 10, F.col("y") / 20 + 1, F.col("x") / 10 + F.col("seq") % 7 - 3), 5) % 360).alias("bearing"))


def fn4(v):
    return v.shots.select("shot", L.compass(F.col("yaw")).alias("direction"))


def fn5(v):
    return v.shots.select("shot", L.normal_angle(F.col("yaw") * 2 + F.col("pitch")).alias("a"))


def fn6(v):
    o = L.overlap(F.col("yaw") + 180, F.col("yaw") * 0.5, F.lit(100.0), F.lit(60.0), F.col("x"))
    return v.shots.select("shot", o.alias("o")).select("shot", "o.mode", "o.dimension", _r("o.pct").alias("pct"))


def fn7(v):
    return v.shots.select("shot", _r(L.forward_overlap(L.compass(F.col("yaw")), F.lit(100.0), F.lit(60.0), F.col("x"))).alias("pct"))


def fn8(v):
    return v.shots.select("shot", L.oblique(F.col("pitch")).alias("oblique"))


def fn10(v):
    lon, lat = F.lit(-91.0) + F.col("x") / 200, F.lit(-0.5) - F.col("y") / 2000
    e, n = L.utm(lon, lat, 15)
    return v.shots.select("shot", _r(e, 3).alias("easting"), _r(n, 3).alias("northing"))


def fn30(v):
    s = v.shots.groupBy("flight").agg(*[f(c).alias(f"{k}_{c}") for c in ("x", "y") for k, f in (("min", F.min), ("max", F.max))])
    dx, dy = (F.col("max_x") - F.col("min_x")) * 0.1, (F.col("max_y") - F.col("min_y")) * 0.1
    return s.select("flight", _r(F.col("min_x") - dx).alias("x1"), _r(F.col("min_y") - dy).alias("y1"), _r(F.col("max_x") + dx).alias("x2"), _r(F.col("max_y") + dy).alias("y2"))


def fn31(v):
    h = F.col("height")
    return v.shots.groupBy(F.when(h <= 40, "low").when(h <= 60, "middle").when(h <= 80, "high").otherwise("top").alias("band")).agg(F.count("*").alias("n"))


def fn32(v):
    return v.shots.groupBy("island").agg(F.bround(F.avg("height"), 1).alias("height"), F.array_join(F.array_sort(F.collect_set("expedition")), ", ").alias("expeditions"))


_GSDW, _GSDH = "13.2*height*100/(10.26*5472)", "8.8*height*100/(10.26*3648)"
_DBL = lambda s: s.replace("13.2", "CAST(13.2 AS DOUBLE)").replace("8.8", "CAST(8.8 AS DOUBLE)").replace("10.26", "CAST(10.26 AS DOUBLE)")
_DIR = "CASE CAST(floor((yaw + 22.5 + 360) % 360 / 45) AS INTEGER) WHEN 0 THEN 'N' WHEN 1 THEN 'NE' WHEN 2 THEN 'E' WHEN 3 THEN 'SE' WHEN 4 THEN 'S' WHEN 5 THEN 'SW' WHEN 6 THEN 'W' WHEN 7 THEN 'NW' END"

def _utm_sql() -> str:
    """FN10 in SQL: the same series, term by term, for zone 15 and southern latitudes."""
    a, f = 6378137.0, 1 / 298.257223563
    n = f / (2 - f)
    big_a = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)
    num = lambda x: f"CAST({x!r} AS DOUBLE)"
    east = "eta" + "".join(f" + {num(c)}*cos({2 * j}*xi)*sinh({2 * j}*eta)" for j, c in enumerate(alpha, 1))
    north = "xi" + "".join(f" + {num(c)}*sin({2 * j}*xi)*cosh({2 * j}*eta)" for j, c in enumerate(alpha, 1))
    return f"""WITH p AS (SELECT shot, radians(-CAST(0.5 AS DOUBLE) - y/2000) AS phi, radians(-CAST(91 AS DOUBLE) + x/200 + 93) AS lam, -CAST(0.5 AS DOUBLE) - y/2000 AS lat FROM shots),
      t AS (SELECT *, sinh(atanh(sin(phi)) - {num(e)}*atanh({num(e)}*sin(phi))) AS t FROM p),
      q AS (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam)/sqrt(1+t*t)) AS eta FROM t)
      SELECT shot, round(500000 + {num(0.9996 * big_a)}*({east}), 3) AS easting, round({num(0.9996 * big_a)}*({north}) + CASE WHEN lat < 0 THEN 10000000 ELSE 0 END, 3) AS northing FROM q"""


BINDINGS = {
    "WN1": binding(wn1, _WN1),
    "WN2": binding(wn2, "WITH c AS (SELECT flight, (avg(cx)+0.5)*15 AS mx, (avg(cy)+0.5)*15 AS my FROM (SELECT DISTINCT flight, floor(x/15) AS cx, floor(y/15) AS cy FROM shots) d GROUP BY 1) SELECT shot, s.flight FROM shots s JOIN c ON s.flight=c.flight WHERE sqrt((x-mx)*(x-mx)+(y-my)*(y-my)) <= 400"),
    "WN3": binding(wn3, f"WITH {_A} SELECT flight, round(coalesce(sum(dist),0),4) AS length_m FROM s1 GROUP BY 1"),
    "WN4": binding(wn4, f"""WITH {_A}, n AS (SELECT flight, count(*) AS n, count(b) AS nb FROM s2 GROUP BY 1), k AS (SELECT flight, t, shot, b, row_number() OVER w AS pos, abs(b - lag(b) OVER w) AS d FROM s2 WHERE b IS NOT NULL {_W}),
      u AS (SELECT flight, pos, pos - lag(pos) OVER (PARTITION BY flight ORDER BY pos) AS gap FROM k WHERE least(d, 360-d) > 90), g AS (SELECT flight, count(*) AS turns, stddev_pop(gap) AS sd, avg(gap) AS mean FROM u GROUP BY 1)
      SELECT n.flight, coalesce(turns,0) AS turns, CASE WHEN n < 20 OR nb < 10 THEN 'insufficient_data' WHEN coalesce(turns,0) < 5 THEN 'corridor' WHEN turns > 3 AND sd/greatest(mean,1) < 0.8 THEN 'zig_zag' ELSE 'irregular' END AS route_type FROM n LEFT JOIN g ON n.flight=g.flight"""),
    "WN5": binding(wn5, f"WITH {_A}, k AS (SELECT flight, abs(b - lag(b) OVER w) AS d FROM s2 {_W}), r AS (SELECT flight, count(CASE WHEN least(d,360-d) > 120 THEN 1 END) AS reversals FROM k GROUP BY 1) SELECT flight, reversals, CASE WHEN reversals > 15 THEN 'grid' ELSE 'line' END AS route_type FROM r"),
    "WN6": binding(wn6, f"WITH {_A} SELECT shot, round(coalesce(sum(dist) OVER (PARTITION BY flight ORDER BY t, shot ROWS UNBOUNDED PRECEDING),0),3) AS total FROM s1"),
    "WN7": binding(wn7, "SELECT shot, round(avg(height) OVER (PARTITION BY flight ORDER BY t, shot ROWS BETWEEN 4 PRECEDING AND CURRENT ROW),6) AS smooth FROM shots"),
    "WN8": binding(wn8, "SELECT shot, round(avg(height) OVER (PARTITION BY flight ORDER BY t, shot ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING),6) AS smooth FROM shots"),
    "WN9": binding(wn9, f"""WITH {_A}, k AS (SELECT flight, shot, sum(dist) OVER (PARTITION BY flight ORDER BY t, shot ROWS UNBOUNDED PRECEDING) AS total, avg(height) OVER (PARTITION BY flight ORDER BY t, shot ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS s FROM s1),
      q AS (SELECT *, row_number() OVER (PARTITION BY flight ORDER BY round(s,9) DESC, shot) AS n FROM k) SELECT flight, round(max(s),6) AS peak, max(CASE WHEN n=1 THEN shot END) AS peak_shot, round(avg(s),3) AS mean, round(coalesce(max(total),0),3) AS total FROM q GROUP BY 1"""),
    "AGG1": binding(agg1, "SELECT expedition, program, count(*) AS n, round(count(*)*100/CAST((SELECT count(*) FROM shots) AS DOUBLE),2) AS pct FROM shots GROUP BY 1,2"),
    "AGG2": binding(agg2, "SELECT drone, CAST(min(CAST(ts AS DATE)) AS VARCHAR) AS first_day, count(*) AS n, round(count(*)*100/CAST((SELECT count(*) FROM shots) AS DOUBLE),2) AS pct FROM shots GROUP BY 1"),
    "AGG3": binding(agg3, _WN1.replace("SELECT shot, round(dist", "SELECT * FROM (SELECT expedition, island, height, gsd, exposure, program, shot, dist, round(dist").replace("FROM s4", "FROM s4) q").replace("SELECT * FROM (SELECT expedition", "SELECT expedition, island, count(*) AS n, round(avg(height),4) AS height, round(avg(gsd),4) AS gsd, round(avg(exposure),4) AS exposure, round(avg(dist),4) AS step, round(quantile_cont(overlap,0.5),2) AS overlap, string_agg(DISTINCT program, ',' ORDER BY program) AS programs FROM (SELECT expedition") + " GROUP BY expedition, island"),
    "AGG4": binding(agg4, "WITH c AS (SELECT flight, quantile_cont(height,0.25) AS q FROM shots GROUP BY 1) SELECT s.flight, round(avg(height),6) AS low FROM shots s JOIN c ON s.flight=c.flight WHERE height <= q GROUP BY 1"),
    "AGG5": binding(agg5, "WITH s AS (SELECT *, year(ts) AS year FROM shots) SELECT expedition, island, year, count(*) AS n, round(avg(height),6) AS height FROM s GROUP BY GROUPING SETS ((expedition, island), (island, year), (year))"),
    "AGG6": binding(agg6, f"WITH {_A}, k AS (SELECT flight, count(*) AS n, round(sum(dist),3) AS length, round(max(t)-min(t),3) AS duration, round(avg(CASE WHEN pitch >= -70 THEN 1.0 ELSE 0.0 END),6) AS oblique_share FROM s1 GROUP BY 1) SELECT *, CASE WHEN oblique_share > 0.5 THEN 'oblique' ELSE 'nadir' END AS survey_type FROM k WHERE n >= 10"),
    "AGG6_drone": binding(agg6_mode, "WITH n AS (SELECT flight, drone, count(*) AS n FROM shots GROUP BY 1,2), k AS (SELECT *, row_number() OVER (PARTITION BY flight ORDER BY n DESC, drone) AS r FROM n) SELECT flight, drone FROM k WHERE r = 1"),
    "AGG7": binding(agg7, f"WITH {_A}, k AS (SELECT *, speed*exposure*1000/(gsd*10) AS px FROM s2), q AS (SELECT *, CASE WHEN px <= 0.0001 THEN 'a' WHEN px <= 0.001 THEN 'b' WHEN px <= 0.01 THEN 'c' ELSE 'd' END AS bin FROM k WHERE px IS NOT NULL), z AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY t, shot) AS n FROM q) SELECT bin, count(*) AS n, max(CASE WHEN n=1 THEN name END) AS first_name, round(avg(height),4) AS height FROM z GROUP BY 1"),
    "AGG8": binding(agg8, "SELECT flight, CASE WHEN avg(CASE WHEN pitch >= -70 THEN 1 ELSE 0 END) > 0.5 THEN 'oblique' ELSE 'nadir' END AS mission_type FROM shots GROUP BY 1"),
    "AGG9": binding(agg9, "SELECT flight, round(max(t)-min(t),3) AS duration FROM shots GROUP BY 1"),
    "AGG10": binding(agg10, "SELECT CAST(CAST(date_trunc('month', ts) AS DATE) AS VARCHAR) AS month, " + ", ".join(f"count(*) FILTER (WHERE drone='D{i}') AS D{i}" for i in range(4)) + " FROM shots GROUP BY 1"),
    "AGG24": binding(
        agg24,
        f"WITH {_A}, {_UNION_AREA}, k AS (SELECT flight, count(*) AS images, round(max(t)-min(t),3) AS duration, round(avg(height),6) AS mean_height, round(coalesce(sum(dist),0),3) AS length FROM s1 GROUP BY 1) SELECT k.*, round(area,3) AS buffer_area FROM k JOIN area ON k.flight=area.flight",
    ),
    "AGG24_lines": binding(
        agg24_lines,
        """WITH n AS (SELECT flight, x, y, row_number() OVER (PARTITION BY flight ORDER BY t, shot)-1 AS n, count(*) OVER (PARTITION BY flight) AS size FROM shots),
          l AS (SELECT flight, n//50 AS page, n, x, y FROM n UNION ALL SELECT flight, n//50+1, n, x, y FROM n WHERE n%50=49 AND n+1 < size)
          SELECT flight, page, count(*) AS n, concat('LINESTRING (', string_agg(concat(x, ' ', y), ', ' ORDER BY n), ')') AS line FROM l GROUP BY 1, 2""",
    ),
    "AGG25": binding(
        agg25,
        f"""WITH {_A}, {_HULL}, k AS (SELECT flight, round(avg(height),6) AS mean_height, round(coalesce(sum(dist),0),2) AS path_length, round(min(t),3) AS first_time, round(max(t),3) AS last_time, round(max(t)-min(t),3) AS duration FROM s1 GROUP BY 1)
          SELECT k.*, round(area,3) AS hull_area, round(mx/area,3) AS centre_x, round(my/area,3) AS centre_y, corners FROM k JOIN hull ON k.flight=hull.flight""",
    ),
    "AGG26": binding(agg26, f"WITH {_A}, p AS (SELECT expedition, flight, sum(dist) AS d, max(t)-min(t) AS s, count(*) AS n FROM s1 GROUP BY 1,2) SELECT expedition, count(*) AS flights, CAST(sum(n) AS BIGINT) AS images, round(sum(d),2) AS distance, round(sum(s),2) AS duration FROM p GROUP BY 1"),
    "FIL18": binding(fil18, "SELECT shot, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS taken FROM shots WHERE NOT (x = 0 AND y = 0)"),
    "FIL19": binding(fil19, "WITH m AS (SELECT flight, quantile_cont(t,0.5) AS mid FROM shots GROUP BY 1) SELECT shot, s.flight FROM shots s JOIN m ON s.flight=m.flight WHERE abs(t-mid) <= 61200"),
    "FIL20": binding(fil20, "SELECT shot, CASE WHEN seq % 7 = 0 THEN NULL ELSE x END AS x FROM shots WHERE program <> 'error'"),
    "FIL21": binding(fil21, "SELECT shot, flight, height FROM shots WHERE expedition='E1' AND height BETWEEN 40 AND 60"),
    "FIL22": binding(fil22, f"WITH {_A} SELECT shot, round(coalesce(speed*exposure*1500,0),5) AS risk FROM s2 WHERE coalesce(speed,0) >= CAST(0.05 AS DOUBLE) AND exposure >= 1/CAST(1500 AS DOUBLE)"),
    "FN1": binding(fn1, "SELECT shot, round((CASE WHEN seq%3=0 THEN -1 ELSE 1 END)*(seq%90+(seq%60)/CAST(60 AS DOUBLE)+(seq%50)/CAST(3600 AS DOUBLE)),9) AS lat FROM shots"),
    "FN2": binding(fn2, _DBL(f"SELECT shot, round({_GSDW},6) AS w, round({_GSDH},6) AS h, round(({_GSDW}+{_GSDH})/2,6) AS a FROM shots")),
    "FN3": binding(fn3, "WITH p AS (SELECT shot, radians(y/20) AS a, radians(y/20+1) AS b, radians(CAST(seq%7-3 AS DOUBLE)) AS d FROM shots) SELECT shot, round((degrees(atan2(sin(d)*cos(b), cos(a)*sin(b)-sin(a)*cos(b)*cos(d)))+360)%360,5)%360 AS bearing FROM p"),
    "FN4": binding(fn4, f"SELECT shot, {_DIR} AS direction FROM shots"),
    "FN5": binding(fn5, "WITH p AS (SELECT shot, yaw*2+pitch AS a FROM shots) SELECT shot, CASE WHEN abs(a) <= 180 THEN a ELSE ((a+180)%360+360)%360-180 END AS a FROM p"),
    "FN6": binding(fn6, "WITH p AS (SELECT shot, x, yaw+180-yaw*0.5 AS d FROM shots), q AS (SELECT *, CASE WHEN abs(d) <= 180 THEN abs(d) ELSE abs(((d+180)%360+360)%360-180) END AS a FROM p), r AS (SELECT shot, x, CASE WHEN a<30 OR a>150 THEN 'forward' WHEN abs(a-90)<30 THEN 'sideways' ELSE 'diagonal' END AS mode FROM q), s AS (SELECT *, CAST(CASE WHEN mode='sideways' THEN 100 ELSE 60 END AS DOUBLE) AS dimension FROM r) SELECT shot, mode, dimension, round((dimension-x)/dimension*100,6) AS pct FROM s"),
    "FN7": binding(fn7, f"WITH p AS (SELECT shot, x, CAST(CASE WHEN {_DIR} IN ('E','W') THEN 100 ELSE 60 END AS DOUBLE) AS d FROM shots) SELECT shot, round(greatest(0,(d-x)/d*100),6) AS pct FROM p"),
    "FN8": binding(fn8, "SELECT shot, pitch >= -70 AS oblique FROM shots"),
    "FN10": binding(fn10, _utm_sql()),
    "FN30": binding(fn30, "WITH s AS (SELECT flight, min(x) AS a, max(x) AS b, min(y) AS c, max(y) AS d FROM shots GROUP BY 1) SELECT flight, round(a-(b-a)*0.1,6) AS x1, round(c-(d-c)*0.1,6) AS y1, round(b+(b-a)*0.1,6) AS x2, round(d+(d-c)*0.1,6) AS y2 FROM s"),
    "FN31": binding(fn31, "SELECT CASE WHEN height <= 40 THEN 'low' WHEN height <= 60 THEN 'middle' WHEN height <= 80 THEN 'high' ELSE 'top' END AS band, count(*) AS n FROM shots GROUP BY 1"),
    "FN32": binding(fn32, "SELECT island, round_even(avg(height),1) AS height, string_agg(DISTINCT expedition, ', ' ORDER BY expedition) AS expeditions FROM shots GROUP BY 1"),
}
