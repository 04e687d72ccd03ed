"""WN*, FN1-FN8, FN30 and the mission aggregates: what is computed along ordered flights."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from aerotally.operators.quantiles import grouped_quantiles

#: Sensor width and height in mm, focal length in mm, pixels.
SENSOR_W, SENSOR_H, FOCAL, PIXELS_W, PIXELS_H = 13.2, 8.8, 10.26, 5472, 3648
COMPASS = ("N", "NE", "E", "SE", "S", "SW", "W", "NW")


def decimal_degrees(d: Column, m: Column, s: Column, ref: Column) -> Column:
    """FN1: degrees, minutes, seconds to decimal degrees; south and west are negative."""
    value = d + m / 60 + s / 3600
    return F.when(ref.isin("S", "W"), -value).otherwise(value)


def gsd(height: Column) -> tuple[Column, Column, Column]:
    """FN2: ground sampling distance in cm per pixel: width, height, mean."""
    w = SENSOR_W * height * 100 / (FOCAL * PIXELS_W)
    h = SENSOR_H * height * 100 / (FOCAL * PIXELS_H)
    return w, h, (w + h) / 2


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """FN3: initial bearing in degrees from north, geographic coordinates."""
    a, b, dl = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return F.pmod(F.degrees(F.atan2(F.sin(dl) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(dl))) + 360, F.lit(360.0))


def planar_bearing(dx: Column, dy: Column) -> Column:
    """FN3 on metres: degrees from north."""
    return F.pmod(F.degrees(F.atan2(dx, dy)) + 360, F.lit(360.0))


def compass(degrees: Column) -> Column:
    """FN4: eight sectors of 45 degrees, half-open, N centred on 0."""
    sector = F.floor(F.pmod(degrees + 22.5, F.lit(360.0)) / 45).cast("int")
    return F.when(degrees.isNotNull(), F.get(F.array(*[F.lit(c) for c in COMPASS]), sector))


def normal_angle(a: Column) -> Column:
    """FN5: to [-180, 180]; both ends stay."""
    wrapped = F.pmod(a + 180, F.lit(360.0)) - 180
    return F.when(F.abs(a) <= 180, a).otherwise(wrapped)


def overlap(course: Column, yaw: Column, width: Column, height: Column, distance: Column) -> Column:
    """FN6: struct of mode (forward, sideways, diagonal), relevant dimension and percentage, not clamped."""
    a = F.abs(normal_angle(course - yaw))
    mode = F.when((a < 30) | (a > 150), "forward").when(F.abs(a - 90) < 30, "sideways").otherwise("diagonal")
    dim = F.when(mode == "forward", height).when(mode == "sideways", width).otherwise(F.least(width, height))
    return F.struct(mode.alias("mode"), dim.alias("dimension"), ((dim - distance) / dim * 100).alias("pct"))


def forward_overlap(direction: Column, width: Column, height: Column, distance: Column) -> Column:
    """FN7: clamped at 0; E and W use the width, all others the height."""
    dim = F.when(direction.isin("E", "W"), width).otherwise(height)
    return F.greatest(F.lit(0.0), (dim - distance) / dim * 100)


def oblique(pitch: Column) -> Column:
    """FN8: pitch of -70 and above is oblique; null is nadir."""
    return F.coalesce(pitch >= -70, F.lit(False))


def finite(c: Column) -> Column:
    """FIL20: infinities and NaN become null."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def metrics(shots: DataFrame, keys: Sequence[str] = ("flight",), *, time: str = "t", order: Sequence[str] = ("t", "shot")) -> DataFrame:
    """WN1: distance, time, speed, risk, shift, ground size, course, overlap and flags against the previous shot of the flight.

    One shuffle by flight serves all of them. The first shot of a flight has
    nulls; a time difference of 0 gives a null speed.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    dx, dy, dt = (F.col(c) - F.lag(c).over(w) for c in ("x", "y", time))
    out = shots.withColumn("dx", dx).withColumn("dy", dy).withColumn("time_diff_seconds", dt)
    out = out.withColumn("distance_to_prev", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")))
    speed = F.when(F.col("time_diff_seconds") != 0, F.col("distance_to_prev") / F.col("time_diff_seconds"))
    out = out.withColumn("speed_m_per_s", speed).withColumn("risk_score", F.col("speed_m_per_s") * F.col("exposure") * 1500).withColumn("shift_mm", F.col("speed_m_per_s") * F.col("exposure") * 1000)
    out = out.withColumn("shift_pixels", F.when(F.col("gsd") > 0, F.col("shift_mm") / (F.col("gsd") * 10)))
    out = out.withColumn("ground_width_m", F.col("image_width") * F.col("gsd") / 100).withColumn("ground_height_m", F.col("image_height") * F.col("gsd") / 100)
    out = out.withColumn("bearing_to_prev", F.when(F.col("distance_to_prev") > 0, planar_bearing(F.col("dx"), F.col("dy")))).withColumn("flight_direction", compass(F.col("bearing_to_prev")))
    o = overlap(F.col("bearing_to_prev"), F.col("yaw"), F.col("ground_width_m"), F.col("ground_height_m"), F.col("distance_to_prev"))
    out = out.withColumn("_o", o).withColumn("flight_mode", F.when(F.col("bearing_to_prev").isNotNull(), F.col("_o.mode"))).withColumn("oblique", oblique(F.col("pitch")))
    pct = F.when(~F.col("oblique") & (F.col("flight_mode") != "sideways"), F.col("_o.pct"))
    return out.withColumn("forward_overlap_pct", pct).drop("_o", "dx", "dy")


def near_centre(shots: DataFrame, keys: Sequence[str], limit: float = 5000.0, cell: float = 15.0) -> DataFrame:
    """WN2: shots within ``limit`` of the centre of the flight's distinct cells; metrics aren't computed again."""
    cells = shots.select(*keys, F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy")).distinct()
    centre = cells.groupBy(*keys).agg(((F.avg("cx") + 0.5) * cell).alias("_mx"), ((F.avg("cy") + 0.5) * cell).alias("_my"))
    away = F.hypot(F.col("x") - F.col("_mx"), F.col("y") - F.col("_my"))
    return shots.join(centre, list(keys)).where(away <= limit).drop("_mx", "_my")


def path_length(shots: DataFrame, keys: Sequence[str] = ("flight",), order: Sequence[str] = ("t", "shot")) -> DataFrame:
    """WN3: sum of the distances between consecutive shots."""
    w = Window.partitionBy(*keys).orderBy(*order)
    step = F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w))
    return shots.withColumn("_d", step).groupBy(*keys).agg(F.coalesce(F.sum("_d"), F.lit(0.0)).alias("length_m"))


def route_type(courses: DataFrame, keys: Sequence[str] = ("flight",), order: Sequence[str] = ("t", "shot")) -> DataFrame:
    """WN4: corridor, zig_zag, irregular or insufficient_data from the changes of course."""
    w = Window.partitionBy(*keys).orderBy(*order)
    n = courses.groupBy(*keys).agg(F.count("*").alias("n"), F.count("bearing_to_prev").alias("n_bearings"))
    known = courses.where("bearing_to_prev is not null").withColumn("pos", F.row_number().over(w))
    turn = F.abs(F.col("bearing_to_prev") - F.lag("bearing_to_prev").over(w))
    turns = known.withColumn("_turn", F.least(turn, 360 - turn)).where("_turn > 90")
    gaps = turns.withColumn("gap", F.col("pos") - F.lag("pos").over(Window.partitionBy(*keys).orderBy("pos")))
    g = gaps.groupBy(*keys).agg(F.count("*").alias("turns"), F.stddev_pop("gap").alias("sd"), F.avg("gap").alias("mean"))
    out = n.join(g, list(keys), "left").fillna(0, ["turns"])
    kind = F.when((F.col("n") < 20) | (F.col("n_bearings") < 10), "insufficient_data").when(F.col("turns") < 5, "corridor")
    kind = kind.when((F.col("turns") > 3) & (F.col("sd") / F.greatest("mean", F.lit(1.0)) < 0.8), "zig_zag").otherwise("irregular")
    return out.select(*keys, "turns", kind.alias("route_type"))


def route_type_old(courses: DataFrame, keys: Sequence[str] = ("flight",), order: Sequence[str] = ("t", "shot")) -> DataFrame:
    """WN5: more than 15 reversals of over 120 degrees make a grid, fewer a line."""
    w = Window.partitionBy(*keys).orderBy(*order)
    turn = F.abs(F.col("bearing_to_prev") - F.lag("bearing_to_prev").over(w))
    counted = courses.withColumn("_r", F.when(F.least(turn, 360 - turn) > 120, 1).otherwise(0)).groupBy(*keys).agg(F.sum("_r").alias("reversals"))
    return counted.withColumn("route_type", F.when(F.col("reversals") > 15, "grid").otherwise("line"))


def cumulative(shots: DataFrame, value: str, name: str, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """WN6, WN10: running sum from the start of the group; nulls add nothing."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return shots.withColumn(name, F.coalesce(F.sum(value).over(w), F.lit(0.0)))


def rolling_mean(df: DataFrame, value: str, name: str, n: int, keys: Sequence[str], order: Sequence[str], *, centred: bool = False) -> DataFrame:
    """WN7 (trailing) and WN8 (centred: even windows reach n/2 back and n/2 - 1 ahead); short windows count what is there."""
    lo, hi = (-(n // 2), (n - 1) // 2) if centred else (-(n - 1), 0)
    return df.withColumn(name, F.avg(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(lo, hi)))


def frequency(df: DataFrame, *keys: str) -> DataFrame:
    """AGG1: counts and percentages (2 digits); null keys aren't counted."""
    some = df.where(" and ".join(f"{k} is not null" for k in keys)).groupBy(*keys).agg(F.count("*").alias("n"))
    total = some.agg(F.sum("n").alias("_total"))
    return some.crossJoin(F.broadcast(total)).select(*keys, "n", F.round(F.col("n") * 100 / F.col("_total"), 2).alias("pct"))  # one row


def lower_quantile_mean(df: DataFrame, value: str, keys: Sequence[str], q: float = 0.25) -> DataFrame:
    """AGG4: mean of the values at or below the interpolated quantile."""
    cut = grouped_quantiles(df, keys, F.col(value), {"_cut": q})
    return df.join(cut, list(keys)).where(F.col(value) <= F.col("_cut")).groupBy(*keys).agg(F.avg(value).alias(f"{value}_low_mean"))


_RING = T.StructType([T.StructField(c, T.ArrayType(T.DoubleType())) for c in "xy"])
_HULL = T.StructType([*[T.StructField(c, T.DoubleType()) for c in ("hull_area", "centre_x", "centre_y")], T.StructField("corners", T.LongType())])


@F.pandas_udf(_RING)
def _corners(x: pd.Series, y: pd.Series) -> pd.DataFrame:
    rings = [_hull(np.column_stack([a, b]).astype(float)) for a, b in zip(x, y)]
    return pd.DataFrame({"x": [r[:, 0] for r in rings], "y": [r[:, 1] for r in rings]})


@F.pandas_udf(_HULL)
def _measured(x: pd.Series, y: pd.Series) -> pd.DataFrame:
    out = []
    for a, b in zip(x, y):
        ring = _hull(np.column_stack([a, b]).astype(float))
        middle = ring.mean(0)
        here = ring - middle
        nxt = np.roll(here, -1, axis=0)
        cross = here[:, 0] * nxt[:, 1] - nxt[:, 0] * here[:, 1]
        area = cross.sum() / 2
        centre = middle + ((here + nxt) * cross[:, None]).sum(0) / (6 * area) if area > 0 else middle
        out.append((area, centre[0], centre[1], len(ring)))
    return pd.DataFrame(out, columns=["hull_area", "centre_x", "centre_y", "corners"])


def hull_area(points: DataFrame, keys: Sequence[str], *, most: int = 10_000) -> DataFrame:
    """AGG25: area, centroid and number of corners of the convex hull of each group's points.

    A hull without area has the middle of its corners for a centroid.

    Two levels, so that no task holds a large group: hulls of hashed chunks of
    about ``most`` points, then the hull of those hulls' corners. Small groups
    are one chunk, and many of them go to Python in one batch.
    """
    some = points.select(*keys, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("x is not null and y is not null").distinct()
    sizes = some.groupBy(*keys).agg(F.ceil(F.count("*") / most).alias("_chunks"))
    sizes = sizes.select(*[F.col(k).alias(f"_size_{i}") for i, k in enumerate(keys)], "_chunks")
    sized = some.join(sizes, [F.col(k).eqNullSafe(F.col(f"_size_{i}")) for i, k in enumerate(keys)])
    chunk = F.pmod(F.xxhash64("x", "y"), F.col("_chunks")).alias("_chunk")
    lists = sized.select(*keys, chunk, "x", "y").groupBy(*keys, "_chunk").agg(F.collect_list(F.struct("x", "y")).alias("p"))
    first = lists.select(*keys, _corners("p.x", "p.y").alias("r"))
    joined = first.groupBy(*keys).agg(F.flatten(F.collect_list(F.arrays_zip("r.x", "r.y"))).alias("p"))
    return joined.select(*keys, _measured("p.x", "p.y").alias("m")).select(*keys, "m.*")


def _hull(p: np.ndarray) -> np.ndarray:
    """Convex hull by the monotone chain, counter-clockwise; collinear corners dropped."""
    p = np.unique(p, axis=0)
    if len(p) < 3:
        return p

    def half(points: Iterator[np.ndarray]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for c in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (c[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (c[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(c)
        return out[:-1]

    return np.array(half(p) + half(p[::-1]))


def located(shots: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """FIL18: shots that aren't at the origin, where cameras without a fix put them."""
    return shots.where(~((F.col(x) == 0) & (F.col(y) == 0)))


def taken_at(text: Column) -> Column:
    """FIL18: time from either of two ways to write it, with colons or dashes in the date; null otherwise."""
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy:MM:dd HH:mm:ss")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")))


def near_median_time(shots: DataFrame, most_seconds: float, keys: Sequence[str] = ("flight",), time: str = "t") -> DataFrame:
    """FIL19: shots within so many seconds of their mission's median time."""
    mid = grouped_quantiles(shots, keys, F.col(time), {"_mid": 0.5})
    return shots.join(mid, list(keys)).where(F.abs(F.col(time) - F.col("_mid")) <= most_seconds).drop("_mid")


def shots_between(shots: DataFrame, values: dict[str, object] | None = None, ranges: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """FIL21: shots with the given values, and numbers within inclusive ranges."""
    for column, value in (values or {}).items():
        shots = shots.where(F.col(column) == F.lit(value))
    for column, (low, high) in (ranges or {}).items():
        shots = shots.where(F.col(column).between(low, high))
    return shots


def anomalous(measured: DataFrame, speed: float = 6.0, exposure: float = 1 / 1500) -> DataFrame:
    """FIL22: shots of :func:`metrics` that were taken too fast for their exposure; unknown speeds and risks count as 0."""
    known = measured.fillna(0, ["speed_m_per_s", "risk_score"])
    return known.where((F.col("speed_m_per_s") >= speed) & (F.col("exposure") >= exposure))


def epsg(zone: Column) -> Column:
    """FN11: the EPSG code of a UTM zone such as 15S."""
    number = F.regexp_extract(zone, r"^(\d+)", 1).try_cast("int")
    return F.when(F.upper(F.right(zone, F.lit(1))) == "N", 32600 + number).otherwise(32700 + number)


def to_pixel(x: Column, y: Column, ox: Column, oy: Column, px: Column, py: Column) -> tuple[Column, Column]:
    """FN9: column and row of a place, by the raster's origin and pixel size (py below zero for north-up)."""
    return ((x - ox) / px).cast("int"), ((y - oy) / py).cast("int")


def to_world(col: Column, row: Column, ox: Column, oy: Column, px: Column, py: Column) -> tuple[Column, Column]:
    """FN9: the place of a pixel's corner."""
    return ox + col * px, oy + row * py


def utm(lon: Column, lat: Column, zone: int) -> tuple[Column, Column]:
    """FN10: easting and northing (WGS 84, northern false northing 0, southern 1e7) by the Krueger series to n^3."""
    a, f = 6378137.0, 1 / 298.257223563
    n = f / (2 - f)
    big_a = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    k0, e = 0.9996, 2 * math.sqrt(n) / (1 + n)
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, c in enumerate(alpha, 1):
        east = east + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500000 + k0 * big_a * east, k0 * big_a * north + F.when(lat < 0, 1e7).otherwise(0.0)
