"""Geodesy and angles as Column expressions. Angles in radians unless the name says deg."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# WGS84.
WGS84_A = 6378137.0
WGS84_F = 1.0 / 298.257223563
WGS84_E2 = 2 * WGS84_F - WGS84_F**2
MAX_ABS_Z_M = 2500.0
TWO_PI = 2 * math.pi


def prime_vertical_radius(lat: Column) -> Column:
    return WGS84_A / F.sqrt(1.0 - WGS84_E2 * F.sin(lat) * F.sin(lat))


def geodetic_to_ecef(lat_deg: Column, lon_deg: Column, h: Column) -> Column:
    """STRUCT<x, y, z> of ellipsoidal coordinates."""
    lat, lon = F.radians(lat_deg), F.radians(lon_deg)
    n = prime_vertical_radius(lat)
    return F.struct(
        ((n + h) * F.cos(lat) * F.cos(lon)).alias("x"),
        ((n + h) * F.cos(lat) * F.sin(lon)).alias("y"),
        ((n * (1.0 - WGS84_E2) + h) * F.sin(lat)).alias("z"),
    )


def geodetic_to_enu(lat_deg: Column, lon_deg: Column, h: Column, lat0: Column, lon0: Column, h0: Column) -> Column:
    """STRUCT<x, y, z>: east, north, up of a point in the tangent frame at (lat0, lon0, h0)."""
    p, o = geodetic_to_ecef(lat_deg, lon_deg, h), geodetic_to_ecef(lat0, lon0, h0)
    dx, dy, dz = p["x"] - o["x"], p["y"] - o["y"], p["z"] - o["z"]
    sp, cp, sl, cl = F.sin(F.radians(lat0)), F.cos(F.radians(lat0)), F.sin(F.radians(lon0)), F.cos(F.radians(lon0))
    return F.struct(
        (-sl * dx + cl * dy).alias("x"),
        (-sp * cl * dx - sp * sl * dy + cp * dz).alias("y"),
        (cp * cl * dx + cp * sl * dy + sp * dz).alias("z"),
    )


def ecef_to_geodetic(x: Column, y: Column, z: Column) -> Column:
    """STRUCT<lat, lon, h> in degrees and metres, by Bowring's closed form."""
    b = WGS84_A * (1 - WGS84_F)
    second = (WGS84_A**2 - b**2) / b**2
    p = F.sqrt(x * x + y * y)
    t = F.atan2(z * WGS84_A, p * b)
    lat = F.atan2(z + second * b * F.pow(F.sin(t), 3), p - WGS84_E2 * WGS84_A * F.pow(F.cos(t), 3))
    h = F.when(F.abs(F.cos(lat)) > 1e-10, p / F.cos(lat) - prime_vertical_radius(lat)).otherwise(F.abs(z) - b)
    return F.struct(F.degrees(lat).alias("lat"), F.degrees(F.atan2(y, x)).alias("lon"), h.alias("h"))


def enu_to_geodetic(e: Column, n: Column, u: Column, lat0: Column, lon0: Column, h0: Column) -> Column:
    o = geodetic_to_ecef(lat0, lon0, h0)
    sp, cp, sl, cl = F.sin(F.radians(lat0)), F.cos(F.radians(lat0)), F.sin(F.radians(lon0)), F.cos(F.radians(lon0))
    return ecef_to_geodetic(
        o["x"] - sl * e - sp * cl * n + cp * cl * u,
        o["y"] + cl * e - sp * sl * n + cp * sl * u,
        o["z"] + cp * n + sp * u,
    )


def orthometric_to_ellipsoidal(height: Column, undulation: Column) -> Column:
    return height + undulation


def plausible_height(z: Column) -> Column:
    """Whether a height is finite and within 2500 m; null counts as implausible."""
    return F.coalesce(~F.isnan(z) & (F.abs(z) <= MAX_ABS_Z_M), F.lit(False))


def theta_to_heading(theta: Column) -> Column:
    """Compass heading from an angle counter-clockwise from east; its own inverse."""
    return F.pmod(math.pi / 2 - theta, F.lit(TWO_PI))


def wrap_pi(a: Column) -> Column:
    """Into [-pi, pi)."""
    return F.pmod(a + math.pi, F.lit(TWO_PI)) - math.pi


def wrap_half_pi(a: Column) -> Column:
    """Into [-pi/4, pi/4)."""
    return F.pmod(a + math.pi / 4, F.lit(math.pi / 2)) - math.pi / 4


def bearing_from_enu(e: Column, n: Column) -> Column:
    """Degrees clockwise from north."""
    return F.pmod(F.degrees(F.atan2(e, n)), F.lit(360.0))


def angular_diff_deg(a: Column, b: Column) -> Column:
    return F.abs(F.pmod(a - b + 180.0, F.lit(360.0)) - 180.0)


def wrap_deg(d: Column, period: float) -> Column:
    """Distance of an angle from the nearest multiple of the period."""
    return F.abs(F.pmod(d + period / 2, F.lit(period)) - period / 2)


def plausible_heading(deg: Column) -> Column:
    return F.coalesce(~F.isnan(deg) & (deg >= 0) & (deg < 360), F.lit(False))


def great_circle_bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return F.pmod(F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d))), F.lit(360.0))


def equirectangular_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    y, x = (lat2 - lat1) * 111320.0, (lon2 - lon1) * 111320.0 * F.cos(F.radians(lat1))
    return F.sqrt(x * x + y * y)


def camera_azimuth(lat: Column, lon: Column, heading_deg: Column, to_lat: Column, to_lon: Column) -> Column:
    """Angle from camera to building: from a usable fix (2 to 1000 m away), else the heading, else null."""
    usable = lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon) & (F.abs(lat) <= 90) & (F.abs(lon) <= 180)
    n, e = (to_lat - lat) * 111320.0, (to_lon - lon) * 111320.0 * F.cos(F.radians(to_lat))
    d = F.sqrt(e * e + n * n)
    return F.when(usable & (d <= 1000) & (d > 2), F.atan2(n, e)).when(plausible_heading(heading_deg), theta_to_heading(F.radians(heading_deg)))


def quadkey(lat: Column, lon: Column, zoom: int) -> Column:
    """Bing tile key of a point."""
    n = float(1 << zoom)
    s = F.sin(F.radians(lat))
    x = F.least(F.floor((lon + 180.0) / 360.0 * n), F.lit(int(n) - 1)).cast("long")
    y = F.least(F.floor((0.5 - F.log((1 + s) / (1 - s)) / (4 * math.pi)) * n), F.lit(int(n) - 1)).cast("long")
    parts = [(F.shiftright(x, i).bitwiseAND(F.lit(1)) + 2 * F.shiftright(y, i).bitwiseAND(F.lit(1))).cast("string") for i in range(zoom - 1, -1, -1)]
    return F.concat(*parts)


def ring_area_m2(area_deg2: Column, lat: Column) -> Column:
    """Rough area of a small polygon given in square degrees at a latitude; for ranking only."""
    return area_deg2 * (111320.0 * 111320.0) * F.cos(F.radians(lat))


def with_undulation(points: DataFrame, grid: DataFrame, step: float, lat0: float, lon0: float) -> DataFrame:
    """``points`` (lat, lon, ...) with ``undulation`` and ``method``: bilinear in a grid of (row, col, n) nodes.

    Node (row, col) lies at lat0 + row * step, lon0 + col * step. Each node goes to the four cells it bounds, so a
    point meets its cell by one equi-join; cells without all four nodes, or beyond 200 m, give null and a reason.
    """
    shifts = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])
    corner = grid.withColumn("s", F.explode(shifts))
    at = lambda i, j: F.max(F.when((F.col("s.i") == i) & (F.col("s.j") == j), F.col("n")))
    cells = corner.groupBy((F.col("row") - F.col("s.i")).alias("cell_row"), (F.col("col") - F.col("s.j")).alias("cell_col")).agg(at(0, 0).alias("n00"), at(0, 1).alias("n01"), at(1, 0).alias("n10"), at(1, 1).alias("n11"))
    u, v = (F.col("lat") - lat0) / step, (F.col("lon") - lon0) / step
    p = points.withColumns({"cell_row": F.floor(u), "cell_col": F.floor(v), "fu": u - F.floor(u), "fv": v - F.floor(v)})
    low = F.col("n00") * (1 - F.col("fv")) + F.col("n01") * F.col("fv")
    high = F.col("n10") * (1 - F.col("fv")) + F.col("n11") * F.col("fv")
    n = low * (1 - F.col("fu")) + high * F.col("fu")
    found = p.join(cells, ["cell_row", "cell_col"], "left").withColumn("undulation", F.when(F.abs(n) <= 200, n))
    return found.withColumn("method", F.when(F.col("undulation").isNotNull(), "grid").otherwise("grid_unavailable")).drop("cell_row", "cell_col", "fu", "fv", "n00", "n01", "n10", "n11")


def photo_aim(lat: Column, lon: Column, heading: Column, to_lat: Column, to_lon: Column) -> Column:
    """STRUCT<bearing, distance_m, off_deg, ok>: whether a photo looks at a building: 40 degrees off and 1 km away at most; nulls are not ok."""
    bearing, distance = great_circle_bearing(lat, lon, to_lat, to_lon), equirectangular_m(lat, lon, to_lat, to_lon)
    off = angular_diff_deg(heading, bearing)
    return F.struct(bearing.alias("bearing"), distance.alias("distance_m"), off.alias("off_deg"), F.coalesce((off <= 40) & (distance <= 1000), F.lit(False)).alias("ok"))
