"""Geodesy and grids as Column expressions. Angles in degrees, distances in kilometres."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Mean Earth radius, and the GRS80 ellipsoid with the parallels of EPSG:5070.
EARTH_KM = 6371.0088
GRS80_A, GRS80_F = 6378137.0, 1 / 298.257222101
ALBERS = {"lat1": 29.5, "lat2": 45.5, "lat0": 23.0, "lon0": -96.0}


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance; null where a coordinate is null or not finite."""
    rad = F.radians
    a = F.pow(F.sin((rad(lat2) - rad(lat1)) / 2), 2) + F.cos(rad(lat1)) * F.cos(rad(lat2)) * F.pow(F.sin((rad(lon2) - rad(lon1)) / 2), 2)
    d = F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), a))))
    return F.when(~F.isnan(lat1 + lon1 + lat2 + lon2), d)


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing in [0, 360)."""
    rad = F.radians
    y = F.sin(rad(lon2) - rad(lon1)) * F.cos(rad(lat2))
    x = F.cos(rad(lat1)) * F.sin(rad(lat2)) - F.sin(rad(lat1)) * F.cos(rad(lat2)) * F.cos(rad(lon2) - rad(lon1))
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


def sector(azimuth: Column) -> Column:
    a = F.pmod(azimuth, F.lit(360.0))
    return F.when((a >= 315) | (a < 45), "N").when(a < 135, "E").when(a < 225, "S").otherwise("W")


def equirect_xy(lat: Column, lon: Column, lat0: float | Column) -> tuple[Column, Column]:
    """x, y in km on a plane whose scale is true at ``lat0``."""
    lat0 = F.lit(lat0) if not isinstance(lat0, Column) else lat0
    return F.lit(EARTH_KM) * F.radians(lon) * F.cos(F.radians(lat0)), F.lit(EARTH_KM) * F.radians(lat)


# Metres a degree of latitude and, at the equator, of longitude, and kilometres a degree, of the grids that use them.
M_PER_LAT, M_PER_LON, KM_PER_DEGREE = 111_132.0, 111_320.0, 111.32


def centred_xy(lat: Column, lon: Column, lat0: float | Column, lon0: float | Column) -> tuple[Column, Column]:
    """x, y in km from a middle, as the local grid has them."""
    lat0, lon0 = (c if isinstance(c, Column) else F.lit(c) for c in (lat0, lon0))
    return F.lit(EARTH_KM) * (F.radians(lon) - F.radians(lon0)) * F.cos(F.radians(lat0)), F.lit(EARTH_KM) * (F.radians(lat) - F.radians(lat0))


def origin_xy_m(lat: Column, lon: Column, lat0: float, lon0: float) -> tuple[Column, Column]:
    """x, y in metres from a grid's origin, by metres a degree."""
    return (lon - lon0) * (M_PER_LON * math.cos(math.radians(lat0))), (lat - lat0) * M_PER_LAT


def degree_xy(lat: Column, lon: Column, lat0: float | Column) -> tuple[Column, Column]:
    """x, y in km by kilometres a degree, for nearness only."""
    lat0 = lat0 if isinstance(lat0, Column) else F.lit(lat0)
    return lon * F.cos(F.radians(lat0)) * KM_PER_DEGREE, lat * KM_PER_DEGREE


def grid_origin(points: DataFrame, grid_km: float) -> tuple[float, float]:
    """The lowest latitude and longitude, snapped down to a grid of about ``grid_km`` in degrees; zeros for no points."""
    lat, lon = points.filter("lat is not null and lon is not null").agg(F.min("lat"), F.min("lon")).first()
    if lat is None:
        return 0.0, 0.0
    by_lat, by_lon = 1000 * grid_km / M_PER_LAT, 1000 * grid_km / (M_PER_LON * math.cos(math.radians(lat)) + 1e-12)
    return math.floor(lat / by_lat) * by_lat, math.floor(lon / by_lon) * by_lon


def padded_bounds(points: DataFrame, cell: float, pad_frac: float = 0.01) -> DataFrame:
    """One row: bounds of ``points(x, y)`` padded by a share of the longer side, and their origin snapped down to the cells."""
    b = points.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    pad = F.greatest(F.lit(1e-9), F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) * pad_frac
    out = b.select((F.col("x0") - pad).alias("x_min"), (F.col("x1") + pad).alias("x_max"), (F.col("y0") - pad).alias("y_min"), (F.col("y1") + pad).alias("y_max"))
    return out.select((F.floor(F.col("x_min") / cell) * cell).alias("x0"), (F.floor(F.col("y_min") / cell) * cell).alias("y0"), "*")


def inverse_equirect(x: Column, y: Column, lat0: float) -> tuple[Column, Column]:
    """lat, lon of a point of that plane."""
    return F.degrees(y / EARTH_KM), F.degrees(x / (EARTH_KM * math.cos(math.radians(lat0))))


def _albers_constants() -> tuple[float, float, float, float]:
    e2 = GRS80_F * (2 - GRS80_F)
    e = math.sqrt(e2)
    m = lambda p: math.cos(p) / math.sqrt(1 - e2 * math.sin(p) ** 2)
    q = lambda p: (1 - e2) * (math.sin(p) / (1 - e2 * math.sin(p) ** 2) - math.log((1 - e * math.sin(p)) / (1 + e * math.sin(p))) / (2 * e))
    p0, p1, p2 = (math.radians(ALBERS[k]) for k in ("lat0", "lat1", "lat2"))
    n = (m(p1) ** 2 - m(p2) ** 2) / (q(p2) - q(p1))
    c = m(p1) ** 2 + n * q(p1)
    return e, n, c, GRS80_A * math.sqrt(c - n * q(p0)) / n


def albers_xy(lat: Column, lon: Column) -> tuple[Column, Column]:
    """EPSG:5070 (ellipsoidal Albers equal-area) x, y in metres."""
    e, n, c, rho0 = _albers_constants()
    s = F.sin(F.radians(lat))
    q = F.lit(1 - e * e) * (s / (1 - F.lit(e * e) * s * s) - F.log((1 - F.lit(e) * s) / (1 + F.lit(e) * s)) / (2 * e))
    rho = F.lit(GRS80_A) * F.sqrt(F.lit(c) - F.lit(n) * q) / n
    theta = F.lit(n) * F.radians(lon - ALBERS["lon0"])
    return rho * F.sin(theta), F.lit(rho0) - rho * F.cos(theta)


def albers_inverse(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """lat, lon of EPSG:5070 coordinates, by fixed-point iteration on the latitude."""
    e, n, c, rho0 = _albers_constants()
    rho, theta = np.hypot(x, rho0 - y), np.arctan2(x, rho0 - y)
    q = (c - (rho * n / GRS80_A) ** 2) / n
    lat = np.arcsin(q / 2)
    for _ in range(8):
        s = np.sin(lat)
        lat = lat + (1 - e * e * s * s) ** 2 / (2 * np.cos(lat)) * (q / (1 - e * e) - s / (1 - e * e * s * s) + np.log((1 - e * s) / (1 + e * s)) / (2 * e))
    return np.degrees(lat), np.degrees(theta / n) + ALBERS["lon0"]


def grid_index(v: Column, origin: float | Column, cell: float | Column) -> Column:
    return F.floor((v - origin) / cell).cast("int")


def snapped_origin(lowest: Column, cell: float) -> Column:
    """The cell multiple at or below a coordinate."""
    return F.floor(lowest / cell) * cell


def cell_id(ix: Column, iy: Column, style: str = "signed") -> Column:
    """``g+000003_-000012`` (signed), ``g3_-12`` (plain) or ``r00012_c00003`` (rowcol)."""
    if style == "signed":
        return F.format_string("g%+07d_%+07d", ix, iy)
    return F.format_string("g%d_%d", ix, iy) if style == "plain" else F.format_string("r%05d_c%05d", iy, ix)


def parse_cell_id(c: Column) -> tuple[Column, Column]:
    """(ix, iy) of any of the formats, and of ``GRID_c_r``; null for other texts."""
    num = lambda pattern, k: F.regexp_extract(c, pattern, k).try_cast("int")
    g, r, u = r"^g([+-]?\d+)_([+-]?\d+)$", r"^r(\d+)_c(\d+)$", r"^GRID_(-?\d+)_(-?\d+)$"
    return F.coalesce(num(g, 1), num(r, 2), num(u, 1)), F.coalesce(num(g, 2), num(r, 1), num(u, 2))
