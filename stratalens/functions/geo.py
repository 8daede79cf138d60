"""Geometry on the sphere as column expressions (whole-stage code, no Python in the plan)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
KM_PER_DEGREE = 111.0


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x)) if isinstance(x, int | float) else F.col(x)


def haversine(lat1, lon1, lat2, lon2, radius: float = EARTH_KM) -> Column:
    """Great-circle distance in the unit of ``radius``; the argument of asin is clamped to 1."""
    a, b, c, d = (_c(x).cast("double") for x in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin(F.radians(c - a) / 2), 2) + F.cos(F.radians(a)) * F.cos(F.radians(c)) * F.pow(F.sin(F.radians(d - b) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def unit_xyz(lat, lon) -> tuple[Column, Column, Column]:
    a, b = F.radians(_c(lat)), F.radians(_c(lon))
    return F.cos(a) * F.cos(b), F.cos(a) * F.sin(b), F.sin(a)


def chord_to_km(chord, radius: float = EARTH_KM) -> Column:
    return 2 * radius * F.asin(F.least(F.lit(1.0), _c(chord) / 2))


def wrap_lon(lon) -> Column:
    """To [-180, 180); NaN becomes 0."""
    return F.pmod(F.nanvl(_c(lon), F.lit(0.0)) + 180.0, F.lit(360.0)) - 180.0


def clip_lat(lat) -> Column:
    return F.greatest(F.lit(-90.0), F.least(F.lit(90.0), F.nanvl(_c(lat), F.lit(0.0))))


def valid(lat, lon) -> Column:
    """Present, finite and in range."""
    a, b = _c(lat).cast("double"), _c(lon).cast("double")
    return F.coalesce(~F.isnan(a) & ~F.isnan(b) & a.between(-90, 90) & b.between(-180, 180), F.lit(False))


def box_around(lat, lon, km: float, floor: float = 0.05) -> tuple[Column, Column, Column, Column]:
    """(lat_min, lat_max, lon_min, lon_max) of a box of half-width ``km``; the cosine has a floor near the poles."""
    half = km / KM_PER_DEGREE
    wide = half / F.greatest(F.lit(floor), F.cos(F.radians(_c(lat))))
    return _c(lat) - half, _c(lat) + half, _c(lon) - wide, _c(lon) + wide


def cell(value, size: float, origin: float) -> Column:
    return F.floor((_c(value) - origin) / size).cast("int")


def box_km(lat, lon, lat_min, lat_max, lon_min, lon_max, radius: float = EARTH_KM) -> Column:
    """Distance to a box: to the point clamped into it."""
    a = F.least(F.greatest(_c(lat), _c(lat_min)), _c(lat_max))
    b = F.least(F.greatest(_c(lon), _c(lon_min)), _c(lon_max))
    return haversine(lat, lon, a, b, radius)


def half_diagonal_km(lat_min, lat_max, lon_min, lon_max, km_per_degree: float = 111.2) -> Column:
    mid = F.radians((_c(lat_min) + _c(lat_max)) / 2)
    return F.hypot((_c(lat_max) - _c(lat_min)) / 2, (_c(lon_max) - _c(lon_min)) / 2 * F.cos(mid)) * km_per_degree


def score_5000(km, decay: float = 1492.7) -> Column:
    """round-half-even of 5000 exp(-d / decay)."""
    return F.bround(5000 * F.exp(-_c(km) / decay), 0)


def reward_band(km) -> Column:
    """A reward that falls in bands: 2 minus the share of 1 km, 1.5 minus the share of 25 km in hundredths, then an exponential tail; null is 0."""
    d = _c(km)
    return F.coalesce(F.when(d < 1, 2 - d / 100).when(d < 25, 1.5 - d / 2500).otherwise(F.exp(-d / 1000)), F.lit(0.0))


def tile(lat, lon, zoom: int) -> tuple[Column, Column]:
    """Web-mercator tile (x, y)."""
    n = float(1 << zoom)
    a = F.radians(_c(lat))
    return F.floor((_c(lon) + 180) / 360 * n).cast("int"), F.floor((1 - F.asinh(F.tan(a)) / math.pi) / 2 * n).cast("int")


def tile_point(x, y, zoom: int, px=0.0, py=0.0, extent: float = 4096.0) -> tuple[Column, Column]:
    """(lat, lon) of a pixel of a tile."""
    n = float(1 << zoom)
    lon = (_c(x) + _c(px) / extent) / n * 360 - 180
    return F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * (_c(y) + _c(py) / extent) / n)))), lon


def dms(degrees, minutes, seconds, reference) -> Column:
    """Degrees, minutes, seconds and a hemisphere letter to decimal degrees."""
    size = _c(degrees) + _c(minutes) / 60 + _c(seconds) / 3600
    return F.when(F.upper(reference).isin("S", "W"), -size).otherwise(size)


def macro_region(lat, lon) -> Column:
    """A coarse region by ordered latitude and longitude rules."""
    a, b = _c(lat), _c(lon)
    return (
        F.when(a < -60, "antarctic")
        .when((b >= -170) & (b < -30) & (a >= 13), "north america")
        .when((b >= -120) & (b < -30), "south america")
        .when((b >= -30) & (b < 60) & (a >= 35), "europe")
        .when((b >= -30) & (b < 60), "africa")
        .when((b >= 60) & (a >= -10), "asia")
        .otherwise("oceania")
    )


def geodesic_km(lat1: pd.Series, lon1: pd.Series, lat2: pd.Series, lon2: pd.Series) -> pd.Series:
    """WGS84 distance by Vincenty's inverse formula, vectorised; antipodal points that do not settle get the haversine."""
    import numpy as np

    a, f = 6378.137, 1 / 298.257223563
    b = a * (1 - f)
    p1, p2, q1, q2 = (np.radians(np.asarray(x, float)) for x in (lat1, lat2, lon1, lon2))
    u1, u2, step = np.arctan((1 - f) * np.tan(p1)), np.arctan((1 - f) * np.tan(p2)), q2 - q1
    lam = step.copy()
    with np.errstate(invalid="ignore", divide="ignore"):
        for _ in range(60):
            s = np.hypot(np.cos(u2) * np.sin(lam), np.cos(u1) * np.sin(u2) - np.sin(u1) * np.cos(u2) * np.cos(lam))
            c = np.sin(u1) * np.sin(u2) + np.cos(u1) * np.cos(u2) * np.cos(lam)
            sigma = np.arctan2(s, c)
            alpha = np.where(s > 0, np.cos(u1) * np.cos(u2) * np.sin(lam) / np.where(s > 0, s, 1), 0)
            cos2 = 1 - alpha**2
            mid = np.where(cos2 > 1e-15, c - 2 * np.sin(u1) * np.sin(u2) / np.where(cos2 > 1e-15, cos2, 1), 0)
            k = f / 16 * cos2 * (4 + f * (4 - 3 * cos2))
            new = step + (1 - k) * f * alpha * (sigma + k * s * (mid + k * c * (2 * mid**2 - 1)))
            settled = np.abs(new - lam) < 1e-12
            lam = new
            if settled.all():
                break
        w = cos2 * (a**2 - b**2) / b**2
        big = 1 + w / 16384 * (4096 + w * (-768 + w * (320 - 175 * w)))
        small = w / 1024 * (256 + w * (-128 + w * (74 - 47 * w)))
        wave = small * s * (mid + small / 4 * (c * (2 * mid**2 - 1) - small / 6 * mid * (4 * s**2 - 3) * (4 * mid**2 - 3)))
        out = b * big * (sigma - wave)
    h = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin((q2 - q1) / 2) ** 2
    return pd.Series(np.where(settled & np.isfinite(out), out, 2 * EARTH_KM * np.arcsin(np.sqrt(np.clip(h, 0, 1)))))


def geodesic(lat1, lon1, lat2, lon2) -> Column:
    return F.pandas_udf(geodesic_km, "double")(*(_c(x).cast("double") for x in (lat1, lon1, lat2, lon2)))


# -- derived coordinates of the given tables, the same integer arithmetic in both engines ---------


def derived_lat(key) -> Column:
    return (_c(key).cast("long") * 7919 % 17001).cast("double") / F.lit(100.0) - F.lit(85.0)


def derived_lon(key) -> Column:
    return (_c(key).cast("long") * 104729 % 36000).cast("double") / F.lit(100.0) - F.lit(180.0)
