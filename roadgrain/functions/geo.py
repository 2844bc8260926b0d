"""Distances, bearings and coordinate notations as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

R_M = 6_371_000.0
R_KM = 6371.0088


def _h(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2))


def _most_one(h: Column) -> Column:
    """Clamped to 1 where rounding passes it; null stays null (``least`` would skip it and give half a great circle)."""
    return F.when(h > 1, F.lit(1.0)).otherwise(h)


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    """Metres, R = 6,371,000, atan2 form; null where an argument is."""
    h = _most_one(_h(*(F.col(c) if isinstance(c, str) else c for c in (lat1, lon1, lat2, lon2))))
    return 2 * R_M * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Kilometres, R = 6371.0088, asin form, the argument clamped to 1."""
    h = _h(*(F.col(c) if isinstance(c, str) else c for c in (lat1, lon1, lat2, lon2)))
    return 2 * R_KM * F.asin(F.sqrt(_most_one(h)))


def bearing_deg(lat1, lon1, lat2, lon2) -> Column:
    """Initial bearing in [0, 360)."""
    a, o, b, p = (F.radians(F.col(c) if isinstance(c, str) else c) for c in (lat1, lon1, lat2, lon2))
    y, x = F.sin(p - o) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(p - o)
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))


def nmea_to_degrees(v: Column) -> Column:
    """ddmm.mmmm to degrees; the degrees part is cut toward zero, so signs carry through."""
    deg = (v / 100).cast("int")
    return deg + (v - 100 * deg) / 60


def curvature(lat0, lon0, lat1, lon1, lat2, lon2) -> Column:
    """1/R of the circle through three points on the local plane, signed by the turn; null if two coincide."""
    k = F.cos(F.radians(lat1)) * F.radians(F.lit(1.0)) * R_M
    ky = F.radians(F.lit(1.0)) * R_M
    ax, ay, bx, by = (lon1 - lon0) * k, (lat1 - lat0) * ky, (lon2 - lon1) * k, (lat2 - lat1) * ky
    cross = ax * by - ay * bx
    a, b, c = F.hypot(ax, ay), F.hypot(bx, by), F.hypot(ax + bx, ay + by)
    return F.try_divide(2 * cross, a * b * c)
