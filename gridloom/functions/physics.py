"""Sea-water thermodynamics, spherical distance, polar stereographic coordinates."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.keys import col

#: Coefficients of the freezing point of sea water (salinity, constant, pressure).
FREEZING = (-0.0575, 0.0901, -7.61e-4)
EARTH_RADIUS = 6_371_000.0
#: WGS84 semi-major axis and flattening; standard parallel in degrees.
WGS84_A, WGS84_F, TRUE_SCALE = 6378137.0, 1 / 298.257223563, -71.0


def pressure(draft: Column | str) -> Column:
    """Decibars at the ice base, about its depth in metres; none above the sea."""
    return F.greatest(-col(draft), F.lit(0.0))


def freezing_point(salinity: Column | str, draft: Column | str) -> Column:
    a, b, c = FREEZING
    return F.lit(a) * col(salinity) + F.lit(b) + F.lit(c) * pressure(draft)


def thermal_driving(temperature: Column | str, salinity: Column | str, draft: Column | str) -> Column:
    return col(temperature) - freezing_point(salinity, draft)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres between points in degrees."""
    p, q = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((q - p) / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return F.lit(2 * EARTH_RADIUS) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def _constants() -> tuple[float, float]:
    e = math.sqrt(2 * WGS84_F - WGS84_F**2)
    s = math.sin(math.radians(-TRUE_SCALE))
    t = math.tan(math.pi / 4 - math.radians(-TRUE_SCALE) / 2) / ((1 - e * s) / (1 + e * s)) ** (e / 2)
    return e, WGS84_A * math.cos(math.radians(-TRUE_SCALE)) / math.sqrt(1 - (e * s) ** 2) / t


def polar_to_degrees(x: Column | str, y: Column | str) -> tuple[Column, Column]:
    """Latitude and longitude of south polar stereographic metres: the series of the conformal latitude."""
    e, k = _constants()
    t = F.sqrt(F.pow(col(x), 2) + F.pow(col(y), 2)) / F.lit(k)
    chi = F.lit(math.pi / 2) - 2 * F.atan(t)
    e2, e4, e6, e8 = e**2, e**4, e**6, e**8
    phi = (
        chi
        + F.lit(e2 / 2 + 5 * e4 / 24 + e6 / 12 + 13 * e8 / 360) * F.sin(2 * chi)
        + F.lit(7 * e4 / 48 + 29 * e6 / 240 + 811 * e8 / 11520) * F.sin(4 * chi)
        + F.lit(7 * e6 / 120 + 81 * e8 / 1120) * F.sin(6 * chi)
        + F.lit(4279 * e8 / 161280) * F.sin(8 * chi)
    )
    return -F.degrees(phi), F.degrees(F.atan2(col(x), col(y)))


def degrees_to_polar(lat: Column | str, lon: Column | str) -> tuple[Column, Column]:
    e, k = _constants()
    phi = F.radians(-col(lat))
    s = F.lit(e) * F.sin(phi)
    t = F.tan(F.lit(math.pi / 4) - phi / 2) / F.pow((1 - s) / (1 + s), F.lit(e / 2))
    return F.lit(k) * t * F.sin(F.radians(col(lon))), F.lit(k) * t * F.cos(F.radians(col(lon)))
