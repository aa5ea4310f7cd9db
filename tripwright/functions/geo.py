"""Distances as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Radius of the sphere on which distances are measured, metres.
EARTH_M = 6_371_000.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres; null if any coordinate is null."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    root = F.sqrt(a)  # least() would pass over a null
    return F.lit(2 * EARTH_M) * F.asin(F.when(root > 1, F.lit(1.0)).otherwise(root))


def planar_m(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Euclidean distance of projected coordinates, in their unit."""
    return F.hypot(x2 - x1, y2 - y1)


def utm_system(latitude: float, longitude: float) -> int:
    """The EPSG number of the UTM zone of a place (such as the medians of all pings), north or south of the equator."""
    zone = min(int((longitude + 180.0) // 6.0) + 1, 60)
    return (32600 if latitude >= 0 else 32700) + zone


def utm_xy(latitude: Column, longitude: Column, system: int) -> tuple[Column, Column]:
    """(east, north) in metres of a UTM system of WGS 84, by the series of Krueger to the third order; null for null coordinates."""
    south, zone = system >= 32700, system % 100
    # The ellipsoid, the scale on the middle meridian and the false origin.
    a, f, k0, e0, n0 = 6_378_137.0, 1 / 298.257223563, 0.9996, 500_000.0, 10_000_000.0 if south else 0.0
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    series = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    e = 2 * math.sqrt(n) / (1 + n)
    turn = F.radians(longitude - (zone * 6 - 183))
    sine = F.sin(F.radians(latitude))
    t = F.sinh(F.atanh(sine) - e * F.atanh(e * sine))
    xi, eta = F.atan2(t, F.cos(turn)), F.atanh(F.sin(turn) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, c in enumerate(series, 1):
        east = east + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return e0 + k0 * radius * east, n0 + k0 * radius * north


def polygon_m(sides: int, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """The radius of the regular polygon about (x2, y2), a corner to the east, on whose edge (x1, y1) lies."""
    step = 2 * math.pi / sides
    off = F.pmod(F.atan2(y1 - y2, x1 - x2), F.lit(step)) - step / 2
    return F.hypot(x1 - x2, y1 - y2) * F.cos(off) / math.cos(step / 2)
