"""Distances and projections as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
#: Fixed value: the radius of the sphere of EPSG:3857 in metres.
MERCATOR_M = 6378137.0


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = EARTH_KM) -> Column:
    """Great-circle distance of two points given in degrees."""
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), F.lit(2.0))
    h = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    h = F.least(F.greatest(h, F.lit(0.0)), F.lit(1.0))
    return F.atan2(F.sqrt(h), F.sqrt(1 - h)) * (2 * radius)


def haversine_sql(lon1: str, lat1: str, lon2: str, lat2: str, radius: float = EARTH_KM) -> str:
    """:func:`haversine_km` for DuckDB."""
    half = lambda a, b: f"pow(sin(radians({b} - {a}) / 2), 2.0)"
    h = f"least(greatest({half(lat1, lat2)} + cos(radians({lat1})) * cos(radians({lat2})) * {half(lon1, lon2)}, 0.0), 1.0)"
    return f"(atan2(sqrt({h}), sqrt(1 - {h})) * {2 * radius})"


def is_position(lon: Column, lat: Column) -> Column:
    """Whether both are degrees in range and not the stand-in (0, 0); false for null and NaN."""
    ok = ~F.isnan(lon) & ~F.isnan(lat) & lon.between(-180.0, 180.0) & lat.between(-90.0, 90.0) & ~((lon == 0.0) & (lat == 0.0))
    return F.coalesce(ok, F.lit(False))


def planar_or_haversine_km(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Planar metres if any coordinate is 1000 or more in size, else degrees."""
    planar = F.greatest(*[F.abs(c) for c in (x1, y1, x2, y2)]) >= 1000.0
    return F.when(planar, F.hypot(x1 - x2, y1 - y2) / 1000.0).otherwise(haversine_km(x1, y1, x2, y2))


def edge_km(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Gap between two rectangles with metric sides ``minx maxx miny maxy``; touching ones are 0 apart."""
    dx = F.greatest(a["minx"] - b["maxx"], b["minx"] - a["maxx"], F.lit(0.0))
    dy = F.greatest(a["miny"] - b["maxy"], b["miny"] - a["maxy"], F.lit(0.0))
    return F.hypot(dx, dy) / 1000.0


def mercator_to_lonlat(x: Column, y: Column) -> tuple[Column, Column]:
    """EPSG:3857 metres as degrees."""
    return F.degrees(x / MERCATOR_M), F.degrees(F.atan(F.exp(y / MERCATOR_M)) * 2 - math.pi / 2)


def lonlat_to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Degrees as EPSG:3857 metres."""
    return F.radians(lon) * MERCATOR_M, F.log(F.tan(F.radians(lat) / 2 + math.pi / 4)) * MERCATOR_M


def lonlat_to_utm(lon: Column, lat: Column, central: float = 9.0) -> tuple[Column, Column]:
    """Degrees as transverse Mercator metres on GRS80 (EPSG:25832 for the central meridian 9), by the Krüger series to n^4."""
    a, f = 6378137.0, 1 / 298.257222101
    n = f / (2 - f)
    big_a = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
        61 * n**3 / 240 - 103 * n**4 / 140,
        49561 * n**4 / 161280,
    )
    phi, lam, e = F.radians(lat), F.radians(lon - central), 2 * math.sqrt(n) / (1 + n)
    t = F.sinh(F.atanh(F.sin(phi)) - F.atanh(F.sin(phi) * e) * e)
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, c in enumerate(alpha, 1):
        east = east + F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j)) * c
        north = north + F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j)) * c
    return east * (0.9996 * big_a) + 500000.0, north * (0.9996 * big_a)
