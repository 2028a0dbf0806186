"""Distances, projections, pixel indices and polygon tests as Column algebra."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import as_col

EARTH_KM = 6371.0


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    p1, p2 = F.radians(as_col(lat1)), F.radians(as_col(lat2))
    half_dlat = (p2 - p1) / 2
    half_dlon = (F.radians(as_col(lon2)) - F.radians(as_col(lon1))) / 2
    h = F.pow(F.sin(half_dlat), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(half_dlon), 2)
    return F.asin(F.sqrt(F.least(h, F.lit(1.0)))) * (2 * EARTH_KM)


def unit_xyz(lat, lon) -> tuple[Column, Column, Column]:
    phi, lam = F.radians(as_col(lat)), F.radians(as_col(lon))
    return F.cos(phi) * F.cos(lam), F.cos(phi) * F.sin(lam), F.sin(phi)


def km_to_chord(km: Column | float) -> Column | float:
    """Straight-line distance on the unit sphere of a great-circle distance."""
    if isinstance(km, Column):
        return F.sin(km / (2 * EARTH_KM)) * 2
    return 2 * math.sin(km / (2 * EARTH_KM))


def chord_to_km(chord: Column) -> Column:
    return F.asin(F.least(chord / 2, F.lit(1.0))) * (2 * EARTH_KM)


def wrap_lon(lon: Column | str) -> Column:
    lon = as_col(lon)
    return F.when(lon > 180, lon - 360).otherwise(lon)


def in_bbox(lat, lon, south: float, north: float, west: float, east: float) -> Column:
    return as_col(lat).between(south, north) & as_col(lon).between(west, east)


def _crossing(lat: Column, lon: Column, x1, y1, x2, y2) -> Column:
    straddles = (y1 > lat) != (y2 > lat)
    return straddles & (lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1)


def in_polygon(lat, lon, ring: list[tuple[float, float]]) -> Column:
    """Even-odd rule against a literal ring of (lon, lat) vertices."""
    lat, lon = as_col(lat), as_col(lon)
    hits = []
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if y1 == y2:
            continue
        straddles = (F.lit(float(y1)) > lat) != (F.lit(float(y2)) > lat)
        at = (lat - float(y1)) * (float(x2 - x1) / float(y2 - y1)) + float(x1)
        hits.append((straddles & (lon < at)).cast("int"))
    return F.pmod(reduce(lambda a, b: a + b, hits, F.lit(0)), F.lit(2)) == 1


def in_ring(lat, lon, ring: Column | str) -> Column:
    """Even-odd rule against an ARRAY<STRUCT<lon, lat>> column."""
    lat, lon, ring = as_col(lat), as_col(lon), as_col(ring)
    n = F.size(ring)
    corner = F.sequence(F.lit(0), n - 1)
    return F.aggregate(
        corner,
        F.lit(False),
        lambda acc, i: acc
        != F.coalesce(
            _crossing(
                lat,
                lon,
                F.get(ring, i)["lon"],
                F.get(ring, i)["lat"],
                F.get(ring, F.pmod(i + 1, n))["lon"],
                F.get(ring, F.pmod(i + 1, n))["lat"],
            ),
            F.lit(False),
        ),
    )


def pixel_index(x, y, a: Column | float, c: Column | float, e: Column | float, f: Column | float) -> tuple[Column, Column]:
    """(row, col) of a point under x = c + a*col, y = f + e*row."""
    row = F.floor((as_col(y) - f) / e).cast("int")
    col = F.floor((as_col(x) - c) / a).cast("int")
    return row, col


def pixel_center(row, col, a, c, e, f) -> tuple[Column, Column]:
    return as_col(col) * a + a / 2 + c, as_col(row) * e + e / 2 + f


def grid_snap(lat, lon, lat0: float, lon0: float, step: float) -> tuple[Column, Column]:
    """Nearest (row, col) of a regular north-up grid whose first pixel centre is (lat0, lon0)."""
    row = F.floor((F.lit(lat0) - as_col(lat)) / step + 0.5).cast("int")
    col = F.floor((as_col(lon) - lon0) / step + 0.5).cast("int")
    return row, col


def equirectangular(lat, lon, lat0: float = 0.0) -> tuple[Column, Column]:
    """(x, y) in metres on a plane that is true at latitude ``lat0``."""
    k = EARTH_KM * 1000.0
    return F.radians(as_col(lon)) * (k * math.cos(math.radians(lat0))), F.radians(as_col(lat)) * k


# Equal-area conic for the lower 48 states on the GRS80 ellipsoid.
ALBERS = {"lat1": 29.5, "lat2": 45.5, "lat0": 23.0, "lon0": -96.0, "a": 6378137.0, "f": 1 / 298.257222101}


def _albers_constants() -> tuple[float, float, float, float, float]:
    a, f = ALBERS["a"], ALBERS["f"]
    e2 = f * (2 - f)
    e = math.sqrt(e2)

    def m(phi: float) -> float:
        return math.cos(phi) / math.sqrt(1 - e2 * math.sin(phi) ** 2)

    def q(phi: float) -> float:
        s = math.sin(phi)
        return (1 - e2) * (s / (1 - e2 * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))

    p1, p2, p0 = (math.radians(ALBERS[k]) for k in ("lat1", "lat2", "lat0"))
    n = (m(p1) ** 2 - m(p2) ** 2) / (q(p2) - q(p1))
    c = m(p1) ** 2 + n * q(p1)
    return n, c, a * math.sqrt(c - n * q(p0)) / n, e, e2


def albers(lat, lon) -> tuple[Column, Column]:
    """(x, y) in metres of the conterminous equal-area projection."""
    n, c, rho0, e, e2 = _albers_constants()
    s = F.sin(F.radians(as_col(lat)))
    q = (s / (1 - s * s * e2) - F.log((1 - s * e) / (1 + s * e)) / (2 * e)) * (1 - e2)
    rho = F.sqrt(F.lit(c) - q * n) * (ALBERS["a"] / n)
    theta = F.radians(as_col(lon) - ALBERS["lon0"]) * n
    return rho * F.sin(theta), F.lit(rho0) - rho * F.cos(theta)


def reproject(lat, lon, crs: str = "albers", **kw) -> tuple[Column, Column]:
    if crs == "albers":
        return albers(lat, lon)
    if crs == "equirectangular":
        return equirectangular(lat, lon, **kw)
    raise ValueError(f"no closed form for {crs!r}")
