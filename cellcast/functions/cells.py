"""Hierarchical hexagonal cells as packed BIGINT ids, all in Column math.

Points are projected to a plane that is true at ``lat0`` and indexed by pointy-top
axial coordinates with cube rounding.  The id packs (resolution, q, r).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import EARTH_KM
from .scalars import as_col

# Edge length in km by resolution.
EDGE_KM = {0: 1107.71, 1: 418.68, 2: 158.24, 3: 59.81, 4: 22.606, 5: 8.544, 6: 3.229, 7: 1.221, 8: 0.4614}

DEFAULT_LAT0 = 31.0
AXIS_BITS = 29
AXIS_BIAS = 1 << 28
AXIS_MASK = (1 << AXIS_BITS) - 1
KM_PER_DEG = EARTH_KM * math.pi / 180.0


def _scale(lat0: float) -> float:
    return KM_PER_DEG * math.cos(math.radians(lat0))


def hex_axial(x: Column, y: Column, edge: float) -> tuple[Column, Column]:
    """Axial (q, r) of the pointy-top hexagon that holds (x, y)."""
    qf = (x * (math.sqrt(3.0) / 3.0) - y * (1.0 / 3.0)) / edge
    rf = y * (2.0 / 3.0) / edge
    sf = -qf - rf
    q, r, s = F.floor(qf + 0.5), F.floor(rf + 0.5), F.floor(sf + 0.5)
    dq, dr, ds = F.abs(q - qf), F.abs(r - rf), F.abs(s - sf)
    fixed_q = F.when((dq > dr) & (dq > ds), -r - s).otherwise(q)
    fixed_r = F.when((dq > dr) & (dq > ds), r).when(dr > ds, -q - s).otherwise(r)
    return fixed_q.cast("long"), fixed_r.cast("long")


def hex_center(q: Column, r: Column, edge: float) -> tuple[Column, Column]:
    return (q + r / 2.0) * (edge * math.sqrt(3.0)), r * (edge * 1.5)


def pack(res: int, q: Column, r: Column) -> Column:
    # addition instead of bit-or: the three fields never overlap
    return F.lit(res << (2 * AXIS_BITS)) + (q + AXIS_BIAS) * F.lit(1 << AXIS_BITS) + (r + AXIS_BIAS)


def cell_resolution(cell: Column | str) -> Column:
    return F.shiftrightunsigned(as_col(cell), 2 * AXIS_BITS).cast("int")


def cell_axes(cell: Column | str) -> tuple[Column, Column]:
    cell = as_col(cell)
    q = F.shiftrightunsigned(cell, AXIS_BITS).bitwiseAND(F.lit(AXIS_MASK)) - AXIS_BIAS
    r = cell.bitwiseAND(F.lit(AXIS_MASK)) - AXIS_BIAS
    return q, r


def cell_id(lat, lon, res: int, lat0: float = DEFAULT_LAT0) -> Column:
    x = as_col(lon) * _scale(lat0)
    y = as_col(lat) * KM_PER_DEG
    q, r = hex_axial(x, y, EDGE_KM[res])
    return pack(res, q, r)


def _edge_of(cell: Column) -> Column:
    edges = F.array(*[F.lit(EDGE_KM[level]) for level in sorted(EDGE_KM)])
    return F.get(edges, cell_resolution(cell))


def cell_center(cell: Column | str, lat0: float = DEFAULT_LAT0, digits: int | None = 6, res: int | None = None) -> tuple[Column, Column]:
    """(lat, lon) of the centre.  Naming ``res`` saves the per-row resolution test."""
    cell = as_col(cell)
    q, r = cell_axes(cell)
    edge = F.lit(EDGE_KM[res]) if res is not None else _edge_of(cell)
    lat = r * 1.5 * edge / KM_PER_DEG
    lon = (q + r / 2.0) * math.sqrt(3.0) * edge / _scale(lat0)
    if digits is None:
        return lat, lon
    return F.round(lat, digits), F.round(lon, digits)


def cell_parent(cell: Column | str, res: int, lat0: float = DEFAULT_LAT0, child_res: int | None = None) -> Column:
    lat, lon = cell_center(cell, lat0, digits=None, res=child_res)
    return cell_id(lat, lon, res, lat0)


def cell_boundary(cell: Column | str, lat0: float = DEFAULT_LAT0) -> Column:
    """Six vertices as ARRAY<STRUCT<lat, lon>>, counter-clockwise from the upper right."""
    cell = as_col(cell)
    lat, lon = cell_center(cell, lat0, digits=None)
    edge = _edge_of(cell)
    corners = []
    for k in range(6):
        angle = math.radians(30 + 60 * k)
        corners.append(
            F.struct(
                F.round(lat + edge * (math.sin(angle) / KM_PER_DEG), 6).alias("lat"),
                F.round(lon + edge * (math.cos(angle) / _scale(lat0)), 6).alias("lon"),
            )
        )
    return F.array(*corners)


def cell_hex(cell: Column | str) -> Column:
    return F.lower(F.hex(as_col(cell)))
