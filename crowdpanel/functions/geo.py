"""Distances, bearings, rings, bands and grid cells as column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Earth radii, metres per degree and the default geometry.
EARTH_RADIUS_M = 6_371_008.8
EARTH_RADIUS_KM = 6371.0
METRES_PER_DEGREE = 111_320.0
VENUE = (37.7786, -122.3893)
SECOND_VENUE = (37.7680, -122.3877)
RING_EDGES_M = (0, 250, 500, 1000, 2500, 5000)
RING_MIDPOINTS_M = (125, 375, 750, 1750, 3750)
PUBLISHED_BANDS_M = (500, 1000, 2000, 4000)
CANONICAL_BANDS_M = (250, 500, 1000, 2500, 5000)
GRID_STEP = (0.00225, 0.00284)
GRID_BOX = (37.70, 37.84, -122.52, -122.35)


def _col(x: Column | str | float) -> Column:
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(float(x))


def haversine(lat, lon, lat0, lon0, radius: float = EARTH_RADIUS_M) -> Column:
    """Great-circle distance; arguments are columns, column names or numbers."""
    a, b, c, d = (F.radians(_col(x)) for x in (lat, lon, lat0, lon0))
    half_chord = F.pow(F.sin((a - c) / 2), 2) + F.cos(a) * F.cos(c) * F.pow(F.sin((b - d) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(half_chord))


def haversine_km(lat, lon, lat0, lon0) -> Column:
    return F.round(haversine(lat, lon, lat0, lon0, EARTH_RADIUS_KM), 2)


def _flat_offsets(lat, lon, lat0, lon0) -> tuple[Column, Column]:
    """North and east offset in metres of (lat, lon) from (lat0, lon0)."""
    north = (_col(lat) - _col(lat0)) * METRES_PER_DEGREE
    east = (_col(lon) - _col(lon0)) * METRES_PER_DEGREE * F.cos(F.radians(_col(lat0)))
    return north, east


def flat_distance(lat, lon, lat0, lon0) -> Column:
    """Equirectangular metres, scaled at (lat0, lon0)."""
    north, east = _flat_offsets(lat, lon, lat0, lon0)
    return F.sqrt(north * north + east * east)


def bearing(lat, lon, lat0, lon0) -> Column:
    """Degrees 0..360 clockwise from north, seen from (lat0, lon0)."""
    north, east = _flat_offsets(lat, lon, lat0, lon0)
    return (F.degrees(F.atan2(east, north)) + 360.0) % 360.0


def ring_id(dist: Column, edges: Sequence[float] = RING_EDGES_M) -> Column:
    """1-based ring of half-open intervals [lo, hi); NULL outside."""
    return _ladder(dist, edges, lambda i, lo, hi: F.lit(i + 1))


def ring_label(dist: Column, edges: Sequence[float] = RING_EDGES_M) -> Column:
    return _ladder(dist, edges, lambda i, lo, hi: F.lit(f"{lo:g}-{hi:g}m"))


def _ladder(dist, edges, value) -> Column:
    out = F.lit(None)
    spans = list(zip(edges, edges[1:]))
    for i in reversed(range(len(spans))):
        lo, hi = spans[i]
        out = F.when((dist >= lo) & (dist < hi), value(i, lo, hi)).otherwise(out)
    return out


def band_upto(dist: Column, uppers: Sequence[float] = PUBLISHED_BANDS_M) -> Column:
    """Band label with an INCLUSIVE upper bound; the last band is open."""
    lows = (0, *uppers)
    out = F.lit(f">{uppers[-1]:g}m")
    for lo, hi in reversed(list(zip(lows, uppers))):
        out = F.when(dist <= hi, F.lit(f"{lo:g}-{hi:g}m")).otherwise(out)
    return out


def band_below(dist: Column, uppers: Sequence[float] = CANONICAL_BANDS_M) -> Column:
    """Band id b1, b2, … with an EXCLUSIVE upper bound; the last band is open."""
    out = F.lit(f"b{len(uppers) + 1}")
    for i in reversed(range(len(uppers))):
        out = F.when(dist < uppers[i], F.lit(f"b{i + 1}")).otherwise(out)
    return out


def grid_index(x: Column, step: float) -> Column:
    return F.floor(x / F.lit(step)).cast("long")


def unit_key(gi: Column, gj: Column) -> Column:
    return F.format_string("c%d_%d", gi, gj)


def in_box(lat: Column, lon: Column, box: Sequence[float] = GRID_BOX) -> Column:
    south, north, west, east = box
    return lat.between(south, north) & lon.between(west, east)


def max_grid_units(step: Sequence[float] = GRID_STEP, box: Sequence[float] = GRID_BOX) -> int:
    """Upper bound on the number of grid cells inside a box."""
    south, north, west, east = box
    rows = math.floor(north / step[0]) - math.floor(south / step[0]) + 1
    cols = math.floor(east / step[1]) - math.floor(west / step[1]) + 1
    return rows * cols
