"""Distances and cells as column arithmetic on longitude and latitude in degrees."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Fixed value: mean earth radius in metres.
EARTH_RADIUS = 6_371_008.8


def point(lon: Column, lat: Column) -> Column:
    """A4: a point, or NULL when a coordinate is missing or out of range."""
    return F.when(on_earth(lon, lat), F.struct(lon.cast("double").alias("lon"), lat.cast("double").alias("lat")))


def on_earth(lon: Column, lat: Column) -> Column:
    """Both coordinates are there and in range; not so for NaN and infinities."""
    return F.coalesce(lon.between(-180, 180) & lat.between(-90, 90), F.lit(False))


def planar(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Distance in degrees on the flat longitude / latitude plane."""
    dx, dy = lon1 - lon2, lat1 - lat2
    return F.sqrt(dx * dx + dy * dy)


def haversine(
    lon1: Column, lat1: Column, lon2: Column, lat2: Column, flat1: Column | None = None, flat2: Column | None = None,
) -> Column:
    """Great-circle distance in metres on the mean-radius sphere.

    ``flat1`` and ``flat2`` are the cosines of the latitudes where rows hold them already.
    """
    flat1 = F.cos(F.radians(lat1)) if flat1 is None else flat1
    flat2 = F.cos(F.radians(lat2)) if flat2 is None else flat2
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    a = half_lat * half_lat + flat1 * flat2 * half_lon * half_lon
    return F.lit(2 * EARTH_RADIUS) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def tenths(value: Column) -> Column:
    """``F.round(value, 1)`` to the bit; that makes decimal text of every value, this one only of those close to a tie."""
    scaled = value * 10
    whole = F.floor(scaled)
    rest = scaled - whole
    plain = (F.abs(scaled) < 1e9) & (F.abs(rest - 0.5) > 1e-6)
    return F.when(plain, (whole + F.when(rest > 0.5, 1).otherwise(0)) / F.lit(10.0)).otherwise(F.round(value, 1))


def unit_vector(lon: Column, lat: Column) -> tuple[Column, Column, Column]:
    """x, y, z of the point on a sphere of radius 1."""
    flat = F.cos(F.radians(lat))
    return flat * F.cos(F.radians(lon)), flat * F.sin(F.radians(lon)), F.sin(F.radians(lat))


def squared_chord(radius: float) -> float:
    """Square of the straight line, on a sphere of radius 1, under an arc of ``radius`` metres."""
    return 4 * math.sin(min(max(radius, 0.0) / EARTH_RADIUS, math.pi) / 2) ** 2


def cells_per_radius(size: float) -> float:
    """Edges of a cubic grid of ``size`` metres, 1 at least, from the middle of the earth to its surface."""
    return EARTH_RADIUS / max(size, 1.0)


def sphere_cell(lon: Column, lat: Column, size: float) -> Column:
    """Cell of a cubic grid of ``size`` metres, 1 at least, that holds the point on the sphere.

    The straight line between two points is never longer than the arc, so points within ``size``
    of each other lie in the same or touching cells, at the poles and the date line too.
    """
    scale = F.lit(cells_per_radius(size))
    return F.struct(*[F.floor(scale * v).cast("long").alias(n) for n, v in zip("xyz", unit_vector(lon, lat))])


def may_hold_near(cell: Sequence[Column], vector: Sequence[Column], radius: float) -> Column:
    """``cell``, of a grid of ``radius`` metres, meets the sphere and comes within ``radius`` of the point at ``vector``."""
    scale, slack = cells_per_radius(radius), 1e-6
    near, inner, outer = F.lit(0.0), F.lit(0.0), F.lit(0.0)
    for index, v in zip(cell, vector):
        low = index.cast("double")
        high = low + 1
        aside = F.greatest(low - v * scale, v * scale - high, F.lit(0.0))
        least, most = F.greatest(low, -high, F.lit(0.0)), F.greatest(F.abs(low), F.abs(high))
        near, inner, outer = near + aside * aside, inner + least * least, outer + most * most
    reach = math.sqrt(squared_chord(radius)) * scale + slack
    return (near <= reach**2) & (inner <= (scale + slack) ** 2) & (outer >= max(scale - slack, 0.0) ** 2)


def within_box(lon: Column, lat: Column, centre_lon: float, centre_lat: float, radius: float) -> Column:
    """Range conditions that hold for every point within ``radius`` metres of the centre."""
    slack = 1e-9
    angle = radius / EARTH_RADIUS
    spread = math.degrees(angle) + slack
    in_lat = lat.between(centre_lat - spread, centre_lat + spread)
    if abs(centre_lat) + spread >= 90 or angle >= math.pi / 2:
        return in_lat
    half = math.degrees(math.asin(min(1.0, math.sin(angle) / math.cos(math.radians(centre_lat))))) + slack
    west, east = centre_lon - half, centre_lon + half
    in_lon = lon.between(west, east)
    if west < -180:
        in_lon = in_lon | (lon >= west + 360)
    if east > 180:
        in_lon = in_lon | (lon <= east - 360)
    return in_lat & in_lon
