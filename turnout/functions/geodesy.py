"""Great-circle expressions on latitude / longitude in degrees."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: mean Earth radius in kilometres.
EARTH_RADIUS_KM = 6371.0


def degrees_from_micro(micro: Column) -> Column:
    return micro / F.lit(1e6)


def haversine_km(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    """Great-circle distance in kilometres."""
    half_dlat = F.radians(lat_b - lat_a) / 2
    half_dlon = F.radians(lon_b - lon_a) / 2
    a = F.pow(F.sin(half_dlat), F.lit(2.0)) + F.cos(F.radians(lat_a)) * F.cos(
        F.radians(lat_b)
    ) * F.pow(F.sin(half_dlon), F.lit(2.0))
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def unit_sphere(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    """Position on the unit sphere, where poles and the date line are ordinary places."""
    phi, theta = F.radians(lat), F.radians(lon)
    return F.cos(phi) * F.cos(theta), F.cos(phi) * F.sin(theta), F.sin(phi)


def chord_of_km(km: float) -> float:
    """Straight-line length on the unit sphere of a great-circle distance."""
    return 2 * math.sin(min(km / (2 * EARTH_RADIUS_KM), math.pi / 2))


def km_of_chord(chord: Column) -> Column:
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.least(F.lit(1.0), chord / 2))
