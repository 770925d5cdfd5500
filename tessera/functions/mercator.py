"""Web Mercator between degrees, the unit square, tiles, and metres."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_LATITUDE = 85.0511287798
EARTH_M = 40075016.68557849


def world_x(lon: Column) -> Column:
    return (lon + 180) / 360


def world_y(lat: Column) -> Column:
    lat = F.least(F.greatest(lat, F.lit(-MAX_LATITUDE)), F.lit(MAX_LATITUDE))
    return (1 - F.asinh(F.tan(F.radians(lat))) / math.pi) / 2


def longitude(wx: Column) -> Column:
    return wx * 360 - 180


def latitude(wy: Column) -> Column:
    return F.degrees(F.atan(F.sinh((1 - 2 * wy) * math.pi)))


def tile(world: Column, z: Column | int) -> Column:
    """Tile number of a place in [0, 1); places on the far edge go to the last tile."""
    n = F.pow(F.lit(2.0), z if isinstance(z, Column) else F.lit(z))
    return F.least(F.greatest(F.floor(world * n), F.lit(0)), (n - 1).cast("long")).cast("int")


def metres_per_unit(z: Column, wy: Column, units: int) -> Column:
    """Ground length of one of ``units`` per tile at a latitude, that of ``wy``."""
    return F.cos(F.radians(latitude(wy))) * EARTH_M / F.pow(F.lit(2.0), z) / units
