"""Distances on the sphere, map tiles and cell codes as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
#: Bits of a cell number along one axis.
AXIS_BITS = 20
#: Spreads 20 bits so that two free bits stand between neighbours: (shift, mask) pairs.
SPREAD = ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres along the great circle of a sphere of radius 6 371 000 m."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def tile_xy(lat: Column, lon: Column, zoom: int) -> tuple[Column, Column]:
    """Column and row of the Web Mercator tile that holds a point."""
    n = float(1 << zoom)
    x = F.floor((lon + 180.0) / 360.0 * n)
    y = F.floor((1.0 - F.asinh(F.tan(F.radians(lat))) / math.pi) / 2.0 * n)
    return x.cast("int"), y.cast("int")


def tile_corner(x: Column, y: Column, zoom: int) -> tuple[Column, Column]:
    """Latitude and longitude of the north-west corner of a tile."""
    n = float(1 << zoom)
    lat = F.degrees(F.atan(F.sinh(F.lit(math.pi) * (1.0 - 2.0 * y / n))))
    return lat, x / n * 360.0 - 180.0


def unit_vector(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    """Position on the unit sphere; works for any latitude and longitude, poles included."""
    la, lo = F.radians(lat), F.radians(lon)
    return F.cos(la) * F.cos(lo), F.cos(la) * F.sin(lo), F.sin(la)


def with_morton3(df: DataFrame, x: Column, y: Column, z: Column, out: str) -> DataFrame:
    """Adds the code of a cell on the three-dimensional Z-order curve.

    The bits are spread in stages, one projection each: within one expression every stage would
    double the size of the generated code.
    """
    names = [f"__{out}{k}" for k in range(3)]
    # never NULL, else the planner infers a filter on the code and unfolds all stages into it
    df = df.withColumns({n: F.coalesce(c.cast("long"), F.lit(0).cast("long")) for n, c in zip(names, (x, y, z), strict=True)})
    for shift, mask in SPREAD:
        df = df.withColumns({n: F.col(n).bitwiseOR(F.shiftleft(F.col(n), shift)).bitwiseAND(F.lit(mask).cast("long")) for n in names})
    a, b, c = (F.col(n) for n in names)
    return df.withColumn(out, a.bitwiseOR(F.shiftleft(b, 1)).bitwiseOR(F.shiftleft(c, 2))).drop(*names)


#: The box (west, north, east, south) that addresses are looked for in, and what is asked behind a street.
LOOKUP_BOX = (8.45, 53.22, 9.05, 52.95)
LOOKUP_TAIL = ", Bremen, Germany"


def in_lookup_box(lat: Column, lon: Column) -> Column:
    west, north, east, south = LOOKUP_BOX
    return lat.between(south, north) & lon.between(west, east)


def lookup_text(street: Column) -> Column:
    """What an address service is asked for a street; NULL without one."""
    return F.concat(street, F.lit(LOOKUP_TAIL))
