"""Web Mercator tile arithmetic in pure column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS = 6378137.0
MOST_LAT = 85.05112878
TILE = 256


def _size(z: Column) -> Column:
    return F.pow(F.lit(2.0), z)


def x_position(lon: Column, z: Column) -> Column:
    return (lon + 180.0) / 360.0 * _size(z)


def y_position(lat: Column, z: Column) -> Column:
    held = F.greatest(F.lit(-MOST_LAT), F.least(F.lit(MOST_LAT), lat))
    return (1 - F.asinh(F.tan(F.radians(held))) / math.pi) / 2 * _size(z)


def tile_x(lon: Column, z: Column) -> Column:
    return x_position(lon, z).cast("bigint")


def tile_y(lat: Column, z: Column) -> Column:
    return y_position(lat, z).cast("bigint")


def pixel(position: Column) -> Column:
    return position * TILE


def tile_west(x: Column, z: Column) -> Column:
    return x / _size(z) * 360 - 180


def tile_north(y: Column, z: Column) -> Column:
    return F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * y / _size(z)))))


def bounds(x: Column, y: Column, z: Column) -> dict[str, Column]:
    return {"west": tile_west(x, z), "south": tile_north(y + 1, z), "east": tile_west(x + 1, z), "north": tile_north(y, z)}


def pixel_to_mercator(px: Column, py: Column, z: Column) -> tuple[Column, Column]:
    origin = math.pi * RADIUS
    return px / (TILE * _size(z)) * origin * 2 - origin, origin - py / (TILE * _size(z)) * origin * 2


def flip_row(y: Column, z: Column) -> Column:
    """Between the two directions of counting rows."""
    return F.pow(F.lit(2), z).cast("bigint") - 1 - y


def quadkey(x: Column, y: Column, z: Column) -> Column:
    def digit(level: Column) -> Column:
        place = F.pow(F.lit(2), level - 1).cast("bigint")
        return (F.pmod(F.floor(x / place), F.lit(2)) + 2 * F.pmod(F.floor(y / place), F.lit(2))).cast("int").cast("string")

    return F.when(z > 0, F.array_join(F.transform(F.sequence(z.cast("int"), F.lit(1), F.lit(-1)), digit), "")).otherwise("")


def is_valid(x: Column, y: Column, z: Column) -> Column:
    most = F.pow(F.lit(2), z)
    return (z >= 0) & (z <= 24) & (x >= 0) & (y >= 0) & (x < most) & (y < most)


def terrarium_height(r: Column, g: Column, b: Column) -> Column:
    return r * 256 + g + b / 256 - 32768


def ring_area(points: Column) -> Column:
    """Signed shoelace area of an array of structs (x, y); the ring is closed if it is not."""
    n = F.size(points)

    def term(i: Column) -> Column:
        p, q = F.get(points, i), F.get(points, F.pmod(i + 1, n))
        return p["x"] * q["y"] - q["x"] * p["y"]

    return F.when(n > 0, F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), term), F.lit(0.0), lambda a, v: a + v) / 2)
