"""Tile addresses and geodesy as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

# WGS84 and the mean radius used for distances in metres.
A, INVERSE_FLATTENING, MEAN_RADIUS = 6378137.0, 298.257223563, 6371008.8
E2 = (2 - 1 / INVERSE_FLATTENING) / INVERSE_FLATTENING


def haversine(lon_a, lat_a, lon_b, lat_b):
    p, q = F.radians(lat_a), F.radians(lat_b)
    h = F.pow(F.sin((q - p) / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin(F.radians(lon_b - lon_a) / 2), 2)
    return 2 * MEAN_RADIUS * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def ecef(lon, lat, height):
    """Geodetic degrees and metres to (x, y, z)."""
    p, l = F.radians(lat), F.radians(lon)
    n = A / F.sqrt(1 - E2 * F.pow(F.sin(p), 2))
    return (n + height) * F.cos(p) * F.cos(l), (n + height) * F.cos(p) * F.sin(l), (n * (1 - E2) + height) * F.sin(p)


def tile_of(lon, lat, level: int):
    """Web Mercator (x, y) of a point in degrees, y from north, clamped to the grid."""
    n, most = 1 << level, 85.05112877980659
    p = F.radians(F.least(F.lit(most), F.greatest(F.lit(-most), lat)))
    x, y = (lon + 180) / 360 * n, (1 - F.ln(F.tan(p) + 1 / F.cos(p)) / math.pi) / 2 * n

    def held(v):
        return F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor(v))).cast("long")

    return held(x), held(y)


def bounds(level, x, y):
    """(west, south, east, north) of a Web Mercator tile in degrees."""
    n = F.pow(F.lit(2.0), level)

    def lat(v):
        return F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * v / n))))

    return x / n * 360 - 180, lat(y + 1), (x + 1) / n * 360 - 180, lat(y)


def quadkey(level, x, y):
    """Base-4 digits, the most significant first; level 0 gives an empty string."""
    bits = F.when(level > 0, F.sequence(level - 1, F.lit(0).cast("long"), F.lit(-1).cast("long"))).otherwise(F.array().cast("array<long>"))

    def bit(v, i):
        return F.floor(v / F.pow(F.lit(2.0), i)).cast("long") % 2

    return F.array_join(F.transform(bits, lambda i: (bit(x, i) + 2 * bit(y, i)).cast("string")), "")


def level_base(level):
    """Tiles of all levels above: (4**z - 1) / 3."""
    return ((F.pow(F.lit(4.0), level) - 1) / 3).cast("long")


def turn_between(a, b):
    """Signed smallest angle from a to b, in [-pi, pi)."""
    return F.pmod(b - a + math.pi, F.lit(2 * math.pi)) - math.pi
