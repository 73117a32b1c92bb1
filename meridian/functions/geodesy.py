"""Points on the ellipsoid, directions and boxes as Column expressions. Angles are radians, lengths metres; vectors are tuples of three Columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# WGS84 and the mean radius.
A, INVERSE_FLATTENING, MEAN_RADIUS = 6378137.0, 298.257223563, 6371008.8
FLATTENING = 1 / INVERSE_FLATTENING
E2 = FLATTENING * (2 - FLATTENING)
B = A * (1 - FLATTENING)
Vec = tuple[Column, Column, Column]


def clamp(v, low, high):
    return F.least(F.greatest(v, low if isinstance(low, Column) else F.lit(float(low))), high if isinstance(high, Column) else F.lit(float(high)))


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def minus(a: Vec, b: Vec) -> Vec:
    return a[0] - b[0], a[1] - b[1], a[2] - b[2]


def length(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def geodetic_to_ecef(lon: Column, lat: Column, height: Column) -> Vec:
    n = F.lit(A) / F.sqrt(1 - E2 * F.sin(lat) * F.sin(lat))
    return (n + height) * F.cos(lat) * F.cos(lon), (n + height) * F.cos(lat) * F.sin(lon), (n * (1 - E2) + height) * F.sin(lat)


def with_geodetic(df: DataFrame, x: str, y: str, z: str, names=("lon", "lat", "height")) -> DataFrame:
    """``df`` with the geodetic position of an ECEF point: a first guess, then four fixed-point steps, each a column of its own so that none is computed twice.

    On the axis the latitude is that of the pole; within a metre of it the height comes from z.
    """
    lon, lat, height = names
    rho, guess = F.sqrt(F.col(x) * F.col(x) + F.col(y) * F.col(y)), F.atan2(F.col(z) * A, F.col("_rho") * B)
    second = (A * A - B * B) / (B * B)
    d = df.withColumn("_rho", rho).withColumn("_lat", guess)
    d = d.withColumn("_lat", F.atan2(F.col(z) + second * B * F.pow(F.sin("_lat"), 3), F.col("_rho") - E2 * A * F.pow(F.cos("_lat"), 3)))
    n = F.lit(A) / F.sqrt(1 - E2 * F.sin("_lat") * F.sin("_lat"))
    for _ in range(4):
        d = d.withColumn("_n", n).withColumn("_h", F.col("_rho") / F.cos("_lat") - F.col("_n"))
        d = d.withColumn("_lat", F.when(F.col("_rho") > 0, F.atan2(F.col(z) / F.col("_rho"), 1 - E2 * F.col("_n") / (F.col("_n") + F.col("_h")))).otherwise(F.lit(0.0)))
    d = d.withColumn("_n", n)
    sin = F.sin("_lat")
    up = F.when(F.col("_rho") > 1, F.col("_rho") / F.cos("_lat") - F.col("_n")).otherwise(F.abs(z) / F.abs(F.when(sin != 0, sin).otherwise(F.lit(1.0))) - F.col("_n") * (1 - E2))
    pole = F.col("_rho") == 0
    d = d.withColumn(height, F.when(pole, F.abs(z) - B).otherwise(up)).withColumn(lat, F.when(pole, F.when(F.col(z) < 0, F.lit(-math.pi / 2)).otherwise(F.lit(math.pi / 2))).otherwise(F.col("_lat")))
    return d.withColumn(lon, F.atan2(y, x)).drop("_rho", "_lat", "_n", "_h")


def enu_frame(lon: Column, lat: Column) -> tuple[Vec, Vec, Vec]:
    """East, north and up at a place."""
    east = -F.sin(lon), F.cos(lon), F.lit(0.0)
    north = -F.sin(lat) * F.cos(lon), -F.sin(lat) * F.sin(lon), F.cos(lat)
    up = F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat)
    return east, north, up


def rectangle_extents(west: Column, south: Column, east: Column, north: Column, low: Column, high: Column) -> dict[str, Column]:
    """Of a rectangle up to pi wide, the least and greatest coordinate along east, north and up of the plane that touches its middle."""
    lon, lat = (west + east) / 2, (south + north) / 2
    origin, axes = geodetic_to_ecef(lon, lat, F.lit(0.0)), enu_frame(lon, lat)
    widest = F.when((south < 0) & (north > 0), F.lit(0.0)).otherwise(lat)

    def along(axis, at_lon, at_lat, h):
        return dot(minus(geodetic_to_ecef(at_lon, at_lat, h), origin), axis)

    e, n, u = axes
    min_x = F.least(along(e, west, north, high), along(e, west, widest, high), along(e, west, south, high))
    return {
        "min_x": min_x, "max_x": -min_x,
        "min_y": F.least(along(n, west, south, high), along(n, lon, south, high)), "max_y": F.greatest(along(n, west, north, high), along(n, lon, north, high)),
        "min_z": F.least(along(u, west, north, low), along(u, west, south, low)), "max_z": high,
    }


def arc(lon_a: Column, lat_a: Column, lon_b: Column, lat_b: Column) -> Column:
    """Angle between two places along a great circle."""
    return F.acos(clamp(F.sin(lat_a) * F.sin(lat_b) + F.cos(lat_a) * F.cos(lat_b) * F.cos(lon_b - lon_a), -1, 1))


def along(lon_a: Column, lat_a: Column, lon_b: Column, lat_b: Column, d: Column, t: Column) -> tuple[Column, Column]:
    """The place ``t`` of the way from a to b, ``d`` being their ``arc``; a itself where they are one."""
    sin_d = F.when(d < 1e-12, F.lit(1.0)).otherwise(F.sin(d))
    sa, sb = F.sin((1 - t) * d) / sin_d, F.sin(t * d) / sin_d
    x = sa * F.cos(lat_a) * F.cos(lon_a) + sb * F.cos(lat_b) * F.cos(lon_b)
    y = sa * F.cos(lat_a) * F.sin(lon_a) + sb * F.cos(lat_b) * F.sin(lon_b)
    z = sa * F.sin(lat_a) + sb * F.sin(lat_b)
    same = d < 1e-12
    return F.when(same, lon_a).otherwise(F.atan2(y, x)), F.when(same, lat_a).otherwise(F.atan2(z, F.sqrt(x * x + y * y)))


def turn_between(a: Column, b: Column) -> Column:
    """Signed smallest angle from a to b, in [-pi, pi)."""
    return F.pmod(b - a + math.pi, F.lit(2 * math.pi)) - math.pi


def bearing(lon: Column, lat: Column, start: Vec, end: Vec, least: float = 1.0) -> Column:
    """Compass bearing from ``start`` (whose place is lon, lat) to ``end``, clockwise from north; null within ``least`` metres on the plane."""
    e, n, _ = enu_frame(lon, lat)
    toward = minus(end, start)
    x, y = dot(toward, e), dot(toward, n)
    return F.when(F.sqrt(x * x + y * y) >= least, F.pmod(F.atan2(x, y), F.lit(2 * math.pi)))


def leash(point: Vec, subject: Vec, most: Column) -> Vec:
    """``point``, drawn in to ``most`` metres of ``subject``."""
    off = minus(point, subject)
    held, size = F.greatest(most, F.lit(0.0)), length(off)
    scale = F.when(size > held, held / size).otherwise(F.lit(1.0))
    return tuple(s + o * scale for s, o in zip(subject, off))


def heading(lon: Column, lat: Column, direction: Vec, up: Vec) -> Column:
    """Compass heading of a view in [0, 2 pi); of one straight down or up, that of its own up."""
    e, n, u = enu_frame(lon, lat)

    def flat(v):
        along_up = dot(v, u)
        return tuple(a - b * along_up for a, b in zip(v, u))

    d, own = flat(direction), flat(up)
    level = dot(d, d) < 1e-18
    return F.pmod(F.when(level, F.atan2(dot(own, e), dot(own, n))).otherwise(F.atan2(dot(d, e), dot(d, n))), F.lit(2 * math.pi))


def pitch(lon: Column, lat: Column, direction: Vec) -> Column:
    """Angle of a view below the horizontal."""
    return F.asin(clamp(-dot(direction, enu_frame(lon, lat)[2]), -1, 1))


def follow_camera(subject: Vec, lon: Column, lat: Column, toward: Column, below: Column, distance: Column) -> Vec:
    """Where a camera stands that looks at ``subject`` along a heading, from ``below`` radians above it."""
    e, n, u = enu_frame(lon, lat)
    return tuple(s - (nn * F.cos(toward) + ee * F.sin(toward)) * F.cos(below) * distance + uu * F.sin(below) * distance for s, ee, nn, uu in zip(subject, e, n, u))


def ray_ellipsoid(origin: Vec, direction: Vec) -> Column:
    """Distance along a ray, in lengths of ``direction``, to the ellipsoid's first point in front; null where it misses."""
    o, d = (tuple(c / F.lit(r) for c, r in zip(v, (A, A, B))) for v in (origin, direction))
    a, b, c = dot(d, d), 2 * dot(o, d), dot(o, o) - 1
    disc = b * b - 4 * a * c
    root = F.sqrt(F.greatest(disc, F.lit(0.0)))
    near, far = (-b - root) / (2 * a), (-b + root) / (2 * a)
    return F.when(disc >= 0, F.when(near > 0, near).when(far > 0, far))


def hits_globe(eye: Vec, direction: Vec, inside: float) -> Column:
    """Whether a ray meets the ellipsoid shrunk by ``inside`` metres in front of the eye."""
    o, d = (tuple(c / F.lit(r - inside) for c, r in zip(v, (A, A, B))) for v in (eye, direction))
    a, b, c = dot(d, d), 2 * dot(o, d), dot(o, o) - 1
    disc = b * b - 4 * a * c
    return (disc >= 0) & ((-b - F.sqrt(F.greatest(disc, F.lit(0.0)))) > 0)


def planes_keep(planes: list[tuple[Vec, Column]], center: Vec, radius) -> Column:
    """Whether every plane (normal, offset) has ``center`` no further behind it than ``radius(normal)``: conservative, it may keep what is out of sight."""
    kept = F.lit(True)
    for normal, offset in planes:
        kept = kept & (dot(normal, center) + offset >= -radius(normal))
    return kept


def sphere_in_planes(planes, center: Vec, radius: Column) -> Column:
    return planes_keep(planes, center, lambda _: radius)


def box_in_planes(planes, center: Vec, axes: list[Vec]) -> Column:
    return planes_keep(planes, center, lambda n: F.abs(dot(axes[0], n)) + F.abs(dot(axes[1], n)) + F.abs(dot(axes[2], n)))


def hides(planet: Vec, planet_radius: Column, center: Vec, radius: Column, eye: Vec) -> Column:
    """Whether a planet hides a sphere from an eye: beyond the horizon and within the shadow of the planet shrunk by the sphere."""
    shrunk, to_eye, to_volume = planet_radius - radius, minus(eye, planet), minus(center, eye)
    horizon, depth = dot(to_eye, to_eye) - shrunk * shrunk, -dot(to_volume, to_eye)
    return (shrunk > 0) & (horizon > 0) & (depth > horizon) & (depth * depth > horizon * dot(to_volume, to_volume))


def box_distance(center: Vec, axes: list[Vec], p: Vec) -> Column:
    """Distance from a point to a box, 0 inside; axes without length don't count."""
    d, nearest = minus(p, center), center
    for axis in axes:
        size = length(axis)
        has = size > 2.220446049250313e-16
        unit = tuple(F.when(has, a / size).otherwise(F.lit(0.0)) for a in axis)
        t = F.least(F.greatest(dot(d, unit), -size), size)
        nearest = tuple(c + u * t for c, u in zip(nearest, unit))
    return length(minus(p, nearest))


def box_hit(center: Vec, axes: list[Vec], origin: Vec, direction: Vec) -> Column:
    """Whether a ray meets a box: slab by slab; one parallel to a slab must lie in it; a start inside is a hit."""
    offset_all, near, far, inside = minus(center, origin), F.lit(-math.inf), F.lit(math.inf), F.lit(True)
    for axis in axes:
        half = length(axis)
        has = half > 0
        unit = tuple(F.when(has, a / half).otherwise(F.lit(0.0)) for a in axis)
        speed, offset = dot(direction, unit), dot(offset_all, unit)
        crosses = has & (F.abs(speed) > 2.220446049250313e-16)
        by = F.when(crosses, speed).otherwise(F.lit(1.0))
        a, b = (offset - half) / by, (offset + half) / by
        near = F.when(crosses, F.greatest(near, F.least(a, b))).otherwise(near)
        far = F.when(crosses, F.least(far, F.greatest(a, b))).otherwise(far)
        inside = inside & ~(has & ~crosses & (F.abs(offset) > half))
    return inside & (near <= far) & (far >= 0)


def screen_space_error(geometric_error: Column, distance: Column, height_px: Column, denominator: Column, scale: Column | None = None) -> Column:
    """Pixels that an error takes on the screen; inside the volume a distance of 1e-7 counts."""
    return geometric_error * (height_px / scale if scale is not None else height_px) / (F.greatest(distance, F.lit(1e-7)) * denominator)
