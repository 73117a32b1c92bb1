"""Light and colour as Column expressions; colours are tuples of three Columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Luminance weights, the least light that counts, the sun's magnitude and temperature, cells of a sky face.
LUMA, FLOOR, SUN_V, SUN_KELVIN, STAR_CELLS = (0.2126, 0.7152, 0.0722), 0.004, -26.76, 5772.0, 32


def linear(stored: Column) -> Column:
    """sRGB 0 to 255 as linear light."""
    v = stored / 255.0
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def luma(c) -> Column:
    return LUMA[0] * c[0] + LUMA[1] * c[1] + LUMA[2] * c[2]


def stops(c) -> Column:
    return F.log2(F.greatest(luma(c), F.lit(1e-6)))


def step(a, b) -> Column:
    """Largest change of a channel between two colours, in stops."""
    return F.greatest(*[F.abs(F.log2((x + FLOOR) / (y + FLOOR))) for x, y in zip(a, b)])


def graded(c, black, gain, contrast: Column, pivot: Column, saturation: Column):
    """Black taken off (not below 0), gain, contrast as a power of luma about the pivot, saturation about luma; at exactly 1 the last two do nothing."""
    d = [F.greatest(v - b, F.lit(0.0)) * g for v, b, g in zip(c, black, gain)]
    by = F.when(contrast != 1, F.pow(F.greatest(luma(d), F.lit(1e-5)) / F.greatest(pivot, F.lit(1e-5)), contrast - 1)).otherwise(F.lit(1.0))
    d = [v * by for v in d]
    y = luma(d)
    return [F.when(saturation != 1, F.greatest(y + (v - y) * saturation, F.lit(0.0))).otherwise(v) for v in d]


def multiplier(gain_stops: Column, strength: Column) -> Column:
    return F.when((gain_stops == 0) | (strength == 0), F.lit(1.0)).otherwise(F.pow(F.lit(2.0), gain_stops * strength))


def irradiance(v: Column) -> Column:
    return F.pow(F.lit(10.0), -0.4 * (v - SUN_V))


def temperature(b_v: Column) -> Column:
    b = F.least(F.greatest(b_v, F.lit(-0.4)), F.lit(2.2))
    return 4600.0 * (1 / (0.92 * b + 1.7) + 1 / (0.92 * b + 0.62))


def _wavelengths():
    """Every 5 nm from 380 to 780: the fitted matching functions and the two numbers of Planck's law that don't depend on the temperature."""

    def lobe(at, mean, below, above):
        return math.exp(-0.5 * ((at - mean) / (below if at < mean else above)) ** 2)

    for at in range(380, 781, 5):
        x = 1.056 * lobe(at, 599.8, 37.9, 31.0) + 0.362 * lobe(at, 442.0, 16.0, 26.7) - 0.065 * lobe(at, 501.1, 20.4, 26.2)
        y = 0.821 * lobe(at, 568.8, 46.9, 40.5) + 0.286 * lobe(at, 530.9, 16.3, 31.1)
        z = 1.217 * lobe(at, 437.0, 11.8, 36.0) + 0.681 * lobe(at, 459.0, 26.0, 13.8)
        yield x, y, z, (at * 1e-9) ** 5, 1.4387769e-2 / (at * 1e-9)


def _rgb(x, y, z):
    return 3.2406 * x - 1.5372 * y - 0.4986 * z, -0.9689 * x + 1.8758 * y + 0.0415 * z, 0.0557 * x - 0.2040 * y + 1.0570 * z


def body_colour(kelvin: Column):
    """Colour of a black body against the sun's, of luminance 1: Planck's law under the matching functions, summed once for all three channels."""
    rows = list(_wavelengths())
    sun = _rgb(*(sum(r[i] / (r[3] * (math.exp(r[4] / SUN_KELVIN) - 1)) for r in rows) for i in range(3)))
    table = F.expr("array(" + ", ".join("named_struct(" + ", ".join(f"'{n}', {v!r}D" for n, v in zip("xyzmc", r)) + ")" for r in rows) + ")")
    zero = F.struct(*[F.lit(0.0).alias(n) for n in "xyz"])

    def add(acc, at, k):
        power = 1 / (at["m"] * (F.exp(at["c"] / k) - 1))
        return F.struct(*[(acc[n] + at[n] * power).alias(n) for n in "xyz"])

    def coloured(s):
        c = [F.greatest(a / b, F.lit(0.0)) for a, b in zip(_rgb(s["x"], s["y"], s["z"]), sun)]
        y = F.greatest(luma(c), F.lit(1e-12))
        return F.struct(*[(v / y).alias(n) for n, v in zip("rgb", c)])

    one = F.get(F.transform(F.array(kelvin), lambda k: F.aggregate(table, zero, lambda acc, at: add(acc, at, k), coloured)), F.lit(0))
    return [one[n] for n in "rgb"]


def magnitude_code(v: Column) -> Column:
    return F.least(F.greatest(F.round((v + 2) * 100), F.lit(0.0)), F.lit(1023.0)).cast("long")


def sky_cell(x: Column, y: Column, z: Column) -> Column:
    """Cell of a cube around the eye that a direction points to: six faces of 32 x 32."""
    ax, ay, az = F.abs(x), F.abs(y), F.abs(z)
    on_x, on_y = (ax >= ay) & (ax >= az), ay >= az
    pick = lambda a, b, c: F.when(on_x, a).when(on_y, b).otherwise(c)
    face = pick((x <= 0).cast("int"), 2 + (y <= 0).cast("int"), 4 + (z <= 0).cast("int"))
    major, u, v = pick(ax, ay, az), pick(y, x, x), pick(z, z, y)

    def at(t):
        return F.least(F.greatest(F.floor((t / major * 0.5 + 0.5) * STAR_CELLS), F.lit(0)), F.lit(STAR_CELLS - 1))

    return (face * STAR_CELLS * STAR_CELLS + at(v) * STAR_CELLS + at(u)).cast("long")
