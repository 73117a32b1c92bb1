"""Tiling schemes, archive ids and zones as Column expressions. Two grids: ``web-mercator`` (1 x 1, y from north) and ``geographic`` (2 x 1)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from meridian.functions.geodesy import A, MEAN_RADIUS, clamp

# Where the Mercator square ends, the deepest level of addresses, metres a degree, the deepest archive level.
MERCATOR_MAX_LAT, MAX_LEVEL, M_PER_DEG, MAX_ZOOM = 1.4844222297453324, 31, MEAN_RADIUS * math.pi / 180, 31
EDGE_REACH = 1.0e-4
TAU = 2 * math.pi


def power_of_two(level: Column) -> Column:
    return F.pow(F.lit(2.0), level).cast("long")


def is_mercator(grid: Column) -> Column:
    return grid == "web-mercator"


def to_normalized(grid: Column, lon: Column, lat: Column) -> tuple[Column, Column]:
    """A place (radians) in the unit square, y down, held to the square."""
    held = clamp(lat, -MERCATOR_MAX_LAT, MERCATOR_MAX_LAT)
    y = F.when(is_mercator(grid), 0.5 - F.ln(F.tan(math.pi / 4 + held / 2)) / TAU).otherwise(0.5 - lat / math.pi)
    return clamp((lon + math.pi) / TAU, 0, 1), clamp(y, 0, 1)


def from_normalized(grid: Column, x: Column, y: Column) -> tuple[Column, Column]:
    lat = F.when(is_mercator(grid), 2 * F.atan(F.exp((0.5 - y) * TAU)) - math.pi / 2).otherwise((0.5 - y) * math.pi)
    return x * TAU - math.pi, lat


def tiles_at(grid: Column, level: Column) -> tuple[Column, Column]:
    """Columns and rows of a level (31 at most)."""
    n = power_of_two(F.least(level, F.lit(MAX_LEVEL).cast("long")))
    return F.when(is_mercator(grid), n).otherwise(2 * n), n


def tile_extent(grid: Column, level: Column, x: Column, y: Column) -> tuple[Column, Column, Column, Column]:
    nx, ny = tiles_at(grid, level)
    w, h = F.lit(1.0) / nx, F.lit(1.0) / ny
    return x * w, y * h, (x + 1) * w, (y + 1) * h


def tile_rect(grid: Column, level: Column, x: Column, y: Column) -> tuple[Column, Column, Column, Column]:
    """(west, south, east, north) in radians of a tile whose y counts from north."""
    x0, y0, x1, y1 = tile_extent(grid, level, x, y)
    (west, north), (east, south) = from_normalized(grid, x0, y0), from_normalized(grid, x1, y1)
    return west, south, east, north


def terrain_rect(level: Column, x: Column, y: Column) -> tuple[Column, Column, Column, Column]:
    """(west, south, east, north) in radians of a 2 x 1 geographic tile whose y counts from south."""
    n = power_of_two(level)
    w, h = F.lit(TAU) / (2 * n), F.lit(math.pi) / n
    west, south = -math.pi + x * w, -math.pi / 2 + y * h
    return west, south, west + w, south + h


def level_zero_error(radius: float = A, roots: int = 2) -> float:
    return radius * TAU * 0.25 / (65 * roots)


def level_error(level: Column, radius: float = A, roots: int = 2) -> Column:
    return F.lit(level_zero_error(radius, roots)) / power_of_two(level)


def level_for_rectangle(grid: Column, width: Column, texels: Column, tile_size: int = 256, deepest: int = 19) -> Column:
    """The coarsest level at which a rectangle ``width`` radians wide has ``texels`` texels across."""
    part = F.greatest(F.greatest(width, F.lit(0.0)) / TAU, F.lit(1e-12))
    roots = F.when(is_mercator(grid), 1.0).otherwise(2.0)
    return F.least(F.greatest(F.ceil(F.log2(F.greatest(texels, F.lit(1.0)) / (part * roots * tile_size))), F.lit(0).cast("long")), F.lit(deepest).cast("long"))


def level_for_spacing(grid: Column, spacing: Column, lat: Column, tile_size: int = 256, deepest: int = 19) -> Column:
    """The level whose texels are nearest to ``spacing`` metres at a latitude."""
    across = F.lit(A * TAU / tile_size) * F.when(is_mercator(grid), F.cos(lat)).otherwise(F.lit(0.5))
    return F.least(F.greatest(F.round(F.log2(across / F.greatest(spacing, F.lit(1e-3)))), F.lit(0.0)), F.lit(float(deepest))).cast("long")


def tile_range(grid: Column, level: Column, west: Column, south: Column, east: Column, north: Column) -> tuple[Column, Column, Column, Column]:
    """(x0, x1, y0, y1), inclusive, of the tiles that cover a rectangle."""
    (u0, v0), (u1, v1) = to_normalized(grid, west, north), to_normalized(grid, east, south)
    nx, ny = tiles_at(grid, level)

    def tile(v, n):
        return F.least(F.floor(v * n), n - 1)

    return tile(u0, nx), tile(F.greatest(u0, u1), nx), tile(v0, ny), tile(F.greatest(v0, v1), ny)


def mosaic_levels(level: Column, coarsest: int = 0) -> Column:
    """The levels that a mosaic may step back through, the finest first."""
    return F.sequence(level, F.lit(coarsest).cast("long"), F.lit(-1).cast("long"))


def bounds_degrees(grid: Column, level: Column, x: Column, y: Column) -> tuple[Column, Column, Column, Column]:
    """(west, south, east, north) in degrees of a stored tile: Mercator from north, geographic from south-west."""
    n = F.pow(F.lit(2.0), level)

    def lat(v):
        return F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * v / n))))

    size = 180 / n
    mercator = x / n * 360 - 180, lat(y + 1), (x + 1) / n * 360 - 180, lat(y)
    geographic = -180 + x * size, -90 + y * size, -180 + x * size + size, -90 + y * size + size
    return tuple(F.when(is_mercator(grid), m).otherwise(g) for m, g in zip(mercator, geographic))


def width_m(grid: Column, level: Column, x: Column, y: Column) -> Column:
    """The larger side of a tile in metres, its width taken at its middle latitude."""
    w, s, e, n = bounds_degrees(grid, level, x, y)
    return F.greatest((e - w) * M_PER_DEG * F.cos(F.radians((s + n) / 2)), (n - s) * M_PER_DEG)


def grid_size(grid: Column, level: Column) -> tuple[Column, Column]:
    n = power_of_two(level)
    return F.when(is_mercator(grid), n).otherwise(2 * n), n


def in_grid(grid: Column, level: Column, x: Column, y: Column) -> Column:
    w, h = grid_size(grid, level)
    deepest = F.when(is_mercator(grid), MAX_ZOOM).otherwise(MAX_ZOOM - 1)
    return (level >= 0) & (level <= deepest) & (x >= 0) & (x < w) & (y >= 0) & (y < h)


def archive_level(grid: Column, level: Column) -> Column:
    """Geographic tiles are stored one level down, where a square holds them."""
    return F.when(is_mercator(grid), level).otherwise(level + 1)


def level_base(z: Column) -> Column:
    """Ids of all coarser levels: (4**z - 1) / 3."""
    return F.call_function("div", _four_to(z) - 1, F.lit(3).cast("long"))


def _four_to(z: Column) -> Column:
    return F.pow(F.lit(4.0), z).cast("long")


def _hilbert_steps() -> str:
    """For each turn of the square and four bits of x and y: their eight bits along the curve, and the turn after them, as an SQL array.

    A turn is whether x and y are exchanged (2) and whether their bits are inverted (1).
    """
    out = []
    for turn in range(4):
        for x in range(16):
            for y in range(16):
                d, swap, inverted = 0, turn >> 1, turn & 1
                for i in (3, 2, 1, 0):
                    rx, ry = ((v >> i & 1) ^ inverted for v in ((y, x) if swap else (x, y)))
                    d = d * 4 + ((3 * rx) ^ ry)
                    if ry == 0:
                        swap, inverted = 1 - swap, inverted ^ rx
                out.append(d * 4 + swap * 2 + inverted)
    return "array(" + ", ".join(f"{v}L" for v in out) + ")"


_STEPS = _hilbert_steps()


def hilbert(z: Column, x: Column, y: Column) -> Column:
    """Place of a tile along the Hilbert curve of its level: four bits at a time from the top, the square turned as the curve turns."""
    table, fours = F.expr(_STEPS), F.ceil(z / 4).cast("int")
    mask = F.pow(F.lit(2.0), z).cast("long") - 1
    # bits above the level's are 0, and each such pair turns the square once
    at = F.struct((x.cast("long").bitwiseAND(mask)).alias("x"), (y.cast("long").bitwiseAND(mask)).alias("y"), F.when(fours > 0, F.sequence(fours - 1, F.lit(0), F.lit(-1))).otherwise(F.array().cast("array<int>")).alias("i"), F.when((fours * 4 - z) % 2 == 1, 2).otherwise(0).cast("long").alias("turn"))

    def along(s):
        def four(v, i):
            return F.call_function("shiftright", s[v], i * 4).bitwiseAND(15)

        def step(acc, i):
            found = F.get(table, (acc.bitwiseAND(3) * 256 + four("x", i) * 16 + four("y", i)).cast("int"))
            return F.shiftleft(acc.bitwiseAND(-4), 8).bitwiseOR(found)

        return F.aggregate(s["i"], s["turn"], step, lambda acc: F.shiftrightunsigned(acc, 2))

    return F.get(F.transform(F.array(at), along), F.lit(0))


def to_id(grid: Column, level: Column, x: Column, y: Column) -> Column:
    """Archive id of a tile; null outside the grid."""
    z = F.least(F.greatest(archive_level(grid, level), F.lit(0).cast("long")), F.lit(MAX_ZOOM).cast("long"))  # held, so that nothing overflows where there is no id
    return F.when(in_grid(grid, level, x, y), level_base(z) + hilbert(z, x, y))


def from_id(grid: Column, tile_id: Column) -> Column:
    """struct(level, x, y) of an archive id; null where the grid has no such tile."""
    most = F.least(F.floor((F.length(F.bin(tile_id)) + 1) / 2).cast("long"), F.lit(MAX_ZOOM).cast("long"))
    z = F.when(tile_id < level_base(most), most - 1).otherwise(most)
    sides = F.when(z > 0, F.sequence(F.lit(0).cast("long"), z - 1)).otherwise(F.array().cast("array<long>"))

    def step(s, i):
        side = F.pow(F.lit(2.0), i).cast("long")
        rx = F.shiftright(s["d"], 1).bitwiseAND(1)
        ry = s["d"].bitwiseXOR(rx).bitwiseAND(1)
        flip = (ry == 0) & (rx == 1)
        a, b = (F.when(flip, side - 1 - s[v]).otherwise(s[v]) for v in "xy")
        turned = ry == 0
        return F.struct(F.shiftright(s["d"], 2).alias("d"), (F.when(turned, b).otherwise(a) + side * rx).alias("x"), (F.when(turned, a).otherwise(b) + side * ry).alias("y"))

    start = F.struct((tile_id - level_base(z)).alias("d"), F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"))
    at = F.aggregate(sides, start, step, lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y")))
    level = F.when(is_mercator(grid), z).otherwise(z - 1)
    out = F.struct(level.alias("level"), at["x"].alias("x"), at["y"].alias("y"))
    return F.when(in_grid(grid, level, at["x"], at["y"]), out)


def zone_of(zone_level: int, level: Column, x: Column, y: Column) -> Column:
    """``top`` above the zone level, else the address of the cell that holds a tile."""
    n = F.pow(F.lit(2.0), level - zone_level).cast("long")
    return F.when(level < zone_level, F.lit("top")).otherwise(F.concat_ws("/", F.call_function("div", x, n).cast("string"), F.call_function("div", y, n).cast("string")))


def zone_prefix(layer: Column, zone_level: int, zone: Column) -> Column:
    return F.when(zone == "top", F.concat(layer, F.lit("/top"))).otherwise(F.concat(layer, F.lit(f"/zones/z{zone_level}/"), zone))


def zone_id_ranges(grid: Column, zone_level: int, x: Column, y: Column) -> Column:
    """array of struct(z, first, last): the ids that a zone's cell can hold, one run for each level, as the curve never leaves a cell."""
    offset = F.when(is_mercator(grid), 0).otherwise(1).cast("long")
    zone_z = offset + zone_level
    deepest = F.lit(MAX_ZOOM).cast("long")
    along = hilbert(zone_z, x, y)

    def of(z):
        span = F.pow(F.lit(4.0), z - zone_z).cast("long")
        first = level_base(z) + along * span
        return F.struct(z.alias("z"), first.alias("first"), (first + span - 1).alias("last"))

    return F.transform(F.sequence(zone_z, deepest), of)


def epoch(at: Column, expiry_days: Column) -> Column:
    """``d`` for a durable layer (null expiry), else the month as YYYYMM."""
    return F.when(expiry_days.isNull(), F.lit("d")).otherwise(F.date_format(at, "yyyyMM"))


def epoch_end(name: Column) -> Column:
    """First day after an epoch's month; null for what is no month."""

    def end(n):
        month = F.make_date(F.substring(n, 1, 4).cast("int"), F.substring(n, 5, 2).cast("int"), F.lit(1))
        return F.when(n.rlike("^(?!0000)[0-9]{4}(0[1-9]|1[0-2])$"), F.add_months(month, 1))

    return F.get(F.transform(F.array(name), end), F.lit(0))  # so that a name that is itself computed is so once


def expires_at(name: Column, expiry_days: Column) -> Column:
    return F.date_add(epoch_end(name), expiry_days.cast("int"))


def is_expired(name: Column, expiry_days: Column, today: Column) -> Column:
    """Whether the epoch's end lies more than ``expiry_days`` back; durable layers and names that are no month never expire."""
    return F.coalesce(F.datediff(today, epoch_end(name)) > expiry_days, F.lit(False))


def neighbours(grid: Column, level: Column, x: Column, y: Column) -> Column:
    """array of struct(x, y): the up to eight cells around one; x wraps around the globe, y does not."""
    w, h = grid_size(grid, level)
    around = [(dx, dy) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dx or dy]
    cells = F.array(*[F.struct(F.pmod(x + dx, w).alias("x"), (y + dy).alias("y")) for dx, dy in around])
    return F.array_distinct(F.filter(cells, lambda c: (c["y"] >= 0) & (c["y"] < h)))


def digest(data: Column) -> Column:
    """FNV-1a of a text's UTF-8 bytes as 16 hex digits, in halves of 32 bits so that nothing overflows."""
    raw = F.hex(data.cast("binary"))
    mask = 0xFFFFFFFF

    def step(s, i):
        byte = F.conv(F.substring(raw, 2 * i + 1, F.lit(2)), 16, 10).cast("long")
        low = s["low"].bitwiseXOR(byte)
        times = low * 435
        high = (s["high"] * 435 + F.shiftright(times, 32) + F.shiftleft(low, 8)).bitwiseAND(mask)
        return F.struct(high.alias("high"), times.bitwiseAND(mask).alias("low"))

    n = F.octet_length(data)
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    start = F.struct(F.lit(0xCBF29CE4).alias("high"), F.lit(0x84222325).alias("low"))
    return F.aggregate(at, start, step, lambda s: F.lower(F.concat(F.lpad(F.hex(s["high"]), 8, "0"), F.lpad(F.hex(s["low"]), 8, "0"))))
