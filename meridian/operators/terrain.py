"""Ground as a grid of heights and as tiles: sampling, spans, brushes, cover.

A height table is ``row, col, h`` with a cell every unit; places are in the same units, col along x, row along y.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridian.functions import geodesy as geo
from meridian.functions import grid
from meridian.operators.ranges import within


def bilinear(heights: DataFrame, probes: DataFrame, rows: int, cols: int) -> DataFrame:
    """``probes(probe, x, y)`` with ``h``, from the four samples around each; 0 outside the grid. The last sample counts whole, nothing beyond it is read."""
    inside = F.col("x").between(0, cols - 1) & F.col("y").between(0, rows - 1)
    c0, r0 = F.least(F.floor("x"), F.lit(cols - 2)), F.least(F.floor("y"), F.lit(rows - 2))
    p = probes.where(inside).withColumn("c0", c0.cast("long")).withColumn("r0", r0.cast("long"))
    fx, fy = F.col("x") - F.col("c0"), F.col("y") - F.col("r0")
    corners = F.array(*[F.struct((F.col("r0") + j).alias("row"), (F.col("c0") + i).alias("col"), ((fx if i else 1 - fx) * (fy if j else 1 - fy)).alias("w")) for j in (0, 1) for i in (0, 1)])
    at = p.select("probe", F.explode(corners).alias("k")).select("probe", "k.*")
    found = at.join(heights, ["row", "col"]).groupBy("probe").agg(F.sum(F.col("w") * F.col("h")).alias("h"))
    return probes.join(found, "probe", "left").withColumn("h", F.coalesce("h", F.lit(0.0)))


def box_means(heights: DataFrame, boxes: DataFrame) -> DataFrame:
    """``boxes(box, x, y, across, down)`` with the mean height over each box, cells weighted by the part of them under it; what is off the grid counts 0."""
    wide, high = F.greatest("across", F.lit(1.0)), F.greatest("down", F.lit(1.0))

    def span(centre, size):
        return F.sequence(F.floor(centre - size / 2 + 0.5).cast("long"), F.ceil(centre + size / 2 - 0.5).cast("long"))

    def part(cell, centre, size):
        return F.greatest(F.least(centre + size / 2, cell + 0.5) - F.greatest(centre - size / 2, cell - 0.5), F.lit(0.0))

    # a box has many cells: dealt by box first, so that a small file's few tasks don't hold the sums of all
    at = boxes.repartition("box").select("*", F.explode(span(F.col("x"), wide)).alias("col")).select("*", F.explode(span(F.col("y"), high)).alias("row"))
    w = part(F.col("col"), F.col("x"), wide) * part(F.col("row"), F.col("y"), high)
    sums = at.withColumn("w", w).where("w > 0").join(heights, ["row", "col"]).groupBy("box").agg(F.sum(F.col("w") * F.col("h")).alias("s"))
    return boxes.join(sums, "box", "left").withColumn("mean", F.coalesce("s", F.lit(0.0)) / (wide * high)).drop("s")


def ground_queries(heights: DataFrame, probes: DataFrame, rows: int, cols: int) -> DataFrame:
    """``probe, surface, solid``: the ground at or below a probe's z (null where it is above the probe, or off the grid), and whether the probe is in it."""
    at = bilinear(heights, probes, rows, cols)
    inside = F.col("x").between(0, cols - 1) & F.col("y").between(0, rows - 1)
    return at.select("probe", F.when(inside & (F.col("h") <= F.col("z")), F.col("h")).alias("surface"), (inside & (F.col("z") < F.col("h"))).alias("solid"))


def ball_chord(dx: Column, dy: Column, z: Column, radius: Column) -> tuple[Column, Column]:
    """Lowest and highest point of a ball on an upright line dx, dy beside its centre; null where the line misses it."""
    h2 = radius * radius - dx * dx - dy * dy
    h = F.when(h2 >= 0, F.sqrt(F.greatest(h2, F.lit(0.0))))
    return z - h, z + h


def brush_extent(kind: Column, column: tuple[Column, Column], a, b, radius: Column) -> tuple[Column, Column]:
    """Lowest and highest point of a brush on a column: a ball around ``a``, or a box from ``a`` to ``b``."""
    low, high = ball_chord(a[0] - column[0], a[1] - column[1], a[2], radius)
    inside = column[0].between(a[0], b[0]) & column[1].between(a[1], b[1])
    return F.when(kind == "ball", low).when(inside, a[2]), F.when(kind == "ball", high).when(inside, b[2])


def tiles_over(rects: DataFrame, level: int, side: float) -> DataFrame:
    """The square tiles ``side / 2**level`` wide that each rectangle ``x0, y0, x1, y1`` touches, west to east and then south to north."""
    size = side / (1 << level)

    def span(a, b):
        return F.sequence(F.floor(F.col(a) / size).cast("long"), F.floor(F.col(b) / size).cast("long"))

    return rects.select("rect", F.explode(span("y0", "y1")).alias("ty"), "x0", "x1").select("rect", F.explode(span("x0", "x1")).alias("tx"), "ty")


def finest_heights(records: DataFrame, probes: DataFrame, deepest: int) -> DataFrame:
    """Greatest known height at each probe ``lon, lat``: of the tiles' last finite records, that of the finest tile over the probe; null where there is none.

    ``records`` is ``level, x, y, height, arrival`` on the 2 x 1 grid that counts from south. An equi-join: each probe asks every level once.
    """
    last = records.where(~F.isnan("height") & (F.abs("height") < float("inf"))).groupBy("level", "x", "y").agg(F.max_by("height", "arrival").alias("height"))
    asks = probes.select("probe", "lon", "lat", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(deepest).cast("long"))).alias("level"))
    n = F.pow(F.lit(2.0), "level")
    x = F.least(F.floor((F.col("lon") + 180) / 360 * 2 * n), 2 * n - 1).cast("long")
    y = F.least(F.floor((F.col("lat") + 90) / 180 * n), n - 1).cast("long")
    found = asks.select("probe", "level", x.alias("x"), y.alias("y")).join(last, ["level", "x", "y"]).groupBy("probe").agg(F.max_by("height", "level").alias("height"), F.max("level").alias("level"))
    return probes.select("probe").join(found, "probe", "left")


def covered(grounds: DataFrame, footprints: DataFrame, cell: float) -> DataFrame:
    """The grounds ``rect, west, south, east, north`` whose four corners and middle each lie in some footprint; not a test of area.

    A range join by squares a quarter of ``cell`` degrees wide, see ``ranges.within``.
    """
    f = footprints.select(F.col("west").alias("x0"), F.col("east").alias("x1"), F.col("south").alias("y0"), F.col("north").alias("y1"))
    places = [("west", "south"), ("east", "south"), ("west", "north"), ("east", "north"), (None, None)]
    points = F.array(*[F.struct(F.lit(i).alias("i"), (F.col(a) if a else (F.col("west") + F.col("east")) / 2).alias("px"), (F.col(b) if b else (F.col("south") + F.col("north")) / 2).alias("py")) for i, (a, b) in enumerate(places)])
    p = grounds.select("rect", F.explode(points).alias("p")).select("rect", "p.*")
    hit = within(p, f, [], cell / 4)
    return hit.select("rect", "i").distinct().groupBy("rect").agg(F.count("*").alias("n")).where("n = 5").select("rect")


def seen_at_night(poses: DataFrame, level: int) -> DataFrame:
    """The geographic tiles ``x, y`` of a level within the horizon of a pose ``lon, lat, height`` (radians, metres) and 0.05 radians more; longitude wraps."""
    across, down = 2 << level, 1 << level
    lv, g = F.lit(level).cast("long"), F.lit("geographic")
    tiles = poses.sparkSession.range(across * down).select((F.col("id") % across).alias("x"), F.call_function("div", F.col("id"), F.lit(across).cast("long")).alias("y"))
    west, south, east, north = grid.tile_rect(g, lv, F.col("x"), F.col("y"))
    t = tiles.select("x", "y", west.alias("w"), south.alias("s"), east.alias("e"), north.alias("n"))
    tau = geo.math.tau

    def off(edge):
        d = F.pmod(F.col(edge) - F.col("lon"), F.lit(tau))
        return F.least(d, tau - d)

    lat = F.least(F.greatest("lat", "s"), F.col("n"))
    lon = F.when(F.col("lon").between(F.col("w"), F.col("e")), F.col("lon")).when(off("w") <= off("e"), F.col("w")).otherwise(F.col("e"))
    cos = F.sin("lat") * F.sin(lat) + F.cos("lat") * F.cos(lat) * F.cos(lon - F.col("lon"))
    reach = F.acos(geo.A / (geo.A + F.greatest("height", F.lit(0.0)))) + 0.05
    return t.join(poses, F.acos(geo.clamp(cos, -1, 1)) <= reach, "left_semi").select("x", "y")
