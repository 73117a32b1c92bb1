"""Selection on a tile tree: what several views want drawn, what has to be asked for, and what stands in for it.

A tree is ``level, x, y`` on the 2 x 1 geographic grid, with a parent for every tile below the roots. Whether a
tile is looked into follows from the tile and the views alone, so a tile is reached if no ancestor is culled or drawn:
one join with the ancestors, not a loop over levels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridian.functions import geodesy as geo
from meridian.functions import grid, tiles

KEY = ("level", "x", "y")


def closed(tiles_: DataFrame) -> DataFrame:
    """The tiles and all their ancestors."""
    up = tiles_.select(*KEY, F.explode(F.sequence(F.lit(0).cast("long"), "level")).alias("rise"))
    n = F.pow(F.lit(2.0), "rise").cast("long")
    return up.select((F.col("level") - F.col("rise")).alias("level"), F.call_function("div", F.col("x"), n).alias("x"), F.call_function("div", F.col("y"), n).alias("y")).distinct()


def ancestors(tiles_: DataFrame) -> DataFrame:
    """``level, x, y, a_level, a_x, a_y`` for every proper ancestor."""
    up = tiles_.where("level > 0").select(*KEY, F.explode(F.sequence(F.lit(1).cast("long"), "level")).alias("rise"))
    n = F.pow(F.lit(2.0), "rise").cast("long")
    return up.select(*KEY, (F.col("level") - F.col("rise")).alias("a_level"), F.call_function("div", F.col("x"), n).alias("a_x"), F.call_function("div", F.col("y"), n).alias("a_y"))


def looked_at(tree: DataFrame, views: list[tuple[float, float, float]], height_px: float, denominator: float) -> DataFrame:
    """The tree with ``sse``, the largest error on a screen of any view (lon, lat in degrees, metres up), and ``seen``, whether one view's horizon reaches the tile."""
    west, south, east, north = grid.bounds_degrees(F.lit("geographic"), *[F.col(c) for c in KEY])
    d = tree.select(*KEY, west.alias("w"), south.alias("s"), east.alias("e"), north.alias("n"))
    error = grid.level_error(F.col("level"))
    sses, sights = [], []
    for lon, lat, up in views:
        ground = tiles.haversine(F.lit(float(lon)), F.lit(float(lat)), F.least(F.greatest(F.lit(float(lon)), "w"), F.col("e")), F.least(F.greatest(F.lit(float(lat)), "s"), F.col("n")))
        sses.append(geo.screen_space_error(error, F.sqrt(ground * ground + up * up), F.lit(height_px), F.lit(denominator)))
        sights.append(ground <= (2 * tiles.MEAN_RADIUS * up + up * up) ** 0.5 + (2 * tiles.MEAN_RADIUS * 4800.0) ** 0.5)
    sse, seen = sses[0], sights[0]
    for a, b in zip(sses[1:], sights[1:]):
        sse, seen = F.greatest(sse, a), seen | b
    return d.select(*KEY, sse.alias("sse"), seen.alias("seen"))


def chosen(tree: DataFrame, views: list[tuple[float, float, float]], most_error: float = 16.0, before: DataFrame | None = None, hysteresis: float = 0.0, height_px: float = 960.0, denominator: float = 1.1547) -> DataFrame:
    """``level, x, y, sse``: the tiles that the views want drawn.

    A seen tile is cut into its children if it has any and its error is over the threshold: ``most_error``, or with
    ``hysteresis`` and the tiles chosen ``before`` more for those and less for all others, so that a choice does not flicker.
    """
    d = looked_at(tree, views, height_px, denominator)
    parents = tree.where("level > 0").select((F.col("level") - 1).alias("level"), F.call_function("div", F.col("x"), F.lit(2).cast("long")).alias("x"), F.call_function("div", F.col("y"), F.lit(2).cast("long")).alias("y")).distinct().withColumn("has", F.lit(True))
    threshold: Column = F.lit(most_error)
    if before is not None and hysteresis > 0:
        d = d.join(before.select(*KEY).distinct().withColumn("was", F.lit(True)), list(KEY), "left")
        threshold = F.when(F.col("was"), most_error * (1 + hysteresis)).otherwise(most_error / (1 + hysteresis))
    d = d.join(parents, list(KEY), "left").withColumn("cuts", F.coalesce("has", F.lit(False)) & (F.col("sse") > threshold))
    ends = d.where(~F.col("seen") | ~F.col("cuts"))
    above = ends.select(F.col("level").alias("a_level"), F.col("x").alias("a_x"), F.col("y").alias("a_y"))
    wanted = ends.where("seen").select(*KEY, "sse")
    under = ancestors(wanted).join(above, ["a_level", "a_x", "a_y"], "left_semi").select(*KEY).distinct()
    return wanted.join(under, list(KEY), "left_anti")


def drawn(wanted: DataFrame, resident: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tiles to draw, requests) of ``chosen`` tiles when only ``resident`` ones are there.

    A chosen tile that is missing is asked for, the largest error first. Its nearest resident ancestor is drawn in its place, and then
    nothing beneath that one; where one such ancestor lies beneath another, the upper one is drawn.
    """
    there = resident.select(*KEY).distinct()
    missing = wanted.join(there, list(KEY), "left_anti")
    r = there.select(F.col("level").alias("a_level"), F.col("x").alias("a_x"), F.col("y").alias("a_y"))
    near = ancestors(missing).join(r, ["a_level", "a_x", "a_y"]).groupBy(*KEY).agg(F.max(F.struct("a_level", "a_x", "a_y")).alias("a"))
    holds = near.select(F.col("a.a_level").alias("level"), F.col("a.a_x").alias("x"), F.col("a.a_y").alias("y")).distinct()
    h = holds.select(F.col("level").alias("a_level"), F.col("x").alias("a_x"), F.col("y").alias("a_y"))
    shown = wanted.select(*KEY).join(there, list(KEY), "left_semi").unionAll(holds)
    hidden = ancestors(shown).join(h, ["a_level", "a_x", "a_y"], "left_semi").select(*KEY).distinct()
    return shown.join(hidden, list(KEY), "left_anti").distinct(), missing.select(*KEY, "sse", F.row_number().over(Window.orderBy(F.desc("sse"), *KEY)).alias("nth"))


def best_drapes(tiles_: DataFrame, drapes: DataFrame, reach: int) -> DataFrame:
    """Of each tile the finest drape among its own and its ancestors' up to ``reach`` levels above."""
    own = tiles_.select(*KEY, F.col("level").alias("a_level"), F.col("x").alias("a_x"), F.col("y").alias("a_y"))
    up = ancestors(tiles_).where(F.col("level") - F.col("a_level") <= reach).unionByName(own)
    d = drapes.select(F.col("level").alias("a_level"), F.col("x").alias("a_x"), F.col("y").alias("a_y"), "drape")
    return up.join(d, ["a_level", "a_x", "a_y"]).groupBy(*KEY).agg(F.max_by("drape", F.struct("a_level", "drape")).alias("drape"), F.max("a_level").alias("from_level"))
