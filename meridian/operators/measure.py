"""Light, scores, films and trees: aggregations, neighbours and selections."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridian.functions import grid, tiles
from meridian.operators.frames import now_and_before


def medians(cells: DataFrame, key: str, value: str) -> DataFrame:
    """Upper, averaged and floor-index medians, which differ for an even count; by rank, so that no group is held in one row."""
    at = F.row_number().over(Window.partitionBy(key).orderBy(value)) - 1
    d = cells.select(key, value, at.alias("at"), F.count("*").over(Window.partitionBy(key)).alias("n"))
    upper, low = F.floor(F.col("n") / 2), F.floor((F.col("n") - 1) / 2)

    def pick(place):
        return F.max(F.when(F.col("at") == place, F.col(value)))

    averaged = F.avg(F.when((F.col("at") == upper) | (F.col("at") == low), F.col(value)))
    return d.groupBy(key).agg(F.round(pick(upper), 6).alias("upper"), F.round(averaged, 6).alias("averaged"), F.round(pick(low), 6).alias("low"))


def weighted_median(rows: DataFrame, key: str, value: str, weight: str) -> DataFrame:
    """The first value at which the running weight reaches half."""
    w = Window.partitionBy(key).orderBy(value).rangeBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(key)
    run = rows.select(key, value, F.sum(weight).over(w).alias("run"), F.sum(weight).over(whole).alias("whole"))
    return run.where(F.col("run") * 2 >= F.col("whole")).groupBy(key).agg(F.round(F.min(value), 6).alias("median"))


def level_summary(light: DataFrame) -> DataFrame:
    mean = (F.col("red") + F.col("green") + F.col("blue")) / 3
    return light.groupBy("level").agg(F.count("*").alias("tiles"), F.round(F.avg(mean), 6).alias("mean"), F.round(F.min(mean), 6).alias("least"), F.round(F.max(mean), 6).alias("most"), F.sum("drapes").alias("drapes"))


def nearest_ancestors(light: DataFrame, within: int = 3, most: int = 2) -> DataFrame:
    """Each tile with its up to ``most`` nearest existing ancestors within ``within`` levels: an equi-join on shifted addresses."""
    up = light.select("level", "x", "y", F.explode(F.sequence(F.lit(1), F.lit(within))).alias("rise"))
    up = up.select("level", "x", "y", "rise", (F.col("level") - F.col("rise")).alias("a_level"), F.floor(F.col("x") / F.pow(F.lit(2.0), "rise")).cast("long").alias("a_x"), F.floor(F.col("y") / F.pow(F.lit(2.0), "rise")).cast("long").alias("a_y"))
    there = light.select(F.col("level").alias("a_level"), F.col("x").alias("a_x"), F.col("y").alias("a_y"), F.col("red").alias("a_red"))
    rank = F.row_number().over(Window.partitionBy("level", "x", "y").orderBy("rise"))
    return up.join(there, ["a_level", "a_x", "a_y"]).withColumn("nth", rank.cast("long")).where(F.col("nth") <= most).select("level", "x", "y", "nth", "a_level", "a_x", "a_y", F.round("a_red", 6).alias("a_red"))


def edge_joints(light: DataFrame) -> DataFrame:
    """Neighbours to the right and below on one level, with the step of their light."""
    other = light.select("level", F.col("x").alias("n_x"), F.col("y").alias("n_y"), F.col("green").alias("n_green"))
    side = F.explode(F.array(F.struct(F.lit("right").alias("side"), F.lit(1).alias("dx"), F.lit(0).alias("dy")), F.struct(F.lit("below").alias("side"), F.lit(0).alias("dx"), F.lit(1).alias("dy"))))
    own = light.select("level", "x", "y", "green", side.alias("s")).select("level", "x", "y", "green", "s.side", (F.col("x") + F.col("s.dx")).alias("n_x"), (F.col("y") + F.col("s.dy")).alias("n_y"))
    return own.join(other, ["level", "n_x", "n_y"]).select("level", "x", "y", "side", F.round(F.col("n_green") - F.col("green"), 6).alias("step"))


def frame_diff(frames: DataFrame) -> DataFrame:
    """Per frame: tiles entered, left and kept against the frame before it."""
    both = now_and_before(frames)

    def count(c):
        return F.sum(c.cast("long"))

    now, was = F.col("now") == 1, F.col("was") == 1
    return both.groupBy("frame").agg(count(~was).alias("entered"), count(~now).alias("left"), count(now & was).alias("kept"))


def tile_usage(frames: DataFrame) -> DataFrame:
    once = frames.select("frame", "tile_id").distinct()  # where a film is dealt by frame, as it comes from its view, nothing moves for this
    return once.groupBy("tile_id").agg(F.count("frame").alias("frames"), F.min("frame").alias("first"), F.max("frame").alias("last"))


def sliding_max(frames: DataFrame, reach: int = 3) -> DataFrame:
    w = Window.partitionBy("session").orderBy("frame").rowsBetween(-reach, reach)
    return frames.select("session", "frame", F.round(F.max("sky_luma").over(w), 6).alias("peak"))


def hold_runs(frames: DataFrame, value: str) -> DataFrame:
    """Run-length coding: runs of equal neighbours, stamped by their first frame."""
    w = Window.partitionBy("session").orderBy("frame")
    fresh = F.coalesce((F.lag(value).over(w) != F.col(value)).cast("long"), F.lit(1))
    runs = frames.select("session", "frame", value, fresh.alias("fresh")).withColumn("run", F.sum("fresh").over(w))
    return runs.groupBy("session", "run").agg(F.min("frame").alias("frame"), F.min(value).alias(value), F.count("*").alias("hold")).drop("run")


def valid(scores: DataFrame) -> DataFrame:
    """Scores whose input is not of another acquisition; an unknown kind counts."""
    return scores.where(F.coalesce(F.col("kind") != "other", F.lit(True)))


def score_medians(scores: DataFrame) -> DataFrame:
    return valid(scores).groupBy("input", "method").agg(F.round(F.percentile("psnr_y", 0.5), 3).alias("psnr_y"), F.round(F.percentile("lpips", 0.5), 3).alias("lpips"), F.count("*").alias("n"))


def score_table(scores: DataFrame, measure: str, methods: list[str]) -> DataFrame:
    """Medians of a measure, a row for each input and a column for each method."""
    return valid(scores).groupBy("input").pivot("method", methods).agg(F.round(F.percentile(measure, 0.5), 3))


def win_rate(scores: DataFrame, baseline: str = "m0") -> DataFrame:
    """Share of an input's valid samples on which a method's mean lpips is below the baseline's; a sample that lacks either is no win but counts."""
    mean = valid(scores).groupBy("sample", "input", "method").agg(F.avg("lpips").alias("lpips")).where("lpips is not null")
    pairs = mean.groupBy("input").agg(F.countDistinct("sample").alias("n"))
    base = mean.where(F.col("method") == baseline).select("sample", "input", F.col("lpips").alias("base"))
    wins = mean.where(F.col("method") != baseline).join(base, ["sample", "input"], "left").groupBy("input", "method").agg(F.sum(F.coalesce(F.col("lpips") < F.col("base"), F.lit(False)).cast("long")).alias("w"))
    return wins.join(pairs, "input").select("input", "method", F.round(F.col("w") / F.col("n"), 6).alias("wins"), "n")


def score_pivot(scores: DataFrame) -> DataFrame:
    return scores.groupBy("sample", "input").pivot("method", ["m0", "m1", "m2", "m3", "m4"]).agg(F.round(F.first("psnr_y"), 6))


def stratified(samples: DataFrame, strata: list[str], key: str, n: int, seed: int) -> DataFrame:
    """About ``n`` rows drawn in proportion from every stratum, at least one from each, in an order set by a hash of key and seed."""
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    d = samples.withColumn("h", order).withColumn("of", F.count("*").over(Window.partitionBy(*strata))).crossJoin(F.broadcast(samples.agg(F.count("*").alias("all"))))
    d = d.withColumn("at", F.row_number().over(Window.partitionBy(*strata).orderBy("h", key)))
    take = F.least(F.col("of"), F.greatest(F.lit(1), F.rint(F.lit(n) * F.col("of") / F.col("all"))))
    return d.where(F.col("at") <= take).orderBy("h", key).limit(n).select(*samples.columns)


def first_samples(scores: DataFrame, most: int = 20) -> DataFrame:
    w = Window.partitionBy("input").orderBy("sample")
    return scores.select("sample", "input").distinct().withColumn("n", F.row_number().over(w).cast("long")).where(F.col("n") <= most)


def class_counts(scores: DataFrame) -> DataFrame:
    """Rows by kind per input, 0 where there are none; a null kind is not ``other``."""
    return scores.groupBy("input").agg(*[F.sum(F.coalesce((F.col("kind") == k).cast("long"), F.lit(0))).alias(k) for k in ("same", "other")], F.sum(F.col("kind").isNull().cast("long")).alias("unknown"))


#: How near an eye that was left out may be to one kept, and the highest ground that an eye's height is measured against.
EYE_SPACING, HIGHEST_GROUND = 500.0, 4800.0


def footprint_keeps(addresses: DataFrame, eyes: DataFrame, factor: float = 2.0) -> DataFrame:
    """The tiles ``grid, level, x, y`` that an eye ``lon, lat, height`` (degrees, metres) can want.

    A tile is kept by an eye whose horizon reaches its nearest point and whose distance to it, the height above the highest ground included,
    is at most ``factor`` times the tile's width and the slack of eyes left out. Tiles and eyes meet by cubes whose side is that of a level:
    a tile goes to those that the ball around its middle touches which holds all places in reach, so each meets the eyes near it only.
    """
    at = (F.col("grid"), F.col("level"), F.col("x"), F.col("y"))
    w, s, e, n = grid.bounds_degrees(*at)
    slack = EYE_SPACING * math.sqrt(2)
    t = addresses.select("grid", "level", "x", "y", w.alias("w"), s.alias("s"), e.alias("e"), n.alias("n"), (factor * grid.width_m(*at) + slack).alias("reach"))
    ground = tiles.haversine(F.col("lon"), F.col("lat"), F.least(F.greatest("lon", "w"), F.col("e")), F.least(F.greatest("lat", "s"), F.col("n")))
    r = 2 * tiles.MEAN_RADIUS
    above, up = F.greatest(F.col("height") - HIGHEST_GROUND, F.lit(0.0)), F.greatest("height", F.lit(0.0))
    horizon = F.sqrt(r * up + F.col("height") * F.col("height")) + math.sqrt(r * HIGHEST_GROUND)
    axes = "xyz"

    def globe(lon, lat):
        p, l = F.radians(lat), F.radians(lon)
        return [tiles.MEAN_RADIUS * c for c in (F.cos(p) * F.cos(l), F.cos(p) * F.sin(l), F.sin(p))]

    # no tile of a level is wider than 360 / 2 ** level degrees, and no way over the globe is longer than the same steps at the equator
    side = 2 * ((math.sqrt(0.5) + factor) * grid.M_PER_DEG * 360 / F.pow(F.lit(2.0), "level") + slack)
    ball = (grid.M_PER_DEG * F.sqrt((F.col("e") - F.col("w")) * (F.col("e") - F.col("w")) + (F.col("n") - F.col("s")) * (F.col("n") - F.col("s"))) / 2 + F.col("reach")) * (1 + 1e-9)
    t = t.withColumns({"ball": ball, "side": side} | {f"m{c}": v for c, v in zip(axes, globe((F.col("w") + F.col("e")) / 2, (F.col("s") + F.col("n")) / 2))})
    for c in axes:
        t = t.withColumn(f"c{c}", F.explode(F.sequence(F.floor((F.col(f"m{c}") - F.col("ball")) / F.col("side")), F.floor((F.col(f"m{c}") + F.col("ball")) / F.col("side")))))
    levels = addresses.select(F.col("level").alias("eye_level")).distinct()
    seen = eyes.select("lon", "lat", "height").crossJoin(F.broadcast(levels)).withColumn("level", F.col("eye_level"))
    seen = seen.select("lon", "lat", "height", "eye_level", *[F.floor(v / side).alias(f"e{c}") for c, v in zip(axes, globe(F.col("lon"), F.col("lat")))])
    near = [F.col("level") == F.col("eye_level"), *[F.col(f"c{c}") == F.col(f"e{c}") for c in axes], ground <= horizon, F.sqrt(ground * ground + above * above) <= F.col("reach")]
    return t.join(seen, near, "left_semi").select("grid", "level", "x", "y").distinct()


def request_order(tree: DataFrame, most: int = 64) -> DataFrame:
    """The ``most`` tiles of largest error, by level and address."""
    return tree.orderBy(F.desc("geometric_error"), "level", "y", "x").limit(most).select("level", "x", "y", F.round("geometric_error", 6).alias("geometric_error"))


def descend(tree: DataFrame, eye_x: float, eye_y: float, target: float) -> DataFrame:
    """Replacement selection on a quadtree: a tile is drawn if its error over its distance is within ``target`` (or it has no children) and no ancestor is drawn.

    The error of the parent decides whether a tile is reached at all; errors halve per level and distances
    are of the tiles' squares, so being reached follows from the parent alone.
    """
    size = F.pow(F.lit(2.0), -F.col("level"))

    def gap(v, e):
        return F.greatest(F.lit(0.0), F.col(v) * size - e, e - (F.col(v) + 1) * size)

    deepest = tree.agg(F.max("level")).first()[0]
    d = F.sqrt(F.pow(gap("x", F.lit(eye_x)), 2) + F.pow(gap("y", F.lit(eye_y)), 2))
    s = tree.withColumn("split", (F.col("geometric_error") > target * d) & (F.col("level") < deepest))
    parent = s.where("split").select((F.col("level") + 1).alias("level"), F.col("x").alias("px"), F.col("y").alias("py"))
    near = s.withColumn("px", F.floor(F.col("x") / 2).cast("long")).withColumn("py", F.floor(F.col("y") / 2).cast("long"))
    reached = near.join(parent, ["level", "px", "py"], "left_semi").unionByName(near.where("level = 0"))
    return reached.where("not split").select("level", "x", "y")
