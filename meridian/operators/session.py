"""Recorded sessions: flicker, deltas, rate and picture size."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Bounds:
    """What a frame may do before it is flagged (fixed values of the rule)."""

    luma_step: float = 0.03
    star_drop: float = 0.5
    min_stars: int = 10
    min_pixels: int = 1000
    max_gap: int = 2
    max_turn_deg: float = 0.5
    max_climb: float = 0.02
    max_scene_step: float = 900.0
    trend: float = 3.0
    min_black: int = 16
    window: int = 5


def _turn(u, v):
    """Degrees between two directions (arrays of three); 0 where one has no length."""
    dot, uu, vv = (sum((a[i] * b[i] for i in (1, 2)), a[0] * b[0]) for a, b in ((u, v), (u, u), (v, v)))
    size = F.sqrt(uu) * F.sqrt(vv)
    return F.when(size > 0, F.degrees(F.acos(F.least(F.greatest(dot / F.when(size > 0, size), F.lit(-1.0)), F.lit(1.0))))).otherwise(F.lit(0.0))


def _steps(frames: DataFrame, b: Bounds) -> DataFrame:
    """Pictured frames with their step from the last picture; null where the two don't compare."""
    w = Window.partitionBy("session").orderBy("frame")
    p = frames.where("pictured").withColumn("prev", F.lag(F.struct("frame", "sky_luma", "ground_luma", "sky_pixels", "ground_pixels", "stars", "altitude", "instant", "direction", "up")).over(w))
    climb = F.abs(F.col("altitude") - F.col("prev.altitude")) / F.greatest(F.abs("prev.altitude"), F.lit(1.0))
    turned = [_turn(F.col(c), F.col(f"prev.{c}")) <= b.max_turn_deg for c in ("direction", "up")]
    clock = F.abs(F.col("instant") - F.col("prev.instant"))  # unknown clocks compare
    still = F.col("prev").isNotNull() & (F.col("frame") - F.col("prev.frame") <= b.max_gap) & (climb <= b.max_climb) & turned[0] & turned[1] & F.coalesce(F.isnan(clock) | (clock == float("inf")) | (clock <= b.max_scene_step), F.lit(True))

    def step(kind):
        both = (F.col(f"{kind}_pixels") >= b.min_pixels) & (F.col(f"prev.{kind}_pixels") >= b.min_pixels)
        return F.when(still & both, F.col(f"{kind}_luma") - F.col(f"prev.{kind}_luma"))

    return p.select("*", step("sky").alias("sky"), step("ground").alias("ground"), F.when(still, F.col("prev.stars")).alias("stars_before"))


def upper_median(values):
    """The element at n/2 of the sorted values; null when there are none."""
    return F.get(F.sort_array(values), F.floor(F.size(values) / 2).cast("int"))


def flicker_flags(frames: DataFrame, b: Bounds = Bounds()) -> DataFrame:
    """Frames whose sky or ground steps out of its neighbours' trend, that lose stars, or show black ground."""
    steps = _steps(frames, b)
    w = Window.partitionBy("session").orderBy("frame")
    near = [w.rowsBetween(-b.window, -1), w.rowsBetween(1, b.window)]

    def stands_out(kind):
        around = F.concat(*[F.collect_list(F.abs(kind)).over(x) for x in near])
        trend = F.coalesce(upper_median(around), F.lit(0.0))
        return F.coalesce((F.abs(kind) > b.luma_step) & (F.abs(kind) > b.trend * trend), F.lit(False))

    stars = F.coalesce((F.col("stars_before") >= b.min_stars) & (F.col("stars") < (1 - b.star_drop) * F.col("stars_before")), F.lit(False))
    out = steps.select("session", "frame", stands_out("sky").alias("sky"), stands_out("ground").alias("ground"), stars.alias("stars"), (F.col("black_ground") >= max(b.min_black, 1)).alias("black"))
    return out.where("sky or ground or stars or black")


def picture_deltas(frames: DataFrame) -> DataFrame:
    """Luma steps against the last picture, and whether its size is the same."""
    w = Window.partitionBy("session").orderBy("frame")
    same = (F.lag("picture_width").over(w) == F.col("picture_width")) & (F.lag("picture_height").over(w) == F.col("picture_height"))
    return frames.where("pictured").select("session", "frame", F.round(F.col("sky_luma") - F.lag("sky_luma").over(w), 6).alias("sky_delta"), F.round(F.col("ground_luma") - F.lag("ground_luma").over(w), 6).alias("ground_delta"), same.alias("same_size"))


def recorded_fps(frames: DataFrame) -> DataFrame:
    """Pictures a second of a session, from the first pictured frame with a finite clock to the last: 1 to 240, 30 where it can't be told."""
    at = frames.where("pictured and wall_ms is not null").groupBy("session").agg(F.min_by("wall_ms", "frame").alias("a"), F.max_by("wall_ms", "frame").alias("b"), F.count("*").alias("n"))
    span = (F.col("b") - F.col("a")) / 1000
    rate = F.when((span > 0) & (F.col("n") > 1), F.least(F.lit(240), F.greatest(F.lit(1), F.round((F.col("n") - 1) / F.when(span > 0, span))))).otherwise(30)
    return frames.select("session").distinct().join(at, "session", "left").select("session", rate.cast("long").alias("fps"))


def frame_size_mode(frames: DataFrame) -> DataFrame:
    """The most frequent picture size of a session; of equals the largest."""
    n = frames.groupBy("session", "picture_width", "picture_height").agg(F.count("*").alias("n"))
    return n.groupBy("session").agg(F.max(F.struct("n", "picture_width", "picture_height")).alias("m")).select("session", "m.picture_width", "m.picture_height", "m.n")
