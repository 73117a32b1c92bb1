"""Frames and the tiles they draw: what enters and leaves, usage, comparison of two films, cameras, change lists.

Film tables are ``frame, tile_id, drape``; a tile counts once a frame and drape.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridian.operators.deal import tasks


#: Frames are put in order in runs of so many numbers (a power of two), and the runs by their first frames.
RUN_BITS = 16


def following(film: DataFrame) -> DataFrame:
    """``frame, next``: each frame and the one drawn after it, null for the last; no single task orders all frames."""
    d = film.select("frame").distinct().withColumn("run", F.shiftright("frame", RUN_BITS))
    heads = d.groupBy("run").agg(F.min("frame").alias("head")).select("run", F.lead("head").over(Window.orderBy("run")).alias("head"))
    inside = d.withColumn("next", F.lead("frame").over(Window.partitionBy("run").orderBy("frame")))
    return inside.join(heads, "run").select("frame", F.coalesce("next", "head").alias("next"))


def now_and_before(film: DataFrame) -> DataFrame:
    """``frame, tile_id, drape, now, was``: 1 where a frame, or the one before it, draws a tile; of a first frame all are new."""
    d = film.select("frame", "tile_id", "drape").distinct()
    # each row is seen as its own frame's and as the next one's: one pass, no join of the film with itself
    both = d.join(following(film), "frame", "left")
    seen = both.select("frame", "tile_id", "drape", F.lit(1).alias("now"), F.lit(0).alias("was")).unionAll(both.where("next is not null").select(F.col("next").alias("frame"), "tile_id", "drape", F.lit(0), F.lit(1)))
    return seen.repartition(tasks(film), "frame").groupBy("frame", "tile_id", "drape").agg(F.max("now").alias("now"), F.max("was").alias("was"))


def changes(film: DataFrame) -> DataFrame:
    """``frame, tile_id, drape, change``: what each frame draws that the one before it did not (``enter``), and the other way round (``leave``)."""
    known = now_and_before(film).where("now <> was")
    return known.select("frame", "tile_id", "drape", F.when(F.col("now") == 1, "enter").otherwise("leave").alias("change"))


def referred(film: DataFrame, first: int, last: int) -> DataFrame:
    """The different tiles that frames ``first`` to ``last`` draw."""
    return film.where(F.col("frame").between(first, last)).select("tile_id", "drape").distinct()


def region_usage(film: DataFrame, tiles: DataFrame, region_level: int) -> DataFrame:
    """How often the tiles of each region are drawn; tiles coarser than the region level are left out. ``tiles`` has ``tile_id, level, x, y``."""
    at = tiles.where(F.col("level") >= region_level)
    n = F.pow(F.lit(2.0), F.col("level") - region_level).cast("long")
    region = at.select("tile_id", F.call_function("div", F.col("x"), n).alias("rx"), F.call_function("div", F.col("y"), n).alias("ry"))
    return film.groupBy("tile_id").agg(F.count("*").alias("n")).join(region, "tile_id").groupBy("rx", "ry").agg(F.sum("n").alias("uses"))


def compared(a: DataFrame, b: DataFrame) -> DataFrame:
    """``frame, verdict``: ``missing`` in one film, another ``selection`` of tiles, the same under other ``drapes``, or ``identical``; by counts, so that no frame is gathered in one row."""

    def side(df, of_a, of_b):
        return df.select("frame", "tile_id", "drape", F.lit(of_a).cast("long").alias("a"), F.lit(of_b).cast("long").alias("b"))

    # dealt by frame once: the three counts that follow need no other
    both = side(a, 1, 0).unionAll(side(b, 0, 1)).repartition(tasks(a, b), "frame").groupBy("frame", "tile_id", "drape").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    tiles = both.groupBy("frame", "tile_id").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.max((F.col("a") != F.col("b")).cast("int")).alias("redraped"))
    frames = tiles.groupBy("frame").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.max((F.col("a") != F.col("b")).cast("int")).alias("other"), F.max("redraped").alias("redraped"))
    verdict = F.when((F.col("a") == 0) | (F.col("b") == 0), "missing").when(F.col("other") == 1, "selection").when(F.col("redraped") == 1, "drapes").otherwise("identical")
    return frames.select("frame", verdict.alias("verdict"))


#: Views of a cell are packed in rows of so many; cells of the finest grid hold about VIEWS_A_CELL places; a radius is halved FINEST times at most.
PACK, VIEWS_A_CELL, FINEST = 64, 16, 24


def nearest_view(views: DataFrame, asked: DataFrame, cell: float) -> DataFrame:
    """For each asked eye the frame whose eye is nearest (the first of equals), among those within ``cell`` metres.

    ``views`` is ``frame, x, y, z``, ``asked`` is ``ask, x, y, z``. An ask without a view in reach has no row. Asks look within a small
    radius first, which follows from how densely the views lie; only those that find none look within four times that radius, and so on up to ``cell``.
    """
    axes = "xyz"
    places = views.groupBy(*axes).agg(F.min("frame").alias("frame")).where("frame is not null")

    def at(column, radius):
        return F.floor(column / (4 * radius))

    filled = [F.approx_count_distinct(F.xxhash64(*[at(F.col(c), cell / 2**k) for c in axes])).alias(f"n{k}") for k in range(FINEST + 1)]
    n = places.agg(F.count("*").alias("n"), *filled).first()
    finest = max([k for k in range(FINEST + 1) if n["n"] >= VIEWS_A_CELL * n[f"n{k}"]], default=0)
    left, found = asked.select("ask", *axes), None
    for k in [*range(finest, 0, -2), 0]:
        radius = cell / 2**k
        v = places.select("frame", *[F.col(c).alias(f"v{c}") for c in axes], *[at(F.col(c), radius).alias(f"c{c}") for c in axes])
        cells = [f"c{c}" for c in axes]
        v = v.withColumn("pack", F.floor((F.row_number().over(Window.partitionBy(*cells).orderBy("frame")) - 1) / PACK))
        v = v.groupBy(*cells, "pack").agg(F.collect_list(F.struct("frame", *[f"v{c}" for c in axes])).alias("views")).drop("pack")
        near = left
        for c in axes:  # one cell or two: all that a ball of the radius touches
            around = F.array_distinct(F.array(*[at(F.col(c) + d * radius, radius) for d in (-1 - 1e-9, 1 + 1e-9)]))
            near = near.withColumn(f"c{c}", F.explode(around))

        def far(s):
            d = [F.col(c) - s[f"v{c}"] for c in axes]
            return F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])

        best = F.array_min(F.transform("views", lambda s: F.struct(far(s).alias("metres"), s["frame"].alias("frame"))))
        near = near.join(v, cells, "left").select("ask", *axes, best.alias("m")).withColumn("m", F.when(F.col("m.metres") <= radius, F.col("m")))
        near = near.groupBy("ask", *axes).agg(F.min("m").alias("m"))
        hit = near.where("m is not null").select("ask", "m")
        found = hit if found is None else found.unionAll(hit)
        left = near.where("m is null").select("ask", *axes)
    best = found.groupBy("ask").agg(F.min("m").alias("m"))
    return best.select("ask", "m.frame", "m.metres")


def need_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """``tile, change, entries``: tiles that ``left``, ``entered`` or ``changed`` between two lists of ``tile, nth, entry``; a tile's entries are compared in their order, and a changed one carries all its new ones."""

    def lists(df, n):
        return df.groupBy("tile").agg(F.transform(F.sort_array(F.collect_list(F.struct("nth", "entry"))), lambda s: s["entry"]).alias(n))

    both = lists(before, "b").join(lists(after, "a"), "tile", "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
    change = F.when(F.col("a").isNull(), "left").when(F.col("b").isNull(), "entered").otherwise("changed")
    return both.select("tile", change.alias("change"), F.coalesce("a", F.array().cast("array<long>")).alias("entries"))


def apply_changes(before: DataFrame, named: DataFrame) -> DataFrame:
    """A list after its changes: each tile named loses its entries and gets its new ones. Inverse of ``need_changes``."""
    kept = before.select("tile", "nth", "entry").join(named.select("tile"), "tile", "left_anti")
    new = named.select("tile", F.posexplode("entries").alias("nth", "entry")).select("tile", F.col("nth").cast("long").alias("nth"), "entry")
    return kept.unionByName(new)


def todo(samples: DataFrame, done: DataFrame, key: str, rank: int, ranks: int) -> DataFrame:
    """The samples (whole numbers) of one of ``ranks`` workers that are not done: dealt in turn by number first, so that a worker's share does not move as others finish.

    Places are counted within runs of 4096 numbers and over the runs, so that no single task orders all samples.
    """
    d = samples.select(key).distinct().withColumn("run", F.floor(F.col(key) / 4096))
    w = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    ahead = d.groupBy("run").agg(F.count("*").alias("n")).select("run", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("ahead"))
    at = d.withColumn("nth", F.row_number().over(Window.partitionBy("run").orderBy(key)) - 1).join(ahead, "run")
    return at.where(F.pmod(F.col("nth") + F.col("ahead"), F.lit(ranks)) == rank).select(key).join(done.select(key), key, "left_anti")


def payload_summary(entries: DataFrame, key: str = "zone") -> DataFrame:
    """Distinct payload bytes against all, and tiles with one payload and with several, per key."""
    per_digest = entries.groupBy(key, "digest").agg(F.count("*").alias("n"), F.max("bytes").alias("bytes"), F.sum("bytes").alias("all"))
    sizes = per_digest.groupBy(key).agg(F.sum("n").alias("entries"), F.count("*").alias("payloads"), F.sum("bytes").alias("distinct_bytes"), F.sum("all").alias("bytes"), F.sum(F.col("n") - 1).alias("duplicates"))
    per_tile = entries.groupBy(key, "tile_id").agg(F.countDistinct("digest").alias("n")).groupBy(key).agg(F.count("*").alias("tiles"), F.sum((F.col("n") == 1).cast("long")).alias("one"), F.sum((F.col("n") > 1).cast("long")).alias("several"))
    return sizes.join(per_tile, key)


def medians_of_medians(rows: DataFrame, outer: str, inner: list[str], value: str) -> DataFrame:
    """Median of each group, then the median, least and greatest of the groups' medians, so that a larger group weighs no more."""
    first = rows.groupBy(outer, *inner).agg(F.percentile(value, 0.5).alias("m"))
    return first.groupBy(outer).agg(F.round(F.percentile("m", 0.5), 6).alias("median"), F.round(F.min("m"), 6).alias("least"), F.round(F.max("m"), 6).alias("most"), F.count("*").alias("groups"))
