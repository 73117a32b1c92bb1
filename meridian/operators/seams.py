"""Where drawn tiles meet: the sides of neighbours, of any level, and the stretches that no neighbour covers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: sides are measured on the grid of this level, finer than any tile's.
DEEP = 40


def sides(drawn: DataFrame, key: str, roots: tuple[int, int] = (2, 1)) -> DataFrame:
    """``key, level, x, y, side, upright, line, start, end`` of the sides of ``drawn(key, level, x, y)`` (y from south): the grid line each lies on and its stretch. East meets west around the globe; there is no side on a pole."""
    one = F.pow(F.lit(2.0), F.lit(DEEP) - F.col("level")).cast("long")
    x, y, around, top = F.col("x") * one, F.col("y") * one, roots[0] << DEEP, roots[1] << DEEP
    rows = [("west", True, x, y, F.lit(True)), ("east", True, (x + one) % around, y, F.lit(True)), ("south", False, y, x, y > 0), ("north", False, y + one, x, y + one < top)]
    each = F.array(*[F.when(there, F.struct(F.lit(n).alias("side"), F.lit(up).alias("upright"), line.alias("line"), start.alias("start"), (start + one).alias("end"))) for n, up, line, start, there in rows])
    return drawn.select(key, "level", "x", "y", F.explode(each).alias("s")).where("s is not null").select(key, "level", "x", "y", "s.*")


def shared(drawn: DataFrame, key: str) -> DataFrame:
    """Pairs of facing sides that share a stretch, once each, from the east or north side ``a`` to the west or south side ``b``; ``share`` is of a's length.

    An interval join: sides of one line of one frame meet, cut to cells of the longest side on that line, so that a line around
    the globe is many groups.
    """
    s = sides(drawn, key)
    a, b = (s.where(F.col("side").isin(*names)) for names in (("east", "north"), ("west", "south")))
    cell = F.greatest(F.max(F.col("end") - F.col("start")), F.lit(1)).alias("cell")
    cells = s.groupBy(key, "upright", "line").agg(cell)

    def listed(df, n):
        d = df.join(cells, [key, "upright", "line"])
        d = d.select(key, "upright", "line", "cell", *[F.col(c).alias(f"{n}_{c}") for c in ("level", "x", "y", "start", "end")])
        return d.withColumn("at", F.explode(F.sequence(F.floor(F.col(f"{n}_start") / F.col("cell")), F.floor((F.col(f"{n}_end") - 1) / F.col("cell")))))

    both = listed(a, "a").join(listed(b, "b").drop("cell"), [key, "upright", "line", "at"])
    start, end = F.greatest("a_start", "b_start"), F.least("a_end", "b_end")
    # a pair meets in each cell that both touch; it counts in the cell where its stretch begins
    met = both.where((start < end) & (F.floor(start / F.col("cell")) == F.col("at")))
    return met.select(key, "upright", "a_level", "a_x", "a_y", "b_level", "b_x", "b_y", ((end - start) / (F.col("a_end") - F.col("a_start"))).alias("share"), ((end - start) / (F.col("b_end") - F.col("b_start"))).alias("b_share"))


def uncovered(drawn: DataFrame, key: str) -> DataFrame:
    """``key, level, x, y, side, bare``: sides of which a share is covered by no facing side."""
    pairs = shared(drawn, key)
    a = pairs.select(key, F.col("a_level").alias("level"), F.col("a_x").alias("x"), F.col("a_y").alias("y"), F.when(F.col("upright"), "east").otherwise("north").alias("side"), "share")
    b = pairs.select(key, F.col("b_level").alias("level"), F.col("b_x").alias("x"), F.col("b_y").alias("y"), F.when(F.col("upright"), "west").otherwise("south").alias("side"), F.col("b_share").alias("share"))
    covered = a.unionAll(b).groupBy(key, "level", "x", "y", "side").agg(F.sum("share").alias("covered"))
    return sides(drawn, key).join(covered, [key, "level", "x", "y", "side"], "left").select(key, "level", "x", "y", "side", (1 - F.coalesce("covered", F.lit(0.0))).alias("bare")).where("bare > 1e-12")


def level_steps(pairs: DataFrame) -> DataFrame:
    """How many shared sides there are between levels so far apart."""
    return pairs.groupBy(F.abs(F.col("a_level") - F.col("b_level")).alias("apart")).agg(F.count("*").alias("n"))
