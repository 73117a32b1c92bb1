"""Byte ranges: merging, capped coalescing, blocks and availability."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridian.operators.deal import tasks

# Ranges this near are read together, up to this length.
GAP, LONGEST = 64 << 10, 4 << 20
#: Squares that lie whole in a box come to the driver and go to all tasks if they are no more than this.
SQUARES = 200_000


#: A key's ranges are put in order in shares, by their starts: so many bits of a start are one share.
SHARE_BITS = 22


def merged(ranges: DataFrame, key: str) -> DataFrame:
    """Inclusive ranges ``start, end`` of each key that overlap or touch, made one.

    Each share of a key's ranges is put in order by itself, knowing how far those of the shares before it reach. What a share goes on with is
    part of the last run that began before it; only one row a share is put in order over the whole key.
    """
    d = ranges.select(F.col(key).alias("k"), "start", "end", F.shiftright(F.col("start").cast("long"), SHARE_BITS).alias("share")).repartition(tasks(ranges), "k", "share")
    shares = Window.partitionBy("k").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)

    def of_share(df, summary):
        s = summary.withColumnsRenamed({"k": "s_k", "share": "s_share"})
        return df.join(s, F.col("k").eqNullSafe(F.col("s_k")) & F.col("share").eqNullSafe(F.col("s_share")), "left").drop("s_k", "s_share")

    tops = d.groupBy("k", "share").agg(F.max("end").alias("top")).select("k", "share", F.max("top").over(shares).alias("reach"))
    w = Window.partitionBy("k", "share").orderBy("start", "end")
    before = F.greatest(F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), "reach")
    runs = of_share(d, tops).withColumn("far", F.coalesce((F.col("start") > before + 1).cast("long"), before.isNull().cast("long")))
    runs = runs.withColumn("run", F.sum("far").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = runs.groupBy("k", "share", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    began = parts.groupBy("k", "share").agg(F.max("run").alias("n"))
    last = F.last(F.when(F.col("n") > 0, F.struct("share", "n")), ignorenulls=True).over(shares)
    at = of_share(parts, began.select("k", "share", last.alias("last")))
    goes_on = F.col("run") == 0
    at = at.select("k", F.when(goes_on, F.col("last.share")).otherwise(F.col("share")).alias("share"), F.when(goes_on, F.col("last.n")).otherwise(F.col("run")).alias("run"), "start", "end")
    return at.groupBy("k", "share", "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).select(F.col("k").alias(key), "start", "end")


def _greedy(start: np.ndarray, end: np.ndarray, gap: int, most: int, whole: bool) -> np.ndarray:
    """The number of the fetch that each span, by start, falls into."""
    out, n, first, last = np.empty(len(start), np.int64), -1, 0, 0
    for i, (a, b) in enumerate(zip(start.tolist(), end.tolist())):
        if n >= 0 and a <= last + gap and (max(last, b) if whole else b) - first <= most:
            last = max(last, b)
        else:
            n, first, last = n + 1, a, b
        out[i] = n
    return out


def coalesced(spans: DataFrame, key: str, gap: int = GAP, most: int = LONGEST, whole: bool = True) -> DataFrame:
    """``key, start, end, serves``: spans (end exclusive) within ``gap`` of each other, read as one fetch of ``most`` bytes at most unless one span is longer.

    Runs without a gap are found with windows. Only a run longer than ``most`` has to be cut in order, in a task of
    its own; every other run is one fetch. With ``whole`` the length is that of the fetch, else up to the span's own end.
    """
    w = Window.partitionBy(key).orderBy("start", "end")
    d = spans.select(key, "start", "end").distinct()
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("far", F.coalesce((F.col("start") > before + gap).cast("long"), F.lit(0)))
    d = d.withColumn("run", F.sum("far").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("far")
    size = Window.partitionBy(key, "run")
    d = d.withColumn("long", F.max("end").over(size) - F.min("start").over(size) > most)
    schema = d.schema[key].dataType.simpleString()

    def cut(table: pa.Table) -> pa.Table:
        table = table.sort_by([("start", "ascending"), ("end", "ascending")])
        return table.append_column("part", pa.array(_greedy(table["start"].to_numpy(), table["end"].to_numpy(), gap, most, whole)))

    long = d.where("long").groupBy(key, "run").applyInArrow(cut, f"{key} {schema}, start long, end long, run long, long boolean, part long")
    parts = d.where("not long").withColumn("part", F.lit(0).cast("long")).unionByName(long)
    return parts.groupBy(key, "run", "part").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("serves")).drop("run", "part")


def block_plan(fetches: DataFrame, block: int) -> DataFrame:
    """``block, frame``: for each block that a fetch touches the last frame that reads it; empty fetches touch none."""
    at = fetches.where("end > start").select("frame", F.explode(F.sequence(F.floor(F.col("start") / block), F.ceil(F.col("end") / block) - 1)).alias("block"))
    return at.groupBy("block").agg(F.max("frame").alias("frame"))


def within(points: DataFrame, boxes: DataFrame, by: list[str], side: float) -> DataFrame:
    """The rows of ``points(*by, px, py, ..)`` that lie in some of ``boxes(*by, x0, x1, y0, y1)``, bounds included.

    Boxes and points meet by squares of ``side``. A square that lies whole in one box holds all its points, so none of them is compared with any
    box; only points of other squares are, with the boxes that touch their square. Margins keep rounding from calling a square whole.
    """

    def square(c):
        return F.floor(F.col(c) / side)

    def listed(low, high):
        """Boxes under squares, by their columns' ranges; an empty range lists none."""
        out = boxes.withColumns({"bx0": low("x0"), "bx1": high("x1"), "by0": low("y0"), "by1": high("y1")}).where("bx0 <= bx1 and by0 <= by1")
        return out.withColumn("cx", F.explode(F.sequence("bx0", "bx1"))).withColumn("cy", F.explode(F.sequence("by0", "by1")))

    at = [*by, "cx", "cy"]
    whole = listed(lambda c: F.ceil(F.col(c) / side + 1e-9), lambda c: F.floor(F.col(c) / side - 1e-9) - 1).select(*at).distinct()
    few = whole.limit(SQUARES + 1).toArrow()
    # Spark's estimates leave out what is listed, so how squares and boxes are joined is said here
    whole = F.broadcast(boxes.sparkSession.createDataFrame(few)) if len(few) <= SQUARES else whole.hint("merge")
    p = points.withColumn("cx", square("px")).withColumn("cy", square("py"))
    touched = listed(lambda c: F.floor(F.col(c) / side - 1e-9), lambda c: F.floor(F.col(c) / side + 1e-9))
    b = touched.select(*at, "x0", "x1", "y0", "y1").join(whole, at, "left_anti").hint("merge").alias("b")
    rest = p.join(whole, at, "left_anti").alias("p")
    same = [F.col(f"p.{c}") == F.col(f"b.{c}") for c in at]
    near = same + [F.col("p.px").between(F.col("b.x0"), F.col("b.x1")), F.col("p.py").between(F.col("b.y0"), F.col("b.y1"))]
    compared = rest.join(b, near, "left_semi")
    return p.join(whole, at, "left_semi").select(points.columns).unionAll(compared.select(points.columns))


def available(tiles: DataFrame, ranges: DataFrame, cell: int = 64) -> DataFrame:
    """The tiles that lie in a range of their level: ``ranges(level, x0, x1, y0, y1)``, inclusive; found by squares half of ``cell`` wide."""
    return within(tiles.withColumn("px", F.col("x")).withColumn("py", F.col("y")), ranges.select("level", "x0", "x1", "y0", "y1"), ["level"], cell / 2).drop("px", "py")
