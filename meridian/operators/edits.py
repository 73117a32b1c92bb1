"""Ordered logs applied one by one: ground edits with their refusals, events before a step, eased cameras."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def judged(edits: DataFrame, ground: str) -> DataFrame:
    """``edits(ground, arrival, seq, valid, ..)`` with ``outcome``: ``applied``, ``consumed`` (its number is used up but the edit is refused), ``stale`` (an older number) or ``gap`` (a number too far ahead).

    An edit carries the next number or is refused. In order of arrival a number is next exactly if it is one more than the
    greatest consumed so far, so a fold is needed; one ground is one group.
    """
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in edits.schema)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("arrival")
        last, out = 0, []
        for seq, valid in zip(table["seq"].to_pylist(), table["valid"].to_pylist()):
            if seq <= last:
                out.append("stale")
            elif seq > last + 1:
                out.append("gap")
            else:
                last = seq
                out.append("applied" if valid else "consumed")
        return table.append_column("outcome", pa.array(out, pa.string()))

    return edits.groupBy(ground).applyInArrow(run, f"{kinds}, outcome string")


def versions(applied: DataFrame, ground: str, side: float, level: int) -> DataFrame:
    """``ground, tx, ty, version``: how often each edit-level tile was changed, by the applied brushes' footprints ``x0, y0, x1, y1``."""
    size = side / (1 << level)

    def span(a, b):
        return F.sequence(F.floor(F.col(a) / size).cast("long"), F.floor(F.col(b) / size).cast("long"))

    touched = applied.where("outcome = 'applied'").select(ground, F.explode(span("x0", "x1")).alias("tx"), "y0", "y1").select(ground, "tx", F.explode(span("y0", "y1")).alias("ty"))
    return touched.groupBy(ground, "tx", "ty").agg(F.count("*").alias("version"))


def replica_digest(applied: DataFrame, ground: str) -> DataFrame:
    """``ground, last, digest``: the last number consumed and a digest of all consumed edits in their order; replicas agree if their logs do.

    Each edit's digest is bound to its number and the sum is order-free, so no log is gathered in one row.
    """
    used = applied.where("outcome in ('applied', 'consumed')")
    each = F.conv(F.substring(F.sha2(F.concat_ws("|", "seq", "outcome", *[c for c in ("x0", "y0", "x1", "y1") if c in applied.columns]), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return used.groupBy(ground).agg(F.max("seq").alias("last"), F.pmod(F.sum(each), F.lit(2**61 - 1).cast("decimal(38,0)")).cast("long").alias("digest"))


def settled(events: DataFrame, loads: DataFrame) -> DataFrame:
    """``events(step, resource, generation, kind)`` with ``stale``: an event counts only for a load of its own generation that is under way; of equal events of a step the first."""
    under = loads.select("resource", F.col("generation").alias("now"))
    nth = F.row_number().over(Window.partitionBy("resource", "generation").orderBy("step", "kind"))
    both = events.join(under, "resource", "left").withColumn("nth", nth)
    return both.select("step", "resource", "generation", "kind", (F.coalesce(F.col("now") != F.col("generation"), F.lit(True)) | (F.col("nth") > 1)).alias("stale"))


def overdue(loads: DataFrame, now: int, timeout: int, grace: int) -> DataFrame:
    """``resource, why`` of the loads ``resource, started, unneeded_since`` to cancel: those that take too long, and those that nobody has needed for a while."""
    late, unneeded = F.col("started") + timeout <= now, F.coalesce(F.col("unneeded_since") + grace <= now, F.lit(False))
    return loads.where(late | unneeded).select("resource", F.when(late, "timeout").otherwise("unneeded").alias("why"))


def eased(targets: np.ndarray, share: float) -> np.ndarray:
    """Each value a share of the way from the one before to its target; the first is on its target."""
    out = np.array(targets, dtype=float)
    for i in range(1, len(out)):
        out[i] = out[i - 1] + (targets[i] - out[i - 1]) * share
    return out


def nearest_content(tiles: DataFrame, views: list[tuple[float, float, float]]) -> DataFrame:
    """``tile, distance``: the distance from the nearest view to each tile ``tile, x, y, z, radius``, at least 1."""
    far = [F.sqrt((F.col("x") - x) * (F.col("x") - x) + (F.col("y") - y) * (F.col("y") - y) + (F.col("z") - z) * (F.col("z") - z)) - F.col("radius") for x, y, z in views]
    return tiles.select("tile", F.greatest(F.least(*far) if len(far) > 1 else far[0], F.lit(1.0)).alias("distance"))


def stand_ins(wanted: DataFrame, shown: DataFrame) -> DataFrame:
    """``tile, stand_in, role`` of ``wanted(tile, chain)``, chain being the tile's ancestors from the nearest: the tile itself if it is shown (``exact``), else its nearest shown ancestor (``fallback``), else none (``lost``)."""
    s = shown.select(F.col("tile").alias("stand_in")).distinct()
    up = wanted.select("tile", F.posexplode(F.concat(F.array("tile"), "chain")).alias("depth", "stand_in"))
    near = up.join(s, "stand_in").groupBy("tile").agg(F.min(F.struct("depth", "stand_in")).alias("m"))
    return wanted.select("tile").join(near, "tile", "left").select("tile", F.col("m.stand_in").alias("stand_in"), F.when(F.col("m").isNull(), "lost").when(F.col("m.depth") == 0, "exact").otherwise("fallback").alias("role"))
