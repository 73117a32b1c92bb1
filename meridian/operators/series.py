"""Time series of a session: zero-phase smoothing, envelopes, pursuit, routes, thinning."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# A low-pass that does not ring, and how far an envelope looks and settles, in time constants.
DAMPING, ENVELOPE_REACH, SETTLE = 0.5, 6.0, 15.0


def low_pass(dt: float, tau: float) -> tuple[float, ...] | None:
    """(b0, b1, b2, a1, a2) of the second-order low-pass; None where the step or the time constant is no positive number or too short for the step."""
    if not (0 < dt < math.inf and 0 < tau < math.inf) or 2 / (2 * math.pi * tau) > 1 / dt:
        return None
    w = dt / tau
    alpha, cos = math.sin(w) / (2 * DAMPING), math.cos(w)
    a0 = 1 + alpha
    return (1 - cos) / 2 / a0, (1 - cos) / a0, (1 - cos) / 2 / a0, -2 * cos / a0, (1 - alpha) / a0


def one_way(c: tuple[float, ...], values: np.ndarray) -> np.ndarray:
    """The filter along ``values``, at rest on the first of them."""
    b0, b1, b2, a1, a2 = c
    out, rest = np.empty(len(values)), values[0] if len(values) else 0.0
    x1 = x2 = y1 = y2 = 0.0
    for i, v in enumerate(values - rest):
        y = b0 * v + b1 * x1 + b2 * x2 - a1 * y1 - a2 * y2
        x1, x2, y1, y2 = v, x1, y, y1
        out[i] = rest + y
    return out


def smooth(values: np.ndarray, dt: float, tau: float) -> np.ndarray:
    """Forward and backward, so that nothing is delayed; unchanged where there is no such filter."""
    c = low_pass(dt, tau)
    return values if c is None else one_way(c, one_way(c, values)[::-1])[::-1]


def pursue(targets: np.ndarray, dt: float, most_rate: float, most_accel: float) -> np.ndarray:
    """Headings that follow ``targets`` within limits of rate and acceleration, from rest on the first: as fast as they can still stop."""
    out, rate = np.array(targets, dtype=float), 0.0
    most_rate, most_accel = max(most_rate, 0.0), max(most_accel, 0.0)
    for i in range(1, len(out)):
        angle = out[i - 1]
        if dt > 0:
            turn = (targets[i] - angle + math.pi) % (2 * math.pi) - math.pi
            half = most_accel * dt / 2
            stops = math.sqrt(half * half + 2 * most_accel * abs(turn)) - half
            wanted = math.copysign(min(stops, most_rate, abs(turn) / dt), turn)
            rate += min(max(wanted - rate, -most_accel * dt), most_accel * dt)
            rate = min(max(rate, -most_rate), most_rate)
            angle += rate * dt
        out[i] = angle
    return out


def along(frames: DataFrame, key: str, order: str, columns: dict[str, tuple[str, object]]) -> DataFrame:
    """``key, order`` and, by name, columns made by a function of a whole series: a recurrence that windows can't express, one series a group."""
    sources = sorted({c for c, _ in columns.values()})
    kinds = {f.name: f.dataType.simpleString() for f in frames.schema}

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        out = {key: table[key], order: table[order]}
        for name, (source, f) in columns.items():
            out[name] = pa.array(np.asarray(f(table[source].to_numpy().astype(float)), dtype=float))
        return pa.table(out)

    made = ", ".join(f"{n} double" for n in columns)
    return frames.select(key, order, *sources).groupBy(key).applyInArrow(run, f"{key} {kinds[key]}, {order} {kinds[order]}, {made}")


def envelope_reach(dt: float, tau: float) -> int:
    """Samples to either side that an envelope takes the greatest of."""
    return math.ceil(ENVELOPE_REACH * tau / dt)


def envelope_margin(dt: float, tau: float) -> int:
    """Samples that a piece of a series needs on both sides for its envelope to be that of the whole."""
    return 0 if low_pass(dt, tau) is None else math.ceil((ENVELOPE_REACH + SETTLE) * tau / dt)


def envelope(frames: DataFrame, key: str, order: str, value: str, dt: float, tau: float) -> DataFrame:
    """``key, order, envelope``: a smooth line that is never below the value."""
    if low_pass(dt, tau) is None:
        return frames.select(key, order, F.col(value).alias("envelope"))
    reach = envelope_reach(dt, tau)
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-reach, reach)
    peaks = frames.select(key, order, value, F.max(value).over(w).alias("peak"))
    smoothed = along(peaks, key, order, {"smooth": ("peak", lambda v: smooth(v, dt, tau))})
    return peaks.join(smoothed, [key, order]).select(key, order, F.greatest(value, "smooth").alias("envelope"))


def route_centre(places: DataFrame, key: str, time: str, stopped_below: float) -> DataFrame:
    """Mean position of the moving places, those reached at ``stopped_below`` or more per unit of time; of all where none moves."""
    w = Window.partitionBy(key).orderBy(time)
    far = F.sqrt(sum(((F.col(c) - F.lag(c).over(w)) * (F.col(c) - F.lag(c).over(w)) for c in "yz"), (F.col("x") - F.lag("x").over(w)) * (F.col("x") - F.lag("x").over(w))))
    d = places.select(key, "x", "y", "z", F.coalesce(far >= stopped_below * (F.col(time) - F.lag(time).over(w)), F.lit(False)).alias("moving"))
    return d.groupBy(key).agg(*[F.coalesce(F.avg(F.when(F.col("moving"), F.col(c))), F.avg(c)).alias(c) for c in "xyz"])


def thinned(frames: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """About ``most`` evenly spaced rows of each series, the first and the last always."""
    w, whole = Window.partitionBy(key).orderBy(order), Window.partitionBy(key)
    d = frames.withColumn("_at", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(whole))
    step = F.greatest(F.ceil(F.col("_n") / max(most, 1)), F.lit(1))
    return d.where((F.col("_at") % step == 0) | (F.col("_at") == F.col("_n") - 1)).drop("_at", "_n")


def polyline_position(points: DataFrame, key: str, order: str, legs: str, fraction: float) -> DataFrame:
    """``key, order, t``: the leg on which a closed line is at ``fraction`` of its length, and how far along it; where two legs meet, the earlier one."""
    w = Window.partitionBy(key).orderBy(order)
    d = points.select(key, order, legs, F.sum(legs).over(w).alias("_to"), F.sum(legs).over(Window.partitionBy(key)).alias("_whole"), F.lead(order).over(w).isNull().alias("_last"))
    at = F.col("_whole") * F.pmod(F.lit(float(fraction)), F.lit(1.0))
    d = d.withColumn("_from", F.col("_to") - F.col(legs)).where((at <= F.col("_to")) | F.col("_last"))
    first = d.groupBy(key).agg(F.min_by(F.struct(order, "_from", legs, "_whole"), order).alias("m"))
    rest = F.col("m._whole") * F.pmod(F.lit(float(fraction)), F.lit(1.0)) - F.col("m._from")
    return first.select(key, F.col(f"m.{order}").alias(order), F.when(F.col(f"m.{legs}") > 1e-12, rest / F.col(f"m.{legs}")).otherwise(F.lit(0.0)).alias("t"))
