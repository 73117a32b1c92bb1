"""Gains of levels and fields of gains: robust sums in Spark, small systems solved beside them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHANNELS = ("r", "g", "b")


def weighted_medians(rows: DataFrame, keys: list[str], values: list[str], weight: str) -> DataFrame:
    """Per group, for each value column the first value at which the running weight reaches half: each by a window of its own order."""
    out = rows.select(*keys).distinct()
    for v in values:
        w = Window.partitionBy(*keys).orderBy(v).rangeBetween(Window.unboundedPreceding, 0)
        run = rows.select(*keys, v, F.sum(weight).over(w).alias("_run"), F.sum(weight).over(Window.partitionBy(*keys)).alias("_all"))
        out = out.join(run.where("_run * 2 >= _all").groupBy(*keys).agg(F.min(v).alias(v)), keys)
    return out


def level_pairs(observations: DataFrame) -> DataFrame:
    """``level, ancestor, r, g, b, spread, n``: the gains agreed between two levels and how far observations are from them, the worst channel's median."""
    seen = observations.where("weight > 0 and level <> ancestor")
    agreed = weighted_medians(seen, ["level", "ancestor"], list(CHANNELS), "weight")
    off = seen.join(agreed.select("level", "ancestor", *[F.col(c).alias(f"m_{c}") for c in CHANNELS]), ["level", "ancestor"])
    off = off.select("level", "ancestor", "weight", *[F.abs(F.col(c) - F.col(f"m_{c}")).alias(c) for c in CHANNELS])
    spread = weighted_medians(off, ["level", "ancestor"], list(CHANNELS), "weight").select("level", "ancestor", F.greatest(*CHANNELS).alias("spread"))
    counts = seen.groupBy("level", "ancestor").agg(F.count("*").alias("n"))
    return agreed.join(spread, ["level", "ancestor"]).join(counts, ["level", "ancestor"])


def level_gains(observations: DataFrame, anchor: int = 10, dead_zone: float = 0.08, clamp: float = 2.0, sweeps: int = 400) -> dict[int, tuple[int, tuple[float, ...]]]:
    """level -> (source, gains in stops) from ``level, ancestor, r, g, b, weight``.

    Levels whose agreed gain lies in the dead zone are one source. Between sources medians are taken anew, and
    sweeps settle each source's gain as the weighted mean of what its neighbours say; the anchor's stays 0. Only one row a pair of
    levels, some hundred at most, comes to the driver.
    """
    edges = level_pairs(observations).orderBy("level", "ancestor").collect()
    levels = sorted({x for e in edges for x in (e.level, e.ancestor)})
    if not levels:
        return {}
    source = {x: x for x in levels}

    def root(x: int) -> int:
        while source[x] != x:
            x = source[x]
        return x

    for e in edges:
        if max(abs(e[c]) for c in CHANNELS) < dead_zone:
            a, b = sorted((root(e.level), root(e.ancestor)))
            source[b] = a
    source = {x: root(x) for x in levels}
    names = F.create_map(*[F.lit(v) for kv in source.items() for v in kv])
    between = observations.where("weight > 0 and level <> ancestor").select(names[F.col("level")].alias("of"), names[F.col("ancestor")].alias("to"), *CHANNELS, "weight").where("of <> to")
    steps = weighted_medians(between, ["of", "to"], list(CHANNELS), "weight").join(between.groupBy("of", "to").agg(F.sum("weight").alias("weight")), ["of", "to"]).orderBy("of", "to").collect()
    held = source[min(levels, key=lambda x: (abs(x - anchor), x))]
    gain = {s: np.zeros(3) for s in sorted(set(source.values()))}
    for _ in range(sweeps):
        for s in gain:
            if s == held:
                continue
            total, weight = np.zeros(3), 0.0
            for t in steps:
                if s in (t.of, t.to):
                    step = np.array([t[c] for c in CHANNELS])
                    total += t.weight * (gain[t.to] + step if t.of == s else gain[t.of] - step)
                    weight += t.weight
            if weight > 0:
                gain[s] = total / weight
    return {x: (source[x], tuple(np.round(np.clip(gain[source[x]], -clamp, clamp) * 1024) / 1024)) for x in levels}


#: Fixed values of gain fields: blocks a side, the weight of a tile's own gain, units of a stop.
BLOCKS, PRIOR, UNITS = 16, 0.05, 1024


def gain_field(gain: np.ndarray, confidence: np.ndarray, overall: np.ndarray, clamp: float = 1.5, passes: int = 6, prior: float = PRIOR) -> np.ndarray:
    """Whole-number gains at the corners of blocks, from blocks' gains (n x n x 3) and confidence: the believed mean around each corner, then smoothed, a corner keeping what it is trusted with."""
    n = gain.shape[0]
    g, c = np.pad(gain * confidence[..., None], ((1, 1), (1, 1), (0, 0))), np.pad(confidence, 1)
    total = g[:-1, :-1] + g[:-1, 1:] + g[1:, :-1] + g[1:, 1:]
    weight = c[:-1, :-1] + c[:-1, 1:] + c[1:, :-1] + c[1:, 1:]
    value = (total + overall * prior) / (weight + prior)[..., None]
    own = (np.minimum(weight, 1) * 0.75)[..., None]
    ones = np.pad(np.ones((n + 1, n + 1)), 1)
    count = (ones[:-2, 1:-1] + ones[2:, 1:-1] + ones[1:-1, :-2] + ones[1:-1, 2:])[..., None]
    for _ in range(passes):
        p = np.pad(value, ((1, 1), (1, 1), (0, 0)))
        value = own * value + (1 - own) * (p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:]) / count
    return np.rint(np.clip(value, -clamp, clamp) * UNITS).astype(np.int16)


def field_at(field: np.ndarray, u: float, v: float) -> np.ndarray:
    """Gain in stops at a place of a tile, (0, 0) its top left: between the four corners around it."""
    n = field.shape[0] - 1
    x, y = min(max(u, 0.0), 1.0) * n, min(max(v, 0.0), 1.0) * n
    i, j = min(int(x), n - 1), min(int(y), n - 1)
    f = field[j : j + 2, i : i + 2] / UNITS
    top, low = (f[k, 0] + (f[k, 1] - f[k, 0]) * (x - i) for k in (0, 1))
    return top + (low - top) * (y - j)


def chained(field: np.ndarray, parent: np.ndarray, quadrant: tuple[int, int], clamp: float = 1.5) -> np.ndarray:
    """A tile's field toward its parent followed by the parent's own; held to the limit at every step, so steps can't be summed first."""
    if not parent.any():
        return field
    n, most = field.shape[0] - 1, round(clamp * UNITS)
    under = np.array([[np.rint(field_at(parent, (quadrant[0] + i / n) / 2, (quadrant[1] + j / n) / 2) * UNITS) for i in range(n + 1)] for j in range(n + 1)])
    return np.clip(field.astype(np.int64) + under.astype(np.int64), -most, most).astype(np.int16)
