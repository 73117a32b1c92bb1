"""Ordered folds of one key each: weighted least-recently-used caches, time to live, relaxation under pressure."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def lru(steps: Iterator[tuple[str, int]], budget: int) -> list[list[str]]:
    """What each insertion of (key, weight) evicts, oldest first. A replaced key is no eviction; one heavier than the budget is not kept and evicts itself."""
    held: OrderedDict[str, int] = OrderedDict()
    used, out = 0, []
    for key, weight in steps:
        used -= held.pop(key, 0)
        gone = []
        if weight > budget:
            gone.append(key)
        else:
            held[key] = weight
            used += weight
            while used > budget:
                old, w = held.popitem(last=False)
                used -= w
                gone.append(old)
        out.append(gone)
    return out


def evictions(inserts: DataFrame, cache: str, order: str, budget: int) -> DataFrame:
    """``cache, order, key, evicted`` of ``inserts(cache, order, key, weight)``: each cache is one ordered fold in a task."""
    kinds = {f.name: f.dataType.simpleString() for f in inserts.schema}

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        gone = lru(zip(table["key"].to_pylist(), table["weight"].to_pylist()), budget)
        return pa.table({cache: table[cache], order: table[order], "key": table["key"], "evicted": pa.array(gone, pa.list_(pa.string()))})

    return inserts.select(cache, order, "key", "weight").groupBy(cache).applyInArrow(run, f"{cache} {kinds[cache]}, {order} {kinds[order]}, key string, evicted array<string>")


def hits(reads: DataFrame, puts: DataFrame, key: str, ttl: int) -> DataFrame:
    """``reads(key, at)`` with the value of the last put at or before it that is younger than ``ttl`` (null where there is none): an as-of join by one window over both."""
    both = reads.select(key, "at", F.lit(1).alias("read"), F.lit(None).cast("long").alias("put_at"), F.lit(None).cast("long").alias("v")).unionAll(puts.select(key, "at", F.lit(0), F.col("at"), "v"))
    w = Window.partitionBy(key).orderBy("at", "read").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("read") == 0, F.struct("put_at", "v")), ignorenulls=True).over(w)
    return both.select(key, "at", "read", last.alias("p")).where("read = 1").select(key, "at", F.when(F.col("at") - F.col("p.put_at") < ttl, F.col("p.v")).alias("v"))


def relaxed(state: np.ndarray, dt: np.ndarray, up: int, down: int, most: int) -> np.ndarray:
    """Scale in thousandths after each step: ``state`` 2 (at a hard limit) grows four times as fast as 1 (over target), 0 (calm) decays, -1 stays.

    Kept in millionths of a thousandth, so that no step's rounding is lost; between 1000 and ``most``.
    """
    fine, out = 1000 * 1_000_000, np.empty(len(state), np.int64)
    for i, (s, t) in enumerate(zip(state.tolist(), dt.tolist())):
        if s > 0:
            fine = min(fine + up * (4 if s == 2 else 1) * t, most * 1_000_000)
        elif s == 0:
            fine = max(fine - down * t, 1000 * 1_000_000)
        out[i] = fine // 1_000_000
    return out


def relaxation(steps: DataFrame, session: str, order: str, up: int, down: int, most: int) -> DataFrame:
    """``session, order, scale`` of ``steps(session, order, state, dt)``: one recurrence a session."""
    kinds = {f.name: f.dataType.simpleString() for f in steps.schema}

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        return pa.table({session: table[session], order: table[order], "scale": pa.array(relaxed(table["state"].to_numpy(), table["dt"].to_numpy(), up, down, most))})

    return steps.select(session, order, "state", "dt").groupBy(session).applyInArrow(run, f"{session} {kinds[session]}, {order} {kinds[order]}, scale long")


def counters_since(later: DataFrame, earlier: DataFrame) -> DataFrame:
    """Counters ``name, value`` less what they were; a counter that was not there counts from 0."""
    return later.join(earlier.select("name", F.col("value").alias("was")), "name", "left").select("name", (F.col("value") - F.coalesce("was", F.lit(0))).alias("value"))


def violations(rows: DataFrame, key: str, rules: dict) -> DataFrame:
    """How many rows of each key break each rule (a condition that must hold); unknown conditions break nothing."""
    return rows.groupBy(key).agg(*[F.sum(F.coalesce((~rule).cast("long"), F.lit(0))).alias(name) for name, rule in rules.items()])


def folded(known: DataFrame, new: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(all ranges, those that are new): repeats, within the new ones or of known ones, are left out."""
    added = new.select(*columns).distinct().join(known.select(*columns), columns, "left_anti")
    return known.select(*columns).unionByName(added), added
