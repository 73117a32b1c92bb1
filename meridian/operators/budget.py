"""Decisions under a budget: scores, priorities, requests, eviction, back-off, histograms of costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quantised(sse: Column, centrality: Column, distance: Column) -> dict[str, Column]:
    """Floats of a need as integers, held to their ranges; what is not finite counts 0 and is reported."""
    odd = [v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")) for v in (sse, centrality, distance)]
    s, c, d = (F.when(o, F.lit(0.0)).otherwise(v) for o, v in zip(odd, (sse, centrality, distance)))

    def held(v, low, high):
        return F.least(F.greatest(v, F.lit(float(low))), F.lit(float(high)))

    return {"sse_excess": F.round(held(s, -16, 16) * 1000).cast("long"), "centrality": F.round(held(c, 0, 1) * 1000).cast("long"), "distance": F.floor(held(d, 0, 2**32 - 1)).cast("long"), "rejected": odd[0] | odd[1] | odd[2]}


def div(a: Column, b) -> Column:
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b).cast("long"))


def score(sse_excess: Column, centrality: Column, waited: Column, age_full: Column, waiting: Column) -> Column:
    """Whole-number urgency: error weighted by nearness to the centre, age up to 1000, descendants that wait up to 4000."""
    sse = div(sse_excess * (500 + div(centrality, 2)), 1000)
    age = F.when(age_full == 0, F.lit(1000).cast("long")).otherwise(div(F.least(waited, age_full) * 1000, F.when(age_full == 0, F.lit(1).cast("long")).otherwise(age_full)))
    return sse + age + F.least(waiting * 250, F.lit(4000).cast("long"))


def priority_order() -> list[Column]:
    return [F.col("urgency"), F.desc("score"), F.col("tier"), F.col("resource")]


def requests(rows: DataFrame) -> DataFrame:
    """One request a tile: the highest group, and the least priority within it."""
    return rows.groupBy("tile").agg(F.max_by(F.struct("group", "priority"), F.struct("group", (-F.col("priority")).alias("p"))).alias("m")).select("tile", "m.group", "m.priority")


def evicted(residents: DataFrame, target: int, high: int = 95, low: int = 85) -> DataFrame:
    """Residents ``class, order, resource, bytes, kept`` that leave: of each class over ``high`` per cent of its target, in order, until no more than ``low`` per cent is used. Kept ones stay and are passed over."""
    use = residents.groupBy("class").agg(F.sum("bytes").alias("used"))
    over = use.where(F.col("used") > target * high // 100).withColumn("least", F.lit(target * low // 100))
    w = Window.partitionBy("class").orderBy("order", "resource").rowsBetween(Window.unboundedPreceding, -1)
    free = residents.where(~F.col("kept")).withColumn("before", F.coalesce(F.sum("bytes").over(w), F.lit(0)))
    return free.join(over, "class").where(F.col("used") - F.col("before") > F.col("least")).select("class", "resource", "bytes")


def backoff(failures: Column, permanent: Column, first: int, most: int) -> Column:
    """Wait after a failure: the most at once if it is permanent, else twice as long each time."""
    shift = F.least(F.greatest(failures - 1, F.lit(0)), F.lit(30)).cast("int")
    wait = F.least(F.lit(float(first)) * F.pow(F.lit(2.0), shift), F.lit(float(most)))
    return F.when(permanent, F.lit(most)).otherwise(wait.cast("long"))


def pow2_bucket(v: Column) -> Column:
    """0 for 0, else the number of bits."""
    return F.when(v <= 0, 0).otherwise(F.length(F.bin(v))).cast("long")


def pow2_quantiles(rows: DataFrame, key: str, value: str, permille: dict[str, int]) -> DataFrame:
    """Per key the upper bound of the power-of-two bucket that holds each rank, in thousandths."""
    w = Window.partitionBy(key).orderBy("bucket")
    n = rows.groupBy(key, pow2_bucket(F.col(value)).alias("bucket")).agg(F.count("*").alias("n"))
    run = n.select(key, "bucket", F.sum("n").over(w).alias("seen"), F.sum("n").over(Window.partitionBy(key)).alias("total"))

    def at(q):
        rank = F.greatest(F.ceil(F.col("total") * min(q, 1000) / 1000), F.lit(1))
        b = F.min(F.when(F.col("seen") >= rank, F.col("bucket")))
        return F.when(b == 0, F.lit(0).cast("long")).otherwise((F.pow(F.lit(2.0), b) - 1).cast("long"))

    return run.groupBy(key).agg(*[at(q).alias(name) for name, q in permille.items()])


def levels_occupied(rows: DataFrame, level: str, levels: int) -> DataFrame:
    """Non-zero counts by level; deeper levels count with the last."""
    return rows.groupBy(F.least(F.col(level), F.lit(levels - 1).cast("long")).alias("level")).agg(F.count("*").alias("n"))


def buckets(rows: DataFrame, key: str, value: str, bounds: list[float]) -> DataFrame:
    """How many values are at most each bound, per key; beyond the last counts in ``n`` only."""
    upto = [F.sum((F.col(value) <= b).cast("long")).alias(f"le_{i}") for i, b in enumerate(bounds)]
    return rows.groupBy(key).agg(*upto, F.count("*").alias("n"), F.round(F.sum(value), 6).alias("sum"))
