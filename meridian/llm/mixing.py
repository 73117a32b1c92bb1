"""Mixing sources to target weights, in DataFrame operations only.

Rows get a hash-random key; each source is cut into key ranges, sorted by key,
and distributed prefix sums of sizes place every document in its source's epoch. Each
source is taken to its exact budget: whole epochs first, then the documents in
key order up to the word where the budget ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridian.llm.common import written

#: One word: a run of anything but space, tab, LF, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"


def sizes(docs: DataFrame, text: str = "text"):
    """Words in the text; null counts 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(per_source: DataFrame, weights=(5, 2, 1), share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """``(source, source_size)`` to ``(source, source_size, target)``.

    Sources by code point (null last) take the weights in turn and share
    ``share`` times all sizes. A target stops at ``limit`` times its source's size and the
    excess goes to the others by weight until none is above: with the sources in order of
    limit per weight, the first k are the ones that stop, for the least k at which the next
    one's share stays within its limit. Runs on one row per source. Sizes of 0 give targets of 0.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    t = per_source.withColumn("w", w).withColumn("most", limit * F.col("source_size"))
    up = Window.orderBy(F.col("most") / F.col("w"), F.col("source").isNull(), "source")
    every = Window.partitionBy(F.lit(0))
    t = (
        t.withColumn("before", F.coalesce(F.sum("most").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("after_w", F.sum("w").over(up.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("all", share * F.sum("source_size").over(every))
        .withColumn("level", F.greatest(F.lit(0.0), F.col("all") - F.col("before")) / F.col("after_w"))
        # the first source in this order whose share is within its limit sets the level of all later ones
        .withColumn("open", F.col("w") * F.col("level") <= F.col("most"))
        .withColumn("set", F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, 0)))
    )
    return t.select("source", "source_size", F.coalesce(F.least(F.col("w") * F.col("set"), "most"), "most").alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text", weights=(5, 2, 1), share: float = 1.5, limit: float = 2.0, seed: str = "mix", digits: int = 3) -> DataFrame:
    """One row a document: ``doc_id, size, source_size, target, taken``.

    ``taken`` counts words with repeats; over a source it sums to the floor of its target
    exactly, and no document is taken more than once above any other of its source.
    The key is md5(seed:doc_id), so reruns agree; its first ``digits`` hex digits are the key
    ranges, of which each (source, range) is sorted in one task, about rows / 16**digits
    of them. Repeated rows tie on the key and follow each other by size. A null doc_id is keyed
    as an empty string; documents without words have size 0 and taken 0. An empty table gives none.
    """
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source).alias("source"), sizes(docs, text).alias("size"), key.alias("key"))
    rows = written(rows, "mix-sizes")[0].withColumn("range", F.substring("key", 1, digits))  # words are counted once
    # (source, range) totals: partial sums are made before the shuffle
    parts = rows.groupBy("source", "range").agg(F.sum("size").alias("in_range"))
    along = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.withColumn("offset", F.coalesce(F.sum("in_range").over(along), F.lit(0)))
    goal = targets(parts.groupBy("source").agg(F.sum("in_range").alias("source_size")), weights, share, limit)
    plan = offsets.alias("o").join(goal.alias("g"), F.expr("o.source <=> g.source")).select(F.col("o.source").alias("s"), F.col("o.range").alias("r"), "offset", "source_size", "target")
    inside = Window.partitionBy("source", "range").orderBy("key", F.col("doc_id"), "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("ahead", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = rows.join(plan, F.expr("source <=> s and range = r"))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    left = budget - epochs * F.col("source_size") - F.col("offset") - F.col("ahead")
    return placed.select(
        "doc_id", "size", "source_size", "target",
        (epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left))).cast("long").alias("taken"),
        "source",
    )


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix as documents: each is repeated once per time it is taken whole, in its own columns.

    A document that the budget cuts is left out of that epoch, so texts stay whole; documents
    without words stay once. Needs ``doc_id, text, source``; other columns pass through.
    Rows with equal (doc_id, source, size) share one decision.
    """
    taken = mix(docs, **how)
    times = taken.groupBy("doc_id", "source", "size").agg(F.min(F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(F.lit(1))).alias("times"))
    t = times.select(F.col("doc_id").alias("t_id"), F.col("source").alias("t_source"), F.col("size").alias("t_size"), "times")
    d = docs.select(F.struct("*").alias("row")).withColumn("n", F.coalesce(F.regexp_count(F.col("row.text"), F.lit(WORD)), F.lit(0)).cast("long"))
    both = d.join(t, F.expr("row.doc_id <=> t_id and row.source <=> t_source and n = t_size")).where("times > 0")
    return both.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("row.*")
