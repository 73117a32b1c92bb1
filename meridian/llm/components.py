"""Distributed union-find over an edge table, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.llm.common import remove, written


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(a long, b long)`` to ``(v long, label long)``, label the least vertex reachable.

    Each round hooks every vertex to its least neighbour, follows parents twice
    and contracts the edges, so the vertex count at least halves; every step
    is written in the shared folder and read again, so that neither lineage nor size estimates grow; what the result doesn't read is removed at the end. Only vertices with an edge to another
    vertex appear. Nulls, self loops and repeated edges are ignored; no edges give an empty table.
    """
    spark, made, kept = edges.sparkSession, [], None

    def cut(df: DataFrame) -> DataFrame:
        out, path = written(df, "components")
        made.append(path)
        return out

    def tidy(df: DataFrame) -> DataFrame:
        return cut(df.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())

    rest, labels = tidy(edges), None
    for _ in range(max_rounds):
        if rest.isEmpty():
            break
        both = rest.union(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("p")).select("v", F.least("v", "p").alias("p"))
        for _ in range(2):
            up = parent.select(F.col("v").alias("p"), F.col("p").alias("pp"))
            parent = cut(parent.join(up, "p", "left").select("v", F.coalesce("pp", "p").alias("p")))
        if labels is None:
            labels, kept = parent.select("v", F.col("p").alias("label")), made[-1]
        else:
            step = parent.select(F.col("v").alias("label"), F.col("p").alias("next"))
            labels = cut(labels.join(step, "label", "left").select("v", F.coalesce("next", "label").alias("label")))
            kept = made[-1]
        pa = parent.select(F.col("v").alias("a"), F.col("p").alias("pa"))
        pb = parent.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        rest = tidy(rest.join(pa, "a").join(pb, "b").select(F.col("pa").alias("a"), F.col("pb").alias("b")))
    else:
        if not rest.isEmpty():
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    for path in made:
        if path != kept:
            remove(spark, path)
    return labels if labels is not None else spark.createDataFrame([], "v long, label long")
