"""Message logs ``input, topic, log_time, seq, data`` as tables: order, merging, replay, recovery, run-length coded channels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "topic string, log_time long, seq long, data binary"


def write(messages: DataFrame, path: str) -> None:
    messages.select("topic", "log_time", "seq", "data").write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def recovered(spark: SparkSession, path: str) -> DataFrame:
    """What can be read of a log that was being written when its writer died: whole files only, broken ones left out."""
    return spark.read.schema(SCHEMA).option("ignoreCorruptFiles", "true").parquet(path)


def ordered(messages: DataFrame) -> DataFrame:
    """By time, then topic, then the order of writing, which a sort alone would not keep."""
    return messages.orderBy("log_time", "topic", "seq")


def replay(messages: DataFrame, topic: str) -> DataFrame:
    return messages.where(F.col("topic") == topic)


def merged(inputs: list[DataFrame]) -> DataFrame:
    """All messages of several logs; a topic that two of them hold is an error."""
    parts = [df.select(F.lit(i).alias("input"), "topic", "log_time", "seq", "data") for i, df in enumerate(inputs)]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    twice = whole.groupBy("topic").agg(F.countDistinct("input").alias("n")).where("n > 1").orderBy("topic").first()
    if twice is not None:
        raise ValueError(f"topic {twice.topic} is in {twice.n} logs")
    return whole.drop("input")


def topic_counts(messages: DataFrame) -> DataFrame:
    return messages.groupBy("topic").agg(F.count("*").alias("n"))


def channel(messages: DataFrame, first: int, step: int) -> DataFrame:
    """``topic, log_time, hold, data``: runs of equal neighbours as one message, stamped by the first slot of the run, ``first`` and ``step`` nanoseconds apart."""
    w = Window.partitionBy("topic").orderBy("log_time", "seq")
    fresh = F.coalesce((~F.col("data").eqNullSafe(F.lag("data").over(w))).cast("long"), F.lit(1))
    d = messages.select("topic", "data", (F.row_number().over(w) - 1).alias("slot"), fresh.alias("fresh"), F.lag("seq").over(w).isNull().alias("start"))
    d = d.withColumn("run", F.sum(F.when(F.col("start"), 1).otherwise(F.col("fresh"))).over(Window.partitionBy("topic").orderBy("slot")))
    runs = d.groupBy("topic", "run").agg(F.min("slot").alias("slot"), F.count("*").alias("hold"), F.min("data").alias("data"))
    return runs.select("topic", (F.lit(first) + F.col("slot") * step).alias("log_time"), "hold", "data")


def expanded(coded: DataFrame, step: int) -> DataFrame:
    """``topic, log_time, data`` of a ``channel``, a message for each slot."""
    slots = F.transform(F.sequence(F.lit(0).cast("long"), F.col("hold") - 1), lambda i: F.col("log_time") + i * step)
    return coded.select("topic", F.explode(slots).alias("log_time"), "data")
