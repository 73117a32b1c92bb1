"""Resumable runs over samples and the datasets that they read: tile trees on disk, shards with their index, point look-ups.

A run's outputs are ``sample, z, x, y, input, family, scale, seconds, png``, in one folder a launch; its index is the same without pictures.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridian.operators.frames import todo

INDEX = "sample long, z long, x long, y long, input string, family string, scale long, seconds double"
OUTPUT = INDEX + ", png binary"


def tile_tree(spark: SparkSession, root: str, suffix: str = "jpg") -> DataFrame:
    """``z, x, y, data`` of the files ``root/z/x/y.suffix``; others are left out."""
    rule = rf"/(\d+)/(\d+)/(\d+)\.{suffix}$"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{suffix}").load(root)
    at = [F.regexp_extract("path", rule, i + 1).cast("long").alias(c) for i, c in enumerate("zxy")]
    return files.where(F.col("path").rlike(rule)).select(*at, F.col("content").alias("data"))


def newest_first(layers: list[DataFrame]) -> DataFrame:
    """Tiles of several layers, given newest first: one that several hold comes from the newest."""
    whole = layers[0].withColumn("_at", F.lit(0))
    for i, d in enumerate(layers[1:], 1):
        whole = whole.unionByName(d.withColumn("_at", F.lit(i)))
    first = whole.groupBy("z", "x", "y").agg(F.min("_at").alias("_at"))
    return whole.join(first, ["z", "x", "y", "_at"], "left_semi").drop("_at")


def save_dataset(index: DataFrame, root: str, spec: dict, sources: list[str], kinds: list[str]) -> None:
    """The samples as Parquet, and beside them the specification with the number of samples of each class by level column."""
    index.write.mode("overwrite").parquet(f"{root}/index")
    counts = index.select(*[F.struct(*[F.sum((F.col(k) == c).cast("long")).alias(c) for c in ("same", "tinted", "other")]).alias(k) for k in kinds], F.count("*").alias("samples")).first().asDict(recursive=True)
    manifest = {"spec": spec, "sources": sources, "samples": counts.pop("samples"), "classes": counts}
    spark = index.sparkSession
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/manifest")


def load_dataset(spark: SparkSession, root: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{root}/index"), json.loads(spark.read.text(f"{root}/manifest").first().value)


def results(spark: SparkSession, run: str) -> DataFrame:
    """Every output written so far without its picture, and the launch that wrote it; none, in the same columns, before the first. A launch that did not end is not read."""
    whole = _done(spark, run)
    if not whole:
        return spark.createDataFrame([], INDEX + ", launch string")
    done = spark.read.schema(OUTPUT).parquet(*whole)
    return done.drop("png").withColumn("launch", F.regexp_extract(F.input_file_name(), r"/shards/([^/]+)/", 1))


def _done(spark: SparkSession, run: str) -> list[str]:
    """The folders of launches that ended."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{run}/shards/*/_SUCCESS")
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    return [] if found is None else [f.getPath().getParent().toString() for f in found]


def output(spark: SparkSession, run: str, family: str, name: str, sample: int) -> bytes | None:
    """The picture of one output: the three keys go down to the scan, the pictures of other rows are not read."""
    whole = _done(spark, run)
    row = None if not whole else spark.read.schema(OUTPUT).parquet(*whole).where((F.col("sample") == sample) & (F.col("input") == name) & (F.col("family") == family)).select("png").first()
    return None if row is None else bytes(row.png)


def local(index: DataFrame, shards: DataFrame) -> DataFrame:
    """The index rows whose launch is among ``shards(launch)``."""
    return index.join(shards.select("launch").distinct(), "launch", "left_semi")


def run(samples: DataFrame, run_path: str, f: Callable[[pd.DataFrame], pd.DataFrame], rank: int = 0, ranks: int = 1, budget: float = 900.0, batch: int = 64) -> int:
    """Work on this rank's samples that are not done; ``f`` takes a batch of them and gives the columns of OUTPUT. Returns the outputs written.

    A task starts no batch once ``budget`` seconds are spent, but each does one, so every launch moves on. A launch is one folder,
    seen by others only when it is whole; a task that runs again writes its part anew.
    """
    spark = samples.sparkSession
    mine = todo(samples, results(spark, run_path).select("sample").distinct(), "sample", rank, ranks)
    pending = samples.join(mine, "sample", "left_semi")
    parts = max(1, min(spark.sparkContext.defaultParallelism, pending.count() // max(1, batch) + 1))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        began, n = time.time(), 0
        for b in batches:
            for at in range(0, len(b), batch):
                if n and time.time() - began > budget:
                    return
                n += 1
                yield f(b.iloc[at : at + batch])

    path = f"{run_path}/shards/{time.strftime('%Y%m%d%H%M%S')}-{uuid.uuid4().hex[:6]}-r{rank}"
    pending.repartition(parts).mapInPandas(work, OUTPUT).write.parquet(path)
    return spark.read.parquet(path).count()


def joined_scores(outputs: DataFrame, truth: DataFrame, inputs: DataFrame) -> DataFrame:
    """``sample, input, method, out, truth, given``: each output beside its sample's truth and its input, for ``images.measured``."""
    t = truth.select("sample", F.col("image").alias("truth"))
    i = inputs.select("sample", "input", F.col("image").alias("given"))
    return outputs.select("sample", "input", F.col("family").alias("method"), F.col("image").alias("out")).join(t, "sample").join(i, ["sample", "input"])


def is_current(cached: DataFrame, wanted: DataFrame, keys: list[str]) -> bool:
    """Whether a cached table has exactly the keys wanted."""
    a, b = cached.select(*keys).distinct(), wanted.select(*keys).distinct()
    return a.join(b, keys, "left_anti").isEmpty() and b.join(a, keys, "left_anti").isEmpty()


def report(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table as CSV with a header under its name."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", "true").csv(f"{folder}/{name}")
