"""Shared-folder checkpoints and small helpers used by the operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that setting is absent and the master is local (tests) a temporary folder is made; on a cluster
    its absence is an error, since executors would each write to disks of their own.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        made = spark.sparkContext._jsc.sc().getCheckpointDir()
        if made.isDefined():
            root = made.get()
        else:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            root = "file://" + tempfile.mkdtemp(prefix="meridian-")
            spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, tag: str) -> str:
    """A fresh path under the shared folder, removed when the session's program ends."""
    path = f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path written by an operator; a session that has ended is no error."""
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the gateway is gone at interpreter exit
        pass


def written(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = shared_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame) -> DataFrame:
    """Eager ``checkpoint()`` in the shared folder."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hamming(a, b):
    return F.bit_count(a.bitwiseXOR(b))
