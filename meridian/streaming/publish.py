"""Fresh tiles as a stream into a store of Parquet deltas: each micro-batch is one publication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from meridian.operators import store

FRESH = "zone string, tile_id long, digest long, bytes long, fetched long, arrival long"
ENTRIES = "zone string, epoch string, archive string, tile_id long, bytes long, digest long, oldest_fetch long, newest_fetch long"


def stored(spark: SparkSession, path: str) -> DataFrame:
    """All entries published so far; an empty table where nothing was."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], ENTRIES)
    return spark.read.schema(ENTRIES).option("recursiveFileLookup", "true").parquet(path)


def publish(fresh: DataFrame, batch: int, path: str, epoch: str) -> None:
    """One publication: of a tile offered twice the later fetch (of equals the later arrival) counts, what the store holds already or newer is left out, the rest becomes one archive a zone.

    The batch's folder is written over when a batch is run again, so a restart publishes nothing twice.
    """
    spark = fresh.sparkSession
    best = F.max_by(F.struct("digest", "bytes", "fetched"), F.struct("fetched", "arrival"))
    offered = fresh.groupBy("zone", "tile_id").agg(best.alias("w")).select("zone", "tile_id", "w.*")
    known = stored(spark, path).where(F.col("archive") != f"{epoch}-{batch:09d}")
    new = store.drop_duplicates(offered, known)
    rows = new.select("zone", F.lit(epoch).alias("epoch"), F.lit(f"{epoch}-{batch:09d}").alias("archive"), "tile_id", "bytes", "digest", F.col("fetched").alias("oldest_fetch"), F.col("fetched").alias("newest_fetch"))
    rows.write.mode("overwrite").parquet(f"{path}/{epoch}-{batch:09d}")


def publishing(stream: DataFrame, path: str, checkpoint: str, epoch: str, **trigger) -> StreamingQuery:
    """Start publishing ``stream`` (the columns of FRESH). ``trigger`` is Structured Streaming's: ``availableNow=True`` flushes all there is, ``processingTime="30 seconds"`` what has come."""
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).foreachBatch(lambda df, n: publish(df, n, path, epoch)).start()


def offered_per_window(stream: DataFrame, time: str, window: str, late: str) -> DataFrame:
    """Tiles offered per window and zone, as a stream; rows later than ``late`` are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), "zone").agg(F.count("*").alias("offers"), F.max("fetched").alias("newest")).select(F.col("w.start").alias("start"), "zone", "offers", "newest")
