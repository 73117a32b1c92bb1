"""What a user plugs in: heights, measures, enlargers, sources of tiles and sinks for fresh ones, and the archive reader as a Spark data source.

Each is a plain Python callable or a small class; the functions here put it where Spark runs it, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Heights(Protocol):
    def __call__(self, lon: np.ndarray, lat: np.ndarray) -> np.ndarray: ...


class Observer(Protocol):
    """A measure of a group's rows, one number."""

    def __call__(self, rows: pd.DataFrame) -> float: ...


class Upscaler(Protocol):
    """Enlarges a batch of images, count x height x width x 3."""

    def __call__(self, images: np.ndarray) -> np.ndarray: ...


class Upstream(Protocol):
    """Bytes of a tile, or None where the source has none."""

    def __call__(self, level: int, x: int, y: int) -> bytes | None: ...


class FreshTiles(Protocol):
    """Takes the tiles of one micro-batch; called again with the same number if the batch is run again."""

    def __call__(self, tiles: DataFrame, batch: int) -> None: ...


def heights_of(f: Heights, lon: Column, lat: Column) -> Column:
    """Heights by a user's function, a batch of places at a time."""

    @F.pandas_udf("double")
    def run(lon: pd.Series, lat: pd.Series) -> pd.Series:
        return pd.Series(np.asarray(f(lon.to_numpy(), lat.to_numpy()), dtype=float))

    return run(lon, lat)


def observed(rows: DataFrame, keys: list[str], observers: dict[str, Observer]) -> DataFrame:
    """``keys`` and one number for each observer and group; a group is in memory of one task."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[*group[keys].iloc[0], *(float(f(group)) for f in observers.values())]], columns=[*keys, *observers])

    return rows.groupBy(*keys).applyInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), *(f"{n} double" for n in observers)]))


def upscaled(images: DataFrame, key: str, side: int, scale: int, f: Upscaler) -> DataFrame:
    """``key, image`` enlarged ``scale`` times; ``image`` is an array of side * side * 3 numbers. Batches, not rows, go to the user's function."""
    kind = images.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                out = f(np.stack([np.asarray(v, dtype=np.float32).reshape(side, side, 3) for v in b["image"]]))
                yield pd.DataFrame({key: b[key], "image": [o.reshape(-1).astype(float) for o in out]})

    return images.select(key, "image").mapInPandas(run, f"{key} {kind}, image array<double>")


def fetched(asked: DataFrame, source: Upstream) -> DataFrame:
    """``level, x, y, data``: each different tile is asked for once, whoever wants it."""

    def run(batches):
        for b in batches:
            keys = list(zip(*(c.to_pylist() for c in b.columns)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([source(*k) for k in keys], pa.binary())], ["level", "x", "y", "data"])

    return asked.select("level", "x", "y").distinct().mapInArrow(run, "level long, x long, y long, data binary")


def backed_by(entries: DataFrame, asked: DataFrame, source: Upstream) -> DataFrame:
    """``level, x, y, data``: the stored tile, or for those that are not stored the source's."""
    missing = asked.join(entries, ["level", "x", "y"], "left_anti")
    return entries.join(asked, ["level", "x", "y"], "left_semi").select("level", "x", "y", "data").unionByName(fetched(missing, source))


class _Archive(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _ArchiveReader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self):
        return [_Archive(p) for p in self.paths]

    def read(self, partition):
        from meridian.sources import archives

        _, e = archives.entries(partition.path)
        for i, runs, size in zip(e["tile_id"].tolist(), e["run_length"].tolist(), e["length"].tolist()):
            yield (partition.path, i, runs, size)


class ArchiveListing(DataSource):
    """``spark.read.format("tile_archive").option("paths", "a,b").load()``: the entries of archives, one partition each."""

    @classmethod
    def name(cls):
        return "tile_archive"

    def schema(self):
        return "archive string, tile_id long, run_length long, length long"

    def reader(self, schema):
        return _ArchiveReader([p for p in self.options.get("paths", "").split(",") if p])


def register(spark: SparkSession) -> None:
    """Make the archive listing known to a session."""
    spark.dataSource.register(ArchiveListing)
