"""Recorded frames as Parquet: numbers that are not finite are null in the file and NaN when read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StructType


def _floats(schema: StructType) -> set[str]:
    return {f.name for f in schema if isinstance(f.dataType, DoubleType | FloatType)}


def write_rows(df: DataFrame, path: str) -> None:
    """Write ``df`` with Snappy; NaN and the infinities become null."""
    floats = _floats(df.schema)

    def kept(c):
        return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c)).alias(c) if c in floats else F.col(c)

    df.select(*[kept(c) for c in df.columns]).write.option("compression", "snappy").parquet(path)


def read_rows(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The columns of ``schema``, by name; a column that is missing or of another type is an error. Null floats come back as NaN."""
    found = {f.name: f.dataType for f in spark.read.parquet(path).schema}
    for f in schema:
        if f.name not in found:
            raise ValueError(f"{path}: no column {f.name}")
        if found[f.name] != f.dataType:
            raise ValueError(f"{path}: column {f.name} is {found[f.name].simpleString()}, not {f.dataType.simpleString()}")
    floats = _floats(schema)
    return spark.read.parquet(path).select(*[F.coalesce(c, F.lit(float("nan"))).alias(c) if c in floats else F.col(c) for c in schema.names])
