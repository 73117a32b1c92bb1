"""Fixed-column text, such as star catalogues: 1-based byte columns, typed and checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType


def _described(name, kind, nullable, what):
    return StructField(name, kind, nullable, {"description": what})


# The columns of a bright-star catalogue and where its source has them (first and last byte).
STARS = StructType([
    _described("hr", IntegerType(), False, "number in the catalogue"), _described("ra_j2000_deg", DoubleType(), False, "right ascension, J2000, degrees"),
    _described("dec_j2000_deg", DoubleType(), False, "declination, J2000, degrees"), _described("pm_ra_cosdec_arcsec_per_year", DoubleType(), True, "proper motion in right ascension"),
    _described("pm_dec_arcsec_per_year", DoubleType(), True, "proper motion in declination"), _described("v_mag", DoubleType(), False, "visual magnitude"), _described("b_v_mag", DoubleType(), True, "colour index"),
])


def field(first: int, last: int, line: str = "value") -> Column:
    """The trimmed text of bytes ``first`` to ``last``; null where it is blank or past the line's end."""
    return F.nullif(F.trim(F.substring(F.col(line), first, last - first + 1)), F.lit(""))


def parse_stars(lines: DataFrame) -> DataFrame:
    """Typed rows of the text lines ``value``. Lines without a number, a position or a magnitude are left out; a field that should be a number and isn't raises an error; blank optional ones are null."""
    d = lines.where(field(1, 4).rlike(r"^\d+$") & field(76, 77).isNotNull() & field(103, 107).isNotNull())

    def number(first, last):
        return field(first, last).cast("double")

    dec = number(85, 86) + number(87, 88) / 60 + number(89, 90) / 3600
    cols = [
        field(1, 4).cast("int"), (number(76, 77) + number(78, 79) / 60 + number(80, 83) / 3600) * 15, F.when(F.substring("value", 84, 1) == "-", -dec).otherwise(dec),
        number(149, 154), number(155, 160), number(103, 107), number(110, 114),
    ]
    return d.select(*[c.alias(f.name, metadata=f.metadata) for c, f in zip(cols, STARS)])


def read_stars(spark: SparkSession, path: str, sha256: str | None = None) -> DataFrame:
    """``parse_stars`` of a text file, gzip or plain; with ``sha256`` the file's bytes must have that digest."""
    if sha256 is not None:
        found = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("d")).first()
        if found is None or found.d != sha256.lower():
            raise ValueError(f"{path}: digest {found and found.d}, not {sha256}")
    return parse_stars(spark.read.text(path))


def write_stars(df: DataFrame, path: str) -> None:
    df.select(*STARS.names).write.parquet(path)


def load_stars(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STARS).parquet(path)
