"""Keys, ranges, validators, templates and clocks as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_key(key: Column) -> Column:
    """Whether a key is a path inside a store: not empty, not absolute, no empty, ``.`` or ``..`` part."""
    return F.coalesce((key != "") & F.forall(F.split(key, "/"), lambda p: ~p.isin("", ".", "..")), F.lit(False))


def byte_range(spec: Column, size: Column, whole_limit: int, open_range: int) -> Column:
    """struct(start, end, partial) that ``bytes=a-b`` or ``bytes=a-`` or nothing asks of an object; null where it can't be answered."""
    pattern = r"^bytes=\s*(\d{1,18})\s*-\s*(\d{0,18})\s*$"
    good = spec.rlike(pattern)
    text = F.when(good, spec)
    start, last = F.regexp_extract(text, pattern, 1).cast("long"), F.nullif(F.regexp_extract(text, pattern, 2), F.lit("")).cast("long")
    end = F.when(last.isNull(), F.least(start + open_range, size)).otherwise(F.least(last + 1, size))
    part = F.when(start < end, F.struct(start.alias("start"), end.alias("end"), F.lit(True).alias("partial")))
    whole = F.when(size <= whole_limit, F.struct(F.lit(0).cast("long").alias("start"), size.alias("end"), F.lit(False).alias("partial")))
    return F.when(spec.isNull(), whole).when(good, part)


def names_tag(if_none_match: Column, etag: Column) -> Column:
    """Whether a list of validators names ``etag``; weak ones count as strong, ``*`` names any."""
    bare = F.regexp_replace(etag, "^(W/)+", "")
    tags = F.transform(F.split(if_none_match, ","), lambda t: F.regexp_replace(F.trim(t), "^(W/)+", ""))
    return F.coalesce(F.array_contains(tags, "*") | F.array_contains(tags, bare), F.lit(False))


def expand_template(template: Column, level: Column, x: Column, y: Column, z: Column | None = None) -> Column:
    out = F.replace(F.replace(F.replace(template, F.lit("{level}"), level.cast("string")), F.lit("{x}"), x.cast("string")), F.lit("{y}"), y.cast("string"))
    return out if z is None else F.replace(out, F.lit("{z}"), z.cast("string"))


def sniff(content: Column) -> Column:
    """Kind of a tile payload by its first four bytes; null for one that is not read."""
    magic = F.substring(content, 1, 4).cast("string")
    return F.when(magic == "glTF", "glb").when(magic == "b3dm", "b3dm")


def parse_utc(text: Column) -> Column:
    """Unix seconds of a number, or of a UTC instant ``YYYY-MM-DD``, with ``THH:MM``, with seconds and a ``Z``; null for anything else."""
    number = F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text)
    bare = F.regexp_replace(text, "Z$", "")
    shape = r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?$"
    at = F.try_to_timestamp(F.when(bare.rlike(shape), F.concat(F.replace(bare, F.lit("T"), F.lit(" ")), F.when(F.length(bare) == 10, F.lit(" 00:00:00")).when(F.length(bare) == 16, F.lit(":00")).otherwise(F.lit("")), F.lit("+00:00"))))
    return F.coalesce(number.cast("double"), F.unix_micros(at) / 1e6)


def instant(start: Column, step: Column, frame: Column) -> Column:
    """Instant that a frame, counted from 1, shows."""
    return start + F.greatest(frame - 1, F.lit(0)) * step


def deep_link(lon: Column, lat: Column, altitude: Column, heading: Column, pitch: Column) -> Column:
    """A link to a view; a heading that rounds to a full turn is 0, the pitch stays between level and straight down."""
    turn = F.when(heading > 359.9995, F.lit(0.0)).otherwise(heading)
    return F.format_string("goto?lon=%.7f&lat=%.7f&altitude=%.2f&heading=%.3f&pitch=%.3f", lon, lat, altitude, turn, F.least(F.greatest(pitch, F.lit(0.0)), F.lit(90.0)))
