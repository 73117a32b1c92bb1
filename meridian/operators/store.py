"""Tile store: which copy wins, what is kept twice, what expires, what is merged next.

Entries are ``zone, epoch, archive, tile_id, bytes, digest, oldest_fetch, newest_fetch``; archives of a zone take
precedence in the order of their names, the last one first. Days are counted from a common day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridian.functions import grid


def newest_wins(puts: DataFrame) -> DataFrame:
    """One row a tile: the newest fetch, of equal ones the later arrival."""
    best = F.max_by(F.struct("fetched_ms", "arrival", "digest"), F.struct("fetched_ms", "arrival"))
    return puts.groupBy("layer", "level", "x", "y").agg(best.alias("w"), F.count("*").alias("offers")).select("layer", "level", "x", "y", "w.*", "offers")


def live(entries: DataFrame, today: Column, expiry_days: Column) -> DataFrame:
    """The entries whose epoch has not expired."""
    return entries.where(~grid.is_expired(F.col("epoch"), expiry_days, today))


def expired(entries: DataFrame, today: Column, expiry_days: Column) -> DataFrame:
    """The archives to retire: those of expired epochs."""
    return entries.where(grid.is_expired(F.col("epoch"), expiry_days, today)).select("zone", "epoch", "archive").distinct()


def census(entries: DataFrame) -> DataFrame:
    """Archives, copies, distinct tiles and tiles held more than once, per zone."""
    per_tile = entries.groupBy("zone", "tile_id").agg(F.count("*").alias("copies"))
    tiles = per_tile.groupBy("zone").agg(F.sum("copies").alias("copies"), F.count("*").alias("tiles"), F.sum((F.col("copies") > 1).cast("long")).alias("repeated"))
    return tiles.join(entries.groupBy("zone").agg(F.countDistinct("archive").alias("archives")), "zone")


def zone_listing(entries: DataFrame) -> DataFrame:
    """The newest archive that holds each tile of a zone, its copy there, and how many list it."""
    newest = F.max(F.when(F.col("archive").isNotNull(), F.struct("archive", "digest", "bytes")))
    return entries.groupBy("zone", "tile_id").agg(newest.alias("w"), F.count("*").alias("listed")).select("zone", "tile_id", "w.digest", "w.archive", "w.bytes", "listed")


def archive_summary(entries: DataFrame) -> DataFrame:
    """Tiles, bytes and fetch bounds of every archive; a bound is null if any entry's is."""

    def bound(agg, c):
        return F.when(F.count(c) == F.count("*"), agg(c))

    return entries.groupBy("zone", "epoch", "archive").agg(F.count("*").alias("tiles"), F.sum("bytes").alias("bytes"), bound(F.min, "oldest_fetch").alias("oldest_fetch"), bound(F.max, "newest_fetch").alias("newest_fetch"))


def stored_copies(asked: DataFrame, entries: DataFrame) -> DataFrame:
    """``asked(zone, tile_id, ..)`` with the copy that a reader would get (null where there is none) and its archive's oldest fetch."""
    newest = zone_listing(entries).select("zone", "tile_id", F.col("digest").alias("s_digest"), F.col("archive").alias("s_archive"))
    oldest = archive_summary(entries).select("zone", F.col("archive").alias("s_archive"), F.col("oldest_fetch").alias("s_oldest"))
    return asked.join(newest.join(oldest, ["zone", "s_archive"]), ["zone", "tile_id"], "left")


def drop_duplicates(fresh: DataFrame, entries: DataFrame) -> DataFrame:
    """Fresh tiles without those whose stored copy is identical or whose copy's archive has an oldest fetch after them; an unknown bound drops nothing."""
    both = stored_copies(fresh, entries)
    gone = F.coalesce(F.col("digest") == F.col("s_digest"), F.lit(False)) | F.coalesce(F.col("s_oldest") > F.col("fetched"), F.lit(False))
    return both.where(~gone).select(*fresh.columns)


def tiering_select(archives: DataFrame, fanout: int = 4, ratio: float = 4.0, most_archives: int = 16) -> DataFrame:
    """Per zone and epoch the run of ``fanout`` neighbouring archives to merge next, if any: ``first, cost, forced``.

    Runs count whose archives are all of the epoch, in the zone's order. The cheapest whose largest is within ``ratio`` times
    the smallest (1 byte at least) is taken, the first of equals; where there is none and the epoch has more than
    ``most_archives``, the cheapest of all (``forced``).
    """
    fanout = max(fanout, 2)
    run = Window.partitionBy("zone").orderBy("archive").rowsBetween(0, fanout - 1)
    cols = [F.sum("bytes").over(run).alias("cost"), F.max("bytes").over(run).alias("most"), F.min("bytes").over(run).alias("least"), F.count("*").over(run).alias("n"), F.min("epoch").over(run).alias("e0"), F.max("epoch").over(run).alias("e1")]
    held = archives.groupBy("zone", "epoch").agg(F.count("*").alias("held"))
    runs = archives.select("zone", "archive", "epoch", *cols).where((F.col("n") == fanout) & (F.col("e0") == F.col("e1"))).join(held, ["zone", "epoch"])
    runs = runs.withColumn("forced", F.col("most") > ratio * F.greatest("least", F.lit(1))).where(~F.col("forced") | (F.col("held") > most_archives))
    best = runs.groupBy("zone", "epoch").agg(F.min(F.struct("forced", "cost", "archive")).alias("m"))
    return best.select("zone", "epoch", F.col("m.archive").alias("first"), "m.cost", "m.forced")


def run_members(archives: DataFrame, chosen: DataFrame, fanout: int = 4) -> DataFrame:
    """``zone, archive, first``: the archives of each chosen run."""
    place = archives.select("zone", "archive", F.row_number().over(Window.partitionBy("zone").orderBy("archive")).alias("at"))
    start = place.join(chosen.select("zone", F.col("first").alias("archive")), ["zone", "archive"]).select("zone", F.col("archive").alias("first"), F.col("at").alias("start"))
    return place.join(start, "zone").where((F.col("at") >= F.col("start")) & (F.col("at") < F.col("start") + fanout)).select("zone", "archive", "first")


def merged(entries: DataFrame, members: DataFrame) -> DataFrame:
    """The entries after each run is merged into one archive in the place of its first: of a tile held twice in a run the newest copy stays.

    Archives outside the runs stay as they are. Each run is one group of equi-joins; a tile's copies meet after partial maxima.
    """
    both = entries.join(members, ["zone", "archive"], "left").withColumn("into", F.coalesce("first", "archive"))
    newest = F.max_by(F.struct("epoch", "bytes", "digest", "oldest_fetch", "newest_fetch"), "archive")
    return both.groupBy("zone", F.col("into").alias("archive"), "tile_id").agg(newest.alias("w")).select("zone", "w.epoch", "archive", "tile_id", "w.bytes", "w.digest", "w.oldest_fetch", "w.newest_fetch")


def scrub(entries: DataFrame, unwanted: Column) -> tuple[DataFrame, DataFrame]:
    """(entries without the unwanted copies, per zone what that changed): older copies of a tile come to light where the newest went."""
    kept = entries.where(~unwanted)
    marked = entries.select("zone", "tile_id", "archive", unwanted.alias("gone"))
    per_tile = marked.groupBy("zone", "tile_id").agg(F.max_by("gone", "archive").alias("newest_gone"), F.min("gone").alias("all_gone"), F.sum(F.col("gone").cast("long")).alias("removed"))
    tiles = per_tile.groupBy("zone").agg(F.sum("removed").alias("removed"), F.sum((F.col("newest_gone") & ~F.col("all_gone")).cast("long")).alias("uncovered"), F.sum(F.col("all_gone").cast("long")).alias("lost"))
    rewritten = marked.where("gone").groupBy("zone").agg(F.countDistinct("archive").alias("rewritten"))
    return kept, tiles.join(rewritten, "zone", "left").select("zone", "removed", "uncovered", "lost", F.coalesce("rewritten", F.lit(0)).cast("long").alias("rewritten"))


def orphans(listed: DataFrame, manifest: DataFrame, age: Column, grace: int) -> DataFrame:
    """Listed archives that no manifest names and that are older than ``grace``."""
    return listed.join(manifest, ["zone", "archive"], "left_anti").where(age > grace)


def due(archives: DataFrame, today: Column, expiry_days: Column, now: int, **how) -> DataFrame:
    """Per zone the earliest day on which something is to be done, not before ``now``, and how many reasons there are: epochs that expire, and runs to merge of those that have not."""
    epochs = archives.select("zone", "epoch").distinct()
    ends = epochs.select("zone", F.datediff(grid.expires_at(F.col("epoch"), expiry_days), F.lit("1995-01-01").cast("date")).cast("long").alias("at")).where("at is not null")
    merge = tiering_select(archives, **how).where(~grid.is_expired(F.col("epoch"), expiry_days, today)).select("zone", F.lit(now).cast("long").alias("at"))
    return ends.unionAll(merge).groupBy("zone").agg(F.greatest(F.min("at"), F.lit(now)).alias("at"), F.count("*").alias("reasons"))


def ladder(entries: DataFrame, absences: DataFrame, now: int) -> DataFrame:
    """Tile against absence: a copy holds unless a living absence was said strictly after it. Absences expire when ``expires`` is reached."""
    copy = entries.groupBy("zone", "tile_id").agg(F.max("newest_fetch").alias("fetched"))
    alive = absences.where(F.col("expires") > now)
    both = copy.join(alive, ["zone", "tile_id"], "full_outer")
    answer = F.when(F.col("said").isNull(), "copy").when(F.col("fetched").isNull() | (F.col("said") > F.col("fetched")), "absent").otherwise("copy")
    return both.select("zone", "tile_id", answer.alias("answer"))


def register(entries: DataFrame, absences: DataFrame) -> DataFrame:
    """The register of a zone as a rebuild leaves it: per tile the newest archive's copy, with that archive's newest fetch, unless an absence was said after it."""
    fetched = archive_summary(entries).select("zone", "archive", F.col("newest_fetch").alias("fetched"))
    copies = zone_listing(entries).join(fetched, ["zone", "archive"]).select("zone", "tile_id", "archive", "digest", "fetched")
    both = copies.join(absences.groupBy("zone", "tile_id").agg(F.max("said").alias("said")), ["zone", "tile_id"], "full_outer")
    absent = F.col("said").isNotNull() & (F.col("fetched").isNull() | (F.col("said") > F.col("fetched")))
    return both.select("zone", "tile_id", absent.alias("absent"), F.when(~absent, F.col("archive")).alias("archive"), F.when(~absent, F.col("digest")).alias("digest"), F.when(absent, F.col("said")).otherwise(F.col("fetched")).alias("fetched"))


def indexed(asked: DataFrame, buffered: DataFrame, zones: DataFrame, entries: DataFrame) -> DataFrame:
    """What an index says of a tile: unknown while it is buffered or its zone is not indexed, else held or not held."""
    b = buffered.select("zone", "tile_id").distinct().withColumn("b", F.lit(True))
    z = zones.select("zone").distinct().withColumn("z", F.lit(True))
    h = entries.select("zone", "tile_id").distinct().withColumn("h", F.lit(True))
    both = asked.join(b, ["zone", "tile_id"], "left").join(z, "zone", "left").join(h, ["zone", "tile_id"], "left")
    return both.select("zone", "tile_id", F.when(F.col("b") | F.col("z").isNull(), "unknown").when(F.col("h"), "held").otherwise("not held").alias("lookup"))


def tile_sources(asked: DataFrame, entries: DataFrame, absences: DataFrame, empty: Column, absences_first: bool) -> DataFrame:
    """Where each asked tile is answered from: ``absent``, ``store``, or ``upstream`` where neither a copy nor an absence is known.

    With ``absences_first`` an absence answers before any copy. A copy that is ``empty`` is read as an absence.
    """
    copy = zone_listing(entries).select("zone", "tile_id", "digest", "bytes").withColumn("empty", empty)
    both = asked.join(copy, ["zone", "tile_id"], "left").join(absences.select("zone", "tile_id", F.lit(True).alias("gone")).distinct(), ["zone", "tile_id"], "left")
    gone, held = F.coalesce("gone", F.lit(False)), F.col("digest").isNotNull()
    first = gone if absences_first else F.lit(False)
    source = F.when(first | (held & F.col("empty")), "absent").when(held, "store").when(gone, "absent").otherwise("upstream")
    return both.select("zone", "tile_id", source.alias("source"))


def extract(asked: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the newest copy of each asked tile that is held, how many asked tiles of each zone are not, and the least of them)."""
    newest = zone_listing(entries)
    a = asked.select("zone", "tile_id").distinct()
    missing = a.join(newest, ["zone", "tile_id"], "left_anti").groupBy("zone").agg(F.count("*").alias("missing"), F.min("tile_id").alias("least"))
    return newest.join(a, ["zone", "tile_id"], "left_semi"), missing


def merge_ranges(ids: DataFrame, key: str, value: str, gap: int = 1) -> DataFrame:
    """Runs of values at most ``gap`` apart, as inclusive ranges."""
    w = Window.partitionBy(key).orderBy(value)
    far = (F.col(value) - F.lag(value).over(w) > gap).cast("long")
    runs = ids.select(key, value).distinct().withColumn("run", F.coalesce(far, F.lit(0)))
    runs = runs.withColumn("run", F.sum("run").over(w))
    return runs.groupBy(key, "run").agg(F.min(value).alias("start"), F.max(value).alias("end"), F.count("*").alias("members")).drop("run")
