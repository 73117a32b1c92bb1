"""Small JSON documents of a store: the catalogue of layers, zone manifests, tile sets, terrain layers; and runs found by their keys."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ABSENT = ".absent"
LAYERS = "layers array<struct<name:string,grid:string,tile_type:string,zone_level:int,expiry_days:int,content_type:string,index:boolean>>"
MANIFEST = "generation long, archives array<struct<key:string,epoch:string,created:long,tiles:long,bytes:long,oldest_fetch_ms:long,newest_fetch_ms:long>>, retired array<struct<key:string,retired:long>>"


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path, multiLine=True) if _exists(spark, path) else spark.createDataFrame([], schema)


def layers(spark: SparkSession, path: str) -> DataFrame:
    """The layers of a catalogue, each with the sibling that holds its absences; no document, no layers. A name that ends as siblings do is an error."""
    own = _read(spark, path, LAYERS).select(F.inline("layers"))
    wrong = own.where(F.col("name").endswith(ABSENT)).first()
    if wrong is not None:
        raise ValueError(f"{wrong.name}: {ABSENT} is kept for absences")
    sibling = own.withColumn("name", F.concat("name", F.lit(ABSENT)))
    return own.unionByName(sibling)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """``seq, key, epoch, created, tiles, bytes, oldest_fetch_ms, newest_fetch_ms`` of a zone's archives; the last one takes precedence. No document, no archives."""
    return _read(spark, path, MANIFEST).select(F.posexplode("archives").alias("seq", "a")).select("seq", "a.*")


def generation(spark: SparkSession, path: str) -> int:
    row = _read(spark, path, MANIFEST).select("generation").first()
    return 0 if row is None or row.generation is None else row.generation


def replace_manifest(spark: SparkSession, path: str, seen: int, archives: list[dict], retired: list[dict]) -> bool:
    """Write a manifest of generation ``seen`` + 1 in the place of generation ``seen``; False where another writer was first.

    The document is written under a name of its own, and a rename that fails if the next generation's marker exists decides
    who is first.
    """
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if generation(spark, path) != seen:
        return False
    claim = jvm.org.apache.hadoop.fs.Path(f"{path}.{seen + 1}")
    if not fs.createNewFile(claim):
        return False
    new = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(new)
    out.write(bytearray(json.dumps({"generation": seen + 1, "archives": archives, "retired": retired}).encode()))
    out.close()
    fs.delete(at, False)
    return bool(fs.rename(new, at))


def listed(manifest_rows: DataFrame, found: DataFrame) -> DataFrame:
    """``nth, key``: archives newest first, then files that no manifest names, by name."""
    known = manifest_rows.select(F.lit(0).alias("stray"), (-F.col("seq")).alias("at"), "key")
    strays = found.select("key").join(manifest_rows.select("key"), "key", "left_anti").select(F.lit(1).alias("stray"), F.lit(0).alias("at"), "key")
    return known.unionByName(strays).orderBy("stray", "at", "key")


def runs(keys: DataFrame, template: str, marker: str) -> DataFrame:
    """``run, chunk, key`` of the keys that follow a template with ``{run}`` and ``{index}``, of the runs that have a marker key ``{run}``."""

    def rule(t):
        parts, at = [], 0
        for name, group in (("{run}", "([^/]+)"), ("{index}", "(\\d+)")):
            i = t.find(name)
            if i >= 0:
                parts.append((i, len(name), group))
        text = ""
        for i, size, group in sorted(parts):
            text += f"\\Q{t[at:i]}\\E{group}"
            at = i + size
        return f"^{text}\\Q{t[at:]}\\E$"

    names = rule(template)
    first = template.find("{run}") < template.find("{index}")
    ready = keys.where(F.col("key").rlike(rule(marker))).select(F.regexp_extract("key", rule(marker), 1).alias("run")).distinct()
    chunks = keys.where(F.col("key").rlike(names)).select(F.regexp_extract("key", names, 1 if first else 2).alias("run"), F.regexp_extract("key", names, 2 if first else 1).cast("long").alias("chunk"), "key")
    return chunks.join(ready, "run", "left_semi")


def tile_tree(document: str, base: str = "") -> list[dict]:
    """Rows ``id, parent, depth, refine, geometric_error, volume, content`` of a tile set document, parents before children; a tile without its own ``refine`` takes its parent's."""
    out: list[dict] = []
    todo = [(json.loads(document)["root"], None, 0, "REPLACE")]
    while todo:
        tile, parent, depth, refine = todo.pop(0)
        refine = tile.get("refine", refine).upper()
        uri = (tile.get("content") or {}).get("uri") or (tile.get("content") or {}).get("url")
        out.append({"id": len(out), "parent": parent, "depth": depth, "refine": refine, "geometric_error": float(tile["geometricError"]), "volume": json.dumps(tile["boundingVolume"], sort_keys=True), "content": None if uri is None else base + uri})
        todo += [(c, len(out) - 1, depth + 1, refine) for c in tile.get("children", [])]
    return out


def tile_sets(texts: DataFrame) -> DataFrame:
    """``set`` and the rows of ``tile_tree`` for each document of ``texts(set, text)``, in Arrow batches."""
    import pyarrow as pa

    kind = "set string, id long, parent long, depth long, refine string, geometric_error double, volume string, content string"

    def run(batches):
        for b in batches:
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                yield pa.RecordBatch.from_pylist([{"set": name, **r} for r in tile_tree(text)], schema=pa.schema([(c.split()[0], {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}[c.split()[1]]) for c in kind.split(", ")]))

    return texts.select("set", "text").mapInArrow(run, kind)


def grafted(tree: DataFrame, host: int, sub: DataFrame) -> DataFrame:
    """A tree with another one below its tile ``host``: the other's ids follow on, its root hangs from the host."""
    base = tree.agg((F.max("id") + 1).alias("base"), F.max(F.when(F.col("id") == host, F.col("depth") + 1)).alias("under"))
    moved = sub.crossJoin(F.broadcast(base))  # one row
    moved = moved.withColumn("parent", F.coalesce(F.col("parent") + F.col("base"), F.lit(host))).withColumn("id", F.col("id") + F.col("base")).withColumn("depth", F.col("depth") + F.col("under"))
    return tree.unionByName(moved.select(*tree.columns))


def terrain_ranges(text: str) -> list[tuple[int, int, int, int, int]]:
    """(level, x0, x1, y0, y1), inclusive, of a terrain layer document's availability."""
    doc = json.loads(text)
    return [(level, r["startX"], r["endX"], r["startY"], r["endY"]) for level, ranges in enumerate(doc.get("available", [])) for r in ranges]
