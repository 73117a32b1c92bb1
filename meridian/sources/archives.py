"""Tile archives in the PMTiles v3 layout: headers, directories, and archives written and read whole or as listings.

Files are opened through ``pyarrow.fs``. A listing reads the header and the directories only, never the tiles.
"""

from __future__ import annotations

import gzip
import hashlib
import struct
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the format: magic, header length, names of compressions and tile types by code.
MAGIC, HEADER = b"PMTiles\x03", 127
COMPRESSION = ("unknown", "none", "gzip", "brotli", "zstd")
TILE_TYPE = ("unknown", "mvt", "png", "jpeg", "webp", "avif")
PLACES = ("root_offset", "root_length", "metadata_offset", "metadata_length", "leaf_offset", "leaf_length", "data_offset", "data_length", "addressed_tiles", "tile_entries", "tile_contents")


def parse_header(raw: bytes) -> dict:
    if raw[: len(MAGIC)] != MAGIC:
        raise ValueError("no archive of this format")
    out = dict(zip(PLACES, struct.unpack_from("<11Q", raw, 8)))
    named = lambda names, code: names[code] if code < len(names) else "unknown"
    return out | {"clustered": bool(raw[96]), "internal_compression": named(COMPRESSION, raw[97]), "tile_compression": named(COMPRESSION, raw[98]), "tile_type": named(TILE_TYPE, raw[99]), "min_zoom": raw[100], "max_zoom": raw[101]}


def varints(raw: bytes) -> np.ndarray:
    """All base-128 numbers of a byte string, least group first: groups are shifted by their place and summed up to each last byte."""
    b = np.frombuffer(raw, dtype=np.uint8)
    ends = np.nonzero(b < 0x80)[0]
    if not len(ends):
        return np.zeros(0, dtype=np.uint64)
    b = b[: ends[-1] + 1]
    starts = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(b)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((b & 0x7F).astype(np.uint64) << (7 * place).astype(np.uint64), starts)


def put_varints(values: np.ndarray) -> bytes:
    v = values.astype(np.uint64)
    size = np.ones(len(v), dtype=np.int64)
    for k in range(1, 10):
        size += v >= np.uint64(1) << np.uint64(7 * k)
    ends = np.cumsum(size)
    out = np.empty(int(ends[-1]) if len(v) else 0, dtype=np.uint8)
    for k in range(10):
        has = size > k
        group = (v[has] >> np.uint64(7 * k) & np.uint64(0x7F)).astype(np.uint8)
        out[(ends - size)[has] + k] = group | np.where(size[has] > k + 1, 0x80, 0).astype(np.uint8)
    return out.tobytes()


def parse_directory(plain: bytes) -> dict[str, np.ndarray]:
    """``tile_id, run_length, length, offset`` of a directory's entries; an offset of 0 follows the entry before."""
    v = varints(plain).astype(np.int64)
    n = int(v[0]) if len(v) else 0
    if len(v) != 1 + 4 * n:
        raise ValueError("a directory of another length than its number of entries")
    ids, runs, lengths, offsets = np.cumsum(v[1 : n + 1]), *(v[1 + k * n : 1 + (k + 1) * n] for k in (1, 2, 3))
    ends = np.cumsum(lengths) - lengths
    own = offsets > 0
    if n and not own[0]:
        offsets, own = np.concatenate([[1], offsets[1:]]), np.concatenate([[True], own[1:]])
    last = np.maximum.accumulate(np.where(own, np.arange(n), 0)) if n else np.zeros(0, np.int64)
    return {"tile_id": ids, "run_length": runs, "length": lengths, "offset": offsets[last] - 1 + ends - ends[last] if n else offsets}


def serialize_directory(d: dict[str, np.ndarray]) -> bytes:
    ids, runs, lengths, offsets = (np.asarray(d[k], dtype=np.int64) for k in ("tile_id", "run_length", "length", "offset"))
    follows = np.zeros(len(ids), dtype=bool)
    follows[1:] = offsets[1:] == offsets[:-1] + lengths[:-1]
    return put_varints(np.concatenate([[len(ids)], np.diff(ids, prepend=0), runs, lengths, np.where(follows, 0, offsets + 1)]))


def build(ids: list[int], contents: list[bytes], tile_type: str = "png", metadata: bytes = b"{}") -> bytes:
    """A whole archive of tiles in strictly increasing order of id; equal contents are stored once, equal neighbours with following ids are one entry."""
    if any(b <= a for a, b in zip(ids, ids[1:])):
        raise ValueError("tile ids must increase")
    data, places, entries = bytearray(), {}, []
    for i, c in zip(ids, contents):
        key = hashlib.sha256(c).digest()
        if key not in places:
            places[key] = (len(data), len(c))
            data += c
        at, size = places[key]
        if entries and entries[-1][2:] == (size, at) and entries[-1][0] + entries[-1][1] == i:
            entries[-1] = (entries[-1][0], entries[-1][1] + 1, size, at)
        else:
            entries.append((i, 1, size, at))
    names = ("tile_id", "run_length", "length", "offset")
    root = gzip.compress(serialize_directory({k: np.array([e[j] for e in entries], dtype=np.int64) for j, k in enumerate(names)}), mtime=0)
    meta = gzip.compress(metadata, mtime=0)
    zoom = [(((3 * i + 1).bit_length() - 1) // 2) for i in (ids[0], ids[-1])] if ids else [0, 0]
    first = HEADER + len(root)
    places_ = (HEADER, len(root), first, len(meta), first + len(meta), 0, first + len(meta), len(data), len(ids), len(entries), len(places))
    head = MAGIC + struct.pack("<11Q", *places_) + bytes([1, COMPRESSION.index("gzip"), COMPRESSION.index("none"), TILE_TYPE.index(tile_type), *zoom])
    return head.ljust(HEADER, b"\0") + root + meta + bytes(data)


def _open(path: str):
    fs, at = pafs.FileSystem.from_uri(path)
    return fs.open_input_file(at)


def entries(path: str) -> tuple[dict, dict[str, np.ndarray]]:
    """(header, entries) of an archive, leaf directories followed."""
    with _open(path) as f:
        h = parse_header(f.read_at(HEADER, 0))
        if h["internal_compression"] not in ("none", "gzip"):
            raise ValueError(f"{path}: directories in {h['internal_compression']}")
        plain = gzip.decompress if h["internal_compression"] == "gzip" else bytes
        todo, found = [parse_directory(plain(f.read_at(h["root_length"], h["root_offset"])))], []
        while todo:
            d = todo.pop(0)
            leaf = d["run_length"] == 0
            found.append({k: v[~leaf] for k, v in d.items()})
            for at, size in zip(d["offset"][leaf].tolist(), d["length"][leaf].tolist()):
                todo.append(parse_directory(plain(f.read_at(size, h["leaf_offset"] + at))))
    all_ = {k: np.concatenate([d[k] for d in found]) for k in ("tile_id", "run_length", "length", "offset")}
    order = np.argsort(all_["tile_id"], kind="stable")
    return h, {k: v[order] for k, v in all_.items()}


def listing(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``archive, tile_id, run_length, offset, length`` of the archives named, one task for each: directories only, no tile is read."""

    def run(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                h, e = entries(path)
                n = len(e["tile_id"])
                cols = [pa.array([path] * n, pa.string()), *(pa.array(e[k]) for k in ("tile_id", "run_length")), pa.array(e["offset"] + h["data_offset"]), pa.array(e["length"])]
                yield pa.RecordBatch.from_arrays(cols, ["archive", "tile_id", "run_length", "offset", "length"])

    named = spark.createDataFrame([(p,) for p in paths], "archive string").repartition(max(1, len(paths)))
    return named.mapInArrow(run, "archive string, tile_id long, run_length long, offset long, length long")


def tiles(listed: DataFrame) -> DataFrame:
    """``archive, tile_id, data`` of the entries of a ``listing``, runs written out; what was filtered from the listing is not read."""

    def run(batches):
        for b in batches:
            rows, f, opened = [], None, None
            for path, tile_id, runs, at, size in zip(*(c.to_pylist() for c in b.columns)):
                if path != opened:
                    f, opened = _open(path), path
                data = f.read_at(size, at)
                rows += [(path, tile_id + k, data) for k in range(runs)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.binary()))], ["archive", "tile_id", "data"])

    return listed.select("archive", "tile_id", "run_length", "offset", "length").mapInArrow(run, "archive string, tile_id long, data binary")


def write(df: DataFrame, folder: str) -> DataFrame:
    """Write ``df(zone, tile_id, data)`` as one archive a zone under ``folder``; returns ``zone, archive, tiles, bytes``.

    A zone is one group and its archive is built in memory, as zones are cut so that one fits. A tile id given
    twice in a zone is an error. A repeated task writes another file, which no returned row names.
    """

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by("tile_id")
        raw = build(table["tile_id"].to_pylist(), table["data"].to_pylist())
        fs, at = pafs.FileSystem.from_uri(folder)
        fs.create_dir(at, recursive=True)
        name = f"{uuid.uuid4().hex}.pmtiles"
        with fs.open_output_stream(f"{at}/{name}", compression=None) as out:
            out.write(raw)
        return pa.table({"zone": [table["zone"][0].as_py()], "archive": [f"{folder}/{name}"], "tiles": [table.num_rows], "bytes": [len(raw)]})

    return df.select("zone", "tile_id", F.coalesce("data", F.lit(b"")).alias("data")).groupBy("zone").applyInArrow(one, "zone string, archive string, tiles long, bytes long")
