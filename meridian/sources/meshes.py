"""Binary tile payloads: batched models and quantised meshes, read and written with numpy."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed values of the formats: header lengths, the greatest quantised coordinate.
B3DM_HEADER, MESH_HEADER, MOST = 28, 88, 32767


def parse_b3dm(raw: bytes) -> dict:
    """Feature and batch tables and the model of a batched 3D model, by the lengths of its header."""
    if raw[:4] != b"b3dm" or len(raw) < B3DM_HEADER:
        raise ValueError("no batched model")
    version, size, *lengths = struct.unpack_from("<6I", raw, 4)
    if version != 1 or size > len(raw) or B3DM_HEADER + sum(lengths) > size:
        raise ValueError("batched model of another version or length")
    ends = np.cumsum([B3DM_HEADER, *lengths]).tolist()
    parts = [raw[a:b] for a, b in zip(ends, [*ends[1:], size])]
    return dict(zip(("feature_json", "feature_binary", "batch_json", "batch_binary", "model"), parts))


def build_b3dm(model: bytes, feature_json: str = '{"BATCH_LENGTH":0}') -> bytes:
    """A batched model; the table is filled with spaces and the model with zeros to multiples of eight."""
    table = feature_json.encode()
    table += b" " * (-(B3DM_HEADER + len(table)) % 8)
    model += b"\0" * (-len(model) % 8)
    return b"b3dm" + struct.pack("<6I", 1, B3DM_HEADER + len(table) + len(model), len(table), 0, 0, 0) + table + model


def _unzigzag(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.int64)
    return np.cumsum((v >> 1) ^ -(v & 1))


def _zigzag(v: np.ndarray) -> np.ndarray:
    d = np.diff(v.astype(np.int64), prepend=0)
    return ((d << 1) ^ (d >> 63)).astype("<u2")


def _high_water(codes: np.ndarray) -> np.ndarray:
    """Indices from their distance below the highest one so far; a code of 0 raises it."""
    fresh = (codes == 0).cumsum()
    return fresh - (codes == 0) - codes.astype(np.int64)


def _from_high_water(indices: np.ndarray) -> np.ndarray:
    top = np.maximum.accumulate(np.concatenate([[-1], indices]))
    if (indices > top[:-1] + 1).any():
        raise ValueError("vertices are not in the order of their first use")
    return top[:-1] + 1 - indices


def parse_mesh(raw: bytes) -> dict:
    """Header fields, ``u, v, height`` from 0 to 1, ``triangles``, edge vertices by side and extensions by number of a quantised mesh."""
    head = struct.unpack_from("<3d2f4d3d", raw, 0)
    n = struct.unpack_from("<I", raw, MESH_HEADER)[0]
    at = MESH_HEADER + 4
    coords = np.frombuffer(raw, "<u2", 3 * n, at).reshape(3, n)
    at += 6 * n
    kind = np.dtype("<u4" if n > 65536 else "<u2")
    at += -at % kind.itemsize
    count = struct.unpack_from("<I", raw, at)[0]
    codes = np.frombuffer(raw, kind, 3 * count, at + 4)
    at += 4 + codes.nbytes
    edges = {}
    for side in ("west", "south", "east", "north"):
        m = struct.unpack_from("<I", raw, at)[0]
        edges[side] = np.frombuffer(raw, kind, m, at + 4).astype(np.int64)
        at += 4 + m * kind.itemsize
    extensions = {}
    while at + 5 <= len(raw):
        number, size = struct.unpack_from("<BI", raw, at)
        extensions[number] = raw[at + 5 : at + 5 + size]
        at += 5 + size
    u, v, h = (_unzigzag(c) / MOST for c in coords)
    triangles = _high_water(codes).reshape(-1, 3)
    if n and triangles.size and triangles.max() >= n:
        raise ValueError("a triangle names a vertex that is not there")
    return {"centre": head[:3], "low": head[3], "high": head[4], "sphere": head[5:9], "horizon": head[9:], "u": u, "v": v, "height": h, "triangles": triangles, "edges": edges, "extensions": extensions}


def build_mesh(mesh: dict) -> bytes:
    """The bytes of ``parse_mesh``'s fields; vertices must stand in the order in which triangles first use them."""
    n = len(mesh["u"])
    kind = np.dtype("<u4" if n > 65536 else "<u2")
    out = bytearray(struct.pack("<3d2f4d3d", *mesh["centre"], mesh["low"], mesh["high"], *mesh["sphere"], *mesh["horizon"]) + struct.pack("<I", n))
    for c in ("u", "v", "height"):
        out += _zigzag(np.rint(np.asarray(mesh[c]) * MOST)).tobytes()
    out += b"\0" * (-len(out) % kind.itemsize)
    codes = _from_high_water(np.asarray(mesh["triangles"], dtype=np.int64).ravel())
    out += struct.pack("<I", len(codes) // 3) + codes.astype(kind).tobytes()
    for side in ("west", "south", "east", "north"):
        e = np.asarray(mesh["edges"][side])
        out += struct.pack("<I", len(e)) + e.astype(kind).tobytes()
    for number, data in sorted(mesh["extensions"].items()):
        out += struct.pack("<BI", number, len(data)) + data
    return bytes(out)


def mesh_vertices(tiles: DataFrame, key: str = "tile_id", data: str = "data") -> DataFrame:
    """``key, vertex, u, v, height`` in metres of every mesh of ``tiles``; a mesh at a time is in memory."""

    def run(batches):
        for b in batches:
            for i, raw in zip(b.column(0), b.column(1)):
                m = parse_mesh(raw.as_py())
                n = len(m["u"])
                yield pa.RecordBatch.from_arrays([pa.array([i.as_py()] * n, pa.int64()), pa.array(np.arange(n)), pa.array(m["u"]), pa.array(m["v"]), pa.array(m["low"] + m["height"] * (m["high"] - m["low"]))], [key, "vertex", "u", "v", "height"])

    return tiles.select(key, data).where(f"{data} is not null").mapInArrow(run, f"{key} long, vertex long, u double, v double, height double")
