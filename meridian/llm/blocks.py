"""Vectors packed into rows of bounded size, for operators that work on matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def whole(vec: str):
    """True where an array column holds numbers only: not null, not empty, no null or non-finite component."""
    v = F.col(vec)
    return F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def clean(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``id long, vec array<double>`` of the rows that take part, those with a null id left out."""
    d = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    return d.where(F.col("id").isNotNull() & whole("vec"))


def pack(df: DataFrame, rows: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows ``(dim, n, ids, vecs, *by)`` of up to ``rows`` vectors each, in the order in which they come.

    Vectors of one block agree in their length and in the columns ``by`` (longs). Memory is bounded by one block and one Arrow batch.
    """

    def run(batches):
        held: dict[tuple, list] = {}

        def block(key):
            ids, vecs = zip(*held.pop(key))
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([np.concatenate(ids).tobytes()]), pa.array([np.concatenate(vecs).tobytes()])] + [pa.array([x], pa.int64()) for x in key[1:]], ["dim", "n", "ids", "vecs", *by])

        sizes: dict[tuple, int] = {}
        for b in batches:
            if not b.num_rows:
                continue
            ids, vec = b.column(0).to_numpy(), b.column(1)
            flat, offsets = vec.values.to_numpy(zero_copy_only=False), vec.offsets.to_numpy()
            lengths = np.diff(offsets)
            cols = np.stack([lengths.astype(np.int64)] + [b.column(2 + i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(len(by))], axis=1)
            keys, inverse = np.unique(cols, axis=0, return_inverse=True)
            inverse = inverse.ravel()
            for k, key in enumerate(map(tuple, keys.tolist())):
                at = np.nonzero(inverse == k)[0]
                own = flat[(offsets[at][:, None] + np.arange(key[0])).ravel()].reshape(-1, key[0])
                for s in range(0, len(at), rows):
                    part = at[s : s + rows]
                    if sizes.get(key, 0) + len(part) > rows:
                        yield block(key)
                        sizes[key] = 0
                    held.setdefault(key, []).append((ids[part], own[s : s + rows]))
                    sizes[key] = sizes.get(key, 0) + len(part)
            if by:  # rows come sorted by these columns: what can't grow any more goes out
                done = [k for k in held if k[1:] != tuple(cols[-1][1:].tolist())]
                for k in done:
                    yield block(k)
                    sizes[k] = 0
        for k in list(held):
            yield block(k)

    more = "".join(f", {c} long" for c in by)
    return df.select("id", "vec", *by).mapInArrow(run, f"dim long, n long, ids binary, vecs binary{more}")


def matrix(ids: bytes, vecs: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, dtype=np.int64), np.frombuffer(vecs, dtype=np.float64).reshape(-1, dim)

