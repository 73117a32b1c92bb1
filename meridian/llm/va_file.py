"""Exact top-k by a vector-approximation file.

Candidates are cut into chunks; a chunk holds its vectors' cells (a few bits a component on a
grid of its own) beside the exact vectors. For each query the cells give an upper and a lower
bound of every inner product. Exact vectors are then read in the order of their bounds until
no unread one can still be among the k best.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridian.llm.blocks import clean, matrix, pack
from meridian.llm.common import cut

CHUNK_ROWS, QUERY_ROWS, BITS, STEP = 4096, 1024, 6, 64
EXACT = float(2**53)


def approximate(v: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes uint8, edges from below, edges from above): cell c of dimension d spans edges_lo[c, d] to edges_hi[c, d]."""
    cells = 1 << bits
    low, high = v.min(axis=0), v.max(axis=0)
    width = np.maximum(high / cells - low / cells, np.finfo(float).tiny)  # halves first: the range may exceed a double
    codes = np.clip((v / width - low / width), 0, cells - 1)
    codes = np.where(np.isfinite(codes), codes, 0).astype(np.uint8)
    lo, hi = np.empty((cells, v.shape[1])), np.empty((cells, v.shape[1]))
    lo[:], hi[:] = high, low
    for d in range(v.shape[1]):  # the members' own least and greatest value bound each cell
        np.minimum.at(lo[:, d], codes[:, d], v[:, d])
        np.maximum.at(hi[:, d], codes[:, d], v[:, d])
    return codes, lo, hi


def _dots(q: np.ndarray, v: np.ndarray, safe: bool) -> np.ndarray:
    """Integer inner products of one query; exact beyond 2**53 by Python's integers, held within 64 bits."""
    if safe:
        return v @ q
    own = [int(x) for x in q]
    return np.array([max(-(2**63), min(2**63 - 1, sum(a * int(b) for a, b in zip(own, row)))) for row in v], dtype=object)


class Best:
    """The k best (score, id) of each query of a block so far."""

    def __init__(self, n: int, k: int):
        self.k, self.rows = k, [[] for _ in range(n)]

    def add(self, i: int, scores, ids) -> None:
        self.rows[i] = sorted([*self.rows[i], *((-int(s), int(v)) for s, v in zip(scores, ids))])[: self.k]

    def bar(self, i: int) -> float:
        r = self.rows[i]
        return -r[-1][0] if len(r) == self.k else -float("inf")


def search_chunk(best: Best, q_ids, q, c_ids, codes, lo, hi, exact) -> int:
    """Raise ``best`` by one chunk; returns how many exact vectors were read."""
    order = np.argsort(c_ids, kind="stable")
    dims = np.arange(q.shape[1])
    below, above = lo[codes, dims], hi[codes, dims]
    top = max(float(np.abs(q).max()), 1.0) * max(float(np.abs(exact).max()), 1.0) * q.shape[1]
    safe, reads = top < EXACT, 0
    if safe:
        plus, minus = np.maximum(q, 0), np.minimum(q, 0)
        upper = plus @ above.T + minus @ below.T
        lower = plus @ below.T + minus @ above.T
    for i in range(len(q)):
        if not safe:  # bounds in doubles would not be certain: all are read
            at = order[c_ids[order] != q_ids[i]]
            best.add(i, _dots(q[i], exact[at], False), c_ids[at])
            reads += len(at)
            continue
        own = c_ids == q_ids[i]
        u, bar = np.where(own, -np.inf, upper[i]), best.bar(i)
        if best.k <= len(c_ids) - own.sum():  # k lower bounds within the chunk are a bar, too
            low = np.where(own, -np.inf, lower[i])
            bar = max(bar, np.partition(low, len(low) - best.k)[len(low) - best.k])
        may = order[(u[order] >= bar) & ~own[order]]
        may = may[np.argsort(-u[may], kind="stable")]
        for s in range(0, len(may), STEP):
            if u[may[s]] < best.bar(i):  # equal bounds may still tie with a smaller id
                break
            part = may[s : s + STEP]
            best.add(i, _dots(q[i], exact[part], True), c_ids[part])
            reads += len(part)
    return reads


def top_k(queries: DataFrame, candidates: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 1024.0) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k highest integer inner products of floor(scale * x), ties to the smaller id.

    Rows with the query's id are not its candidates. Rows that are null, empty, or hold null or
    non-finite components take no part, nor do null ids; vectors meet those of their own length
    only. A repeated query id asks once, by its least vector; repeated candidate rows each
    count. A score beyond 64 bits is given as the nearest 64-bit number. Empty tables give no rows.
    """
    spark = queries.sparkSession

    def scaled(df: DataFrame) -> DataFrame:
        d = clean(df, id_col, vec_col)
        # a double times 1024 may overflow; such a component is non-finite then and its vector takes no part
        return d.select("id", F.transform("vec", lambda x: F.when(F.abs(x) < 2.0**52, F.floor(x * scale).cast("double")).otherwise(x * scale)).alias("vec")).where(F.forall("vec", lambda x: F.abs(x) < float("inf")))

    asked = scaled(queries).groupBy("id").agg(F.min("vec").alias("vec"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, -(-asked.count() // QUERY_ROWS))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("long")).repartition(min(blocks, parts), "block").sortWithinPartitions("block")
    q = pack(asked, QUERY_ROWS, ("block",)).select("dim", "block", F.col("ids").alias("q_ids"), F.col("vecs").alias("q_vecs"))
    q = cut(q)
    chunks = pack(scaled(candidates), CHUNK_ROWS)

    def cells(batches):
        for b in batches:
            for dim, n, ids, vecs in zip(*(c.to_pylist() for c in b.columns)):
                codes, lo, hi = approximate(matrix(ids, vecs, dim)[1])
                yield pa.RecordBatch.from_arrays([pa.array([dim]), pa.array([ids]), pa.array([vecs]), pa.array([codes.tobytes()]), pa.array([lo.tobytes()]), pa.array([hi.tobytes()])], ["dim", "ids", "vecs", "codes", "lo", "hi"])

    file = chunks.mapInArrow(cells, "dim long, ids binary, vecs binary, codes binary, lo binary, hi binary")
    # every block of queries meets every chunk of its length; a pair of block and share is one group, so more blocks make more tasks, not fewer
    shares = max(1, -(-2 * max(parts, spark.sparkContext.defaultParallelism) // blocks))
    file = file.withColumn("share", F.pmod(F.xxhash64("ids"), F.lit(shares)).cast("int"))
    file = file.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    q = q.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    # both sides are exploded, which Spark's estimates leave out: without the hint one may be broadcast, however large
    pairs = q.join(file.hint("merge"), ["dim", "block", "share"]).select("block", "share", "dim", "q_ids", "q_vecs", "ids", "vecs", "codes", "lo", "hi")

    def run(batches):
        at, state = None, {}

        def done():
            rows = [(int(ids[i]), v, -s) for ids, _, best in state.values() for i, r in enumerate(best.rows) for s, v in r]
            state.clear()
            return [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["query_id", "vec_id", "score"])] if rows else []

        for b in batches:
            for block, share, dim, qi, qv, ci, cv, codes, lo, hi in zip(*(c.to_pylist() for c in b.columns)):
                if at != (block, share, dim):  # the best of one group at a time are held; a group that comes again is ranked with it later
                    yield from done()
                    at = (block, share, dim)
                if qi not in state:
                    ids, vecs = matrix(qi, qv, dim)
                    state[qi] = ids, vecs, Best(len(ids), k)
                ids, vecs, best = state[qi]
                c_ids, exact = matrix(ci, cv, dim)
                search_chunk(best, ids, vecs, c_ids, np.frombuffer(codes, dtype=np.uint8).reshape(-1, dim), np.frombuffer(lo).reshape(-1, dim), np.frombuffer(hi).reshape(-1, dim), exact)
        yield from done()

    found = pairs.mapInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

