"""Approximate nearest neighbours by balanced posting lists.

Vectors are brought to one length (a component is added that makes inner products and distances
agree), a bounded sample is split in halves until the leaves are small, and the leaves'
means are the centroids. Every vector goes to its nearest centroid's list and, near a
boundary, to further ones. A query finds centroids by walking a graph of them in
memory and searches the lists within a ratio of the nearest one's distance.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridian.llm.blocks import clean, matrix, pack
from meridian.llm.common import cut

#: The fit reads this many vectors at most, by hash of id; lists aim at LIST_ROWS vectors; there are CENTROIDS at most.
SAMPLE, LIST_ROWS, CENTROIDS = 20_000, 200, 4096
REPLICAS, CLOSURE, DEGREE = 2, 1.01, 24
#: The prune ratio is set so that this share of a sample's true neighbours is in the lists searched.
AIM, AIM_QUERIES = 0.93, 400
QUERY_BLOCK, LIST_BLOCK, BUFFER = 256, 2048, 200_000
#: Distances are made so many at a time, so that neither the fit nor a task holds a whole table of them.
AT_ONCE = 500_000


def lift(v: np.ndarray, most: float) -> np.ndarray:
    """Vectors with one more component that brings each to length ``most``: the nearest is then the greatest inner product."""
    rest = np.sqrt(np.maximum(most * most - np.einsum("ij,ij->i", v, v), 0))
    return np.concatenate([v, rest[:, None]], axis=1)


def lift_query(q: np.ndarray, most: float) -> np.ndarray:
    norm = np.maximum(np.linalg.norm(q, axis=1, keepdims=True), np.finfo(float).tiny)
    return np.concatenate([q / norm * most, np.zeros((len(q), 1))], axis=1)


def split(v: np.ndarray, leaf: int, rng) -> list[np.ndarray]:
    """Positions of balanced leaves: halves along the line between two spread-out members, again and again."""
    todo, out = [np.arange(len(v))], []
    while todo:
        at = todo.pop()
        if len(at) <= leaf:
            out.append(at)
            continue
        a = v[at[rng.integers(len(at))]]
        step = max(1, AT_ONCE // v.shape[1])
        shares = [at[s : s + step] for s in range(0, len(at), step)]
        for _ in range(2):
            b, a = a, v[at[np.argmax(np.concatenate([((v[x] - a) ** 2).sum(axis=1) for x in shares]))]]
        order = np.argsort(np.concatenate([v[x] @ (a - b) for x in shares]), kind="stable")
        todo += [at[order[: len(at) // 2]], at[order[len(at) // 2 :]]]
    return out


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0))


def blocks(n: int, width: int):
    """Slices of ``n`` rows whose distances to ``width`` others are AT_ONCE at most, or a row's."""
    step = max(1, AT_ONCE // max(1, width))
    return (slice(s, min(n, s + step)) for s in range(0, n, step))


class Index:
    """Centroids, their graph and the prune ratio: all that a task needs, of bounded size."""

    def __init__(self, sample: np.ndarray, n: int, k: int, most: float):
        rng = np.random.default_rng(7)
        self.most = most
        v = lift(sample, most)
        lists = int(np.clip(-(-n // LIST_ROWS), 1, min(CENTROIDS, max(1, len(v) // 4))))
        leaves = split(v, -(-len(v) // lists), rng)
        self.centroids = np.stack([v[at].mean(axis=0) for at in leaves])
        c = len(self.centroids)
        near = np.concatenate([np.argsort(distances(self.centroids[at], self.centroids), axis=1, kind="stable")[:, 1 : DEGREE + 1] for at in blocks(c, c)])
        edges = [set(r.tolist()) for r in near]
        for i in range(c):  # both ways, and a ring that keeps the graph in one piece
            for j in near[i]:
                edges[j].add(i)
            edges[i].add((i + 1) % c)
        self.graph = [np.array(sorted(e - {i}), dtype=np.int64) for i, e in enumerate(edges)]
        self.ratio = self.calibrate(sample, v, k, rng)

    def calibrate(self, sample: np.ndarray, v: np.ndarray, k: int, rng) -> float:
        at = rng.permutation(len(sample))[:AIM_QUERIES]
        k = min(k, len(sample) - 1)
        if k < 1:
            return 1e9
        rows, lists = self.assign(sample)
        need = []
        for part in blocks(len(at), len(sample)):
            own = at[part]
            truth = sample[own] @ sample.T
            truth[np.arange(len(own)), own] = -np.inf
            d = distances(lift_query(sample[own], self.most), self.centroids)
            least = d.min(axis=1)
            for i in range(len(own)):
                for j in np.argpartition(-truth[i], k - 1)[:k]:
                    need.append(d[i, lists[rows == j]].min() / max(least[i], 1e-12))
        return float(np.quantile(need, AIM)) + 1e-9

    def assign(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list): the nearest centroid, and for a vector near a boundary up to REPLICAS in all, those within CLOSURE of its distance."""
        out_r, out_c = [], []
        for at in blocks(len(vectors), len(self.centroids)):
            d = distances(lift(vectors[at], self.most), self.centroids)
            every, order, near = np.arange(len(d)), [], []
            for _ in range(min(REPLICAS, d.shape[1])):
                order.append(np.argmin(d, axis=1))
                near.append(d[every, order[-1]])
                d[every, order[-1]] = np.inf
            order, near = np.stack(order, axis=1), np.stack(near, axis=1)
            r, c = np.nonzero(near <= CLOSURE * near[:, :1])
            out_r.append(r + at.start)
            out_c.append(order[r, c])
        return np.concatenate(out_r), np.concatenate(out_c)

    def lists(self, q: np.ndarray, least_rows: int, rows: np.ndarray) -> np.ndarray:
        """Centroids within the prune ratio of the nearest, found by best-first steps over the graph.

        Where their lists hold fewer than ``least_rows`` vectors (``rows`` of each list), further lists are
        taken in order of distance until that many may be found; replicas count as what they are, so all are taken if need be.
        """
        c, q = self.centroids, lift_query(q[None], self.most)[0]
        seen = np.zeros(len(c), dtype=bool)
        dist = np.full(len(c), np.inf)
        starts = np.unique(np.linspace(0, len(c) - 1, min(16, len(c))).astype(np.int64))
        heap, least = [], np.inf

        def visit(at):
            nonlocal least
            seen[at] = True
            dist[at] = np.sqrt(((c[at] - q) ** 2).sum(axis=1))
            least = min(least, float(dist[at].min()))
            for i in at.tolist():
                heapq.heappush(heap, (dist[i], i))

        visit(starts)
        steps = 0
        while heap:
            d, i = heapq.heappop(heap)
            steps += 1
            if d > self.ratio * least and steps > 64:
                break
            fresh = self.graph[i][~seen[self.graph[i]]]
            if len(fresh):
                visit(fresh)
        near = np.nonzero(dist <= self.ratio * least)[0]
        if rows[near].sum() >= REPLICAS * least_rows or len(near) == len(c):
            return near
        order = np.argsort(np.sqrt(((c - q) ** 2).sum(axis=1)), kind="stable")
        enough = int(np.searchsorted(np.cumsum(rows[order]), REPLICAS * least_rows)) + 1
        return np.union1d(near, order[:enough])


def fit_rows(usable: DataFrame, n: int) -> DataFrame:
    """``vec`` of the SAMPLE of ``n`` rows that are least by hash of id.

    Only rows whose hash is low are put in order, some twice SAMPLE; where ids repeat so much that too few are low, all are.
    """
    h, rows = F.xxhash64("id"), usable
    if n > 2 * SAMPLE:
        low = usable.where(h < F.lit(-(1 << 63) + int((1 << 64) * (2 * SAMPLE / n))))
        if low.count() >= SAMPLE:
            rows = low
    return rows.orderBy(h, "id").limit(SAMPLE).select("vec")


def search(queries: DataFrame, candidates: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest found by inner product, ties to the smaller id.

    Rows with the query's id are not its candidates. Null, empty and zero vectors, those with
    null or non-finite components and null ids take no part; only vectors of the most
    frequent length are indexed (the least such length on a tie). A repeated query id asks once, by its
    least vector; a repeated candidate id counts once a score. Empty tables give no rows. Every
    vector is indexed; the fit alone is on a sample of SAMPLE vectors. Components of any finite size are taken; a score that
    overflows is infinite, and such ties go to the smaller id.
    """
    spark = queries.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"

    def usable(df: DataFrame) -> DataFrame:
        return clean(df, id_col, vec_col).where(F.exists("vec", lambda x: x != 0))

    all_ = usable(candidates)
    greatest = F.array_max(F.transform("vec", F.abs))
    shape = all_.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n"), F.max(greatest).alias("unit")).orderBy(F.desc("n"), "dim").first()
    if shape is None:
        return spark.createDataFrame([], schema)
    all_ = all_.where(F.size("vec") == shape.dim)
    sample = fit_rows(all_, shape.n).toArrow().column("vec").combine_chunks()  # SAMPLE rows at most, as one array of numbers
    sample = sample.flatten().to_numpy(zero_copy_only=False).reshape(-1, shape.dim)
    # lists are found for vectors over the greatest component, so that no square overflows; scores are of the vectors as they are
    unit, dim = shape.unit, shape.dim
    squares = F.aggregate("vec", F.lit(0.0), lambda s, x: s + (x / F.lit(unit)) * (x / F.lit(unit)))
    most = float(np.sqrt(all_.agg(F.max(squares)).first()[0]))
    index = spark.sparkContext.broadcast(Index(sample / unit, shape.n, k, most))
    del sample

    def vectors(b):
        return b.column(0).to_numpy(), b.column(1).values.to_numpy(zero_copy_only=False)[b.column(1).offsets[0].as_py() :][: b.num_rows * dim].reshape(-1, dim)

    def listed(ids, vec, rows, lists):
        flat = pa.array(np.ascontiguousarray(vec[rows]).ravel())
        return pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * dim, pa.int32()), flat), pa.array(lists.astype(np.int64))], ["id", "vec", "list"])

    def scale(vec):
        """A query's own greatest component: which list is near depends on its direction alone."""
        return np.abs(vec).max(axis=1, keepdims=True)

    def post(batches):
        for b in batches:
            if b.num_rows:
                ids, vec = vectors(b)
                yield listed(ids, vec, *index.value.assign(vec / unit))

    def ask(batches):
        for b in batches:
            if b.num_rows:
                ids, vec = vectors(b)
                found = [index.value.lists(v, k + 1, held.value) for v in vec / scale(vec)]
                yield listed(ids, vec, np.repeat(np.arange(len(ids)), [len(f) for f in found]), np.concatenate(found))

    layout = "id long, vec array<double>, list long"
    postings = cut(all_.mapInArrow(post, layout))
    # a list that holds many copies is dealt out in shares: one count a list, bounded by CENTROIDS, comes to the driver
    sizes = {r.list: r.n for r in postings.groupBy("list").agg(F.count("*").alias("n")).collect()}
    held = spark.sparkContext.broadcast(np.array([sizes.get(i, 0) for i in range(len(index.value.centroids))]))
    shares = F.array(*[F.lit(-(-sizes.get(i, 1) // LIST_BLOCK)) for i in range(len(index.value.centroids))])
    share = F.pmod(F.xxhash64("id", "vec"), F.element_at(shares, (F.col("list") + 1).cast("int"))).cast("long")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lists = pack(postings.withColumn("share", share).repartition(parts, "list", "share").sortWithinPartitions("list", "share"), LIST_BLOCK, ("list", "share"))
    asked = usable(queries).where(F.size("vec") == dim).groupBy("id").agg(F.min("vec").alias("vec"))
    asked = pack(asked.repartition(parts, F.xxhash64("id")).mapInArrow(ask, layout).repartition(parts, "list").sortWithinPartitions("list"), QUERY_BLOCK, ("list",))
    # a query is sent to many lists, which Spark's estimate of ``asked`` leaves out: without the hint it may be broadcast, however large
    pairs = lists.select("list", "ids", "vecs").join(asked.select("list", F.col("ids").alias("q_ids"), F.col("vecs").alias("q_vecs")).hint("merge"), "list")

    def run(batches):
        held, size, limit = [], 0, BUFFER

        def shrink():
            q, v, s = (np.concatenate(c) for c in zip(*held))
            at = best_once(q, v, s, k)
            return q[at], v[at], s[at]

        for b in batches:
            for _, ids, vecs, qi, qv in zip(*(c.to_pylist() for c in b.columns)):
                (c_ids, c), (q_ids, q) = matrix(ids, vecs, dim), matrix(qi, qv, dim)
                rough, once = q @ c.T, len(np.unique(c_ids)) == len(c_ids)
                for i in range(len(q)):
                    own = np.nonzero(c_ids != q_ids[i])[0]
                    if not len(own):
                        continue
                    r = rough[i, own]
                    if len(own) > k and once and np.isfinite(r).all():  # a little below the kth, so that rounding loses none
                        bar = np.partition(r, len(r) - k)[len(r) - k]
                        own = own[r >= bar - 1e-9 * (1 + abs(bar))]
                    s = (c[own] * q[i]).sum(axis=1)  # summed in the same order wherever the vector stands
                    s[np.isnan(s)] = -np.inf  # two overflows of unlike sign
                    at = np.lexsort((c_ids[own], -s))
                    if not once:  # an id counts by its best row
                        at = at[np.sort(np.unique(c_ids[own][at], return_index=True)[1])]
                    at = at[:k]
                    held.append((np.full(len(at), q_ids[i]), c_ids[own][at], s[at]))
                    size += len(at)
                if size > limit:
                    held = [shrink()]
                    size = len(held[0][0])
                    limit = max(BUFFER, 2 * size)
        if held:
            q, v, s = shrink()
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(v), pa.array(s)], ["query_id", "vec_id", "score"])

    found = pairs.mapInArrow(run, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def best_once(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of each query's k best, an id counting once."""
    order = np.lexsort((ids, -score, query))
    q, v = query[order], ids[order]
    same = np.zeros(len(q), dtype=bool)
    same[1:] = (q[1:] == q[:-1]) & (v[1:] == v[:-1])  # copies of a vector have equal scores, so they are neighbours
    order, q = order[~same], q[~same]
    first = np.ones(len(q), dtype=bool)
    first[1:] = q[1:] != q[:-1]
    start = np.maximum.accumulate(np.where(first, np.arange(len(q)), 0))
    return order[np.arange(len(q)) - start < k]
