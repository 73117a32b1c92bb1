"""SimHash near-duplicates: fingerprints of word shingles, linked within a few bits.

64 bits are three segments of 22, 21 and 21 bits. Four errors over three segments leave
either one segment without error, or two segments with one error each at most
(1+1+1 or 1+1+2). The first kind meets in buckets of equal segments; the second meets under
the Golay keys of two segments (``golay.py``). All candidates are verified on 64 bits.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.llm import golay
from meridian.llm.common import cut, hamming
from meridian.llm.components import connected_components

SEED = 42
#: (shift, bits) of the three segments.
SEGMENTS = ((42, 22), (21, 21), (0, 21))
#: Buckets up to this size are joined with themselves; larger ones are searched block by block.
SMALL_BUCKET = 16
BLOCK = 2048


def fingerprint(text: str | None, words: int = 4) -> int:
    """SimHash of the shingles of ``words`` words, repeats counted; 0 for a text without words."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and \x20\x09-\x0D only
    if not w:
        return 0
    line = b" ".join(w)
    ends = list(accumulate(map(len, w), lambda a, n: a + n + 1))  # end of each word in line
    digest = xxhash.xxh64_intdigest
    if len(w) < words:
        h = [digest(line, SEED)]
    else:
        starts = [0, *(e + 1 for e in ends[:-1])]
        h = [digest(line[s:e], SEED) for s, e in zip(starts, ends[words - 1 :])]
    bits = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 65536):
        part = np.array(h[at : at + 65536], dtype=np.uint64)
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 4) -> DataFrame:
    """``(doc_id, fp long)`` of every whole text; fp holds the 64 bits as a signed number."""

    def run(batches):
        for b in batches:
            f = np.array([fingerprint(t.as_py(), words) for t in b.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(f.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, fp long")


def _forest(fps: np.ndarray, other: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Edges that span the components of ``fps`` and ``other``, at most ``bits`` apart.

    Breadth-first: what is reached leaves the pool, so a dense cluster is scanned once.
    """
    pool, edges = np.unique(np.concatenate([fps, other])), []
    while len(pool):
        queue, pool = [pool[0]], pool[1:]
        while queue and len(pool):
            at = queue.pop()
            near = np.bitwise_count(pool ^ at) <= bits
            if near.any():
                found = pool[near]
                pool = pool[~near]
                edges += [(int(at), int(x)) for x in found.view(np.int64)]
                queue += list(found)
    return [(int(np.uint64(a).astype(np.int64)), b) for a, b in edges]


def _links_in_segments(fps: DataFrame, bits: int) -> DataFrame:
    """Edges among fingerprints that agree in a whole segment."""
    u = F.col("fp")
    segs = F.array(*[F.struct(F.lit(i).alias("seg"), F.shiftrightunsigned(u, s).bitwiseAND((1 << n) - 1).alias("val")) for i, (s, n) in enumerate(SEGMENTS)])
    rows = fps.select("fp", F.explode(segs).alias("k")).select("fp", "k.seg", "k.val")
    full = rows.groupBy("seg", "val").count().where("count > 1")
    rows = cut(rows.join(full, ["seg", "val"]))
    a, b = (rows.where(F.col("count") <= SMALL_BUCKET).select("seg", "val", F.col("fp").alias(x)) for x in "ab")
    small = a.join(b, ["seg", "val"]).where((F.col("a") < F.col("b")) & (hamming(F.col("a"), F.col("b")) <= bits)).select("a", "b")
    blocks = F.ceil(F.col("count") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    big = rows.where(F.col("count") > SMALL_BUCKET).withColumn("mine", mine).withColumn("i", F.explode(F.sequence(F.lit(0), blocks - 1)))
    big = big.select("seg", "val", F.least("mine", "i").alias("lo"), F.greatest("mine", "i").alias("hi"), "fp")

    def spans(key, table):
        f = table.column("fp").to_numpy().view(np.uint64)
        edges = _forest(f, f[:0], bits)
        return pa.table({"a": pa.array([x for x, _ in edges], pa.int64()), "b": pa.array([x for _, x in edges], pa.int64())})

    return small.union(big.groupBy("seg", "val", "lo", "hi").applyInArrow(spans, "a long, b long"))


def _golay_keys(batches, probe: bool):
    """Rows (key, fp, comp): two segments' codeword indices and the pair's number in one key."""
    for b in batches:
        fp, comp = b.column(0).to_numpy(), b.column(1).to_numpy()
        words = [(fp.view(np.uint64) >> np.uint64(s) & np.uint64((1 << n) - 1)).astype(np.int64) for s, n in SEGMENTS]
        for at in range(0, len(fp), 4096):
            cutw = [w[at : at + 4096] for w in words]
            for pair, (p, q) in enumerate(((0, 1), (0, 2), (1, 2))):
                if not probe:
                    rows, key = np.arange(len(cutw[0])), golay.nearest(cutw[p]) << 12 | golay.nearest(cutw[q])
                else:
                    (rp, kp), (rq, kq) = golay.around_distinct(cutw[p]), golay.around_distinct(cutw[q])
                    first, n = np.searchsorted(rq, np.arange(len(cutw[0]) + 1)), np.bincount(rq, minlength=len(cutw[0]))
                    times = n[rp]
                    rows = np.repeat(rp, times)
                    inner = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    key = np.repeat(kp, times) << 12 | kq[first[rows] + inner]
                yield pa.RecordBatch.from_arrays([pa.array(key | pair << 24), pa.array(fp[at + rows]), pa.array(comp[at + rows])], ["key", "fp", "comp"])


def _links_across(fps: DataFrame, bits: int) -> DataFrame:
    """Edges between components so far, by Golay keys of two segments with one error each at most."""
    schema = "key long, fp long, comp long"
    index = fps.select("fp", "comp").mapInArrow(lambda it: _golay_keys(it, False), schema)
    probe = fps.select("fp", "comp").mapInArrow(lambda it: _golay_keys(it, True), schema)
    i, p = index.alias("i"), probe.alias("p")
    near = (F.col("i.key") == F.col("p.key")) & (F.col("i.comp") < F.col("p.comp")) & (hamming(F.col("i.fp"), F.col("p.fp")) <= bits)
    both = (F.col("i.key") == F.col("p.key")) & (F.col("i.comp") > F.col("p.comp")) & (hamming(F.col("i.fp"), F.col("p.fp")) <= bits)
    return i.join(p, near | both).select(F.col("i.comp").alias("a"), F.col("p.comp").alias("b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 4, bits: int = 4) -> DataFrame:
    """One row a document: ``doc_id, fingerprint, component_id``.

    Equal fingerprints are one node; nodes link at ``bits`` (up to 4) or fewer differing
    bits, and component_id is the least doc_id of the node's component. No pairs within a group
    are listed: buckets of more than SMALL_BUCKET nodes yield spanning edges only, found
    block against block. Null and empty texts have fingerprint 0 and link like any other. Rows with a
    null doc_id take part and get a component id; a component of such rows only has null. Repeated rows each
    give a row. An empty table gives an empty one.
    """
    if not 0 <= bits <= 4:
        raise ValueError("three segments find up to 4 differing bits")
    rows = cut(fingerprints(docs, id_col, text, words))
    # equal fingerprints in 32 salted shares first, so that a hot one is never one group
    shares = cut(rows.groupBy("fp", F.pmod(F.xxhash64("doc_id"), F.lit(32)).alias("salt")).agg(F.min("doc_id").alias("least")))
    nodes = cut(shares.groupBy("fp").agg(F.min("least").alias("least")))
    first = connected_components(_links_in_segments(nodes.select("fp"), bits))
    nodes = cut(nodes.join(first, nodes.fp == first.v, "left").select("fp", "least", F.coalesce("label", "fp").alias("comp")))
    second = connected_components(_links_across(nodes, bits))
    nodes = nodes.join(second, nodes.comp == second.v, "left").select("fp", "least", F.coalesce("label", "comp").alias("comp"))
    ids = nodes.groupBy("comp").agg(F.min("least").alias("component_id"))
    known = shares.select("fp", "salt").join(nodes.select("fp", "comp"), "fp").join(ids, "comp").select("fp", "salt", "component_id")
    out = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(32))).join(known, ["fp", "salt"])
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """Documents without near-copies: of each component the row with the least doc_id stays, with its own columns.

    Of rows that repeat that doc_id one stays. Rows with a null doc_id can't be named and stay.
    """
    best = near_duplicates(docs, **how).select(F.col("component_id").alias("doc_id")).distinct()
    return docs.join(best, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(docs.columns).union(docs.where("doc_id is null"))
