"""Token ids on disk: ranks by frequency in byte-aligned codes with separate control bytes.

Ids are replaced by their rank in the corpus, so the most frequent 256 take one byte.
Four ids share a control byte of four 2-bit lengths; the bytes of the ranks follow apart, least
byte first. A reader takes the lengths of all control bytes from a table of 256 rows and
gathers the ranks with numpy. A file is a run of blocks, each readable by itself:

    "RVB1", u32 documents, u64 ids, u64 data bytes, documents x (u8 has an id, i64 id, u32 ids),
    control bytes, data bytes            (all little-endian)
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridian.llm.common import remove, shared_path, written

HEAD = "<4sIQQ"
DOC = np.dtype([("has", "u1"), ("id", "<i8"), ("n", "<u4")])
BLOCK_IDS = 1 << 19
#: Lengths (1 to 4) of the four codes of each control byte.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.int64) + 1
KEPT, KEPT_CHARS = 500_000, 40


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of ranks below 2**32."""
    v = ranks.astype(np.uint32)
    size = 1 + (v > 0xFF) + (v > 0xFFFF) + (v > 0xFFFFFF).astype(np.int64)
    codes = np.zeros((len(v) + 3) // 4 * 4, dtype=np.uint8)
    codes[: len(v)] = size - 1
    control = codes[0::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6
    ends = np.cumsum(size)
    data = np.empty(int(ends[-1]) if len(v) else 0, dtype=np.uint8)
    starts = ends - size
    for k in range(4):
        has = size > k
        data[starts[has] + k] = v[has] >> (8 * k) & 0xFF
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ranks again, by table lookup."""
    size = LENGTHS[np.frombuffer(control, dtype=np.uint8)].ravel()[:n]
    raw = np.frombuffer(data, dtype=np.uint8)
    starts = np.cumsum(size) - size
    v = raw[starts].astype(np.uint32)
    for k in range(1, 4):
        has = np.nonzero(size > k)[0]
        if not len(has):
            break
        v[has] |= raw[starts[has] + k].astype(np.uint32) << (8 * k)
    return v


class Words(dict):
    """Ids of words as bytes, made by the library's model when first asked for; up to KEPT are kept."""

    def __init__(self, model, dtype: str):
        super().__init__()
        self.tokenize, self.dtype = model.tokenize, dtype
        # byte-level form: printable bytes stand for themselves, the others follow from U+0100 on
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = iter(range(0x100, 0x200))
        self.form = {b: b if b in printable else next(rest) for b in range(256)}

    def __missing__(self, word: str) -> bytes:
        tokens = self.tokenize(word.encode().decode("latin-1").translate(self.form))
        ids = np.array([t.id for t in tokens], dtype=self.dtype).tobytes()
        if len(self) < KEPT and len(word) <= KEPT_CHARS:
            self[word] = ids
        return ids


class Encoder:
    """The tokenizers library, with the words of plain Latin text kept in a table.

    A text whose characters are all below U+0180 (but U+0130) is its own NFC form and is lower-cased
    character by character, so its words can be taken one by one; other texts, and those
    that may hold a special token, go to the library whole.
    """

    BEYOND = re.compile("[^\x00-\u012f\u0131-\u017f]")
    LETTERS = "a-zA-Z\xaa\xb5\xba\xdf-\xf6\xf8-\u024f\xc0-\xd6\xd8-\xde"
    NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
    SPACES = "\x09-\x0d\x20\x85\xa0"
    WORD = re.compile(f"[{LETTERS}]+|'(?:[stmd]|re|ve|ll)|[{NUMBERS}]|[^{LETTERS}{NUMBERS}{SPACES}]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        self.dtype = "<u2" if self.size <= 1 << 16 else "<u4"
        self.words = Words(self.library.model, self.dtype)

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if "<|" in text or not text.isascii() and self.BEYOND.search(text):
            return self.whole(text)
        return b"".join(map(self.words.__getitem__, self.WORD.findall(text.lower())))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(docs: DataFrame, path: str, end_id: int | None = 2, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, ids`` of every whole text, ``end_id`` appended; ids are little-endian, 2 bytes each for vocabularies up to 65536, else 4."""

    def run(batches):
        e = encoder(path)
        end = b"" if end_id is None else np.array([end_id], dtype=e.dtype).tobytes()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([e(t.as_py()) + end for t in b.column(1)], pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, ids binary")


def counts(encoded: DataFrame, dtype: str, size: int) -> np.ndarray:
    """How often each id occurs in the corpus: summed per task, then over tasks; as many rows as ids reach the driver."""

    def run(batches):
        total = np.zeros(size, dtype=np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                total += np.bincount(np.frombuffer(b"".join(b.column(0).slice(at, 512).to_pylist()), dtype=dtype), minlength=size)
        seen = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["id", "n"])

    out = np.zeros(size, dtype=np.int64)
    for r in encoded.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r.id] = r.n
    return out


def write(docs: DataFrame, tokenizer: str, path: str, end_id: int | None = 2, parts: int | None = None) -> DataFrame:
    """Tokenize ``docs`` and write the files under ``path``, in ascending doc_id order; returns the blocks' manifest.

    The manifest has ``file, at, bytes, documents, ids, start`` a block, start being the ids before it; parts follow
    each other in doc_id order (null first). The table that turns ranks back into ids is ``path/ranks``.
    Part limits are approximate quantiles of doc_id, so no part grows with a source.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    e = encoder(tokenizer)
    dtype, size = e.dtype, e.size
    at = [i / parts for i in range(1, parts)]
    limits = sorted(set(docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), at or [0.5], 10_000).alias("q")).first().q or []))
    part = F.lit(0) if not limits else F.coalesce(sum((F.col("doc_id") > x).cast("int") for x in limits) if len(limits) < 64 else F.size(F.filter(F.array(*map(F.lit, limits)), lambda x: x < F.col("doc_id"))), F.lit(0))
    rows = encode(docs, tokenizer, end_id).withColumn("part", part).repartitionById(len(limits) + 1, F.col("part").cast("int")).sortWithinPartitions("part", "doc_id", "ids")
    kept, spare = written(rows, "token-ids")
    n = counts(kept, dtype, size)
    order = np.lexsort((np.arange(size), -n)).astype("<u4")
    rank = np.empty(size, dtype=np.uint32)
    rank[order] = np.arange(size, dtype=np.uint32)
    fs, root = pafs.FileSystem.from_uri(path)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/ranks", compression=None) as f:
        f.write(order.tobytes())
    known = spark.sparkContext.broadcast(rank)  # as many numbers as the vocabulary has entries

    def run(batches):
        rank, made = known.value, []
        block, total, part, last, out, name, at = [], 0, None, None, None, "", 0

        def flush():
            nonlocal block, total, out, name, at
            if not block:
                return
            control, data = pack(rank[np.concatenate([ids for _, ids in block])])
            head = np.array([(key[0], key[1], len(ids)) for key, ids in block], dtype=DOC)
            raw = struct.pack(HEAD, b"RVB1", len(block), total, len(data)) + head.tobytes() + control + data
            if out is None:
                fs, root = pafs.FileSystem.from_uri(path)
                name, at = f"{uuid.uuid4().hex}.rvb", 0
                out = fs.open_output_stream(f"{root}/{name}", compression=None)
            out.write(raw)
            made.append((part, *block[0][0], *block[-1][0], f"{path}/{name}", at, len(raw), len(block), total))
            at += len(raw)
            block, total = [], 0

        for b in batches:
            for doc_id, ids, its_part in zip(*(c.to_pylist() for c in b.columns)):
                key = (int(doc_id is not None), doc_id or 0)
                if its_part != part or key < last or total >= BLOCK_IDS:  # a task may read runs of several parts
                    flush()
                    part = its_part
                block.append((key, np.frombuffer(ids, dtype=dtype)))
                total += len(block[-1][1])
                last = key
        flush()
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made]) for i in range(10)], names)

    names = ["part", "first_has", "first", "last_has", "last", "file", "at", "bytes", "documents", "ids"]
    blocks, _ = written(kept.mapInArrow(run, "part long, first_has long, first long, last_has long, last long, file string, at long, bytes long, documents long, ids long"), "token-blocks")
    remove(spark, spare)
    # ids before each block: sums over parts, then within a part
    before = blocks.groupBy("part").agg(F.sum("ids").alias("n")).select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part").orderBy("first_has", "first", "last_has", "last", "file", "at").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("start", F.coalesce(F.sum("ids").over(inside), F.lit(0))).join(before, "part").select("file", "at", "bytes", "documents", "ids", (F.col("start") + F.col("before")).alias("start"))


def read(manifest: DataFrame, path: str) -> DataFrame:
    """``doc_id, start, ids`` of the blocks in ``manifest``: start is the number of ids of all documents before it; ids are unsigned 32-bit."""

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(path)
        order = np.frombuffer(fs.open_input_file(f"{root}/ranks").read(), dtype="<u4")
        for b in batches:
            for file, at, size, start in zip(*(c.to_pylist() for c in b.columns)):
                with fs.open_input_file(pafs.FileSystem.from_uri(file)[1]) as f:
                    f.seek(at)
                    raw = f.read(size)
                magic, n_docs, n_ids, n_data = struct.unpack_from(HEAD, raw)
                if magic != b"RVB1":
                    raise ValueError(f"{file}: no block at {at}")
                docs = np.frombuffer(raw, dtype=DOC, count=n_docs, offset=struct.calcsize(HEAD))
                here = struct.calcsize(HEAD) + docs.nbytes
                data = here + (n_ids + 3) // 4
                ids = order[unpack(raw[here:data], raw[data : data + n_data], n_ids)]
                ends = np.cumsum(docs["n"].astype(np.int64))
                starts = ends - docs["n"]
                yield pa.RecordBatch.from_arrays([pa.array(docs["id"], mask=docs["has"] == 0), pa.array(starts + start), pa.array([ids[s:e].tobytes() for s, e in zip(starts, ends)], pa.binary())], ["doc_id", "start", "ids"])

    places = manifest.select("file", "at", "bytes", "start")
    return places.repartition(max(1, min(manifest.count(), 4 * manifest.sparkSession.sparkContext.defaultParallelism))).mapInArrow(run, "doc_id long, start long, ids binary")


def stored(docs: DataFrame, tokenizer: str, end_id: int | None = 2) -> DataFrame:
    """Write ``docs`` to files in the shared folder and read them back: ``doc_id, start, n_tokens, ids_crc32``.

    Null and empty texts are the end id alone. Repeated rows and doc_ids each keep a row; rows
    without a doc_id come first. An empty table gives no file and no row.
    """
    path = shared_path(docs.sparkSession, "tokens")
    back = read(write(docs, tokenizer, path, end_id), path)
    return back.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
