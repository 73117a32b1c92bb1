"""WARC archives of gzip members: a writer and a splittable reader.

The reader cuts files into byte ranges. A task scans its range for the gzip magic, accepts a
place as a member if its first bytes decode to WARC headers, then reads member after
member and owns those that start inside its range.

Files are opened through ``pyarrow.fs`` under the shared folder; a failed or repeated write
attempt leaves a file that no manifest row names, so it is never read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridian.llm.common import shared_path, written

MAGIC = b"\x1f\x8b\x08"
ROLL_BYTES = 256 << 20
SPLIT_BYTES = 16 << 20
WINDOW = 1 << 20
#: Fixed value: the profile of a record that repeats another's payload.
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FIELDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def base32_sha1(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def _name(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _number(urn: str):
    digits = urn.strip("<>").rpartition(":")[2]
    return int(digits) if digits else None


def _one_line(value) -> str:
    return "" if value is None else " ".join(str(value).split())


def record(page_id, url, payload: bytes | None, size: int, digest: str, refers_to=None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One gzip member: a response with its payload, or (payload None) a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if payload is None else 'response'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {date}", f"WARC-Target-URI: {_one_line(url)}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}"]
    if payload is None:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {_name(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def headers(raw: bytes) -> tuple[dict[str, str], int] | None:
    """The fields of a WARC record and where its block starts; None if ``raw`` isn't one's beginning."""
    if not raw.startswith((b"WARC/1.0\r\n", b"WARC/1.1\r\n")):
        return None
    end = raw.find(b"\r\n\r\n")
    if end < 0:
        return None
    lines = raw[:end].decode("utf-8", "replace").split("\r\n")[1:]
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    return (fields, end + 4) if "warc-type" in fields and fields.get("content-length", "").isdigit() else None


def parse(raw: bytes) -> dict:
    """A decoded record as a row; a response's size and digest come from its payload."""
    fields, at = headers(raw)
    block = raw[at : at + int(fields["content-length"])]
    kind, given = fields["warc-type"], fields.get("warc-payload-digest", "").removeprefix("sha1:")
    row = {"page_id": _number(fields.get("warc-record-id", "")), "record_type": kind, "url": fields.get("warc-target-uri"), "refers_to": None}
    if kind == "revisit":
        return row | {"payload_bytes": int(fields["x-payload-length"]), "payload_digest": given, "refers_to": _number(fields.get("warc-refers-to", ""))}
    payload = block[block.index(b"\r\n\r\n") + 4 :]
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    if given and given != digest:
        raise ValueError(f"payload of {fields.get('warc-record-id')} has another digest than its header")
    return row | {"payload_bytes": len(payload), "payload_digest": digest}


class _Input:
    """Bytes of a file by position, read in windows."""

    def __init__(self, path: str):
        fs, at = pafs.FileSystem.from_uri(path)
        self.file, self.start, self.data = fs.open_input_file(at), 0, b""
        self.size = self.file.size()

    def at(self, pos: int, least: int) -> bytes:
        """At least ``least`` bytes from ``pos``, fewer at the file's end."""
        if pos < self.start or pos + least > self.start + len(self.data):
            self.file.seek(pos)
            self.start, self.data = pos, self.file.read(max(least, WINDOW))
        return self.data[pos - self.start :]

    def member(self, pos: int, most: int | None = None) -> tuple[bytes, int] | None:
        """The gzip member at ``pos`` decoded (its first ``most`` bytes) and where it ends; None if there is none."""
        z, out, total = zlib.decompressobj(31), [], 0
        try:
            while not z.eof and pos < self.size:
                chunk = self.at(pos, 1)[:WINDOW]
                got = z.decompress(chunk, most - total if most else 0)
                out.append(got)
                total += len(got)
                pos += len(chunk)
                if most and total >= most:
                    return b"".join(out), pos
        except zlib.error:
            return None
        return (b"".join(out), pos - len(z.unused_data)) if z.eof or most else None


def _begins(f: _Input, pos: int) -> bool:
    """Whether a record's member starts at ``pos``; its headers are decoded to their end, however long they are."""
    most = 65536
    while True:
        began = f.member(pos, most)
        if began is None or not began[0].startswith((b"WARC/1.0\r\n", b"WARC/1.1\r\n")):
            return False
        if b"\r\n\r\n" in began[0] or len(began[0]) < most:
            return headers(began[0]) is not None
        most *= 4


def records(path: str, start: int, end: int):
    """Decoded records whose members start in bytes ``start`` to ``end`` of the file."""
    f, pos = _Input(path), start
    while pos < min(end, f.size):  # the first member of the range
        window = f.at(pos, 4)
        hit = window.find(MAGIC, 0, min(len(window), end - pos + len(MAGIC) - 1))
        if hit < 0:
            pos += max(1, len(window) - len(MAGIC) + 1)
            continue
        pos += hit
        if _begins(f, pos):
            break
        pos += 1
    while pos < min(end, f.size):
        whole = f.member(pos)
        if whole is None:
            raise ValueError(f"{path}: no member at {pos}")
        yield whole[0]
        pos = whole[1]


def write(pages: DataFrame, path: str, least_bytes: int = 0) -> DataFrame:
    """Write every row of ``pages(page_id, url, html)`` as a record under ``path``; returns the manifest ``(file, bytes, records)``.

    Of records with equal payloads of at least ``least_bytes`` the one with the least page_id
    is the response (of repeated ids, the least url's, and one of equal rows) and the rest revisit it. A null
    html is an empty payload; a null page_id comes last and has an empty name; an empty
    table gives no file.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.struct(F.col("page_id").isNull().alias("none"), "page_id", F.col("url").isNull().alias("no_url"), "url").alias("rank"))
    rows = rows.select("*", F.sha1("payload").alias("sha1"), F.length("payload").cast("long").alias("size"), F.pmod(F.xxhash64("page_id", "url"), F.lit(64)).alias("salt"))
    # equal payloads in up to 64 shares: a hot one is never one group, and shares are summed before they meet; all
    # of this follows from a row's own values, so that a task that runs again says the same
    shares = rows.select("sha1", "salt", "rank").groupBy("sha1", "salt").agg(F.min("rank").alias("rank"))
    firsts = shares.groupBy("sha1").agg(F.min("rank").alias("first"), F.collect_set("salt").alias("salts")).select("sha1", "first", F.explode("salts").alias("salt"))
    nth = F.row_number().over(Window.partitionBy("sha1", "salt", "page_id", "url").orderBy("size"))
    rows = rows.join(firsts, ["sha1", "salt"]).withColumn("nth", nth)
    again = (F.col("size") >= least_bytes) & ~(F.col("rank").eqNullSafe(F.col("first")) & (F.col("nth") == 1))
    rows = rows.select("page_id", "url", F.when(~again, F.col("payload")).alias("payload"), "size", "sha1", F.when(again, F.col("first.page_id")).alias("refers_to"))
    stamp = datetime.fromtimestamp(0, timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches):
        out, made = None, []

        def close():
            nonlocal out
            if out:
                out[0].close()
                made.append((out[1], out[2], out[3]))
                out = None

        for b in batches:
            for page_id, url, body, size, sha1, refers_to in zip(*(c for c in b.columns)):
                if out is None:
                    fs, at = pafs.FileSystem.from_uri(path)
                    fs.create_dir(at, recursive=True)
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out = [fs.open_output_stream(f"{at}/{name}", compression=None), f"{path}/{name}", 0, 0]
                data = record(page_id.as_py(), url.as_py(), body.as_py(), size.as_py(), base32_sha1(sha1.as_py()), refers_to.as_py(), stamp)
                out[0].write(data)
                out[2] += len(data)
                out[3] += 1
                if out[2] >= ROLL_BYTES:
                    close()
        close()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made]) for i in range(3)], ["file", "bytes", "records"])

    return written(rows.mapInArrow(run, "file string, bytes long, records long"), "warc-manifest")[0]


def read(manifest: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The records of the archives that ``manifest(file, bytes, records)`` names, by byte ranges of ``split_bytes``.

    The rows are written once, and a file of which another number of records was read than its manifest says is an error.
    """
    ranges = manifest.where("bytes > 0").select("file", "bytes", F.explode(F.sequence(F.lit(0), F.col("bytes") - 1, F.lit(split_bytes))).alias("start"))
    n = ranges.count()
    names = [x.split()[0] for x in FIELDS.split(", ")]

    def run(batches):
        for b in batches:
            for file, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = []
                for raw in records(file, start, start + split_bytes):
                    rows.append(parse(raw) | {"file": file})
                    if len(rows) == 4096:
                        yield pa.RecordBatch.from_pylist(rows, schema=SCHEMA)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=SCHEMA)

    layout = ", ".join(f"{c} {FIELDS.split(', ')[i].split()[1]}" for i, c in enumerate(names)) + ", file string"
    rows, _ = written(ranges.select("file", "start").repartition(max(1, min(n, 20_000))).mapInArrow(run, layout), "warc-rows")
    counted = rows.groupBy("file").agg(F.count("*").alias("n"))
    wrong = manifest.join(counted, "file", "left").where(F.coalesce("n", F.lit(0)) != F.col("records")).select("file", "records", "n").first()
    if wrong:
        raise ValueError(f"{wrong.file}: {wrong.n or 0} records read, {wrong.records} written")
    return rows.drop("file")


SCHEMA = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("file", pa.string())])


def archived(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back, one row a page."""
    return read(write(pages, shared_path(pages.sparkSession, "warc"), least_bytes))
