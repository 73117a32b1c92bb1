"""SentencePiece BPE by a prefix table, and its decoding.

For every prefix of a text BPE ends in one certain token. The table stores that token for each
prefix: an automaton gives the pieces that end there, and the one is right whose left
neighbour, the token stored where it starts, forms a pair with it that BPE leaves as it is. Ids
are then recovered from the end backwards. A pair is compatible if merging its own characters
gives the two pieces again. No piece spans two neighbouring characters that are neighbours in no piece, so
a text is cut at such places (before a space mark, a line end, most punctuation) and
frequent cuts are kept in a table.
"""

from __future__ import annotations

import heapq
import re
import string
import struct
from collections import ChainMap
from functools import lru_cache
from hashlib import sha256

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Cuts kept by a worker, and the longest that is kept.
KEPT, KEPT_CHARS = 500_000, 40
KEPT_PAIRS = 500_000
NEVER = float("-inf")
#: Texts of more characters are merged with a heap.
LONG = 64


class Bpe:
    """Encoder and decoder of one BPE model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)  # read for its vocabulary only
        n = model.vocab_size()
        self.bos, self.eos = model.bos_id(), model.eos_id()
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        special = {i for i in range(n) if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)}
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in special}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece holds a space mark after another character")
        # characters that follow, within any piece, only a mark or one of themselves: a text is cut before their runs
        apart = {c for c in string.punctuation + "\n\t" if c != MARK}
        before = {(p[i - 1], p[i]) for p in self.ids for i in range(1, len(p))}
        while lost := {b for a, b in before if b in apart and a != MARK and a not in apart}:
            apart -= lost
        own = "".join(map(re.escape, sorted(apart)))
        self.cuts = re.compile(f"{MARK}*[^{MARK}{own}]+|{MARK}*[{own}]+[^{MARK}{own}]*|{MARK}+" if own else f"{MARK}*[^{MARK}]+|{MARK}+").findall
        self.score = {p: model.get_score(i) for p, i in self.ids.items()}
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.kept: dict[str, bytes] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        # decoding: each id's text, or its byte
        byte = {i: bytes([b]) for b, i in enumerate(self.byte_ids)}
        self.out = [byte[i] if i in byte else b"" if i in special else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]

    def merged(self, text: str) -> list[str]:
        """Plain BPE: merge the best-scored neighbouring pair, the leftmost of equals, until none is left."""
        if len(text) > LONG:
            return self._merged_long(text)
        s, score = list(text), self.score.get
        pairs = [score(a + b, NEVER) for a, b in zip(s, s[1:])]
        while pairs and (best := max(pairs)) > NEVER:
            i = pairs.index(best)
            s[i : i + 2] = [s[i] + s[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = score(s[i - 1] + s[i], NEVER)
            if i < len(pairs):
                pairs[i] = score(s[i] + s[i + 1], NEVER)
        return s

    def _merged_long(self, text: str) -> list[str]:
        """``merged`` with a heap of pairs, so that a run of n marks takes n log n steps."""
        n, score = len(text), self.score.get
        piece: list[str | None] = list(text)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(-s, i, text[i : i + 2]) for i in range(n - 1) if (s := score(text[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, both = heapq.heappop(heap)
            j = after[i]
            if piece[i] is None or j >= n or piece[i] + piece[j] != both:
                continue  # one of the two was merged otherwise since
            piece[i], piece[j], after[i] = both, None, after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (s := score(piece[a] + piece[b])) is not None:
                    heapq.heappush(heap, (-s, a, piece[a] + piece[b]))
        return [p for p in piece if p is not None]

    def compatible(self, left: str, right: str) -> bool:
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            known = self.pairs[left, right] = left + right not in self.ids and self.merged(left + right) == [left, right]
        return known

    def prefix_table(self, text: str) -> list[str]:
        """The last token of BPE on each prefix; a character outside the vocabulary is a token of its own."""
        last: list[str | None] = [None] * len(text)
        pairs, compatible = self.pairs, self.compatible
        for end, piece in self.automaton.iter(text):  # by end, the longest first
            if last[end] is None:
                at = end - len(piece)
                left = last[at] if at >= 0 else None  # None: the text's start, or a character outside the vocabulary
                if left is None or pairs.get((left, piece)) or (left, piece) not in pairs and compatible(left, piece):
                    last[end] = piece
        return [t or text[i] for i, t in enumerate(last)]

    def tokens(self, cut: str) -> list[str]:
        if cut[:2] == MARK * 2:  # runs of marks share one score, which makes ties: plain merging decides
            run = len(cut) - len(cut.lstrip(MARK))
            if run == len(cut) or len(cut) <= 64:
                return self.merged(cut)
            body = self.tokens(cut[run - 1 :])
            if body[0] != MARK:  # the last mark belongs to the word
                return self.merged(cut[: run - 1]) + body
            return self.merged(cut[:run]) + body[1:]
        last, out, i = self.prefix_table(cut), [], len(cut)
        while i:
            out.append(last[i - 1])
            i -= len(last[i - 1])
        return out[::-1]

    def encoded(self, cut: str) -> bytes:
        """Ids of one cut as little-endian unsigned 32-bit integers."""
        got = []
        for t in self.tokens(cut):
            i = self.ids.get(t)
            if i is None:
                got += [self.byte_ids[b] for b in t.encode("utf-8", "surrogatepass")]
            else:
                got.append(i)
        return struct.pack(f"<{len(got)}I", *got)

    def __call__(self, text: str | None) -> bytes:
        """Ids of a text, begin and end included, as little-endian unsigned 32-bit integers."""
        begin, end = (i.to_bytes(4, "little") for i in (self.bos, self.eos))
        if not text:
            return begin + end
        cuts, known = self.cuts(MARK + text.replace(" ", MARK)), self.kept
        if fresh := set(cuts).difference(known):
            new = {c: self.encoded(c) for c in fresh}
            if len(known) + len(new) <= KEPT:
                known.update((c, i) for c, i in new.items() if len(c) <= KEPT_CHARS)
            if len(new) and not known.keys() >= fresh:
                known = ChainMap(new, known) if len(cuts) < 64 else {c: new.get(c) or known[c] for c in set(cuts)}
        return begin + b"".join(map(known.__getitem__, cuts)) + end

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids: pieces and bytes joined, without the space that encoding puts in front; invalid UTF-8 becomes U+FFFD."""
        out = self.out
        raw = b"".join(map(out.__getitem__, ids.tolist()))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def bpe(path: str) -> Bpe:
    return Bpe(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, ids``: every whole text's ids as one binary of little-endian unsigned 32-bit integers.

    Null and empty texts give the begin and end ids. Repeated rows each give a row; an empty
    table gives none. ``path`` must be readable on every executor.
    """

    def run(batches):
        encoder = bpe(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([encoder(t.as_py()) for t in b.column(1)], pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encode``'s rows with the decoded ``text``; null ids give null."""

    def run(batches):
        decoder = bpe(path)
        for b in batches:
            texts = [None if (i := x.as_py()) is None else decoder.decode(np.frombuffer(i, dtype="<u4")) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: the encoder, then the decoder on its ids, in one pass over the rows."""

    def run(batches):
        model = bpe(path)
        for b in batches:
            n, of_ids, of_text = [], [], []
            for t in b.column(1):
                ids = model(t.as_py())
                n.append(len(ids) // 4)
                of_ids.append(sha256(ids).hexdigest())
                of_text.append(sha256(model.decode(np.frombuffer(ids, dtype="<u4")).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(of_ids), pa.array(of_text)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
