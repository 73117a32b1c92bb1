"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A sentence's probability is logistic in the words it holds, measured from that of a sentence that says
nothing: what is below FLOOR counts 0, so length alone makes no document toxic. A document's is the noisy-or of
its sentences, 1 - prod(1 - p). Only document labels are learned from, and what is learned
names the sentences that make a document toxic.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.llm.common import cut

SENTENCE = re.compile(r"[^.!?\n。！？]+")
TOKEN = re.compile(r"[^\W_]+")
STEM = 5
#: Documented bound of the fit: so many labelled documents of either class, by hash of doc_id, each whole.
FIT_POSITIVE, FIT_NEGATIVE = 3000, 5000
#: Memory bound of the fit: of either class no further document is taken once those taken have so many characters.
FIT_TOTAL = 8_000_000
#: A sentence of this probability or less says nothing of its document.
FLOOR = 0.1


def sentences(text: str | None) -> list[tuple[int, int]]:
    """Code-point spans between sentence marks and line ends that hold a word."""
    return [m.span() for m in SENTENCE.finditer(text or "") if not m.group().isspace()]


def held_out(doc_id):
    """True where crc32 of the id's text leaves 0 modulo 5; a null id is never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def features(low: str) -> set[str]:
    """The words of a lower-case text, and under ``^`` the first five letters of the longer ones."""
    words = set(TOKEN.findall(low))
    return words | {"^" + w[:STEM] for w in words if len(w) > STEM}


class Model:
    """Weights of the features that matter (all others weigh 0) and the bias of a sentence."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        self.words = frozenset(w for w in weights if w[0] != "^")
        self.stems = frozenset(w[1:] for w in weights if w[0] == "^")
        self.floor = -math.log1p(-FLOOR)

    def logit(self, low: str) -> float:
        return self.bias + sum(self.weights[w] for w in sorted(self.weights.keys() & features(low)))

    def score(self, text: str | None) -> float:
        """Noisy-or over the whole text; 0 for one without sentences."""
        low = (text or "").lower()
        words = set(TOKEN.findall(low))
        if self.bias < 0 and self.words.isdisjoint(words) and self.stems.isdisjoint([w[:STEM] for w in words if len(w) > STEM]):
            return 0.0
        z = [self.logit(s) for s in SENTENCE.findall(low) if not s.isspace()]
        return -math.expm1(-sum(max(0.0, (math.log1p(math.exp(v)) if v < 30 else v) - self.floor) for v in z))

    def located(self, text: str | None, least: float = 0.5) -> list[tuple[int, int, float]]:
        """Spans (code points, end exclusive) of the sentences that score ``least`` or more."""
        out = []
        for a, b in sentences(text):
            p = 1 / (1 + math.exp(-max(self.logit(text[a:b].lower()), -700)))
            if p >= least:
                out.append((a, b, p))
        return out


def fit(docs: list[tuple[str, int]], steps: int = 120, rate: float = 0.3, l1: float = 0.0003, least_docs: int = 3) -> Model:
    """Noisy-or logistic regression by Adam with L1 shrinkage, on (text, label) pairs.

    Features of fewer than ``least_docs`` documents are left out. Without labels of both kinds the
    model scores all at the rate of the labels seen (0 if none).
    """
    labels = np.array([y for _, y in docs], dtype=float)
    if not len(labels) or labels.min() == labels.max():
        return Model({}, 20.0 if len(labels) and labels[0] else -20.0)
    names: dict[str, int] = {}
    cols, rows, of_doc, in_docs = array("l"), array("l"), array("l"), array("l")
    for d, (text, _) in enumerate(docs):
        seen: set[int] = set()
        for s in SENTENCE.findall(text.lower()):
            own = [names.setdefault(w, len(names)) for w in features(s)]
            if own:
                cols.extend(own)
                rows.extend([len(of_doc)] * len(own))
                of_doc.append(d)
                seen.update(own)
        in_docs.extend(seen)
    cols, rows, of_doc = (np.frombuffer(x, dtype=np.int64) if len(x) else np.zeros(0, np.int64) for x in (cols, rows, of_doc))
    often = np.bincount(np.frombuffer(in_docs, dtype=np.int64), minlength=len(names)) >= least_docs if len(in_docs) else np.zeros(0, bool)
    vocab = np.cumsum(often) - 1
    used = often[cols]
    cols, rows = vocab[cols[used]], rows[used]
    names = [w for w, keep in zip(names, often) if keep]
    n_docs, n_sent, n_words = len(docs), len(of_doc), len(names)
    balance = np.where(labels == 1, 0.5 / labels.sum(), 0.5 / (1 - labels).sum())
    x = np.zeros(n_words + 1)  # the last is the bias
    x[-1] = -6.0
    m, v = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, steps + 1):
        z = np.bincount(rows, weights=x[cols], minlength=n_sent) + x[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        none = np.bincount(of_doc, weights=np.logaddexp(0, z), minlength=n_docs)  # -log prod(1 - p)
        whole = np.maximum(-np.expm1(-none), 1e-12)
        per_doc = np.where(labels == 1, -np.exp(-none) / whole, 1.0) * balance
        g_sent = p * per_doc[of_doc]
        g = np.append(np.bincount(cols, weights=g_sent[rows], minlength=n_words), g_sent.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        lr = rate * (1 - step / (steps + 1)) + 0.005
        scale = lr / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        x -= scale * m / (1 - 0.9**step)
        x[:-1] = np.sign(x[:-1]) * np.maximum(0, np.abs(x[:-1]) - scale[:-1] * l1)  # proximal step
    return Model({names[i]: float(x[i]) for i in np.nonzero(np.abs(x[:-1]) > 1.0)[0]}, float(x[-1]))


def train(docs: DataFrame, labels: DataFrame, positives: int = FIT_POSITIVE, negatives: int = FIT_NEGATIVE, total: int = FIT_TOTAL) -> Model:
    """Fit on at most ``positives`` and ``negatives`` labelled documents that are not held out.

    The sample is the least hashes of doc_id, so it is the same on every run; labels other than 0 and 1 and
    null texts are left out. Texts are read whole: where a class has more than ``total`` characters, fewer
    documents of it are taken, in the same order, and never a part of one. So the size bound holds at any input size.
    A row that is repeated counts once.
    """
    known = labels.where("toxic in (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(~held_out("doc_id")).withColumn("at", F.xxhash64("doc_id"))
    ids = [known.where(F.col("toxic") == y).orderBy("at", "doc_id").limit(n) for y, n in ((1, positives), (0, negatives))]
    chosen = F.broadcast(ids[0].union(ids[1]).groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").where("text is not null")
    named = ["at", "doc_id", "h"]
    rows = cut(rows.select("toxic", F.xxhash64("doc_id").alias("at"), "doc_id", F.xxhash64("text").alias("h"), F.length("text").alias("n"), "text"))
    spent, taken = {0: 0, 1: 0}, []
    for r in rows.drop("text").dropDuplicates(named).orderBy(named).limit(positives + negatives).collect():
        if spent[r.toxic] < total:
            taken.append((r.at, r.doc_id, r.h))
            spent[r.toxic] += r.n
    keep = rows.sparkSession.createDataFrame(taken, "at long, doc_id long, h long")
    rows = rows.join(F.broadcast(keep), named, "left_semi").dropDuplicates(named)
    return fit([(r.text, r.toxic) for r in sorted(rows.select("doc_id", "text", "toxic").collect(), key=lambda r: (r.doc_id, r.text))])


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted``, one row a document, from the text alone."""

    def run(batches):
        for b in batches:
            ids = b.column(0)
            score = [model.score(t.as_py()) for t in b.column(1)]
            out = [i.as_py() is None or zlib.crc32(str(i.as_py()).encode()) % 5 == 0 for i in ids]
            yield pa.RecordBatch.from_arrays([ids, pa.array(out, pa.bool_()), pa.array(score, pa.float64()), pa.array([int(s >= 0.5) for s in score], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on ``labels`` and score every whole text.

    Null and empty texts score 0. Repeated rows score alike. A null doc_id counts as held
    out. With an empty table, or no usable labels, training gives a model that scores all 0.
    """
    return scored(docs, train(docs, labels))


def toxic_sentences(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """``doc_id, start, end, score`` of the sentences that offend."""

    def run(batches):
        for b in batches:
            rows = [(i, *x) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for x in model.located(t, least)]
            cols = list(zip(*rows)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.float64())], ["doc_id", "start", "end", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, start long, end long, score double")


def not_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows whose text scores below 0.5, unchanged in all columns."""
    model = train(docs, labels)

    @F.pandas_udf("boolean")
    def clean(text):
        return text.map(lambda t: model.score(t) < 0.5).astype(bool)

    return docs.where(clean(F.col("text")))
