"""A training-corpus pipeline of five stages; each reads what the one before it kept.

Every function takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes each
stage's rows as Parquet in the shared folder and reads them again as the next one's documents.

In every stage null and empty texts, texts of any length, repeated rows and further columns, whatever their names, are
allowed, and an empty table gives an empty one; all but the last return the columns of the documents they got. What else a stage does
with such rows is said at it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meridian.llm import line_dedup, mixing, sentencepiece_bpe, simhash, toxicity
from meridian.llm.common import table, written
from meridian.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go. Null and empty texts score 0 and stay; repeated rows score alike; without usable labels all stay."""
    return toxicity.not_toxic(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal or similar lines the first stays, by doc_id (null last); every document stays, if need be without a line. Null texts stay null, blank lines stay, rows with equal doc_id and text lose the same lines."""
    return line_dedup.without_repeated_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least doc_id stays; copies are op9_simhash's, of four bits at most. Texts without words are copies of each other; of rows that repeat the doc_id one stays; rows without doc_id all stay."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source is cut or repeated to its budget of words, in whole documents. A null source is one of its own; documents without words stay once; repeated rows are taken alike."""
    return mixing.mixed_documents(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document of the mix, after a round trip through the ids. Null and empty texts have the begin and end ids only."""
    return sentencepiece_bpe.round_trip(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode_texts),
]

#: Stages with a trained model, MinHash and union-find have no SQL form; a test holds run() against the stages written plainly, all pairs compared.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs, _ = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
