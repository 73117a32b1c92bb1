"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meridian.llm.common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten highest integer inner products of every 100th vector, against all."""
    from meridian.llm import va_file

    vectors = table(spark, sf_dir, "embeddings")
    return va_file.top_k(vectors.where("vec_id % 100 = 0"), vectors, 10)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meridian.llm import secrets

    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meridian.llm import warc

    return warc.archived(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meridian.llm import sentencepiece_bpe

    return sentencepiece_bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meridian.llm import token_store

    return token_store.stored(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2)


def op6_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty nearest by inner product of every 20th vector, by posting lists."""
    from meridian.llm import posting_lists

    vectors = table(spark, sf_dir, "embeddings")
    return posting_lists.search(vectors.where("vec_id % 20 = 0"), vectors, 20)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meridian.llm import mixing

    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meridian.llm import line_dedup

    return line_dedup.decisions(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meridian.llm import simhash

    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meridian.llm import toxicity

    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_exact_top_k, op2_secrets, op3_warc, op4_sentencepiece, op5_token_store, op6_posting_lists, op7_mixing, op8_line_dedup, op9_simhash, op10_toxicity)}

ORACLE = {
    "op1_exact_top_k": """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * cast(x as double))) as e from embeddings
  where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.e, c.e) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 100 = 0),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 10""",
    "op3_warc": """
with p as (select page_id, coalesce(html, '') as h, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as x from pages),
r as (select *, min(page_id) over (partition by x) as first_id from p)
select page_id, payload_bytes::bigint as payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(x, 1 + 5 * (i // 4), 5))::bigint >> (15 - 5 * (i % 4))::int) & 31))::int, 1)), '') as payload_digest,
  case when page_id = first_id then 'response' else 'revisit' end as record_type, case when page_id <> first_id then first_id end as refers_to from r""",
    "op7_mixing": r"""
with d as (
  select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size,
         md5('mix:' || coalesce(cast(doc_id as varchar), '')) as key from documents),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
w as (
  select *, 2.0::double * source_size as most,
         (list_value(5.0::double, 2.0::double, 1.0::double))[1 + (row_number() over (order by source is null, source) - 1) % 3] as w from s),
l as (
  select *, greatest(0.0::double, 1.5::double * sum(source_size) over () - coalesce(sum(most) over (order by most / w, source is null, source rows between unbounded preceding and 1 preceding), 0.0::double))
            / sum(w) over (order by most / w, source is null, source rows between current row and unbounded following) as level from w),
t as (
  select source, source_size, coalesce(least(w * first_value(case when w * level <= most then level end ignore nulls) over (order by most / w, source is null, source rows between unbounded preceding and current row), most), most) as target from l),
c as (
  select d.*, source_size, target, floor(target) as budget,
         coalesce(sum(size) over (partition by d.source order by key, doc_id, size rows between unbounded preceding and 1 preceding), 0) as ahead
  from d join t on d.source is not distinct from t.source),
e as (select *, case when source_size > 0 then floor(budget / source_size) else 0 end as epochs from c)
select doc_id, size, source_size, target, cast(epochs * size + greatest(0, least(size, budget - epochs * source_size - ahead)) as bigint) as taken from e""",
}
