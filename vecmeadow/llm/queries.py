"""Queries of the numbered operators over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecmeadow.llm import (
    byte_pairs,
    fill_middle,
    fingerprints,
    jaccard_join,
    packing,
    pq_dedup,
    quality,
    sentencepieces,
    sharding,
    spelling,
    token_counts,
    toxicity,
    url_filter,
)
from vecmeadow.session import scratch_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents through a digest cache that starts empty."""
    counted = token_counts.count_tokens(
        table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), scratch_table(spark, "token-cache")
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > 2048)


@query
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by four rules and, beyond them, by its host's path templates."""
    rules = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), rules)


@query
def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded into pieces and decoded again."""
    return sentencepieces.summarise_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def held_out(modulus: int, rest: int) -> Column:
    """Whether the checksum of the id, as text, leaves ``rest``; not so for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == rest, F.lit(False))


def quality_model(spark: SparkSession, sf_dir: str) -> quality.Ranking:
    return quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out(5, 0))


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Machine:
    return toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out(3, 1))


@query
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score_documents(docs, quality_model(spark, sf_dir))
    return scored.select(
        "doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted")
    )


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score_documents(docs, toxicity_model(spark, sf_dir))
    return scored.select(
        "doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted")
    )


@query
def op5_pq_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of all embeddings with a cosine of 0.95 or more, by product quantisation."""
    return pq_dedup.linked_vectors(table(spark, sf_dir, "embeddings"))


@query
def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of four-word shingles have a Jaccard similarity of 0.85 or more."""
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=85)


@query
def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


@query
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 2048 tokens."""
    return packing.pack(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), pattern=public_tokenizers.PATTERN
    )


@query
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents dealt into shards of at most 1 MiB of text."""
    return sharding.assign_shards(table(spark, sf_dir, "documents"))


ORACLES["op9_sharding"] = """
WITH hashed AS (
  SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS h
  FROM documents),
at_depth AS (SELECT *, d AS depth, h >> (60 - d) AS prefix FROM hashed, (SELECT unnest(range(0, 61)) AS d)),
buckets AS (
  SELECT depth, prefix, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes, count(*) AS shard_docs,
    sum(n_bytes) <= 1048576 OR min(h) = max(h) AS stops
  FROM at_depth GROUP BY depth, prefix),
placed AS (
  SELECT doc_id, n_bytes, min(depth) AS depth
  FROM at_depth JOIN buckets USING (depth, prefix) WHERE stops GROUP BY doc_id, n_bytes, h)
SELECT p.doc_id, CAST(p.n_bytes AS BIGINT) AS n_bytes, CAST(p.depth AS BIGINT) AS depth,
  CASE WHEN p.depth = 0 THEN '' ELSE right(repeat('0', 60) || bin(b.prefix), CAST(p.depth AS INTEGER)) END AS shard,
  b.shard_bytes, b.shard_docs, b.shard_bytes <= 1048576 AS fits
FROM placed p JOIN at_depth a ON a.doc_id = p.doc_id AND a.depth = p.depth
JOIN buckets b ON b.depth = a.depth AND b.prefix = a.prefix"""


@query
def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with the frequent word that each may be a spelling of; every 199th run by checksum has lost a letter."""
    return spelling.group_spellings(table(spark, sf_dir, "documents"), slip=199)


@query
def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents cut at line ends into prefix, middle and suffix, put together in another order and turned back."""
    moved = fill_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    back = fill_middle.restored(F.col("form"), F.col("output"))
    return moved.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"),
    )


ORACLES["op12_fill_middle"] = """
WITH hashed AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
counted AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS parts,
    length(text) - length(replace(text, chr(10), '')) + CASE WHEN text = '' OR suffix(text, chr(10)) THEN 0 ELSE 1 END AS n,
    CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
  FROM hashed),
chosen AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
      WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM counted),
heads AS (
  SELECT *, CASE WHEN a = n THEN text WHEN a = 0 THEN '' ELSE array_to_string(parts[1:a], chr(10)) || chr(10) END AS head,
    CASE WHEN b = n THEN text WHEN b = 0 THEN '' ELSE array_to_string(parts[1:b], chr(10)) || chr(10) END AS upto
  FROM chosen),
cut AS (
  SELECT *, length(head) AS p, length(upto) - length(head) AS m FROM heads),
built AS (
  SELECT *, CASE form WHEN 'plain' THEN text
    WHEN 'psm' THEN '<P>' || head || '<S>' || substr(text, p + m + 1) || '<M>' || substr(text, p + 1, m)
    ELSE '<S>' || substr(text, p + m + 1) || '<P>' || head || '<M>' || substr(text, p + 1, m) END AS output
  FROM cut)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(p AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(m AS BIGINT) END AS middle_chars, sha256(output) AS output_sha256, sha256(text) AS restored_sha256
FROM built"""


@query
def op13_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded by merge ranks and decoded again."""
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = byte_pairs.encode_documents(table(spark, sf_dir, "documents"), ranks, pattern)
    decoded = byte_pairs.decode_documents(encoded, ranks, pattern)
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
