"""Token counts through a digest cache.

A count is stored under the digest of the normalised text and the digest of the
tokenizer file. A run joins the digests of its documents to the cache, encodes
one copy of each text that is not there, and appends those counts.

Nulls: a null text counts as the empty text and has 0 tokens; rows with a null
or repeated id all come back. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecmeadow.llm import worker
from vecmeadow.session import scratch_table

CACHE_SCHEMA = "content binary, n_tokens long, tokenizer string"
ENCODED = "content binary, n_tokens long"


def tokenizer_digest(path: str) -> str:
    """Version of a tokenizer: digest of its file."""
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


def content_digest(text: Column) -> Column:
    """Digest of the text with runs of white space made one space.

    The tokenizer drops white space, so texts with equal digests have equal
    counts. Letter case stays: strings of special tokens depend on it.
    """
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "), 256))


def open_cache(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """Stored counts of one tokenizer version; a cache that does not exist yet is empty."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], ENCODED)
    stored = spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer") == version)
    return stored.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_bytes, n_tokens), one per document; ``cache`` is a folder that all executors see and grows by the misses."""
    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer)
    digested = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("content", content_digest(F.col("text")))
    keys_path = scratch_table(spark, "token-keys")
    digested.select(
        "id", "content", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    ).write.parquet(keys_path)
    keys = spark.read.parquet(keys_path)

    # One id per distinct text; map-side partial minima keep a hot text to one row per task.
    misses = keys.groupBy("content").agg(F.min("id").alias("id")).join(open_cache(spark, cache, version), "content", "left_anti")
    wanted = misses.select(F.col("id").alias("want_id"), F.col("content").alias("want")).hint("shuffle_hash")
    texts = digested.join(wanted, F.col("id").eqNullSafe(F.col("want_id")) & (F.col("content") == F.col("want")), "left_semi")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = worker.encoder(tokenizer, counts=True)
        for block in worker.blocks(batches):
            counts = tool.encode([t or "" for t in block.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(counts, pa.int64())], ["content", "n_tokens"])

    fresh = texts.select("content", "text").mapInArrow(encode, ENCODED).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    fresh.withColumn("tokenizer", F.lit(version)).write.mode("append").partitionBy("tokenizer").parquet(cache)
    # The counts are written first, so that the last join stands alone and a hot text's partition can be split.
    counts_path = scratch_table(spark, "token-counts")
    open_cache(spark, cache, version).join(keys.select("content").distinct(), "content", "left_semi").write.parquet(counts_path)
    counts = spark.read.parquet(counts_path)
    return keys.join(counts, "content").select(F.col("id").alias(id_col), "n_bytes", "n_tokens")
