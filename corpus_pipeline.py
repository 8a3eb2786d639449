"""Corpus pipeline: documents that pass the quality and toxicity models, one of each near-duplicate group, packed."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecmeadow.llm import jaccard_join, packing, quality, queries, toxicity
from vecmeadow.session import scratch_table

SCORE, KEY = "__score", "__key"


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality ranking accepts."""
    model = quality.train(docs, queries.table(spark, sf_dir, "labels"), ~queries.held_out(5, 0))
    scored = quality.score_documents(docs, model, SCORE)
    return scored.where(F.col(SCORE) >= quality.THRESHOLD).drop(SCORE)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity machine does not reject."""
    model = toxicity.train(docs, queries.table(spark, sf_dir, "labels"), ~queries.held_out(3, 1))
    scored = toxicity.score_documents(docs, model, SCORE)
    return scored.where(F.col(SCORE) < toxicity.THRESHOLD).drop(SCORE)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that with the least hash of id and text, its row key.

    Rows that repeat an id with another text, and rows without an id, are documents of their own. Of rows
    that repeat id and text one stays. Documents without words are linked with nothing; each of their keys stays.
    """
    keyed = docs.withColumn(KEY, F.xxhash64("doc_id", "text"))
    found = jaccard_join.near_duplicates(keyed.select(F.col(KEY).alias("doc_id"), "text"))
    kept = found.where("component_id = doc_id").groupBy(F.col("doc_id").alias("__kept")).agg(F.count("*").alias("__rows"))
    rows = keyed.join(kept.hint("shuffle_hash"), F.col(KEY) == F.col("__kept"))
    result = rows.where("__rows = 1").select(*docs.columns)
    if kept.where("__rows > 1").isEmpty():
        return result
    least = F.min_by(F.struct(*docs.columns), F.coalesce("text", F.lit(""))).alias("__row")
    return result.unionByName(rows.where("__rows > 1").groupBy("__kept").agg(least).select("__row.*"))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), pattern=public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_quality),
    ("toxicity", not_toxic),
    ("jaccard_join", one_of_each_group),
    ("packing", pack_documents),
]

# Two stages decide by models that are trained here, so SQL cannot give the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_table(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
