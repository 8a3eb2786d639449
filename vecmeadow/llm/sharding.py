"""Shards by extendible hashing, with DataFrame operations only.

A document's key is hashed to 60 bits. The directory is indexed by the first
bits of the hash; a bucket that holds more bytes than the limit is split on its
next bit, and no other bucket is. Bytes are summed per prefix of ``DEPTH_STEP``
more bits than an even spread would need; prefixes that are still too large go
on with deeper bits, and only their rows are summed again.

A shard's id is its prefix written in bits ("" for a single shard). A bucket
whose rows all share one hash cannot be split; it stays as it is and ``fits``
is false. Null keys are hashed as the text "null"; a null text has 0 bytes;
repeated rows come back repeated.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecmeadow.session import scratch_table

BITS = 60
DEPTH_STEP = 4
SHARD_BYTES = 1024 * 1024


def hash_bits(key: Column) -> Column:
    """First 60 bits of the MD5 of the key's text, as a long."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null")).cast("binary")), 1, 15), 16, 10).cast("long")


def _prefix(h: Column, depth: Column | int) -> Column:
    depth = F.lit(depth) if isinstance(depth, int) else depth
    return F.call_function("shiftright", h, (F.lit(BITS) - depth).cast("int"))


def _leaves(sums: DataFrame, top: int, deep: int, limit: int) -> DataFrame:
    """(depth, prefix, bytes, rows, fits) of the buckets that stop splitting between ``top`` and ``deep`` bits.

    ``sums`` has one row per prefix of ``deep`` bits, all below too-large buckets of ``top - 1`` bits.
    """
    levels = F.sequence(F.lit(top), F.lit(deep))
    every = (
        sums.select("p", "b", "n", "lo", "hi", F.explode(levels).alias("depth"))
        .withColumn("prefix", F.call_function("shiftright", F.col("p"), (F.lit(deep) - F.col("depth")).cast("int")))
        .groupBy("depth", "prefix")
        .agg(F.sum("b").alias("b"), F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .withColumn("stops", (F.col("b") <= limit) | (F.col("lo") == F.col("hi")))
    )
    parents = every.select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("up"), F.col("stops").alias("up_stops"))
    return (
        every.withColumn("up", F.shiftright("prefix", 1))
        .join(parents, ["depth", "up"], "left")
        .where(~F.coalesce(F.col("up_stops"), F.lit(False)))
        .select("depth", "prefix", "b", "n", "stops")
    )


def assign_shards(
    docs: DataFrame, limit: int = SHARD_BYTES, key_col: str = "doc_id", text_col: str = "text", step: int = DEPTH_STEP
) -> DataFrame:
    """Rows (key, n_bytes, shard, depth, shard_bytes, shard_docs, fits), one per document."""
    spark = docs.sparkSession
    rows_path, leaves_path = scratch_table(spark, "shard-rows"), scratch_table(spark, "shard-leaves")
    docs.select(
        F.col(key_col).alias("key"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
        hash_bits(F.col(key_col)).alias("h"),
    ).write.parquet(rows_path)
    rows = spark.read.parquet(rows_path)
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    deep = min(BITS, step + max(0, math.ceil(math.log2(max(1, total / limit)))))
    top, left = 0, rows
    while True:
        sums = left.groupBy(_prefix(F.col("h"), deep).alias("p")).agg(
            F.sum("n_bytes").alias("b"), F.count("*").alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi")
        )
        found = _leaves(sums, top, deep, limit)
        path = f"{leaves_path}/deep={deep}"
        found.withColumn("stop", F.col("stops") | (F.col("depth") == BITS)).where("stop or depth = %d" % deep).write.parquet(path)
        over = spark.read.parquet(path).where("not stop").select(F.col("prefix").alias("p"))
        if over.isEmpty():
            break
        left = rows.withColumn("p", _prefix(F.col("h"), deep)).join(over, "p", "left_semi")
        top, deep = deep + 1, min(BITS, deep + 2 * step)
    # The directory: each leaf is found by its prefix among the prefixes of a row's hash.
    leaves = spark.read.parquet(leaves_path).where("stop").select("depth", "prefix", "b", "n", "stops")
    depths = [r[0] for r in leaves.select("depth").distinct().collect()]  # at most 61 numbers
    directory = leaves.select(
        "depth", "prefix", F.col("b").alias("shard_bytes"), F.col("n").alias("shard_docs"), (F.col("b") <= limit).alias("fits"),
        F.when(F.col("depth") == 0, "").otherwise(F.lpad(F.bin("prefix"), F.col("depth"), F.lit("0"))).alias("shard"),
    )
    return (
        rows.select("key", "n_bytes", "h", F.explode(F.array(*[F.lit(d) for d in sorted(depths)] or [F.lit(0)])).alias("depth"))
        .withColumn("prefix", _prefix(F.col("h"), F.col("depth")))
        .join(directory, ["depth", "prefix"])
        .select(F.col("key").alias(key_col), "n_bytes", "shard", F.col("depth").cast("long").alias("depth"), "shard_bytes", "shard_docs", "fits")
    )


def write_shards(docs: DataFrame, assigned: DataFrame, path: str, key_col: str = "doc_id") -> None:
    """Write each shard's documents below ``shard=<bits>``; one file per shard, as a shard fits its limit."""
    of = assigned.select(key_col, F.col("shard").alias("shard")).distinct()
    docs.join(of, docs[key_col].eqNullSafe(of[key_col])).drop(of[key_col]).repartition("shard").write.partitionBy("shard").parquet(path)
