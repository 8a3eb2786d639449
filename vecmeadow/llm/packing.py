"""Packing of token sequences by best-fit decreasing.

Each text becomes its ids and an end id. A document over the window is first cut
into full windows. What is left of every document is dealt by hash into groups
of bounded size; in a group the pieces are placed from the longest to the
shortest, each into the open window with the least room that holds it. A segment
tree over the remaining capacities finds that window in logarithmic time.

A null text is the empty text (its only id is the end id). Rows with null or
repeated ids are packed like any other; pieces of equal length go by id, start
and checksum, so a result does not depend on row order.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecmeadow.llm import worker
from vecmeadow.session import scratch_table

WINDOW = 2048
END_ID = 1
# Pieces in one group: enough that the last, half-empty windows of a group do not count, and a few MB in memory.
GROUP_PIECES = 32_768
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PLACED = PIECES + ", sequence_id long, offset long"


class CapacityTree:
    """Open windows by remaining capacity; a node counts the windows below it."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, capacity: int, by: int) -> None:
        node = self.leaves + capacity
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, capacity: int, window_id: int) -> None:
        self.open[capacity].append(window_id)
        self._add(capacity, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(capacity, window) with the least capacity of at least ``need``, removed from the tree."""
        node = self.leaves + need
        if not self.count[node]:
            # Up to the first ancestor with a window to the right, then down to its leftmost one.
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        self._add(capacity, -1)
        return capacity, self.open[capacity].pop()


def best_fit(lengths: list[int], window: int = WINDOW) -> tuple[list[int], list[int]]:
    """Window number and offset of each piece; ``lengths`` come longest first."""
    tree, where, offsets, opened = CapacityTree(window), [], [], 0
    for length in lengths:
        found = tree.take(length)
        capacity, at = found or (window, opened)
        opened += found is None
        where.append(at)
        offsets.append(window - capacity)
        if capacity > length:
            tree.put(capacity - length, at)
    return where, offsets


def cut_pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, pattern: str | None = None) -> DataFrame:
    """Pieces of all documents: full windows from the start, then the rest."""
    end = struct.pack("<I", end_id)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = worker.encoder(tokenizer, counts=False, pattern=pattern)
        for block in worker.blocks(batches):
            found = []
            for doc_id, ids in zip(block.column(0).to_pylist(), tool.encode([t or "" for t in block.column(1).to_pylist()])):
                ids += end
                total = len(ids) // 4
                for start in range(0, total, window):
                    piece = ids[4 * start : 4 * (start + window)]
                    found.append((doc_id, start, len(piece) // 4, zlib.crc32(piece), total))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in zip(*found)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


def pack(
    docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, group_pieces: int = GROUP_PIECES, pattern: str | None = None
) -> DataFrame:
    """One row per piece with its sequence and its offset there; for ``pattern`` see ``worker.ChunkEncoder``."""
    spark = docs.sparkSession
    path = scratch_table(spark, "pieces")
    cut_pieces(docs, tokenizer, window, end_id, pattern).write.parquet(path)
    pieces = spark.read.parquet(path)
    groups = max(1, -(-pieces.count() // group_pieces))

    def place(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], ignore_index=True)
        where, offsets = best_fit(rows["length"].tolist(), window)
        rows["sequence_id"] = (np.int64(key[0]) << 32) + np.array(where, dtype=np.int64)
        rows["offset"] = np.array(offsets, dtype=np.int64)
        rows["doc_id"] = rows["doc_id"].astype("Int64")
        return rows.drop(columns="group")

    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups)).cast("long"))
    return dealt.groupBy("group").applyInPandas(place, PLACED)
