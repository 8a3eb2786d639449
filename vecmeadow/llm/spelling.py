"""Spelling variants of words: Bloom-guided neighbourhoods of one edit.

The vocabulary (words with enough letters and occurrences) is hashed into blocked
Bloom filters, one or more per word length. Each word's edits are made as hashes,
not as strings: a word's hash is a sum over its letters and their places, so a
replaced or deleted letter changes it by a few terms. The edits are probed
against the broadcast filters, and only positives are shuffled, as pairs of hashes, to an exact
join with the vocabulary, which also removes false positives. An inserted letter
is a deleted one seen from the other word, and of two words that differ by a
replaced letter only the one with the smaller letter asks, so each pair is found once.

Filters have a bounded size each (``SHARD_WORDS``) and are broadcast in rounds of
``FILTER_BYTES``: a larger vocabulary takes more rounds, not more memory.

Nulls: a null text has no words; a null id is written as the empty text. Repeated rows count each.
Other columns are ignored. Without words the result is empty.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecmeadow.llm import worker
from vecmeadow.session import scratch_table

MIN_LENGTH = 6
MIN_COUNT = 5
RATIO = 5  # a form is at least so many times as frequent as the word
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))
BLOCK_BYTES = 1 << 20
FLUSH = 100_000
POOLED = 64  # words of this length or more share their filters
SHARD_WORDS = 1 << 14
FILTER_BYTES = 32 * 1024 * 1024
WORDS_PER_BLOCK = 16  # a block is 8 lanes of 32 bits, so 16 bits a word
PROBE_WORDS = 4_000  # words of one probing task
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
# One odd multiplier for each lane of a block.
_LANES = np.array([0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31], dtype=np.uint32)
KEYED = "word string, n long, size int, key long"
SHARDED = "shard int, key long"
FILTER = "shard int, blocks int, bits binary"
PAIRS = "size_from int, key_from long, size_to int, key_to long"


def word_counts(docs: DataFrame, min_length: int = MIN_LENGTH, slip: int | None = None) -> DataFrame:
    """Rows (word, n) of maximal letter runs of at least ``min_length``, A-Z lower-cased.

    With ``slip`` the checksum of ``<doc_id>:<run>`` decides which runs lose a letter: those it divides.
    """
    run = re.compile("[a-z\u00c0-\u00ff]{%d,}" % min_length)

    def rows(counted: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counted), pa.string()), pa.array(list(counted.values()), pa.int64())], ["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: Counter[str] = Counter()
        for block in worker.blocks(batches, limit=BLOCK_BYTES):
            for doc_id, text in zip(block.column(0).to_pylist(), block.column(1).to_pylist()):
                found = Counter(run.findall((text or "").encode().translate(_LOWER).decode()))
                if slip is None:
                    counted.update(found)
                    continue
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in found.items():
                    h = zlib.crc32(word.encode(), start)
                    if h % slip == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < min_length:
                            continue
                    counted[word] += n
            if len(counted) >= FLUSH:
                yield rows(counted)
                counted = Counter()
        if counted:
            yield rows(counted)

    return docs.select("doc_id", "text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _mixed(h: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of ``h``."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _terms(codes: np.ndarray, place: np.ndarray) -> np.ndarray:
    """What a letter at a place adds to a word's hash."""
    return _mixed(codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03))


def _codes(words: list[str]) -> np.ndarray:
    """Words of one length as a matrix of code points."""
    return np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").reshape(len(words), -1)


def word_keys(words: list[str]) -> np.ndarray:
    """64-bit keys; equal words have equal keys."""
    sizes = np.array([len(w) for w in words])
    out = np.zeros(len(words), np.uint64)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        codes = _codes([words[i] for i in at])
        out[at] = _mixed(_terms(codes, np.arange(size)[None, :]).sum(axis=1, dtype=np.uint64))
    return out


def one_edit_keys(words: list[str]) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """(word numbers, change of length, keys of edits) for words of one length: each deleted letter, each letter replaced by a larger one.

    Deleting any letter of a run of equal ones gives the same word, so only the first is deleted.
    """
    codes = _codes(words)
    rows, size = codes.shape
    here = _terms(codes, np.arange(size)[None, :])
    total = here.sum(axis=1, dtype=np.uint64)
    letters = np.array([ord(c) for c in LETTERS], dtype=np.uint32)
    numbers = np.arange(rows)
    before = np.zeros(rows, np.uint64)  # letters up to the deleted one
    moved = _terms(codes[:, 1:], np.arange(size - 1)[None, :])  # letters behind it, one place to the left
    behind = moved.sum(axis=1, dtype=np.uint64)
    for i in range(size):
        first = numbers if i == 0 else np.flatnonzero(codes[:, i] != codes[:, i - 1])
        if len(first):
            yield first, -1, _mixed(before[first] + behind[first])
        before = before + here[:, i]
        if i < size - 1:
            behind = behind - moved[:, i]
        row, letter = np.nonzero(letters[None, :] > codes[:, i, None])
        if len(row):
            added = _terms(letters, np.full(len(letters), i))
            yield row, 0, _mixed((total - here[:, i])[row] + added[letter])


def _lanes(keys: np.ndarray) -> np.ndarray:
    """Bit of each lane of a block, one row per key."""
    low = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return np.uint32(1) << ((low[:, None] * _LANES[None, :]) >> np.uint32(27))


def _blocks(keys: np.ndarray, blocks: np.ndarray | int) -> np.ndarray:
    return (((keys >> np.uint64(32)) * np.asarray(blocks, dtype=np.uint64)) >> np.uint64(32)).astype(np.int64)


def filter_bits(keys: np.ndarray) -> np.ndarray:
    """Blocked Bloom filter of the keys: (blocks, 8) lanes."""
    bits = np.zeros((max(1, -(-len(keys) // WORDS_PER_BLOCK)), 8), np.uint32)
    np.bitwise_or.at(bits, _blocks(keys, len(bits)), _lanes(keys))
    return bits


class Shards:
    """Which filter a word of a length belongs to: ``parts`` of each length class, by other bits of the key than the filter's."""

    def __init__(self, words_of_class: dict[int, int], shard_words: int):
        self.parts = np.zeros(POOLED + 1, np.int64)
        for size, n in words_of_class.items():
            self.parts[size] = -(-n // shard_words)
        self.first = np.cumsum(self.parts) - self.parts
        self.count = int(self.parts.sum())

    def of(self, size: int | np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Shard of each key, -1 where no word has that length."""
        kind = np.minimum(size, POOLED)
        parts = self.parts[kind]
        part = (_mixed(keys + np.uint64(1)) >> np.uint64(33)).astype(np.int64) % np.maximum(parts, 1)
        return np.where(parts > 0, self.first[kind] + part, -1)


class Filters:
    """Some shards' filters behind one another in one array."""

    def __init__(self, shards: Shards, found: list[tuple[int, int, bytes]]):
        self.shards = shards
        self.start = np.full(shards.count + 1, -1, np.int64)  # the last is for keys of no shard
        self.blocks = np.ones(shards.count + 1, np.int64)
        at, parts = 0, []
        for shard, blocks, bits in found:
            self.start[shard], self.blocks[shard] = at, blocks
            at += blocks
            parts.append(np.frombuffer(bits, np.uint32).reshape(blocks, 8))
        self.bits = np.concatenate(parts)

    def holds(self, size: int, keys: np.ndarray) -> np.ndarray:
        """Numbers of the keys that may be words of that length."""
        shard = self.shards.of(size, keys)
        left = np.flatnonzero(self.start[shard] >= 0)
        shard, keys = shard[left], keys[left]
        block = self.start[shard] + _blocks(keys, self.blocks[shard])
        low = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        # A lane is looked at only for keys that passed those before it.
        for lane in range(8):
            hit = (self.bits[block, lane] >> ((low * _LANES[lane]) >> np.uint32(27))) & np.uint32(1) != 0
            left, block, low = left[hit], block[hit], low[hit]
        return left


def keyed_vocabulary(counts: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """Words with enough occurrences, their length in code points and their key; a table in the shared folder."""

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in worker.blocks(batches, text="word", limit=BLOCK_BYTES):
            words = block.column(0).to_pylist()
            sizes = pa.array([len(w) for w in words], pa.int32())
            yield pa.RecordBatch.from_arrays([*block.columns, sizes, pa.array(word_keys(words).view(np.int64))], ["word", "n", "size", "key"])

    spark = counts.sparkSession
    path = scratch_table(spark, "vocabulary")
    counts.where(F.col("n") >= min_count).select("word", "n").mapInArrow(key, KEYED).write.parquet(path)
    return spark.read.parquet(path)


def build_filters(words: DataFrame, shards: Shards) -> DataFrame:
    """One row per shard with its filter; a shard has a bounded number of words."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(1).to_numpy(zero_copy_only=False)
            shard = shards.of(batch.column(0).to_numpy(zero_copy_only=False), keys.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), batch.column(1)], ["shard", "key"])

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        bits = filter_bits(rows.column("key").to_numpy().view(np.uint64))
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "blocks": pa.array([len(bits)], pa.int32()), "bits": [bits.tobytes()]})

    spark = words.sparkSession
    path = scratch_table(spark, "spelling-filters")
    words.select("size", "key").mapInArrow(place, SHARDED).groupBy("shard").applyInArrow(build, FILTER).write.parquet(path)
    return spark.read.parquet(path)


def near_pairs(words: DataFrame, shard_words: int = SHARD_WORDS, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """Rows (a, a_n, b, b_n), one per pair of words that differ by exactly one inserted, deleted or replaced letter."""
    spark = words.sparkSession
    kinds = words.groupBy(F.least("size", F.lit(POOLED)).alias("kind")).count().collect()
    shards = Shards({r["kind"]: r["count"] for r in kinds}, shard_words)
    path = scratch_table(spark, "spelling-pairs")
    spark.createDataFrame([], PAIRS).write.parquet(path)
    if shards.count:
        filters = build_filters(words, shards)
        tasks = max(1, sum(r["count"] for r in kinds) // PROBE_WORDS)
        dealt = words.select("word", "size", "key").repartition(tasks)
        least_bytes = 32 * (-(-shard_words // WORDS_PER_BLOCK))
        in_round = max(1, filter_bytes // least_bytes)
        for first in range(0, shards.count, in_round):
            found = filters.where(F.col("shard").between(first, first + in_round - 1)).collect()
            shared = spark.sparkContext.broadcast(Filters(shards, [tuple(r) for r in found]))
            dealt.mapInArrow(_prober(shared), PAIRS).write.mode("append").parquet(path)
            shared.unpersist()
    pairs = spark.read.parquet(path)
    side = lambda name, end: words.select(
        F.col("size").alias(f"size_{end}"), F.col("key").alias(f"key_{end}"), F.col("word").alias(name), F.col("n").alias(f"{name}_n")
    )
    found = pairs.join(side("b", "to"), ["size_to", "key_to"]).join(side("a", "from"), ["size_from", "key_from"])
    return found.where(F.levenshtein("a", "b", 1) == 1).select("a", "a_n", "b", "b_n")


def _prober(shared):
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = shared.value
        for block in worker.blocks(batches, text="word", limit=64 * 1024):
            words = np.array(block.column(0).to_pylist(), dtype=object)
            sizes = block.column(1).to_numpy(zero_copy_only=False)
            own = block.column(2).to_numpy(zero_copy_only=False)
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                for row, change, keys in one_edit_keys(words[at].tolist()):
                    hit = filters.holds(size + change, keys)
                    if len(hit):
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(np.full(len(hit), size, np.int32)), pa.array(own[at[row[hit]]]),
                                pa.array(np.full(len(hit), size + change, np.int32)), pa.array(keys[hit].view(np.int64)),
                            ],
                            ["size_from", "key_from", "size_to", "key_to"],
                        )

    return probe


def with_roots(forms: DataFrame) -> DataFrame:
    """(word, form, form_n) with ``root``, the last word that forms lead to. Pointers double in each round.

    Counts grow by ``RATIO`` at each step, so chains are short and never circular.
    """
    spark = forms.sparkSession

    def stored(df: DataFrame) -> DataFrame:
        path = scratch_table(spark, "spelling-roots")
        df.write.parquet(path)
        return spark.read.parquet(path)

    at = stored(forms.withColumn("root", F.col("form")).withColumn("ended", F.lit(False)))
    while not at.where(~F.col("ended")).isEmpty():
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("further"), F.col("ended").alias("further_ended"))
        joined = at.join(onward, "root", "left")
        at = stored(
            joined.select(
                "word", "form", "form_n", F.coalesce("further", "root").alias("root"), F.coalesce("further_ended", F.lit(True)).alias("ended")
            )
        )
    return at.drop("ended")


def group_spellings(
    docs: DataFrame,
    min_length: int = MIN_LENGTH,
    min_count: int = MIN_COUNT,
    ratio: int = RATIO,
    slip: int | None = None,
    shard_words: int = SHARD_WORDS,
    filter_bytes: int = FILTER_BYTES,
) -> DataFrame:
    """Rows (word, form, root, n, n_near, form_n), one per word of the vocabulary.

    ``form`` is the most frequent near word (ties: the smallest), if it has at least ``ratio`` times the word's occurrences.
    """
    words = keyed_vocabulary(word_counts(docs, min_length, slip), min_count)
    pairs = near_pairs(words, shard_words, filter_bytes)
    # Both ends of a pair in one pass; partial minima keep a word with many neighbours to one row per task.
    ends = pairs.select(
        F.explode(
            F.array(
                F.struct(F.col("a").alias("word"), F.struct((-F.col("b_n")).alias("less"), F.col("b").alias("near")).alias("best")),
                F.struct(F.col("b").alias("word"), F.struct((-F.col("a_n")).alias("less"), F.col("a").alias("near")).alias("best")),
            )
        ).alias("end")
    ).select("end.*")
    spark = docs.sparkSession
    path = scratch_table(spark, "spelling-words")
    best = ends.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min("best").alias("best"))
    joined = words.select("word", "n").join(best, "word", "left")
    formed = -F.col("best.less") >= ratio * F.col("n")
    joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(formed, F.col("best.near")).alias("form"), F.when(formed, -F.col("best.less")).alias("form_n"),
    ).write.parquet(path)
    found = spark.read.parquet(path)
    roots = with_roots(found.where("form is not null").select("word", "form", "form_n")).select("word", "root")
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
