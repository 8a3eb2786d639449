"""Document fingerprints from prefix polynomial hashes.

A text's code points c_0, c_1, ... have prefix sums S_i = c_0 + c_1 B + ... +
c_(i-1) B^(i-1) modulo two primes. A span's difference of prefix sums, moved to
position 0 by the inverse power of B, depends on the span's characters alone:
any two spans of any texts are compared in constant time, and the longest
common extension of two positions is found by binary search.

The fingerprint is a bottom sketch: the ``SKETCH`` least hashes of all spans of
``SPAN`` characters (a shorter text is one span). Two fingerprints are alike by
the share of common values among the least ones of both, an estimate of the
Jaccard similarity of their span sets. Equal texts have equal fingerprints.

A null text is the empty text; its fingerprint is empty and like none but an
empty one. Memory is about 150 bytes per character of the longest text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecmeadow.llm import worker
from vecmeadow.llm.shingles import mix
from vecmeadow.session import small_side

SPAN = 16
SKETCH = 64
BLOCK = 1024 * 1024
PART_BYTES = 64 * 1024 * 1024
PRIMES = (2147483647, 2147483629)
BASES = (1_000_003, 1_299_709)
OUT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, same_start_edited long, same_start_next long"
)


class _Powers:
    """Powers of the bases and of their inverses, as far as needed so far."""

    def __init__(self):
        self.up, self.down = [], []
        self.size = 0

    def reach(self, n: int) -> None:
        if n <= self.size:
            return
        self.size = 1 << n.bit_length()
        table = lambda b, p: _power_table(b, p, self.size)
        self.up = [table(b, p) for b, p in zip(BASES, PRIMES)]
        self.down = [table(pow(b, -1, p), p) for b, p in zip(BASES, PRIMES)]


def _power_table(base: int, prime: int, size: int) -> np.ndarray:
    out = np.ones(1, dtype=np.uint64)
    while len(out) < size:
        out = np.r_[out, out * np.uint64(pow(base, len(out), prime)) % np.uint64(prime)]
    return out


class Prefixes:
    """Prefix hash arrays of texts laid one after the other."""

    def __init__(self, texts: list[str]):
        self.sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64) + np.uint64(1)
        self.powers = worker.kept("prefix powers", _Powers)
        self.powers.reach(len(codes) + 1)
        self.sums = []
        for up, prime in zip(self.powers.up, PRIMES):
            p = np.uint64(prime)
            # Terms are below 2^31, so sums of 2^32 of them fit.
            self.sums.append(np.r_[np.zeros(1, np.uint64), np.cumsum(codes * up[: len(codes)] % p) % p])

    def spans(self, begin: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        """Hashes of spans at absolute positions, one array per prime."""
        out = []
        for sums, down, prime in zip(self.sums, self.powers.down, PRIMES):
            p = np.uint64(prime)
            out.append((sums[end] + p - sums[begin]) % p * down[begin] % p)
        return out

    def joined(self, begin: np.ndarray, middle: int, other: int, ends: np.ndarray) -> list[np.ndarray]:
        """Hashes of the spans [begin, middle) each followed by [other, ends)."""
        left, right = self.spans(begin, np.full(len(begin), middle)), self.spans(np.full(len(ends), other), ends)
        return [
            (a + b * up[middle - begin] % np.uint64(prime)) % np.uint64(prime)
            for a, b, up, prime in zip(left, right, self.powers.up, PRIMES)
        ]

    def same(self, i: int, j: int, size: int) -> bool:
        """Whether the spans of ``size`` characters at ``i`` and ``j`` are equal."""
        for sums, up, prime in zip(self.sums, self.powers.up, PRIMES):
            a = (int(sums[i + size]) - int(sums[i])) * int(up[max(0, j - i)])
            b = (int(sums[j + size]) - int(sums[j])) * int(up[max(0, i - j)])
            if (a - b) % prime:
                return False
        return True

    def extension(self, i: int, j: int, most: int) -> int:
        """Length of the longest common extension of two positions, at most ``most``."""
        low, high = 0, most
        while low < high:
            size = (low + high + 1) // 2
            if self.same(i, j, size):
                low = size
            else:
                high = size - 1
        return low


def _values(hashes: list[np.ndarray]) -> np.ndarray:
    return (mix((hashes[0] << np.uint64(31)) | hashes[1]) >> np.uint64(32)).astype(np.uint32)


def _least(values: np.ndarray) -> np.ndarray:
    """The ``SKETCH`` least distinct values, ascending."""
    if len(values) > 8 * SKETCH:
        found = np.unique(np.partition(values, 4 * SKETCH)[: 4 * SKETCH])
        if len(found) >= SKETCH:
            return found[:SKETCH]
    return np.unique(values)[:SKETCH]


def fingerprint_text(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of common values among the least values of both sketches; 1 for two empty ones."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    least = np.union1d(a, b)[:SKETCH]
    return float(np.isin(least, a, assume_unique=True)[np.isin(least, b, assume_unique=True)].sum()) / len(least)


def fingerprint_pairs(texts: list[str]) -> list[tuple]:
    """For each text but the last, with the one after it as its next: the query's columns after ``doc_id``."""
    prefixes = Prefixes(texts)
    total = int(prefixes.sizes.sum())
    at = np.arange(max(0, total - SPAN + 1))
    windows = _values(prefixes.spans(at, at + SPAN))
    starts, sizes = prefixes.starts.tolist(), prefixes.sizes.tolist()

    def own(i: int) -> np.ndarray:
        s, n = starts[i], sizes[i]
        if n >= SPAN:
            return _least(windows[s : s + n - SPAN + 1])
        return _values(prefixes.spans(np.array([s]), np.array([s + n])))if n else np.zeros(0, np.uint32)

    sketches = [own(i) for i in range(len(texts))]
    out = []
    for i in range(len(texts) - 1):
        s, n, t = starts[i], sizes[i], starts[i + 1]
        head = n - n // 2
        taken = min(n // 2, sizes[i + 1])
        m = head + taken
        if m < SPAN:
            edited = _values(prefixes.joined(np.array([s]), s + head, t, np.array([t + taken]))) if m else np.zeros(0, np.uint32)
        else:
            across = np.arange(max(0, head - SPAN + 1), min(head, m - SPAN + 1))
            edited = _least(np.concatenate([
                windows[s : s + max(0, head - SPAN + 1)],
                _values(prefixes.joined(s + across, s + head, t, t + SPAN - (head - across))),
                windows[t : t + max(0, taken - SPAN + 1)],
            ]))
        # The edited text begins with the head, and goes on where the next text goes on like this one.
        start_edited = head + prefixes.extension(s + head, t, taken)
        start_next = prefixes.extension(s, t, min(n, sizes[i + 1]))
        text = texts[i][:head] + texts[i + 1][:taken]
        out.append((
            n, hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(), fingerprint_text(sketches[i]), fingerprint_text(edited),
            likeness(sketches[i], edited), likeness(sketches[i], sketches[i + 1]), start_edited, start_next,
        ))
    return out


def _emit(ids: list, texts: list[str]) -> pa.RecordBatch:
    columns = list(zip(*fingerprint_pairs(texts)))
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
    names = [f.split()[0] for f in OUT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *[pa.array(c, k) for c, k in zip(columns, kinds)]], names)


def fingerprint_documents(docs: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """Fingerprints of every text and of its edited text, made with the next document in descending order of ids.

    Null ids come last; rows with equal or null ids go by a hash of the text, then by the text. Documents are moved once, into
    parts that follow the order; each part also gets the first document of the part after it.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn(
        "tie", F.expr("shiftrightunsigned(xxhash64(text), 2)")
    )
    size = F.octet_length("text")
    held, unnamed = rows.agg(F.sum(size), F.sum(F.when(F.col("doc_id").isNull(), size))).first()
    parts = max(parts, -(-(held or 0) // part_bytes))
    extra = max(1, parts * (unnamed or 0) // max(1, held or 0))
    steps = [i / parts for i in range(1, parts)]
    # As many numbers as parts; any cut points give the same result.
    cuts = np.array(
        (rows.agg(F.percentile_approx(-F.col("doc_id"), steps, 50 * parts)).first()[0] or []) if steps else [], dtype=np.int64
    )
    unique = np.unique(cuts)

    @F.pandas_udf("int")
    def part_of(doc_id: pd.Series, tie: pd.Series) -> pd.Series:
        null = doc_id.isna().to_numpy()
        known = np.searchsorted(unique, -doc_id.fillna(0).to_numpy().astype(np.int64), side="left")
        late = len(unique) + 1 + np.minimum(extra - 1, (tie.to_numpy() / 2.0**62 * extra).astype(np.int64))
        return pd.Series(np.where(null, late, known).astype(np.int32))

    placed = rows.withColumn("part", part_of("doc_id", "tie"))
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), (-F.col("doc_id")).alias("back"), "tie")
    firsts = placed.groupBy("part").agg(F.min(order).alias("first")).select("part", "first.*").orderBy("part").collect()
    before = [(firsts[i - 1]["part"], f["unnamed"], f["back"], f["tie"]) for i, f in enumerate(firsts)]
    wanted = small_side(spark.createDataFrame(before, "to_part int, unnamed boolean, back long, want long"))
    same = (F.col("tie") == F.col("want")) & (-F.col("doc_id")).eqNullSafe(F.col("back"))
    nexts = rows.join(wanted, same).select("doc_id", "text", "tie", F.col("to_part").alias("part"), F.lit(True).alias("next"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, done = [], [], False
        for block in worker.blocks(batches, limit=BLOCK):
            for doc_id, text, is_next in zip(*(block.column(i).to_pylist() for i in range(3))):
                if done:
                    continue
                ids.append(doc_id)
                texts.append(text)
                done = is_next
            if len(texts) > 1:
                yield _emit(ids[:-1], texts)
                ids, texts = ids[-1:], texts[-1:]

    both = placed.withColumn("next", F.lit(False)).unionByName(nexts)
    return (
        both.repartitionById(len(unique) + 1 + extra, F.col("part"))
        .sortWithinPartitions("next", F.col("doc_id").desc_nulls_last(), "tie", "text")
        .select("doc_id", "text", "next").mapInArrow(run, OUT)
    )
