"""Fill-in-the-middle transformation of texts, cut at line ends.

A text is cut into chunks by its content: a rolling hash over 32 bytes ends a
chunk where its top bits are zero, so passages that texts share become the same
chunks. Each chunk's summary is kept in a bounded cache under the chunk itself (a hit is
compared byte by byte): code points, the places behind its line ends, whether it
holds a marker, and the bytes at its ends, where a marker may lie across two
chunks. A document's lines and code points are sums over its chunks; a cut is
found by binary search over the summed line counts and a look into one chunk.

Two checksums of the id choose the cuts, a third whether the text is
transformed, a fourth the order of the parts. An empty text and one that holds a marker
stay as they are, so that every output can be turned back.

Nulls: a null text is the empty text; a null id is written as the empty text.
Repeated rows come back each. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecmeadow.llm import worker

SEED = 7
RATE = 100  # per cent of texts that are transformed
SUFFIX_FIRST = 50  # per cent of those with the suffix first
MARKS = ("<P>", "<S>", "<M>")
WINDOW = 32
ZERO_BITS = 10  # chunks of about 1 KB
LONGEST = 16 * 1024
CACHE_BYTES = 16 * 1024 * 1024
BLOCK_BYTES = 1 << 20
OUTPUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def _byte_values() -> np.ndarray:
    """A mixed 32-bit value for each byte."""
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(32)).astype(np.uint32)


VALUES = _byte_values()


def chunk_ends(data: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Ends of the chunks of one text (UTF-8 bytes); they lie between code points, and only the bytes before an end decide on it."""
    if not len(data):
        return np.zeros(0, np.int64)
    # h[i] = sum of VALUES[data[i - j]] << j over the window, by doubling the window.
    h = VALUES[data]
    span = 1
    while span < WINDOW:
        longer = h.copy()
        longer[span:] += h[:-span] << np.uint32(span)
        h, span = longer, 2 * span
    starts = np.r_[(data[1:] & 0xC0) != 0x80, True]  # whether a code point starts behind the byte
    ends = np.flatnonzero((h >> np.uint32(32 - ZERO_BITS) == 0) & starts) + 1
    ends = ends[ends >= WINDOW]
    ends = np.unique(np.r_[ends, len(data)])
    gaps = np.diff(np.r_[0, ends])
    if (gaps > longest).any():
        more = []
        for end, gap in zip(ends[gaps > longest].tolist(), gaps[gaps > longest].tolist()):
            for at in range(end - gap + longest, end, longest):
                while (data[at] & 0xC0) == 0x80:
                    at -= 1
                more.append(at)
        ends = np.unique(np.r_[ends, more])
    return ends


@dataclass(frozen=True)
class Summary:
    """What a document needs to know of a chunk."""

    size: int
    chars: int
    line_ends: list[int]  # places behind the line feeds, in bytes
    line_chars: list[int]  # and in code points
    marked: bool
    head: bytes
    tail: bytes


def summarise(chunk: bytes, marks: tuple[bytes, ...]) -> Summary:
    ends, chars, at, seen = [], [], 0, 0
    while (found := chunk.find(b"\n", at)) >= 0:
        seen += len(chunk[at : found + 1].decode())
        at = found + 1
        ends.append(at)
        chars.append(seen)
    edge = max(map(len, marks)) - 1
    total = seen + len(chunk[at:].decode())
    return Summary(len(chunk), total, ends, chars, any(m in chunk for m in marks), chunk[:edge], chunk[-edge:])


class SummaryCache:
    """Summaries of chunks by content, at most ``CACHE_BYTES`` of them; then it begins anew."""

    def __init__(self, marks: tuple[str, ...]):
        self.marks = tuple(m.encode() for m in marks)
        self.edge = max(map(len, self.marks)) - 1
        self.kept: dict[bytes, Summary] = {}
        self.bytes = self.hits = 0

    def of(self, chunk: bytes) -> Summary:
        # The dictionary compares the bytes of chunks whose hashes are equal.
        found = self.kept.get(chunk)
        if found is not None:
            self.hits += 1
            return found
        found = summarise(chunk, self.marks)
        if self.bytes > CACHE_BYTES:
            self.kept.clear()
            self.bytes = 0
        self.kept[chunk] = found
        self.bytes += len(chunk) + 72 * len(found.line_ends) + 400
        return found

    def outline(self, data: bytes) -> "Outline":
        ends = chunk_ends(np.frombuffer(data, np.uint8)).tolist()
        return Outline([self.of(data[a:b]) for a, b in zip([0, *ends], ends)], data[-1:] == b"\n", self.marks, self.edge)


class Outline:
    """Sums over a document's chunks."""

    def __init__(self, chunks: list[Summary], ended: bool, marks: tuple[bytes, ...], edge: int):
        self.chunks = chunks
        self.sizes = [0, *accumulate(c.size for c in chunks)]
        self.chars = [0, *accumulate(c.chars for c in chunks)]
        self.feeds = [0, *accumulate(len(c.line_ends) for c in chunks)]
        self.lines = self.feeds[-1] + (1 if chunks and not ended else 0)
        self.marked = any(c.marked for c in chunks)
        before = b""
        for c in chunks:
            if self.marked:
                break
            self.marked = any(m in before + c.head for m in marks)
            before = (before + c.tail)[-edge:]

    def end_of(self, line: int) -> tuple[int, int]:
        """Bytes and code points up to the end of that many lines."""
        if line > self.feeds[-1]:
            return self.sizes[-1], self.chars[-1]
        if line == 0:
            return 0, 0
        at = bisect_left(self.feeds, line) - 1
        k = line - self.feeds[at] - 1
        return self.sizes[at] + self.chunks[at].line_ends[k], self.chars[at] + self.chunks[at].line_chars[k]


def fill_in_middle(
    docs: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, marks: tuple[str, str, str] = MARKS
) -> DataFrame:
    """Rows (doc_id, n lines, form, prefix_chars, middle_chars, output), one per document.

    ``form`` is plain (the text itself), psm (prefix, suffix, middle) or spm (suffix, prefix, middle), each part behind its marker.
    """
    p, s, m = (mark.encode() for mark in marks)

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker.kept(f"line summaries {marks}", lambda: SummaryCache(marks))
        for block in worker.blocks(batches, limit=BLOCK_BYTES):
            rows = []
            for doc_id, data in zip(block.column(0).to_pylist(), block.column(1).cast(pa.binary()).to_pylist()):
                data = data or b""
                outline = cache.outline(data)
                digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
                h = [int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12)]
                n = outline.lines
                if not data or outline.marked or h[2] % 100 >= rate:
                    rows.append((doc_id, n, "plain", None, None, data))
                    continue
                a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
                (from_, before), (to, upto) = outline.end_of(a), outline.end_of(b)
                prefix, middle, suffix = data[:from_], data[from_:to], data[to:]
                if h[3] % 100 < suffix_first:
                    rows.append((doc_id, n, "spm", before, upto - before, b"".join((s, suffix, p, prefix, m, middle))))
                else:
                    rows.append((doc_id, n, "psm", before, upto - before, b"".join((p, prefix, s, suffix, m, middle))))
            ids, lines, forms, first, second, out = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [
                    *(pa.array(c, pa.int64()) for c in (ids, lines)), pa.array(forms),
                    *(pa.array(c, pa.int64()) for c in (first, second)), pa.array(out, pa.binary()).cast(pa.string()),
                ],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(transform, OUTPUT)


def restored(form: Column, output: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text, from output and form alone: the first of each marker is the one that was put in, since the text has none."""
    p, s, m = marks
    place = lambda mark: F.instr(output, mark)
    part = lambda mark, end: output.substr(place(mark) + len(mark), end - place(mark) - len(mark))
    last = output.substr(place(m) + len(m), F.char_length(output))
    return (
        F.when(form == "psm", F.concat(part(p, place(s)), last, part(s, place(m))))
        .when(form == "spm", F.concat(part(p, place(m)), last, part(s, place(p))))
        .otherwise(output)
    )
