"""What a Python worker keeps from task to task, and text columns cut into blocks of bounded bytes."""

from __future__ import annotations

import ctypes
import json
import re
import sys
from collections.abc import Callable, Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 8 * 1024 * 1024
MEMO_BYTES = 64 * 1024 * 1024
MEMO_ENTRIES = 600_000  # of memos of short entries
ENTRY_BYTES = 200  # of an entry besides its text and ids
KEPT = 2  # objects of a worker process; the one used last but that many goes
JOINED = 400
LATIN = "\u0250"
_SPACED = re.compile(r"\s*\S+|\s+")
# Python counts these as white space, the tokenizers' patterns do not.
_SEPARATORS = re.compile("[\x1c-\x1f]")


def kept(name: str, build: Callable):
    """``build()`` once per worker process. Shipped functions get new globals in each task, so the object hangs on ``sys``.

    A process that goes on to another job keeps only the ``KEPT`` objects used last.
    """
    store = sys.__dict__.setdefault("_kept_between_tasks", {})
    found = store.pop(name, None)
    if found is None:
        while len(store) >= KEPT:
            store.pop(next(iter(store)))
        found = build()
    store[name] = found
    return found


def give_back() -> None:
    """Return freed memory to the system: the executor's memory is shared with its JVM and other workers."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``limit`` bytes of text, or of a column of sizes; a longer text is a slice of its own."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        if not len(batch):
            continue
        sizes = column if pa.types.is_integer(column.type) else pa.compute.binary_length(column)
        ends = np.cumsum(pa.compute.fill_null(sizes, 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(batch):
            before = ends[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(at, upto - at)
            at = upto
        pa.default_memory_pool().release_unused()
    give_back()


def byte_ranks(path: str) -> dict[bytes, int] | None:
    """Tokens of a byte-level BPE file as bytes, if its merges stand in the order of their ids; else None."""
    with open(path, encoding="utf-8") as file:
        read = json.load(file)
    model, before = read["model"], read.get("pre_tokenizer") or {}
    if before.get("type") != "ByteLevel" or not before.get("use_regex") or before.get("add_prefix_space") or read.get("normalizer"):
        return None
    # Byte-level files write bytes that are no printable Latin-1 characters as the code points from 256 on.
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    vocab = model["vocab"]
    ids = [vocab[m] for m in merged]
    if ids != sorted(ids) or len(set(ids)) != len(ids) or any(c not in vocab for c in of):
        return None
    return {bytes(of[c] for c in t): i for t, i in vocab.items() if all(c in of for c in t)}


class ChunkEncoder:
    """Token ids of whole texts, put together from memoised pieces.

    Both tokenizers here split at white space before they merge: a run of white
    space and the word after it are encoded alike in any text. So a text is the
    concatenation of its ``\\s*\\S+`` chunks, and each distinct chunk is encoded
    once per worker. A text with characters that only Python counts as white
    space is encoded whole. New chunks are handed to the tokenizer many at a time,
    with the string of a special token, where any text is cut, between them.

    ``pattern`` is the pre-tokenizer's pattern. With it, and if the file allows it,
    ids of chunks in Latin letters come from tiktoken over the same vocabulary,
    which gives the same ids in a quarter of the time.
    """

    def __init__(self, path: str, counts: bool, pattern: str | None = None):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.counts = counts
        self.memo: dict = {}
        self.memo_bytes = 0
        self.plain = None
        ranks = byte_ranks(path) if pattern else None
        if ranks:
            import tiktoken

            self.plain = tiktoken.Encoding("chunks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        special = {str(t.content): i for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and not t.normalized}
        self.between, self.between_id = min(special.items(), key=lambda e: e[1], default=(None, None))

    def _encoded(self, texts: list[str]) -> list:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        if self.counts:
            return [len(x.ids) for x in found]
        return [np.array(x.ids, dtype="<u4").tobytes() for x in found]

    def _encoded_chunks(self, chunks: list[str]) -> list:
        if self.plain is None:
            return self._joined(chunks)
        others = [c for c in chunks if max(c) >= LATIN or (self.between and self.between in c)]
        of = dict(zip(others, self._joined(others)))
        encode = self.plain.encode_ordinary
        if self.counts:
            return [of[c] if c in of else len(encode(c)) for c in chunks]
        # Ids go into one array at once; its bytes are cut at the chunks' ends.
        ids = [[] if c in of else encode(c) for c in chunks]
        raw = np.fromiter(chain.from_iterable(ids), dtype="<u4").tobytes()
        ends = list(accumulate(4 * len(i) for i in ids))
        return [of[c] if c in of else raw[a:b] for c, a, b in zip(chunks, [0, *ends], ends)]

    def _joined(self, chunks: list[str]) -> list:
        if self.between is None or self.between in "".join(chunks):
            return self._encoded(chunks)
        out = []
        lines = [self.between.join(chunks[i : i + JOINED]) for i in range(0, len(chunks), JOINED)]
        for line in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False):
            ids = np.array(line.ids, dtype="<u4")
            ends = np.append(np.flatnonzero(ids == self.between_id), len(ids))
            starts = np.append(0, ends[:-1] + 1)
            if self.counts:
                out += (ends - starts).tolist()
            else:
                raw = ids.tobytes()
                out += [raw[a:b] for a, b in zip((4 * starts).tolist(), (4 * ends).tolist())]
        return out

    def encode(self, texts: list[str]) -> list:
        """Per text its number of tokens, or its ids as little-endian unsigned 32-bit integers."""
        if self.memo_bytes > MEMO_BYTES:
            self.memo.clear()
            self.memo_bytes = 0
        memo = self.memo
        cut = [_SPACED.findall(t) if not _SEPARATORS.search(t) else None for t in texts]
        new = list({c for chunks in cut if chunks for c in chunks if c not in memo})
        found = self._encoded_chunks(new)
        memo.update(zip(new, found))
        self.memo_bytes += ENTRY_BYTES * len(new) + sum(map(len, new)) + (0 if self.counts else sum(map(len, found)))
        out = []
        for text, chunks in zip(texts, cut):
            if chunks is None:
                out.append(self._encoded([text])[0])
            elif self.counts:
                out.append(sum(map(memo.__getitem__, chunks)))
            else:
                out.append(b"".join(map(memo.__getitem__, chunks)))
        return out


def encoder(path: str, counts: bool, pattern: str | None = None) -> ChunkEncoder:
    return kept(f"encoder {path} {counts} {pattern}", lambda: ChunkEncoder(path, counts, pattern))
