"""Byte-level BPE over matrices of symbols, and decoding.

A text is cut by the pre-tokenizer's pattern. Pieces that are tokens need no
merging. The others, each distinct one once per worker (bounded memo), are laid as rows of padded
matrices by length class. In each round every row merges its leftmost pair of
least rank: ranks of neighbouring pairs come from a hash table of pairs (open
addressing), the merged symbol takes the left place, and dropping the right place of every row
keeps the matrix rectangular. Only the ranks on both sides of a merge are looked up again. Rows
without a pair leave the matrix.

A piece longer than ``LONG`` bytes is a row of its own, and merges the places of its least
pair in one round, from left to right up to the first merge that makes a pair of lower rank. That
gives the same symbols as one merge at a time.

Nulls: a null text is the empty text and has no tokens; null ids decode to nothing. Null and repeated
doc_ids come back each. Other columns are ignored. An id without a token is an error.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecmeadow.llm import worker

NONE = np.int32(2**31 - 1)
LONG = 256
ROWS = 4096  # rows of one matrix
MEMO_BYTES = 48 * 1024 * 1024
BLOCK_BYTES = 1 << 20
# White space as the tokenizer's pattern library counts it (Unicode White_Space).
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CHUNK = regex.compile(rf"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
# The same chunks of texts without the characters that only Python counts as white space.
_PLAIN_CHUNK = re.compile(r"\s*\S+|\s+")
_SEPARATORS = re.compile("[\x1c-\x1f]")


def splitter(pattern: str) -> regex.Pattern:
    """The pattern with its classes of white space written out."""
    for name, spelled in ((r"[^\s", rf"[^{SPACE}"), (r"\s", f"[{SPACE}]"), (r"\S", f"[^{SPACE}]")):
        pattern = pattern.replace(name, spelled)
    return regex.compile(pattern)


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as file:
        found = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, filter(bytes.strip, file))}
    if sorted(found) != list(range(len(found))) or len(set(found.values())) != len(found):
        raise ValueError(f"{path} needs one token for each rank from 0 on")
    return [found[i] for i in range(len(found))]


class PairTable:
    """Rank of the token that two neighbouring tokens make, by open addressing."""

    def __init__(self, tokens: list[bytes]):
        rank = {t: i for i, t in enumerate(tokens)}
        found = [(rank[t[:k]], rank[t[k:]], i) for i, t in enumerate(tokens) for k in range(1, len(t)) if t[:k] in rank and t[k:] in rank]
        left, right, merged = np.array(found, dtype=np.int64).reshape(-1, 3).T
        keys = self._key(left, right)
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NONE, np.int32)
        rest, slot = np.arange(len(keys)), self._slot(keys)
        while len(rest):
            free = self.keys[slot] == -1
            _, first = np.unique(slot, return_index=True)
            placed = np.zeros(len(rest), bool)
            placed[first] = True
            placed &= free
            self.keys[slot[placed]], self.ranks[slot[placed]] = keys[rest[placed]], merged[rest[placed]]
            rest, slot = rest[~placed], (slot[~placed] + 1) & ((1 << self.bits) - 1)

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.int64) << 32) | right.astype(np.int64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = (keys ^ (keys >> 29)).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks, ``NONE`` where there is no such pair or a side is padding (-1)."""
        out = np.full(left.shape, NONE, np.int32)
        at = np.flatnonzero((left >= 0) & (right >= 0))
        keys = self._key(left[at], right[at])
        slot = self._slot(keys)
        while len(at):
            found = self.keys[slot]
            same = found == keys
            out[at[same]] = self.ranks[slot[same]]
            on = ~same & (found != -1)
            at, keys, slot = at[on], keys[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out


def merge_rows(symbols: np.ndarray, table: PairTable) -> list[np.ndarray]:
    """Merged symbols of each row of a matrix padded with -1 on the right."""
    rows, width = symbols.shape
    out: list = [None] * rows
    number = np.arange(rows)
    ranks = table.look_up(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(rows, width - 1)
    while len(number):
        if ranks.shape[1]:
            at = ranks.argmin(axis=1)  # the first of equal ranks
            least = ranks[np.arange(len(number)), at]
        else:
            least = np.full(len(number), NONE)
        done = least == NONE
        if done.any():
            for i, row in zip(number[done].tolist(), symbols[done]):
                out[i] = row[row >= 0]
            number, symbols, ranks, at, least = number[~done], symbols[~done], ranks[~done], at[~done], least[~done]
            if not len(number):
                break
        here = np.arange(len(number))
        symbols[here, at] = least
        stays = np.ones(symbols.shape, bool)
        stays[here, at + 1] = False
        symbols = symbols[stays].reshape(len(number), -1)
        stays = np.ones(ranks.shape, bool)
        stays[here, at] = False
        ranks = ranks[stays].reshape(len(number), -1)
        for place in (at - 1, at):
            ok = (place >= 0) & (place < ranks.shape[1])
            i, k = here[ok], place[ok]
            ranks[i, k] = table.look_up(symbols[i, k], symbols[i, k + 1])
    return out


def merge_long(symbols: np.ndarray, table: PairTable) -> np.ndarray:
    """Merged symbols of one long row."""
    ranks = table.look_up(symbols[:-1], symbols[1:])
    while len(ranks):
        least = int(ranks.min())
        if least == NONE:
            break
        at = np.flatnonzero(ranks == least)
        # Of overlapping places every second one from the left.
        starts = np.flatnonzero(np.r_[True, np.diff(at) != 1])
        run = np.repeat(starts, np.diff(np.r_[starts, len(at)]))
        at = at[(np.arange(len(at)) - run) % 2 == 0]
        # The neighbours that each merge finds: those to its left are merged by then.
        left = np.where(at > 0, symbols[at - 1], -1)
        left[1:][at[:-1] + 2 == at[1:]] = least
        right = np.where(at + 2 < len(symbols), symbols[np.minimum(at + 2, len(symbols) - 1)], -1)
        merged = np.full(len(at), least)
        lower = np.minimum(table.look_up(left, merged), table.look_up(merged, right)) < least
        if lower.any():
            at = at[: int(lower.argmax()) + 1]
        symbols[at] = least
        symbols = np.delete(symbols, at + 1)
        ranks = np.delete(ranks, at)
        now = at - np.arange(len(at))
        for place in (now - 1, now):
            place = place[(place >= 0) & (place < len(ranks))]
            ranks[place] = table.look_up(symbols[place], symbols[place + 1])
    return symbols


class BytePairs:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str):
        self.tokens = read_ranks(path)
        self.spelled = np.array(self.tokens, dtype=object)
        self.whole = {t: np.uint32(i).astype("<u4").tobytes() for i, t in enumerate(self.tokens)}
        self.table = PairTable(self.tokens)
        self.byte_symbol = np.full(256, -1, np.int32)
        for i, t in enumerate(self.tokens):
            if len(t) == 1:
                self.byte_symbol[t[0]] = i
        if (self.byte_symbol < 0).any():
            raise ValueError(f"{path} needs a token for each byte")
        self.split = splitter(pattern)
        self.memo: dict[str, bytes] = {}
        self.memo_bytes = 0

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian unsigned 32-bit integers."""
        out: list = [self.whole.get(p) for p in pieces]
        classes: dict[int, list[int]] = {}
        for i, found in enumerate(out):
            if found is None and pieces[i]:
                size = len(pieces[i])
                if size > LONG:
                    symbols = self.byte_symbol[np.frombuffer(pieces[i], np.uint8)]
                    out[i] = merge_long(symbols, self.table).astype("<u4").tobytes()
                else:
                    classes.setdefault((size - 1).bit_length(), []).append(i)
        for width, numbers in classes.items():
            for start in range(0, len(numbers), ROWS):
                part = numbers[start : start + ROWS]
                matrix = np.full((len(part), 1 << width), -1, np.int32)
                sizes = np.array([len(pieces[i]) for i in part])
                matrix[np.arange(1 << width)[None, :] < sizes[:, None]] = self.byte_symbol[
                    np.frombuffer(b"".join(pieces[i] for i in part), np.uint8)
                ]
                for i, row in zip(part, merge_rows(matrix, self.table)):
                    out[i] = row.astype("<u4").tobytes()
        return [ids or b"" for ids in out]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text. White space and the word after it are cut alike in any text, so ids are kept per such chunk."""
        if self.memo_bytes > MEMO_BYTES:
            self.memo.clear()
            self.memo_bytes = 0
        cut = [(_CHUNK if _SEPARATORS.search(t) else _PLAIN_CHUNK).findall(t) for t in texts]
        memo = self.memo
        new = list({c for chunks in cut for c in chunks if c not in memo})
        pieces = [[p.encode() for p in self.split.findall(c)] for c in new]
        distinct = list({p for found in pieces for p in found})
        ids = dict(zip(distinct, self.encode_pieces(distinct)))
        fresh = {c: b"".join([ids[p] for p in found]) for c, found in zip(new, pieces)}
        kept = {c: i for c, i in fresh.items() if len(c) <= LONG}
        memo.update(kept)
        self.memo_bytes += sum(map(len, kept.values())) + 2 * sum(map(len, kept)) + 180 * len(kept)
        if len(kept) < len(fresh):
            return [b"".join([memo[c] if c in memo else fresh[c] for c in chunks]) for chunks in cut]
        return [b"".join(map(memo.__getitem__, chunks)) for chunks in cut]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(self.spelled[np.frombuffer(ids, "<u4")])


def coder(path: str, pattern: str) -> BytePairs:
    return worker.kept(f"byte pairs {path} {pattern}", lambda: BytePairs(path, pattern))


def encode_documents(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Rows (doc_id, n_tokens, ids), one per document; ``ids`` are little-endian unsigned 32-bit integers behind one another."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = coder(ranks, pattern)
        for block in worker.blocks(batches, limit=BLOCK_BYTES):
            ids = tool.encode([t or "" for t in block.column(1).to_pylist()])
            counts = pa.array([len(i) // 4 for i in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([block.column(0), counts, pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, "doc_id long, n_tokens long, ids binary")


def decode_documents(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """The rows with ``decoded`` (the bytes of the tokens), which replaces a column of that name."""
    encoded = encoded.drop("decoded")
    schema = encoded.select("*", F.lit(b"").alias("decoded")).schema

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = coder(ranks, pattern)
        for block in worker.blocks(batches, text="ids", limit=4 * BLOCK_BYTES):
            found = [tool.decode(i or b"") for i in block.column(block.schema.get_field_index("ids")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*block.columns, pa.array(found, pa.binary())], [*block.schema.names, "decoded"])

    return encoded.mapInArrow(decode, schema)
