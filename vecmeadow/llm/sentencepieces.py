"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

A model file gives pieces with scores, the byte pieces and the unknown piece. A
unigram file's scores are log probabilities; a merge file's are ranks, so there
the log score of a piece is set from its rank by Zipf's law. Encoding puts the
white-space marker for each blank and one before the text, and takes the
segmentation with the highest sum of scores; a character without a piece of its
own may stand for itself at a penalty and is written as byte pieces. Decoding
joins pieces and bytes, turns markers into blanks and drops the first one.

Pieces have the marker only at their start, so no piece crosses from a word to
the blank after it: a best segmentation is best in each ``marker word`` chunk.
Distinct chunks are segmented side by side, all words of a block at once, and
remembered per worker. A model with inner markers is segmented by whole texts.

A null text is the empty text and has no pieces; null and repeated ids come back
as they are.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecmeadow.llm import worker

MARKER = "▁"
UNKNOWN_PENALTY = 10.0
WINDOW = 1024
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
_CHUNKS = re.compile(f"{MARKER}*[^{MARKER}]+|{MARKER}+")
OUT = "doc_id long, n_pieces long, n_byte_pieces long, ids_crc32 long, round_trip boolean"


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of the fields of a protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or number()
            yield key >> 3, raw[at : at + size]
            at += size


def read_model(path: str) -> tuple[list[str], np.ndarray, np.ndarray, bool]:
    """(pieces, scores, kinds, whether the scores are log probabilities) of a model file."""
    with open(path, "rb") as file:
        message = list(_fields(file.read()))
    found = [dict(_fields(v)) for n, v in message if n == 1]
    trainer = dict(_fields(next((v for n, v in message if n == 2), b"")))
    scores = np.array([struct.unpack("<f", p.get(2, bytes(4)))[0] for p in found], dtype=np.float64)
    return [p.get(1, b"").decode() for p in found], scores, np.array([p.get(3, NORMAL) for p in found]), trainer.get(3, 1) == 1


def zipf_scores(kinds: np.ndarray) -> np.ndarray:
    """Log scores by rank for the normal pieces, in the order of the file; 0 for the others."""
    normal = kinds == NORMAL
    share = 1.0 / (np.arange(normal.sum()) + 2.0)
    scores = np.zeros(len(kinds))
    scores[normal] = np.log(share / share.sum()).astype(np.float32)
    return scores


class DoubleArray:
    """A trie over bytes: the child of state s by byte b is base[s] + b + 1 if its check is s; ``value`` has a word's number."""

    def __init__(self, words: dict[bytes, int]):
        tree: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        for word, number in words.items():
            at = 0
            for byte in word:
                following = tree[at].get(byte)
                if following is None:
                    following = tree[at][byte] = len(tree)
                    tree.append({})
                at = following
            ends[at] = number
        # Bases first, for the nodes with most children first, each at the first fit; then the slots follow from the root.
        used = np.zeros(2 * len(tree) + 4096, dtype=bool)
        used[:2] = True
        bases, look = {}, {}
        for node in sorted((n for n, c in enumerate(tree) if c), key=lambda n: (-len(tree[n]), n)):
            offsets = np.array(sorted(tree[node])) + 1
            at = look.get(len(offsets), 1)
            while True:
                if at + WINDOW + 258 > len(used):
                    used = np.r_[used, np.zeros(len(used), dtype=bool)]
                free = ~used[at + offsets[0] : at + offsets[0] + WINDOW]
                for o in offsets[1:]:
                    free &= ~used[at + o : at + o + WINDOW]
                if free.any():
                    break
                at += WINDOW
            at += int(free.argmax())
            bases[node] = look[len(offsets)] = at
            used[at + offsets] = True
        size = int(np.flatnonzero(used).max()) + 259
        self.base, self.check, self.value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        todo = [(0, 0)]
        while todo:
            node, state = todo.pop()
            if node not in bases:
                continue
            self.base[state] = at = bases[node]
            for byte, child in tree[node].items():
                self.check[at + byte + 1] = state
                self.value[at + byte + 1] = ends.get(child, -1)
                todo.append((child, at + byte + 1))


@dataclass
class Model:
    """What encoding and decoding need, as arrays."""

    trie: DoubleArray
    scores: np.ndarray
    unknown_score: float
    byte_ids: np.ndarray
    raw: list[bytes]
    split: bool

    @classmethod
    def load(cls, path: str) -> Model:
        pieces, scores, kinds, logs = read_model(path)
        return cls.of(pieces, scores if logs else zipf_scores(kinds), kinds)

    @classmethod
    def of(cls, pieces: list[str], scores: np.ndarray, kinds: np.ndarray) -> Model:
        used = {p.encode(): i for i, p in enumerate(pieces) if kinds[i] in (NORMAL, USER)}
        bytes_of = {int(p[3:5], 16): i for i, p in enumerate(pieces) if kinds[i] == BYTE}
        if len(bytes_of) < 256:
            unknown = int(np.flatnonzero(kinds == UNKNOWN)[0])
            bytes_of = {b: bytes_of.get(b, unknown) for b in range(256)}
        raw = [p.replace(MARKER, " ").encode() for p in pieces]
        for i, kind in enumerate(kinds):
            if kind == BYTE:
                raw[i] = bytes([int(pieces[i][3:5], 16)])
            elif kind in (CONTROL, UNKNOWN):
                raw[i] = b"" if kind == CONTROL else "⁇".encode()
        lowest = scores[kinds == NORMAL].min(initial=0.0)
        return cls(
            DoubleArray(used), scores, float(lowest - UNKNOWN_PENALTY), np.array([bytes_of[b] for b in range(256)]), raw,
            not any(MARKER in p.lstrip(MARKER) for p in pieces),
        )

    def segment(self, chunks: list[str]) -> list[bytes]:
        """Ids of the best segmentation of each chunk, as little-endian unsigned 32-bit integers."""
        encoded = [c.encode("utf-8", "surrogatepass") for c in chunks]
        sizes = np.array([len(b) for b in encoded], dtype=np.int64)
        raw = np.frombuffer(b"".join(encoded), dtype=np.uint8)
        ends = np.cumsum(sizes)
        begins = ends - sizes
        start = np.flatnonzero((raw & 0xC0) != 0x80)
        chunk = np.searchsorted(ends, start, side="right")
        after = np.r_[start[1:], len(raw)]
        # All starts walk the trie together; each step keeps those that still match.
        state, at, left = np.zeros(len(start), dtype=np.int64), np.arange(len(start)), ends[chunk] - start
        edges, depth = [], 0
        single = np.zeros(len(start), dtype=bool)
        while len(at):
            going = left[at] > depth
            at, state = at[going], state[going]
            state_next = self.trie.base[state] + raw[start[at] + depth].astype(np.int64) + 1
            match = self.trie.check[state_next] == state
            at, state = at[match], state_next[match].astype(np.int64)
            depth += 1
            value = self.trie.value[state]
            word = value >= 0
            edges.append((at[word], start[at[word]] + depth, value[word].astype(np.int64)))
            single[at[word][after[at[word]] - start[at[word]] == depth]] = True
        lone = np.flatnonzero(~single)
        edges.append((lone, after[lone], np.full(len(lone), -1)))
        source, target, piece = (np.concatenate(c) for c in zip(*edges))
        score = np.where(piece >= 0, self.scores[piece], self.unknown_score)
        # Forward by the number of characters from the chunk's start; there each end is reached from one start at most.
        first = np.searchsorted(start, begins)
        turn = source - first[chunk[source]]
        order = np.argsort(turn, kind="stable")
        cuts = np.searchsorted(turn[order], np.arange(turn.max(initial=-1) + 2))
        # A chunk's start and the end of the one before are different positions.
        place = start + chunk
        goal = target + chunk[source]
        best, back = np.full(len(raw) + len(chunks) + 1, -np.inf), np.full(len(raw) + len(chunks) + 1, -1)
        best[begins + np.arange(len(chunks))] = 0.0
        for a, b in zip(cuts[:-1], cuts[1:]):
            e = order[a:b]
            candidate = best[place[source[e]]] + score[e]
            better = candidate > best[goal[e]]
            e = e[better]
            best[goal[e]], back[goal[e]] = candidate[better], e
        at = ends + np.arange(len(chunks))
        stop = begins + np.arange(len(chunks))
        alive = np.flatnonzero(at > stop)
        found = []
        while len(alive):
            e = back[at[alive]]
            found.append((alive, e))
            at[alive] = place[source[e]]
            alive = alive[at[alive] > stop[alive]]
        if not found:
            return [b"" for _ in chunks]
        owner = np.concatenate([o for o, _ in found])
        edge = np.concatenate([e for _, e in found])
        ordered = np.lexsort((source[edge], owner))
        owner, edge = owner[ordered], edge[ordered]
        unknown = piece[edge] < 0
        width = np.where(unknown, target[edge] - start[source[edge]], 1)
        ids = np.repeat(piece[edge], width)
        offset = np.arange(len(ids)) - np.repeat(np.cumsum(width) - width, width)
        where = np.flatnonzero(np.repeat(unknown, width))
        ids[where] = self.byte_ids[raw[np.repeat(start[source[edge]], width)[where] + offset[where]]]
        cut = 4 * np.cumsum(np.bincount(owner, width, minlength=len(chunks)).astype(np.int64))
        packed = ids.astype("<u4").tobytes()
        return [packed[a:b] for a, b in zip([0, *cut.tolist()], cut.tolist())]

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


class Encoder:
    """A model with the chunks it has segmented."""

    def __init__(self, model: Model):
        self.model, self.memo = model, {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.memo) > worker.MEMO_ENTRIES:
            self.memo.clear()
        memo = self.memo
        marked = [MARKER + t.replace(" ", MARKER) if t else "" for t in texts]
        cut = [_CHUNKS.findall(t) if self.model.split else [t] * bool(t) for t in marked]
        new = list({c for chunks in cut for c in chunks if c not in memo})
        memo.update(zip(new, self.model.segment(new) if new else ()))
        return [b"".join(map(memo.__getitem__, chunks)) for chunks in cut]


def encode_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids array) of all texts, in one pass without a shuffle."""
    return _encoded(docs, model_path, "doc_id long, ids array<int>", lambda model, texts, ids: (pa.array([np.frombuffer(i, "<i4") for i in ids], pa.list_(pa.int32())),))


def decode_documents(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); a null array is the empty text."""
    model = Model.load(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [model.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def summarise_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """Per document the number of pieces and of byte pieces, a checksum of the ids, and whether decoding gives the text back."""

    def columns(model: Model, texts: list[str], ids: list[bytes]) -> tuple:
        is_byte = np.zeros(len(model.raw), dtype=bool)
        is_byte[model.byte_ids] = True
        numbers = [np.frombuffer(i, dtype="<u4") for i in ids]
        return (
            pa.array([len(n) for n in numbers], pa.int64()), pa.array([int(is_byte[n].sum()) for n in numbers], pa.int64()),
            pa.array([zlib.crc32(i) for i in ids], pa.int64()), pa.array([model.decode(n.tolist()) == t for n, t in zip(numbers, texts)]),
        )

    return _encoded(docs, model_path, OUT, columns)


def _encoded(docs: DataFrame, model_path: str, schema: str, columns) -> DataFrame:
    model = Model.load(model_path)
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker.kept(f"pieces {model_path}", lambda: Encoder(model))
        for block in worker.blocks(batches, limit=worker.BLOCK_BYTES // 4):
            texts = [t or "" for t in block.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([block.column(0), *columns(model, texts, encoder.encode(texts))], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
