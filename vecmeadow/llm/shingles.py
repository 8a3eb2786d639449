"""Word shingles of many texts at once, as 64-bit hashes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

from vecmeadow.llm import worker

_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_ROOM = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(30))) * _A
    h = (h ^ (h >> np.uint64(27))) * _B
    return h ^ (h >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse modulo 2^64, as long as the longest block so far needs."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)
        self.bytes = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            size = -(-n // _ROOM) * _ROOM
            self.up, self.down = (
                np.cumprod(np.r_[np.ones(1, np.uint64), np.full(size, b, dtype=np.uint64)]) for b in (_BASE, pow(_BASE, -1, 1 << 64))
            )


@dataclass
class Sets:
    """Distinct shingle hashes by document: ``hashes`` sorted within ``doc``, which ascends; ``sizes`` per document."""

    doc: np.ndarray
    hashes: np.ndarray
    sizes: np.ndarray

    def starts(self) -> np.ndarray:
        return np.cumsum(self.sizes) - self.sizes


def shingle_sets(texts: list[str], words: int) -> Sets:
    """Sets of ``words``-word shingles over lower-cased (A-Z) words between ASCII white space.

    A text with fewer words has its whole sequence as one shingle, one without words none.
    """
    encoded = [t.encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([len(b) + 1 for b in encoded], dtype=np.int64)
    raw = np.frombuffer(b" ".join(encoded) + b" ", dtype=np.uint8)
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.flatnonzero(np.diff(np.r_[True, blank, True].view(np.int8)))
    begin, end = edge[::2], edge[1::2]
    powers = worker.kept("shingle powers", _Powers)
    powers.reach(len(raw) + 1)
    lower = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)
    prefix = np.r_[np.zeros(1, np.uint64), np.cumsum(powers.bytes[lower] * powers.up[: len(raw)])]
    # A span's prefix difference, moved to position 0, is a polynomial of its bytes alone.
    word = mix((prefix[end] - prefix[begin]) * powers.down[begin] + (end - begin).astype(np.uint64))
    doc = np.repeat(np.arange(len(texts)), sizes)[begin] if len(begin) else np.zeros(0, np.int64)
    per_doc = np.bincount(doc, minlength=len(texts))
    n = len(word) - words + 1
    full = np.flatnonzero(doc[:n] == doc[words - 1 :]) if n > 0 else np.zeros(0, np.int64)
    h = np.zeros(len(full), dtype=np.uint64)
    for i in range(words):
        h = mix(h * _A + word[full + i])
    short = np.flatnonzero((per_doc > 0) & (per_doc < words))
    first = np.cumsum(per_doc) - per_doc
    tails = np.zeros(len(short), dtype=np.uint64)
    for at, d in enumerate(short):
        own = np.full(1, per_doc[d], dtype=np.uint64)
        for w in word[first[d] : first[d] + per_doc[d]]:
            own = mix(own * _B + w)
        tails[at] = own[0]
    owner, h = np.r_[doc[full], short], np.r_[h, tails]
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    new = np.r_[True, (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])] if len(h) else np.zeros(0, bool)
    owner, h = owner[new], h[new]
    return Sets(owner, h, np.bincount(owner, minlength=len(texts)))


def in_blocks(texts: Sequence[str], words: int, limit: int) -> Sets:
    """``shingle_sets`` of many texts, made in blocks of about ``limit`` characters so that working memory stays small."""
    parts, start, held = [], 0, 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= limit or i == len(texts) - 1:
            found = shingle_sets(texts[start : i + 1], words)  # a slice is a list, also of texts that are unpacked on demand
            parts.append(Sets(found.doc + start, found.hashes, found.sizes))
            start, held = i + 1, 0
    if not parts:
        return shingle_sets([], words)
    return Sets(*(np.concatenate([getattr(p, name) for p in parts]) for name in ("doc", "hashes", "sizes")))


def digests(sets: Sets) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit sums over each set; 0 for an empty one."""
    out = []
    for seed in (_A, _B):
        total = np.zeros(len(sets.sizes), dtype=np.uint64)
        np.add.at(total, sets.doc, mix(sets.hashes ^ seed))
        out.append(total.view(np.int64))
    return out[0], out[1]


def common(a: Sets, b: Sets) -> np.ndarray:
    """Size of the intersection of the i-th set of ``a`` with the i-th of ``b``."""
    doc, h = np.r_[a.doc, b.doc], np.r_[a.hashes, b.hashes]
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    twice = (doc[1:] == doc[:-1]) & (h[1:] == h[:-1])
    return np.bincount(doc[1:][twice], minlength=len(a.sizes))
