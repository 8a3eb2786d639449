"""Quality classifier by Bradley-Terry ranking.

A document's utility is a linear function of features of its whole text. It is
learnt from preference pairs (a document labelled 1 is preferred to one labelled
0) by logistic loss on the difference of their features. Documents are accepted
by a quantile of the training utilities, the share labelled 0; the score is a
logistic curve that passes through ``threshold`` there.

The model is fitted on at most ``sample`` labelled documents, the first by a hash
of their ids; everything else covers all rows. Rows with a null label do not
train. Without both labels every score is 0.5. A null text is the empty text,
whose features are all 0. Null and repeated ids are scored like any others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecmeadow.llm import worker

SAMPLE = 4000
PAIRS_PER_DOC = 8
THRESHOLD = 0.3
SLOPE = 1.0
L2 = 1e-3
BLOCK_BYTES = 1 << 20  # class codes take 16 bytes a byte of text
CLASSES = 10  # lower, upper, digit, blank, line end, punctuation, "!", "|", other ASCII, other bytes


def _byte_classes() -> np.ndarray:
    of = np.full(256, 8, dtype=np.int64)
    of[128:] = 9
    for number, characters in enumerate(
        ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\r\n", ".,;:'\"?()-", "!", "|")
    ):
        of[[ord(c) for c in characters]] = number
    return of


def features(texts: list[str]) -> np.ndarray:
    """One row of features per text."""
    encoded = [t.encode() for t in texts]
    sizes = np.array([len(b) for b in encoded])
    raw = np.frombuffer(b"".join(encoded), dtype=np.uint8)
    counts = np.bincount(
        np.repeat(np.arange(len(texts)) * CLASSES, sizes) + _byte_classes()[raw], minlength=len(texts) * CLASSES
    ).reshape(-1, CLASSES)
    shares = np.sqrt(counts / np.maximum(sizes, 1)[:, None])
    loud = counts[:, 1] / np.maximum(counts[:, 0] + counts[:, 1], 1)
    spoken = []
    for text in texts:
        words, lines = text.split(), text.split("\n")
        n = len(words)
        spoken.append((
            np.log1p(len(set(words))) / np.log1p(n) if n else 0.0,
            sum(map(eq, words, words[1:])) / n if n else 0.0,
            len(text) / n if n else 0.0,
            len(set(lines)) / len(lines) if text else 0.0,
        ))
    spoken = np.array(spoken, dtype=float).reshape(-1, 4)
    spoken[:, 2] = np.log1p(spoken[:, 2])
    return np.column_stack([shares, loud, spoken, np.log1p(sizes)])


@dataclass(frozen=True)
class Ranking:
    """A fitted model: feature scaling, weights, and the utility at which the score is ``threshold``."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    threshold: float

    def utility(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.weights.any():
            return np.full(len(x), 0.5)
        odds = SLOPE * (self.utility(x) - self.cut) + np.log(self.threshold / (1 - self.threshold))
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def fit_ranking(x: np.ndarray, labels: np.ndarray, threshold: float = THRESHOLD, pairs: int = PAIRS_PER_DOC) -> Ranking:
    """Weights that minimise the logistic loss over pairs of a preferred and a rejected document."""
    dim = x.shape[1]
    good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    if not len(good) or not len(bad):
        return Ranking(np.zeros(dim), np.ones(dim), np.zeros(dim), 0.0, threshold)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = (x - mean) / scale
    # Every document of either label meets several of the other.
    more = max(len(good), len(bad)) * pairs
    left, right = good[np.arange(more) % len(good)], bad[(np.arange(more) * 7 + np.arange(more) // len(bad)) % len(bad)]
    d = z[left] - z[right]
    w = np.zeros(dim)
    for _ in range(50):
        p = 1 / (1 + np.exp(np.clip(d @ w, -500, 500)))
        gradient = L2 * w - d.T @ p / len(d)
        hessian = L2 * np.eye(dim) + (d * (p * (1 - p))[:, None]).T @ d / len(d)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    cut = float(np.quantile(z @ w, len(bad) / (len(good) + len(bad)), method="midpoint"))
    return Ranking(mean, scale, w, cut, threshold)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, limit: int) -> DataFrame:
    """(text, label) of at most ``limit`` labelled documents, the first by a hash of the id."""
    chosen = (
        labels.where(F.col(label).isin(0, 1) & learn)
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    )
    # At most ``limit`` rows: their number bounds the broadcast.
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "label")


def train(docs: DataFrame, labels: DataFrame, learn: Column | None = None, sample: int = SAMPLE, threshold: float = THRESHOLD) -> Ranking:
    """Fit on the labelled documents for which ``learn`` (a condition on ``doc_id``) holds."""
    learn = F.lit(True) if learn is None else F.coalesce(learn, F.lit(False))

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in worker.blocks(batches, limit=BLOCK_BYTES):
            x = features([t or "" for t in block.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array(list(x)), block.column(1)], ["x", "label"])

    rows = labelled_sample(docs, labels, "quality", learn, sample).mapInArrow(featurise, "x array<double>, label int").toPandas()
    if rows.empty:
        return fit_ranking(np.zeros((0, features([""]).shape[1])), np.zeros(0), threshold)
    rows = rows.sort_values(["label", "x"], key=lambda c: c.map(tuple) if c.name == "x" else c)
    return fit_ranking(np.array(rows["x"].tolist()), rows["label"].to_numpy(), threshold)


def score_documents(docs: DataFrame, model: Ranking, name: str = "score") -> DataFrame:
    """All columns of ``docs`` and ``name``, which replaces a column of that name, in one pass without a shuffle."""
    docs = docs.drop(name)
    schema = docs.select("*", F.lit(0.0).alias(name)).schema

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in worker.blocks(batches, limit=BLOCK_BYTES):
            texts = block.column(block.schema.get_field_index("text")).to_pylist()
            found = model.score(features([t or "" for t in texts]))
            yield pa.RecordBatch.from_arrays([*block.columns, pa.array(found)], [*block.schema.names, name])

    return docs.mapInArrow(score, schema)
