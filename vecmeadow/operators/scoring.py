"""Nearest-prototype scoring: map-only passes over the queries, one for each slice of the bank.

A slice holds whole labels and is bounded in bytes, so it can be sent to the
workers whatever the bank's size; most banks are one slice. A task multiplies
Arrow batches of queries with the slice, in slabs of bounded size, and keeps the
top ``k`` per row. The slices' winners stay on the row and are merged there, so
nothing is exploded, sorted or shuffled, and no row is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecmeadow.functions import vectors as V
from vecmeadow.functions.arrow import matrix_of, unit_rows
from vecmeadow.operators import bank as B
from vecmeadow.operators.bank import UNKNOWN
from vecmeadow.session import checkpointed

SLICE_BYTES = 16 * 1024 * 1024
# So many slices are passes of one stage, each with its own Python worker.
CHAINED = 8
SLAB_BYTES = 64 * 1024 * 1024
_SQL_TYPES = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}


def cosines(part: tuple, queries: np.ndarray) -> np.ndarray:
    """Best cosine per (query, label)."""
    matrix, labels, starts, mean = part
    q = unit_rows(queries)
    if mean is not None:
        q = unit_rows(q - mean)
    raw = q @ matrix.T
    if len(labels) == matrix.shape[0]:
        return raw
    return np.maximum.reduceat(raw, starts, axis=1)


def pack(labels: list, rows: list, mean: np.ndarray | None = None) -> tuple:
    """``(matrix, labels, starts, mean)``: unit prototypes sorted by label; ``starts`` marks where each label begins.

    A plain tuple, because broadcast values are unpickled where this package may
    not be installed.
    """
    order = sorted(range(len(labels)), key=lambda i: labels[i])
    names, starts = [], []
    for position, i in enumerate(order):
        if not names or names[-1] != labels[i]:
            names.append(labels[i])
            starts.append(position)
    matrix = unit_rows(np.array([rows[i] for i in order], dtype=np.float64))
    if mean is not None:
        matrix = unit_rows(matrix - mean)
    return matrix, names, np.array(starts), mean


def top_columns(scores: np.ndarray, k: int) -> np.ndarray:
    """Column numbers of the ``k`` best per row; equal scores keep the smaller label first."""
    k = min(k, scores.shape[1])
    if k > 8:
        return np.argsort(-scores, axis=1, kind="stable")[:, :k]
    left = scores.copy()
    picked = np.empty((len(scores), k), dtype=np.int64)
    rows = np.arange(len(scores))
    for j in range(k):
        picked[:, j] = left.argmax(axis=1)
        left[rows, picked[:, j]] = -np.inf
    return picked


def _candidate_list(labels: list, scores: np.ndarray, picked: np.ndarray, label_type: pa.DataType) -> pa.Array:
    rows, k = picked.shape
    names = pa.array(labels, type=label_type).take(pa.array(picked.reshape(-1)))
    values = pa.array(np.take_along_axis(scores, picked, axis=1).reshape(-1))
    items = pa.StructArray.from_arrays([names, values], names=["label", "score"])
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * k), items)


def _means(bank: DataFrame, keys: list[str], label: str, prototype: str) -> DataFrame:
    """Mean of the labels' unit centroids, per group; none where there is a single label."""
    centroids = B.fit_bank(bank, [*keys, label], prototype)
    found = centroids.groupBy(*keys).agg(V.vector_mean(V.doubles(F.col("centroid"))).alias("mean"), F.count(F.lit(1)).alias("n"))
    return found.filter("n > 1").select(*keys, "mean")


def _slices(bank: DataFrame, label: str, prototype: str, group: str | None, centring: bool, max_bytes: int) -> Iterator:
    """First the number of slices and the dimension, then the slices as ``{group: packed prototypes}`` of about ``max_bytes``.

    A slice is read when it is asked for and not kept here.
    """
    keys = [group] if group else []
    held = bank.select(label, prototype, *keys).persist()
    means = None
    try:
        shape = held.agg(
            F.count(F.lit(1)).alias("rows"), F.max(F.size(prototype)).alias("dim"), F.min(F.size(prototype)).alias("narrowest")
        ).first()
        if not shape["rows"]:
            yield 1, 0
            yield {}
            return
        if shape["dim"] != shape["narrowest"]:
            raise ValueError("prototypes differ in dimension")
        n = -(-shape["rows"] * shape["dim"] * 8 // max_bytes)
        yield n, shape["dim"]
        means = _means(held, keys, label, prototype).persist() if centring else None
        cut = held.withColumn("__slice", F.pmod(F.xxhash64(*keys, label), F.lit(n)))
        for number in range(n):
            yield _read_slice(cut.filter(F.col("__slice") == number), means, label, prototype, group)
    finally:
        if means is not None:
            means.unpersist()
        held.unpersist()


def _read_slice(part: DataFrame, means: DataFrame | None, label: str, prototype: str, group: str | None) -> dict:
    packed: dict = {}
    for row in part.collect():  # bounded by max_bytes
        names, rows = packed.setdefault(row[group] if group else None, ([], []))
        names.append(row[label])
        rows.append(row[prototype])
    centre = {}
    if means is not None:
        wanted = means.join(part.select(group).distinct(), group, "left_semi") if group else means
        centre = {row[group] if group else None: np.array(row["mean"]) for row in wanted.collect()}
    return {key: pack(names, rows, centre.get(key)) for key, (names, rows) in packed.items()}


def score(
    queries: DataFrame,
    bank: DataFrame,
    k: int = 2,
    vector: str = "embedding",
    label: str = "label",
    prototype: str = "centroid",
    group: str | None = None,
    truth: str | None = None,
    centring: bool = False,
    all_scores: bool = False,
    max_bytes: int = SLICE_BYTES,
    keep_vector: bool = False,
) -> DataFrame:
    """Add ``candidates`` (top ``k`` of ``{label, score}``, best first) to every query.

    ``bank`` may hold several rows per label (sub-prototypes): the label's score
    is their maximum. ``group`` names a column on both sides; a query meets only
    the prototypes of its group. Where there are none, and with an empty bank, the
    candidates are an empty list. ``truth`` adds ``true_score`` and ``rival_score``
    (best other label). ``centring`` moves queries and prototypes by the mean of
    the (group's) bank. The vector column is dropped from the result unless
    ``keep_vector``. Slices of the bank are read, sent and dropped one at a time; after every
    ``CHAINED`` slices the rows and their winners are written to the checkpoint folder and the slices are destroyed
    (in a stream all slices are passes of one stage).
    """
    label_type = bank.schema[label].dataType.simpleString()
    if label_type not in _SQL_TYPES:
        raise TypeError(f"labels must be int, bigint or string, not {label_type}")
    slices = _slices(bank, label, prototype, group, centring, max_bytes)
    count, dim = next(slices)
    candidate = T.ArrayType(
        T.StructType([T.StructField("label", bank.schema[label].dataType), T.StructField("score", T.DoubleType())])
    )
    most = None if all_scores else k

    def merged(scored: DataFrame, parts: list[str]) -> DataFrame:
        """The rows with the winners of ``parts`` (suffixes of the columns of single slices) in ``__c``, ``__t`` and ``__r``."""
        col = lambda kind: [F.col(f"__{kind}{p}") for p in parts]
        columns = [F.col("__c" + parts[0]) if len(parts) == 1 else _best_first(F.flatten(F.array(*col("c"))), most)]
        if truth:
            columns += [F.coalesce(*col("t")), col("r")[0] if len(parts) == 1 else F.greatest(*col("r"))]
        return scored.select(*queries.columns, *[c.alias(f"__{kind}") for c, kind in zip(columns, "ctr")])

    scored, parts, live = queries, [], []
    for number in range(count):
        added = [T.StructField(f"__c{number}", candidate)]
        if truth:
            added += [T.StructField(f"__t{number}", T.DoubleType()), T.StructField(f"__r{number}", T.DoubleType())]
        schema = T.StructType([*scored.schema.fields, *added])
        shipped = queries.sparkSession.sparkContext.broadcast(next(slices))
        scored = scored.mapInArrow(
            _pass(shipped, dim, most, vector, group, truth, _SQL_TYPES[label_type], [f.name for f in added]), schema
        )
        parts.append(str(number))
        live.append(shipped)
        if len(live) == CHAINED and number + 1 < count and not queries.isStreaming:
            scored = checkpointed(merged(scored, parts))
            for done in live:
                done.destroy()
            parts, live = [""], []
    slices.close()
    scored = merged(scored, parts)
    columns = [F.col(c) for c in queries.columns if keep_vector or c != vector] + [F.col("__c").alias("candidates")]
    if truth:
        columns += [F.col("__t").alias("true_score"), F.coalesce("__r", F.lit(0.0)).alias("rival_score")]
    return scored.select(*columns)


def _pass(shipped, dim: int, k: int | None, vector: str, group: str | None, truth: str | None, label_type: pa.DataType, added: list[str]):
    """The function that adds one slice's candidates to Arrow batches of queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index
            if group:
                keys = batch.column(at(group)).to_pylist()
                wanted = {}
                for position, key in enumerate(keys):
                    wanted.setdefault(key, []).append(position)
                pieces = [(key, batch.take(pa.array(rows))) for key, rows in wanted.items()]
            else:
                pieces = [(None, batch)]
            for key, whole in pieces:
                part = shipped.value.get(key)
                wide = 1 if part is None else len(part[0])
                slab = max(1, SLAB_BYTES // (8 * wide))
                for start in range(0, whole.num_rows, slab):
                    piece = whole.slice(start, slab)
                    truths = piece.column(at(truth)).to_pylist() if truth else None
                    if part is None:
                        found, names = np.zeros((piece.num_rows, 0)), []
                    else:
                        found, names = cosines(part, matrix_of(piece.column(at(vector)), dim)), part[1]
                    picked = top_columns(found, len(names) if k is None else k)
                    arrays = [*piece.columns, _candidate_list(names, found, picked, label_type)]
                    if truth:
                        arrays += _true_and_rival(names, found, truths)
                    yield pa.RecordBatch.from_arrays(arrays, names=[*piece.schema.names, *added])

    return run


def _true_and_rival(labels: list, scores: np.ndarray, truths: list) -> tuple[pa.Array, pa.Array]:
    """Score of the true label and the best score of any other label; null where there is none."""
    at = {name: i for i, name in enumerate(labels)}
    columns = np.array([at.get(t, -1) for t in truths], dtype=np.int64)
    rows = np.arange(len(columns))
    known = columns >= 0
    if not labels:
        return pa.nulls(len(rows), pa.float64()), pa.nulls(len(rows), pa.float64())
    own = scores[rows, np.where(known, columns, 0)]
    others = scores.copy()
    others[rows[known], columns[known]] = -np.inf
    rival = others.max(axis=1)
    return pa.array(own, mask=~known), pa.array(rival, mask=np.isneginf(rival))


def _best_first(candidates: Column, k: int | None) -> Column:
    ranked = F.array_sort(
        candidates,
        lambda a, b: F.when(a["score"] > b["score"], -1)
        .when(a["score"] < b["score"], 1)
        .when(a["label"] < b["label"], -1)
        .when(a["label"] > b["label"], 1)
        .otherwise(0),
    )
    return ranked if k is None else F.slice(ranked, 1, k)


def margin_of(candidates: Column) -> Column:
    """Best minus second score; a score that is not there counts as 0."""
    first, second = (F.coalesce(F.get(candidates, F.lit(i))["score"], F.lit(0.0)) for i in (0, 1))
    return first - second


def decide(scored: DataFrame, theta: float, margin: float | None = None) -> DataFrame:
    """Add ``best_label, score, margin, is_known, predicted``. Equality with either bound accepts.

    Without candidates the score is 0 and the prediction ``Unknown``.
    """
    best = F.get("candidates", F.lit(0))
    df = scored.withColumns(
        {"best_label": best["label"], "score": F.coalesce(best["score"], F.lit(0.0)), "margin": margin_of(F.col("candidates"))}
    )
    known = (F.col("score") >= theta) & (F.size("candidates") > 0)
    if margin is not None:
        known = known & (F.col("margin") >= margin)
    df = df.withColumn("is_known", F.coalesce(known, F.lit(False)))
    return df.withColumn("predicted", F.when(F.col("is_known"), F.col("best_label").cast("string")).otherwise(UNKNOWN))


def classify(
    queries: DataFrame, bank: DataFrame, theta: float, margin: float | None = None, k: int = 2, **options
) -> DataFrame:
    """Score and decide in one plan; an empty bank gives ``Unknown`` with score 0."""
    return decide(score(queries, bank, k=max(k, 2), **options), theta, margin)


def candidate_rows(scored: DataFrame, k: int | None, keep: list[str]) -> DataFrame:
    """One row per kept candidate (all without ``k``): ``keep..., rank, label, score``."""
    kept = F.col("candidates") if k is None else F.slice("candidates", 1, k)
    return scored.select(*keep, F.posexplode(kept).alias("__p", "c")).select(
        *keep, (F.col("__p") + 1).cast("long").alias("rank"), F.col("c.label").alias("label"), F.col("c.score").alias("score")
    )


def sub_rows(bank: DataFrame, label: str = "label") -> DataFrame:
    """One row per sub-prototype; a label without any keeps its centroid."""
    usable = F.when(F.size("sub_prototypes") > 0, F.col("sub_prototypes")).otherwise(F.array("centroid"))
    return bank.select(label, F.explode(usable).alias("centroid"))


def headline(scored: DataFrame, recording: str) -> DataFrame:
    """Per recording the most confident known segment, else the most confident one."""
    strength = F.struct("is_known", "score", (-F.col("segment")).alias("s"))
    return scored.groupBy(recording).agg(
        F.max_by(F.struct("segment", "predicted", "score", "is_known"), strength).alias("h")
    ).select(recording, "h.*")
