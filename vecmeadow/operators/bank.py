"""Prototype banks: mergeable centroid state per label."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecmeadow.functions import vectors as V
from vecmeadow.functions.arrow import group_codes, list_column, matrix_of, unit_rows
from vecmeadow.operators.ordered import first_rows
from vecmeadow.session import checkpointed, small_side

UNKNOWN = "Unknown"


# A task hands over its partial sums when they fill this many bytes.
PARTIAL_BYTES = 64 * 1024 * 1024


def partial_sums(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """``keys, sum_vector, n_support`` with about one row per key and task.

    Unit vectors are added up batch by batch before anything is shuffled, which
    is the map-side combine of a sum whose values are whole vectors.
    """
    schema = T.StructType(
        [df.schema[k] for k in keys]
        + [T.StructField("sum_vector", T.ArrayType(T.DoubleType())), T.StructField("n_support", T.LongType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def handed_over():
            columns = list(zip(*held))
            arrays = [pa.array(c, type=t) for c, t in zip(columns, types)]
            sums = list_column(np.array([v[0] for v in held.values()]))
            counts = pa.array([v[1] for v in held.values()], type=pa.int64())
            return pa.RecordBatch.from_arrays([*arrays, sums, counts], names=[*keys, "sum_vector", "n_support"])

        types: list = []
        dim = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            columns = [batch.column(i) for i in range(len(keys))]
            types = [c.type for c in columns]
            units = unit_rows(matrix_of(batch.column(len(keys)), dim))
            dim = units.shape[1]
            first, number = group_codes(columns)
            order = np.argsort(number, kind="stable")
            counts = np.bincount(number)
            sums = np.add.reduceat(units[order], np.r_[0, np.cumsum(counts)[:-1]], axis=0)
            names = zip(*[c.take(pa.array(first)).to_pylist() for c in columns])
            for name, total, n in zip(names, sums, counts.tolist()):
                if name in held:
                    before, m = held[name]
                    held[name] = (before + total, m + n)
                else:
                    held[name] = (total, n)
            if len(held) * dim * 8 > PARTIAL_BYTES:
                yield handed_over()
                held.clear()
        if held:
            yield handed_over()

    return df.select(*keys, vector).mapInArrow(run, schema)


def fit_bank(df: DataFrame, keys: list[str] | str = "label", vector: str = "embedding") -> DataFrame:
    """Labelled vectors to ``keys, centroid, n_support, sum_vector``.

    One shuffle of partial sums, so a label that holds most of the rows costs no
    more than the others.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    return with_centroid(_merged(partial_sums(df, keys, vector), keys), keys)


def _merged(sums: DataFrame, keys: list[str]) -> DataFrame:
    return sums.groupBy(*keys).agg(
        V.vector_sum(F.col("sum_vector")).alias("sum_vector"), F.sum("n_support").alias("n_support")
    )


def with_centroid(state: DataFrame, keys: list[str]) -> DataFrame:
    return state.select(*keys, V.l2(F.col("sum_vector")).alias("centroid"), "n_support", "sum_vector")


def update_bank(bank: DataFrame, df: DataFrame, keys: list[str] | str = "label", vector: str = "embedding") -> DataFrame:
    """Merge new vectors into the bank; an unseen label is enrolled."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return merge_banks(bank, fit_bank(df, keys, vector), keys)


def merge_banks(a: DataFrame, b: DataFrame, keys: list[str] | str = "label") -> DataFrame:
    """Add the running sums of two banks. Associative, so shards can be merged in any order."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    columns = [*keys, "sum_vector", "n_support"]
    merged = _merged(a.select(*columns).unionByName(b.select(*columns)), keys)
    return with_centroid(merged, keys)


def remove_labels(bank: DataFrame, labels: list, label: str = "label") -> DataFrame:
    return bank.filter(~F.col(label).isin(labels))


def clear_bank(bank: DataFrame) -> DataFrame:
    return bank.filter(F.lit(False))


def prototype_of(bank: DataFrame, value, label: str = "label") -> DataFrame:
    return bank.filter(F.col(label) == value).select(label, "centroid")


def list_labels(bank: DataFrame, by: str = "label") -> DataFrame:
    return bank.select(by).distinct().orderBy(by)


def enrol_split(
    df: DataFrame, k: int, label: str = "label", id_col: str = "vec_id"
) -> tuple[DataFrame, DataFrame]:
    """First ``k`` rows of each label by id, and the rest.

    The split needs only each label's k-th id, so the wide rows are never
    sorted: one small aggregate of ids and one join on the label.
    """
    ids = first_rows(df.select(label, id_col), [label], [F.col(id_col)], k)
    last = checkpointed(ids.groupBy(label).agg(F.max(id_col).alias("__last")))
    # One row per label: broadcast if that is proven small, so the vectors are not shuffled.
    marked = df.join(small_side(last), label)
    enrolled = marked.filter(F.col(id_col) <= F.col("__last")).drop("__last")
    held_out = marked.filter(F.col(id_col) > F.col("__last")).drop("__last")
    return enrolled, held_out


def global_mean(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """One row ``mean``."""
    return df.agg(V.vector_mean(V.doubles(F.col(vector))).alias("mean"))


def mean_as_column(df: DataFrame, vector: str = "embedding") -> Column:
    """The mean as a constant array: one vector of D numbers, whatever the row count."""
    row = global_mean(df, vector).first()
    return F.array(*[F.lit(float(x)) for x in row["mean"]]) if row and row["mean"] is not None else F.lit(None)


def centre(df: DataFrame, vector: str = "embedding", mean: Column | None = None, zero: str = "keep") -> DataFrame:
    """Subtract the mean from the unit vectors and renormalise."""
    unit = V.l2(F.col(vector))
    if mean is None:
        mean = mean_as_column(df.select(unit.alias("__u")), "__u")
    return df.withColumn(vector, V.centred(unit, mean, zero=zero))


def label_spread(df: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """Population variance of the cosine to the label's own unit mean, per label.

    Two passes over the vectors; the second meets one mean per label.
    """
    units = df.select(label, V.l2(F.col(vector), zero="keep").alias("__u"))
    means = units.groupBy(label).agg(V.vector_sum(F.col("__u")).alias("__s")).select(
        label, V.l2(F.col("__s"), zero="keep").alias("__m")
    )
    scored = units.join(small_side(checkpointed(means)), label).select(label, V.dot(F.col("__u"), F.col("__m")).alias("c"))
    return scored.groupBy(label).agg(
        F.var_pop("c").alias("cosine_variance"), F.count(F.lit(1)).alias("n")
    )
