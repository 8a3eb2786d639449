"""Array-of-number columns as vectors (all JVM-side)."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-12


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product, accumulated in double."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    squares = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    return F.sqrt(squares)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    An expression that is only mentioned inside a lambda would be evaluated again
    for every element; as a lambda variable it is not.
    """
    return F.transform(F.array(value), body)[0]


def l2(v: Column, zero: str = "uniform") -> Column:
    """Unit vector. A norm below 1e-12 gives ``1/sqrt(D)`` everywhere, or with ``zero="keep"`` the vector as it is."""

    def scaled(u: Column, length: Column) -> Column:
        size = F.size(u)
        flat = u if zero == "keep" else F.array_repeat(F.lit(1.0) / F.sqrt(size.cast("double")), size)
        return F.when(length < TINY, flat).otherwise(F.transform(u, lambda x: x / length))

    return let(doubles(v), lambda u: let(norm(u), lambda length: scaled(u, length)))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def centred(v: Column, mean: Column, zero: str = "uniform") -> Column:
    """``l2(v - mean)``."""
    return l2(F.zip_with(v, mean, lambda x, m: x.cast("double") - m), zero=zero)


def of_dimension(v: Column, dim: int) -> Column:
    """True when the vector is present, has ``dim`` entries and all of them are finite."""
    return F.coalesce(
        (F.size(v) == dim)
        & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))),
        F.lit(False),
    )


def require_dimension(v: Column, dim: int) -> Column:
    """The vector itself; the job fails on the first row of another size."""
    problem = F.concat(F.lit(f"expected {dim} dimensions, got "), F.size(v).cast("string"))
    return F.when(F.size(v) == dim, v).otherwise(F.raise_error(problem))


def vector_sum(v: Column) -> Column:
    """Aggregate: element-wise sum with map-side partial sums."""
    return vector_to_array(Summarizer.sum(array_to_vector(doubles(v))))


def vector_mean(v: Column) -> Column:
    """Aggregate: element-wise mean with map-side partial sums."""
    return vector_to_array(Summarizer.mean(array_to_vector(doubles(v))))


def centroid(v: Column) -> Column:
    """Aggregate for ``groupBy().agg()``: the unit sum of unit vectors."""
    return l2(vector_sum(l2(v)))


def sigmoid(x: Column, clip: float = 20.0) -> Column:
    bounded = F.greatest(F.lit(-clip), F.least(F.lit(clip), x))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-bounded))


def argmax(v: Column) -> Column:
    """Zero-based position of the first maximum."""
    return F.array_position(v, F.array_max(v)) - 1


def vec_from_json(text: Column) -> Column:
    return F.from_json(text, "array<double>")


def vec_to_json(v: Column) -> Column:
    return F.to_json(v)


def score_map(label: Column, score: Column, digits: int = 4) -> Column:
    """Aggregate: label to rounded score, one entry per label of one query."""
    pairs = F.array_sort(F.collect_list(F.struct(label.cast("string").alias("k"), F.round(score, digits).alias("v"))))
    return F.map_from_entries(pairs)
