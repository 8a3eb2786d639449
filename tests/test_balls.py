"""Pairs by balls against all pairs, and how many of them are compared."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from test_vectors import frame, unit

from vecmeadow.operators import evaluate as E, novelty as N


def clusters(rows, centres, noise, width=32, seed=7):
    rng = np.random.default_rng(seed)
    return unit(unit(rng.standard_normal((centres, width)))[np.arange(rows) % centres] + noise * rng.standard_normal((rows, width)))


@pytest.mark.parametrize("rows_per_block", [40, 16_384])
@pytest.mark.parametrize("t", [0.2, 0.9, -0.1])
def test_pairs_by_balls_are_all_pairs(spark, t, rows_per_block):
    m = np.vstack([clusters(240, 8, 0.06, 12), np.random.default_rng(1).standard_normal((60, 12)), np.zeros((1, 12))])
    m[50:150] = clusters(100, 1, 0.02, 12)  # a third in one ball
    got = {(r.a, r.b) for r in N.similar_nodes(N.Pairing(frame(spark, m).select(F.col("vec_id").alias("node"), F.lit(1).alias("weight"), F.expr("embedding").alias("v")).filter("node < 240"), t, rows_per_block), t).collect()}
    c = np.triu(m[:240] @ m[:240].T >= t, 1)
    assert got == set(zip(*(x.tolist() for x in np.nonzero(c))))
    odd = frame(spark, m)
    u = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    u[-1] = 1 / np.sqrt(12)
    c = np.triu(u @ u.T >= t, 1)
    pairs = N.similar_pairs(odd, t, rows_per_block=rows_per_block).select("a", "b").collect()
    assert {(r.a, r.b) for r in pairs} == set(zip(*(x.tolist() for x in np.nonzero(c))))


def test_few_pairs_are_compared_on_clustered_data(spark):
    m = clusters(3000, 60, 0.03)
    nodes = frame(spark, m).select(F.col("vec_id").alias("node"), F.col("embedding").alias("v"))
    count = lambda one, two, same: iter([pa.table({"n": [len(one) * (len(one) - 1) // 2 if same else len(one) * len(two)]})])
    for rows_per_block in (200, 16_384):
        pairing = N.Pairing(nodes, 0.8, rows_per_block)
        compared = pairing.run(count, T.StructType([T.StructField("n", T.LongType())])).agg(F.sum("n")).first()[0]
        similar = int(np.triu(m @ m.T >= 0.8, 1).sum())
        assert similar <= compared < len(m) * (len(m) - 1) // 2 / 10


@pytest.mark.parametrize("rows_per_block", [50, 16_384])
def test_extremes_and_moments(spark, rows_per_block):
    for m in (clusters(400, 9, 0.05), np.random.default_rng(3).standard_normal((150, 5)), np.eye(2), -np.eye(3)[[0, 0]]):
        c = (unit(m) @ unit(m).T)[np.triu_indices(len(m), 1)]
        r = E.pair_statistics(frame(spark, m), rows_per_block=rows_per_block).first()
        assert r.pairs == len(c)
        assert np.allclose([r.min_cosine, r.max_cosine, r.mean_cosine, r.std_cosine], [c.min(), c.max(), c.mean(), c.std()], atol=2e-6)


def test_pairs_of_few_rows(spark):
    df = frame(spark, np.eye(3))
    assert tuple(E.pair_statistics(df.limit(1)).first()) == (1 - 1, None, None, None, None)
    assert tuple(E.pair_statistics(df.limit(0)).first()) == (0, None, None, None, None)
    assert N.similar_pairs(df.limit(0), 0.5).isEmpty() and N.similar_pairs(df, 0.5).isEmpty()
