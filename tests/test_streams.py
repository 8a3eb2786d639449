"""Streaming queries on tables that are folders of files."""

import numpy as np

from vecmeadow import plans


def folder(spark, path):
    """Embeddings as three files in a folder, and the other table that the queries read."""
    m = np.random.default_rng(3).standard_normal((60, 8))
    rows = [(i, [float(x) for x in row], i % 4) for i, row in enumerate(m)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{path}/embeddings.parquet")
    names = [(i, f"n{i}") for i in range(4)]
    spark.createDataFrame(names, "n_nationkey int, n_name string").write.parquet(f"{path}/nation.parquet")
    return str(path)


def test_a_folder_of_files_is_routed_without_a_bank(spark, tmp_path):
    found = plans.queries()["t7_route_without_bank"](spark, folder(spark, tmp_path)).collect()
    assert {r.vec_id for r in found} == set(range(60)) and len(found) == 60
    assert {(r.label, r.confidence, r.quarantined) for r in found} == {("Unknown", 0.0, True)}


def test_a_folder_of_files_is_scored_and_joined(spark, tmp_path):
    path = folder(spark, tmp_path)
    gated = plans.queries()["t8_score_stream"](spark, path).count()
    assert gated == spark.read.parquet(f"{path}/embeddings.parquet").filter("exists(embedding, x -> abs(x) >= float(0.3))").count() > 0
    assert plans.queries()["j13_stream_static_join"](spark, path).count() == 60
