"""Spherical k-means per label, all labels in one job per iteration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecmeadow.functions import vectors as V
from vecmeadow.operators import bank as B
from vecmeadow.operators.ordered import first_rows
from vecmeadow.operators.scoring import score
from vecmeadow.session import checkpointed, small_side


def sub_prototypes(
    df: DataFrame, k: int = 3, iterations: int = 50, tolerance: float = 1e-6, label: str = "label",
    id_col: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """``label, sub, centroid`` for every label with at least ``k`` rows.

    Starts from the first ``k`` rows by id. An empty cluster keeps its centre; a
    label stops when no entry moves by more than ``tolerance + 1e-5 * |entry|``. Each
    iteration is one scoring pass and one partial-sum shuffle.
    """
    start = first_rows(df, [label], [F.col(id_col)], k, "sub")
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= k).select(label)
    centres = start.join(sizes, label, "left_semi").select(
        label, F.col("sub").cast("int").alias("sub"), V.l2(F.col(vector)).alias("centroid"), F.lit(False).alias("done")
    )
    centres = checkpointed(centres)
    for _ in range(iterations):
        moving = centres.filter("NOT done")
        if moving.isEmpty():
            break
        moved = one_iteration(df, moving, label, id_col, vector)
        gap = F.zip_with(
            "centroid", "old", lambda a, b: F.abs(a - b) > tolerance + 1e-5 * F.abs(b)
        )
        moved = moved.withColumn("__moved", F.exists(gap, lambda x: x))
        still = moved.groupBy(label).agg(F.max("__moved").alias("__any"))
        updated = moved.join(still, label).select(label, "sub", "centroid", (~F.col("__any")).alias("done"))
        centres = checkpointed(centres.filter("done").unionByName(updated))
    return centres.drop("done")


def one_iteration(df: DataFrame, centres: DataFrame, label: str, id_col: str, vector: str) -> DataFrame:
    """Assign each row of the centres' labels to the best centre of its own label and recompute the centres."""
    rows = df.select(label, id_col, vector).join(small_side(centres.select(label).distinct()), label, "left_semi")
    near = score(
        rows, centres.withColumn("__g", F.col(label)).select("__g", "sub", "centroid")
        .withColumnRenamed("__g", label), k=1, vector=vector, label="sub", group=label, keep_vector=True,
    )
    assigned = near.withColumn("sub", F.get("candidates", F.lit(0))["label"])
    fresh = B.fit_bank(assigned, [label, "sub"], vector).select(label, "sub", "sum_vector")
    old = centres.select(label, "sub", F.col("centroid").alias("old"))
    usable = F.col("sum_vector").isNotNull() & (V.norm(F.col("sum_vector")) > V.TINY)
    new = F.when(usable, V.l2(F.col("sum_vector"))).otherwise(F.col("old"))
    return old.join(fresh, [label, "sub"], "left").select(label, "sub", new.alias("centroid"), "old")


def adaptive_sub_prototypes(
    df: DataFrame, variance: float = 0.05, k: int = 2, iterations: int = 50, label: str = "label",
    id_col: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """``k`` sub-prototypes for labels whose cosine variance reaches ``variance``, one mean for the others."""
    spread = checkpointed(B.label_spread(df, label, vector))
    wide = spread.filter((F.col("cosine_variance") >= variance) & (F.col("n") >= k)).select(label)
    split = sub_prototypes(df.join(wide, label, "left_semi"), k, iterations, 1e-5, label, id_col, vector)
    single = B.fit_bank(df.join(wide, label, "left_anti"), label, vector)
    return split.unionByName(single.select(label, F.lit(1).alias("sub"), "centroid"))


def with_sub_prototypes(bank: DataFrame, subs: DataFrame, label: str = "label") -> DataFrame:
    """Attach ``sub_prototypes`` to a bank; at most ``k`` vectors per label are collected."""
    lists = subs.groupBy(label).agg(F.array_sort(F.collect_list(F.struct("sub", "centroid"))).alias("__s"))
    return bank.join(lists, label, "left").withColumn(
        "sub_prototypes", F.coalesce(F.transform("__s", lambda s: s["centroid"]), F.array().cast("array<array<double>>"))
    ).drop("__s")
