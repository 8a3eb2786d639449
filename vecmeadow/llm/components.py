"""Connected components of a graph given as links, by contraction.

Each round every node takes its smallest neighbour if that is smaller than
itself, the trees this makes are flattened by pointer jumping, and links are
drawn again between roots. A component loses at least half of its nodes in a
round, and a star of any size is done in one. Minima are summed up before a
shuffle; the joins are plain equi-joins that adaptive execution may split.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecmeadow.session import scratch_table


def forest(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """Within one block: the smallest item that links between items ``a`` and ``b`` lead to, per item."""
    label = np.arange(size)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_table(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _flattened(parents: DataFrame) -> DataFrame:
    """(node, root) from (node, root) whose roots may have roots themselves."""
    while True:
        up = parents.select(F.col("node").alias("root"), F.col("root").alias("top"))
        jumped = _stored(parents.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")), "roots")
        parents = jumped.select("node", "root")
        if not jumped.agg(F.max("moved")).first()[0]:
            return parents


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node with a link to another; the component is its smallest node. Links are (a, b)."""
    links = _stored(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    found = None
    while not links.isEmpty():
        # b > a in each link, so b's smallest neighbour is at most a.
        parents = _flattened(links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")))
        if found is None:
            found = parents
        else:
            up = parents.select(F.col("node").alias("root"), F.col("root").alias("top"))
            found = found.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root")).unionByName(
                parents.join(found.select("node"), "node", "left_anti")
            )
        found = _stored(found, "found")
        of = lambda name: parents.select(F.col("node").alias(name), F.col("root").alias(f"r{name}"))  # noqa: B023, E731
        moved = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(
            F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")
        )
        links = _stored(
            moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links"
        )
    spark = links.sparkSession
    if found is None:
        return spark.createDataFrame([], links.select(F.col("a").alias("node"), F.col("a").alias("component")).schema)
    roots = found.select(F.col("root").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return found.select("node", F.col("root").alias("component")).unionByName(roots.join(found.select("node"), "node", "left_anti"))
