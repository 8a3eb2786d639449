"""Novel groups among rejected vectors: similar pairs, exact leader clustering, promotion.

Equal vectors are merged into one weighted node first, so a vector copied a
million times costs as much as one. Similarity work runs between balls that the threshold lets meet.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecmeadow.functions import vectors as V
from vecmeadow.functions.arrow import matrix_of
from vecmeadow.operators import bank as B
from vecmeadow.operators.balls import Cover
from vecmeadow.operators.ordered import first_rows, ranked_globally
from vecmeadow.operators.tiles import ROWS_PER_BLOCK, self_tiles
from vecmeadow.session import checkpointed

# Above this many similar pairs the links are not stored; every round then
# compares them again and keeps only one number per node.
STORED_PAIRS = 2_000_000_000
UNITED = 16  # rounds whose taken nodes are kept apart


def cohesion(df: DataFrame, cluster: str, vector: str = "embedding") -> DataFrame:
    """Mean cosine of the members to their centroid.

    It equals ``|sum of unit vectors| / n``, so one aggregate is enough.
    """
    bank = B.fit_bank(df, cluster, vector)
    return bank.select(
        cluster,
        F.round(V.norm(F.col("sum_vector")) / F.col("n_support"), 4).alias("cohesion"),
        F.col("n_support").alias("n_samples"),
    )


def distinct_vectors(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per different vector: smallest id as ``node``, number of copies as ``weight``."""
    return df.groupBy(vector).agg(F.min(id_col).alias("node"), F.count(F.lit(1)).alias("weight"))


def unit_nodes(df: DataFrame, id_col: str, vector: str, centring: bool) -> DataFrame:
    nodes = distinct_vectors(df, id_col, vector)
    unit = V.l2(F.col(vector))
    if centring:
        mean = B.mean_as_column(df.select(unit.alias("__u")), "__u")
        unit = V.centred(unit, mean, zero="keep")
    return nodes.select("node", "weight", unit.alias("v"))


def _hits(a, b, threshold: float, same: bool):
    """Pairs of one tile that reach ``threshold`` as ``(rows, columns, cosines)``; of one table with itself, each pair once and every row with itself.

    Single precision finds them, less its error, and double precision decides. Inputs are unit vectors already.
    """
    width = len(a.column("v")[0])
    left, right = matrix_of(a.column("v"), width), matrix_of(b.column("v"), width)
    low = np.float32(threshold - (width + 8) * 2.0**-22)
    few, many = left.astype(np.float32), right.astype(np.float32)
    slab, some = max(1, 2_000_000 // len(right)), max(1, 4_000_000 // width)
    for at in range(0, len(left), slab):
        start = at if same else 0
        rows, columns = np.nonzero(few[at : at + slab] @ many[start:].T >= low)
        if 20 * len(rows) > slab * (len(right) - start):
            found = left[at : at + slab] @ right[start:].T
            rows, columns = np.nonzero(found >= threshold)
            cosines = found[rows, columns]
        else:
            cosines = np.concatenate([
                np.einsum("ij,ij->i", left[rows[i : i + some] + at], right[columns[i : i + some] + start]) for i in range(0, len(rows), some)
            ] or [np.zeros(0)])
        keep = cosines >= threshold
        if same:
            keep &= rows <= columns
        yield rows[keep] + at, columns[keep] + start, cosines[keep]


class Pairing:
    """Runs a function over all pairs of nodes that can reach ``threshold``: by balls, or by all tiles where zero vectors count too."""

    def __init__(self, nodes: DataFrame, threshold: float, rows_per_block: int = ROWS_PER_BLOCK):
        self.nodes, self.rows_per_block, self.cover = nodes, rows_per_block, None
        if threshold > 0:
            self.cover = Cover(nodes.select("node", "v"), "node", rows_per_block)
            if self.cover.count:
                self.reach = self.cover.reach(threshold)
                self.parts = self.cover.parts(self.reach)

    def run(self, fn, schema: T.StructType, values: DataFrame | None = None) -> DataFrame:
        """``values`` (node, value) restricts the nodes and adds its column."""
        if self.cover is None or not self.cover.count:
            base = self.nodes.select("node", "v")
            base = base if self.cover is None else base.limit(0)
            return self_tiles(base if values is None else base.join(values, "node"), "node", fn, schema, self.rows_per_block)
        base = self.cover.rows if values is None else self.cover.rows.join(values, "node")
        return self.cover.tiles(base, self.reach, self.parts, fn, schema)


def similar_nodes(pairing: Pairing, threshold: float) -> DataFrame:
    """``a < b, cosine`` for all pairs of nodes that reach ``threshold``."""
    schema = T.StructType(
        [T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("cosine", T.DoubleType())]
    )

    def pairs(one, two, same):
        left, right = one.column("node").to_numpy(), two.column("node").to_numpy()
        for rows, columns, c in _hits(one, two, threshold, same):
            x, y = left[rows], right[columns]
            keep = x != y if same else np.ones(len(x), dtype=bool)
            x, y, c = x[keep], y[keep], c[keep]
            if len(x):
                yield pa.table({"a": np.minimum(x, y), "b": np.maximum(x, y), "cosine": c})

    return pairing.run(pairs, schema)


def similar_pairs(
    df: DataFrame, threshold: float, id_col: str = "vec_id", vector: str = "embedding", centring: bool = False,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """All pairs of different vectors with cosine at least ``threshold``.

    Copies are counted, not enumerated: ``copies_a`` and ``copies_b`` say how
    many rows each side stands for (``distinct_vectors`` maps rows to nodes).
    """
    nodes = checkpointed(unit_nodes(df, id_col, vector, centring))
    pairs = similar_nodes(Pairing(nodes, threshold, rows_per_block), threshold)
    side = lambda s: nodes.select(F.col("node").alias(s), F.col("weight").alias(f"copies_{s}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "cosine", "copies_a", "copies_b")


def _pair_fold(pairing: Pairing, values: DataFrame, threshold: float, how: str) -> DataFrame:
    """Per node, fold ``value`` (null = absent) over its closed neighbourhood without storing a link."""
    schema = T.StructType([T.StructField("node", T.LongType()), T.StructField("folded", T.LongType())])
    smallest = how == "min"

    def side(nodes, known, values, rows, columns):
        rows, columns = rows[known[columns]], columns[known[columns]]
        if smallest:
            best = np.full(len(nodes), np.iinfo(np.int64).max)
            np.minimum.at(best, rows, values[columns])
        else:
            best = np.zeros(len(nodes), dtype=np.int64)
            np.add.at(best, rows, values[columns])
        hit = np.bincount(rows, minlength=len(nodes)) > 0
        return pa.table({"node": nodes[hit], "folded": best[hit]})

    def fold(one, two, same):
        left, right = one.column("node").to_numpy(), two.column("node").to_numpy()
        known, values = zip(*((t.column("value").is_valid().to_numpy(), t.column("value").fill_null(0).to_numpy()) for t in (one, two)))
        for rows, columns, _ in _hits(one, two, threshold, same):
            yield side(left, known[1], values[1], rows, columns)
            apart = rows != columns if same else slice(None)
            yield side(right, known[0], values[0], columns[apart], rows[apart])

    folded = pairing.run(fold, schema, values.select("node", "value"))
    agg = F.min("folded") if smallest else F.sum("folded")
    return folded.groupBy("node").agg(agg.alias("folded"))


def _pair_count(pairing: Pairing, threshold: float, enough: int) -> int:
    """Number of similar ordered pairs; pairs are only compared if all together could pass ``enough``."""
    rows = pairing.nodes.count()
    if rows * rows <= enough:
        return rows * rows

    def count(one, two, same):
        n = sum(len(rows) if not same else 2 * len(rows) - int((rows == columns).sum()) for rows, columns, _ in _hits(one, two, threshold, same))
        yield pa.table({"n": pa.array([n if same else 2 * n], pa.int64())})

    return pairing.run(count, T.StructType([T.StructField("n", T.LongType())])).agg(F.sum("n")).first()[0] or 0


def _leaders_of_links(nodes: DataFrame, pairs: DataFrame, threshold: float, min_size: int) -> DataFrame:
    """``node, leader`` of all taken nodes, from stored links.

    A link (node, candidate) lives while the candidate is undecided and no known leader below it is near the node. A round
    reads the living links once: by candidate for the verdicts, by node for the leaders and the first candidate that is left.
    """
    around = Window.partitionBy("node")
    link = lambda node, candidate: F.struct(F.col(node).alias("node"), F.col(candidate).alias("candidate"))
    both = pairs.select(F.explode(F.array(link("a", "b"), link("b", "a"))).alias("l")).select("l.*")
    itself = nodes.filter(V.dot(F.col("v"), F.col("v")) >= threshold).select("node", F.col("node").alias("candidate"))
    links = both.unionByName(itself).join(nodes.select("node", "weight"), "node")
    links = checkpointed(links.withColumn("first", F.min("candidate").over(around)))
    taken = [nodes.select("node", F.col("node").alias("leader")).limit(0)]
    while not links.isEmpty():
        votes = links.groupBy("candidate").agg(
            F.sum("weight").alias("free"), F.sum(F.expr("CASE WHEN first = candidate THEN weight ELSE 0 END")).alias("sure"),
            F.min(F.expr("CASE WHEN node = candidate THEN first END")).alias("own"),
        )
        leads = F.expr(f"CASE WHEN own = candidate AND sure >= {min_size} THEN true WHEN own IS NULL OR free < {min_size} THEN false END")
        judged = links.join(votes.select("candidate", leads.alias("leads")), "candidate")
        judged = judged.withColumn("leader", F.min(F.expr("CASE WHEN leads THEN candidate END")).over(around))
        judged = judged.filter("candidate = leader OR (leads IS NULL AND (leader IS NULL OR candidate < leader))")
        judged = checkpointed(judged.withColumn("first", F.min(F.expr("CASE WHEN leads IS NULL THEN candidate END")).over(around)))
        taken.append(judged.filter("candidate = leader").select("node", "leader"))
        if len(taken) == UNITED:
            taken = [checkpointed(reduce(DataFrame.unionByName, taken))]
        links = judged.filter("leads IS NULL").select("node", "candidate", "weight", "first")
    return checkpointed(reduce(DataFrame.unionByName, taken).groupBy("node").agg(F.min("leader").alias("leader")))


def _leaders_by_comparing(pairing: Pairing, threshold: float, min_size: int) -> DataFrame:
    """The same without a stored link: a round compares the pairs twice and keeps a few numbers per node."""
    state = pairing.nodes.select("node", "weight", F.lit(None).cast("boolean").alias("leads"))
    while True:
        first = _pair_fold(pairing, state.select("node", F.expr("CASE WHEN coalesce(leads, true) THEN node END").alias("value")), threshold, "min")
        verdicts = state.select(F.col("node").alias("first"), F.col("leads").alias("first_leads"))
        near = checkpointed(
            state.join(first.withColumnRenamed("folded", "first"), "node", "left").join(verdicts, "first", "left")
            .withColumn("open", F.expr("first IS NOT NULL AND first_leads IS NULL"))
        )
        if near.filter("leads IS NULL").isEmpty():
            return near.filter("first_leads").select("node", F.col("first").alias("leader"))
        free = _pair_fold(pairing, near.select("node", F.expr("CASE WHEN open THEN weight END").alias("value")), threshold, "sum")
        sure = near.filter("open").groupBy(F.col("first").alias("node")).agg(F.sum("weight").alias("sure"))
        judged = F.expr(
            f"CASE WHEN leads IS NOT NULL THEN leads WHEN first = node AND sure >= {min_size} THEN true "
            f"WHEN NOT open OR coalesce(folded, 0) < {min_size} THEN false END"
        )
        state = checkpointed(near.join(sure, "node", "left").join(free, "node", "left").select("node", "weight", judged.alias("leads")))


def leader_clusters(
    df: DataFrame, threshold: float = 0.5, min_size: int = 3, id_col: str = "vec_id", vector: str = "embedding",
    centring: bool = True, rows_per_block: int = ROWS_PER_BLOCK, stored_pairs: int = STORED_PAIRS,
) -> DataFrame:
    """Exact leader clustering in id order: ``id, leader`` for every clustered row.

    In id order, a free vector whose free neighbours (itself included) number at
    least ``min_size`` takes them all; otherwise it stays free. So a vector belongs to the smallest leader near it, and a vector
    leads if no smaller leader is near it and enough of its neighbours have none below it. Each round decides every
    vector whose answer no undecided one can change: it leads if it is the first candidate (leader or undecided) around
    itself and around enough neighbours, and never will if a smaller leader is near or too few neighbours are left.
    The smallest undecided vector is always among them; in random order few rounds decide all.
    """
    nodes = checkpointed(unit_nodes(df, id_col, vector, centring))
    pairing = Pairing(nodes, threshold, rows_per_block)
    if _pair_count(pairing, threshold, stored_pairs) <= stored_pairs:
        taken = _leaders_of_links(nodes, similar_nodes(pairing, threshold), threshold, min_size)
    else:
        taken = _leaders_by_comparing(pairing, threshold, min_size)
    copies = distinct_vectors(df, id_col, vector).select(vector, "node").join(taken, "node").select(vector, "leader")
    return df.select(id_col, vector).join(copies, vector).select(id_col, "leader")


def describe_clusters(df: DataFrame, members: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per cluster in leader order: number, id, size, cohesion and raw-space centroid."""
    rows = df.select(id_col, vector).join(members, id_col)
    stats = B.fit_bank(rows, "leader", vector)
    ranked = ranked_globally(stats.select("leader"), [F.col("leader")], "number")
    return stats.join(ranked, "leader").select(
        "number", F.format_string("Novel_Cluster_%02d", "number").alias("cluster_id"), "leader",
        F.col("n_support").alias("n_samples"),
        F.round(V.norm(F.col("sum_vector")) / F.col("n_support"), 4).alias("cohesion"), "centroid", "sum_vector",
    )


def example_members(members: DataFrame, n: int = 5, id_col: str = "vec_id") -> DataFrame:
    """The first ``n`` member ids of each cluster, for listings."""
    return first_rows(members, ["leader"], [F.col(id_col)], n, "place")


def promote(
    bank: DataFrame, df: DataFrame, members: DataFrame, names: DataFrame, id_col: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """Enrol clusters under new labels (``names``: leader, label); a label already in the bank is replaced."""
    rows = df.select(id_col, vector).join(members, id_col).join(names, "leader")
    fresh = B.fit_bank(rows, "label", vector)
    return bank.join(fresh.select("label"), "label", "left_anti").unionByName(fresh)


def assign_clusters(quarantine: DataFrame, members: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """Write the cluster into ``cluster_id`` of the quarantined rows that are members; others keep theirs."""
    new = members.select(id_col, F.col("leader").alias("__new"))
    return quarantine.join(new, id_col, "left").withColumn("cluster_id", F.coalesce("__new", "cluster_id")).drop("__new")
