"""Near-duplicate vectors by product quantisation.

Unit vectors are cut into two halves; each half has its own centroids and a pair
of them is an inverted list, so few centroids give as many lists as the number
of rows asks for. In its list a vector is kept as the codes of its residual, one
byte for each of ``SUBSPACES`` groups of dimensions, and the length of what the codes miss.
A query probes, per half, the centroids whose bisector with its nearest one is
within ``MARGIN`` standard deviations of what a linked vector may differ along
one direction. Per probed list it makes one table of distances to all code words
and adds up entries; a vector whose summed distance, less its own coding error,
is within the link's radius is compared exactly, by cosine in double precision
of the vectors as given. The distance test loses nothing; only probing may.

Each pair is looked up once, by the vector in the list with the smaller number.
Lists are met block by block, so a list of any size is many bounded tasks, and a
block returns counts and a spanning forest of its links, not pairs. Equal
vectors are one node with a multiplicity.

The index is fitted on at most ``SAMPLE`` vectors, the first by a hash of their
ids; all rows are indexed and all are queries. Vectors of different lengths have
no cosine, so each length that occurs has an index of its own. Vectors that are null, zero, or
hold null or non-finite components link with nothing; so do rows with a null id, whose component is null. Rows that
repeat an id are one node with several vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecmeadow.llm.components import connected_components, forest
from vecmeadow.session import scratch_table, small_side

SIMILARITY = 0.95
LIST_SIZE = 256
SUBSPACES = 8
WORDS = 256
MARGIN = 3.5
SAMPLE = 10_000
BLOCK = 2048
QUERIES_AT_ONCE = 512


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((centroids**2).sum(axis=1) - 2 * x @ centroids.T).argmin(axis=1)


def _kmeans(x: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Lloyd's algorithm from evenly spaced rows; an empty cluster keeps its centroid."""
    centroids = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        near = _nearest(x, centroids)
        count = np.bincount(near, minlength=len(centroids))
        sums = np.column_stack([np.bincount(near, x[:, d], minlength=len(centroids)) for d in range(x.shape[1])])
        full = count > 0
        centroids[full] = sums[full] / count[full, None]
    return centroids


@dataclass(frozen=True)
class Index:
    """Half centroids and code words of the residuals' subspaces; ``width`` is the dimension padded to whole subspaces."""

    dim: int
    width: int
    halves: tuple[np.ndarray, np.ndarray]
    words: np.ndarray
    radius: float

    def unit(self, x: np.ndarray) -> np.ndarray:
        x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
        return np.pad(x, ((0, 0), (0, self.width - self.dim)))

    def centroids(self, cell: np.ndarray) -> np.ndarray:
        per = len(self.halves[1])
        return np.concatenate([self.halves[0][cell // per], self.halves[1][cell % per]], axis=1)

    def cells(self, u: np.ndarray) -> np.ndarray:
        half = self.width // 2
        return _nearest(u[:, :half], self.halves[0]) * len(self.halves[1]) + _nearest(u[:, half:], self.halves[1])

    def encode(self, u: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals and the lengths they miss."""
        parts = (u - self.centroids(cell)).reshape(len(u), SUBSPACES, -1)
        codes = np.stack([_nearest(parts[:, m], self.words[m]) for m in range(SUBSPACES)], axis=1).astype(np.uint8)
        missed = parts - self.words[np.arange(SUBSPACES), codes]
        return codes, np.sqrt((missed**2).sum(axis=(1, 2)))

    def probes(self, u: np.ndarray) -> list[np.ndarray]:
        """Per vector the lists after its own that may hold a linked one."""
        half, reach = self.width // 2, MARGIN * self.radius / np.sqrt(self.dim)
        near = []
        for part, c in zip((u[:, :half], u[:, half:]), self.halves):
            d = (c**2).sum(axis=1) - 2 * part @ c.T
            own = d.argmin(axis=1)
            apart = 2 * np.sqrt(((c[own][:, None] - c[None]) ** 2).sum(axis=2))
            near.append((d - d[np.arange(len(d)), own][:, None] <= reach * apart, own))
        per = len(self.halves[1])
        out = []
        for i in range(len(u)):
            cells = (np.flatnonzero(near[0][0][i])[:, None] * per + np.flatnonzero(near[1][0][i])).ravel()
            out.append(cells[cells > near[0][1][i] * per + near[1][1][i]])
        return out

    def distances(self, u: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances of queries to coded vectors of one list, by table lookup."""
        parts = (u - self.centroids(np.array([cell]))).reshape(len(u), SUBSPACES, -1)
        total = np.repeat((parts**2).sum(axis=(1, 2)).astype(np.float32)[:, None], len(codes), axis=1)
        for m in range(SUBSPACES):
            # Without the query's own square, which is the same for all words and stands in the total.
            table = ((self.words[m] ** 2).sum(axis=1) - 2 * parts[:, m] @ self.words[m].T).astype(np.float32)
            total += np.take(table, codes[:, m], axis=1)
        return total


def fit_index(sample: np.ndarray, rows: int, similarity: float = SIMILARITY) -> Index:
    """Centroids for about ``LIST_SIZE`` rows a list, and code words, from sample vectors."""
    dim = sample.shape[1]
    width = -(-dim // SUBSPACES) * SUBSPACES
    radius = float(np.sqrt(2 - 2 * similarity))
    per_half = max(1, int(np.ceil(np.sqrt(rows / LIST_SIZE))))
    shell = Index(dim, width, (np.zeros((1, width // 2)),) * 2, np.zeros((SUBSPACES, 1, width // SUBSPACES)), radius)
    u = shell.unit(sample)
    halves = tuple(_kmeans(part, per_half) for part in (u[:, : width // 2], u[:, width // 2 :]))
    index = Index(dim, width, halves, shell.words, radius)
    parts = (u - index.centroids(index.cells(u))).reshape(len(u), SUBSPACES, -1)
    return Index(dim, width, halves, np.stack([_kmeans(parts[:, m], WORDS) for m in range(SUBSPACES)]), radius)


ENTRIES = "cell int, query boolean, node long, n long, vec binary, codes binary, missed double"


def _entries(index: Index, node: np.ndarray, n: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
    """List entries of vectors, and their query rows for the lists they probe."""
    u = index.unit(x.astype(np.float64))
    cell = index.cells(u)
    codes, missed = index.encode(u, cell)
    probes = index.probes(u)
    again = np.repeat(np.arange(len(x)), [len(p) for p in probes])
    raw, coded = [v.tobytes() for v in x], [c.tobytes() for c in codes]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.r_[cell, *probes].astype(np.int32)), pa.array(np.repeat([False, True], [len(x), len(again)])),
            pa.array(np.r_[node, node[again]]), pa.array(np.r_[n, n[again]]), pa.array(raw + [raw[i] for i in again], pa.binary()),
            pa.array(coded + [b""] * len(again), pa.binary()), pa.array(np.r_[missed, np.zeros(len(again))]),
        ],
        ["cell", "query", "node", "n", "vec", "codes", "missed"],
    )


def _links(index: Index, cell: int, listed: pd.DataFrame, asking: pd.DataFrame, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query number, entry number) of linked pairs, in blocks of queries."""
    kind = np.dtype(np.float32)
    x = np.frombuffer(b"".join(listed["vec"]), dtype=kind).reshape(len(listed), -1).astype(np.float64)
    codes = np.frombuffer(b"".join(listed["codes"]), dtype=np.uint8).reshape(len(listed), SUBSPACES)
    within = (index.radius + listed["missed"].to_numpy() + 1e-4) ** 2
    lengths, nodes = np.sqrt((x * x).sum(axis=1)), listed["node"].to_numpy()
    own = ~asking["query"].to_numpy()
    for start in range(0, len(asking), QUERIES_AT_ONCE):
        rows = asking.iloc[start : start + QUERIES_AT_ONCE]
        q = np.frombuffer(b"".join(rows["vec"]), dtype=kind).reshape(len(rows), -1).astype(np.float64)
        near = index.distances(index.unit(q), cell, codes) <= within
        # Pairs within the list are met from the smaller node only.
        near &= ~own[start : start + len(rows), None] | (rows["node"].to_numpy()[:, None] < nodes[None])
        a, b = np.nonzero(near)
        long_q = np.sqrt((q * q).sum(axis=1))
        if len(a) * 8 > near.size:
            cosine = (q @ x.T)[a, b]
        else:
            cosine = np.einsum("ij,ij->i", q[a], x[b])
        linked = cosine >= similarity * long_q[a] * lengths[b]
        yield a[linked] + start, b[linked]


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_table(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _linked_nodes(good: DataFrame, dim: int, total: int, similarity: float, sample: int) -> DataFrame:
    """Rows (v, node, n_links, component) of the distinct vectors among ``good`` (id, v), all of one length."""
    drawn = good.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toArrow().column(0).combine_chunks()
    index = fit_index(drawn.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64), total, similarity)
    nodes = _stored(good.groupBy("v").agg(F.min("id").alias("node"), F.count("*").alias("n")), "vector-nodes")

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 1024):
                part = batch.slice(start, 1024)
                x = part.column(0).flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)
                yield _entries(index, part.column(1).to_numpy(), part.column(2).to_numpy(), x)

    entries = _stored(nodes.select("v", "node", "n").mapInArrow(enter, ENTRIES), "vector-entries")
    sizes = entries.groupBy("cell").agg(
        F.ceil(F.count_if(~F.col("query")) / BLOCK).cast("int").alias("blocks"), F.ceil(F.count("*") / BLOCK).cast("int").alias("turns")
    ).where("blocks > 0")
    sized = entries.join(small_side(sizes), "cell")
    # A block of the list meets a block of its queries: foreign ones and the list's own vectors.
    block, turn = F.pmod(F.xxhash64("node"), F.col("blocks")), F.pmod(F.xxhash64("node"), F.col("turns"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    listed = sized.where(~F.col("query")).withColumn("turn", every("turns")).withColumn("block", block.cast("int"))
    asking = sized.withColumn("block", every("blocks")).withColumn("turn", turn.cast("int"))
    met = listed.withColumn("asks", F.lit(False)).unionByName(asking.withColumn("asks", F.lit(True)))

    def meet(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("node", kind="stable")
        entry, ask = group[~group["asks"]], group[group["asks"]]
        out = pd.DataFrame({"node": [], "links": [], "peer": []}, dtype="int64")
        if entry.empty or ask.empty:
            return out
        found = list(_links(index, int(key[0]), entry, ask, similarity))
        a, b = (np.concatenate(c) for c in zip(*found))
        if not len(a):
            return out
        both = np.r_[ask["node"].to_numpy(), entry["node"].to_numpy()]
        weight = np.r_[ask["n"].to_numpy(), entry["n"].to_numpy()]
        ids, number = np.unique(both, return_inverse=True)
        i, j = number[a], number[b + len(ask)]
        links = np.bincount(i, weight[b + len(ask)], minlength=len(ids)) + np.bincount(j, weight[a], minlength=len(ids))
        peers = ids[forest(i, j, len(ids))]
        hit = links > 0
        return pd.DataFrame({"node": ids[hit], "links": links[hit].astype(np.int64), "peer": peers[hit]})

    columns = ["cell", "block", "turn", "asks", "query", "node", "n", "vec", "codes", "missed"]
    found = _stored(met.select(*columns).groupBy("cell", "block", "turn").applyInPandas(meet, "node long, links long, peer long"), "vector-links")
    components = connected_components(found.select(F.col("node").alias("a"), F.col("peer").alias("b")))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    per_node = nodes.join(counts, "node", "left").join(components, "node", "left").select(
        "v", "node", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("component")
    )
    return _stored(per_node, "vector-results")


def linked_vectors(vectors: DataFrame, similarity: float = SIMILARITY, id_col: str = "vec_id", vec_col: str = "embedding", sample: int = SAMPLE) -> DataFrame:
    """Rows (id, n_links, component_id, kept), one per row of ``vectors``."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>").alias("v"))
    fits = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    good = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & fits)
    # One row per length, not per vector.
    lengths = good.groupBy(F.size("v").alias("dim")).count().orderBy("dim").collect()
    if not lengths:
        return rows.select(
            F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept")
        )
    linked = reduce(
        DataFrame.unionByName,
        [_linked_nodes(good.where(F.size("v") == dim), dim, total, similarity, sample) for dim, total in lengths],
    )
    usable = F.when(F.col("id").isNotNull() & fits, F.col("v"))
    result = rows.select("id", usable.alias("v")).join(linked, "v", "left")
    component = F.coalesce("component", "id")
    return result.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )
