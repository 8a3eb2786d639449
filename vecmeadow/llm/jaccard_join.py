"""Near-duplicate join of word-shingle sets by PartEnum signatures. Exact: no pair at or over the similarity is lost.

Sizes are cut into bands; sets of which one may be similar to the other always
share the one in which the smaller set begins. In a band where sets of up to U begin, a smaller
set and one similar to it differ in at most k = U(1-s)/s elements. The elements are dealt by hash into partitions:

* up to ``SMALL_K`` differences: k + 2 partitions, and every pair of partitions is
  a signature; k differences leave two partitions untouched;
* beyond: k + m + 2w partitions, each a signature of its own; at least m + 2w
  stay untouched, so each set may leave out its w weakest ones (at most
  ``WEAK`` elements), which common phrases would fill, and m are still shared.
  Of the signatures that a node shares with others its m - 1 commonest are left
  out, all ordered by how many nodes have them. The rarest of m common ones has at
  least m - 1 others before it in both nodes' orders, so it stays in both. A node with
  fewer than m goes, which is most of those that have only a common phrase in common.

The last bits of a signature hold its m (1 for pairs of partitions).

Sets with equal digests are one node, found by map-side partial minima; the node
is the smallest id, and rows of the others' signatures are moved to it. Nodes that share a signature are weighed by how many they share. A signature's center
is its weightiest node, a node's home the weightiest center it meets, and each
node is first compared with its home. Where that leaves a signature with nodes in
different components, its nodes are compared with each other in clusters: nodes
of one home are a cluster, and so are those of one center's signatures that span
homes. A cluster
is compared in tiles of two blocks of about ``TILE`` texts and ``TILE_BYTES`` each, which travel compressed: a matrix product counts the common
shingles of all pairs of a tile at once, and the tile returns a spanning forest
of its links, not pairs. Comparisons are of whole texts.

Nulls: a null or empty text has no set and links with nothing; a row with a null
id comes back with a null component. Rows that repeat an id are one document
with several texts; it links when any of them does.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecmeadow.llm import worker
from vecmeadow.llm.components import connected_components, forest
from vecmeadow.llm.shingles import Sets, common, digests, in_blocks, mix, shingle_sets
from vecmeadow.session import scratch_table, small_side

WORDS = 5
PERCENT = 80
SMALL_K = 8
WEAK = 2
NEED = 8  # one signature more is needed for each so many differences
STEP = 1.3
BLOCK = 1024 * 1024
NEED_MASK = 63
TILE = 512
TILE_BYTES = 4 * 1024 * 1024
COLUMNS = 8_192


class Bands:
    """Overlapping size bands: (smallest, largest, differences) such that any two similar sizes share the smaller one's last."""

    def __init__(self, percent: int, reach: int):
        self.rows = []
        low = 1
        while low <= reach:
            following = max(low + 1, int(low * STEP))
            high = (following - 1) * 100 // percent
            # Sets of a <= b elements differ in (a + b)(1 - s)/(1 + s) at most, and b is a/s at most.
            self.rows.append((low, high, (following - 1) * (100 - percent) // percent))
            low = following

    def of(self, size: int) -> list[int]:
        return [i for i, (low, high, _) in enumerate(self.rows) if low <= size <= high]


def signatures(sets: Sets, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, signature) of all non-empty sets."""
    largest = int(sets.sizes.max(initial=0))
    reach = 1 << max(10, largest.bit_length())
    bands = worker.kept(f"bands {percent} {reach}", lambda: Bands(percent, reach))
    lows, highs, ks = (np.array(c) for c in zip(*bands.rows))
    starts, spread = sets.starts(), mix(sets.hashes)
    docs_out, sigs_out = [], []
    last = np.searchsorted(lows, sets.sizes, side="right") - 1
    for back in range(4):  # sizes lie in at most so many bands, see the assertion
        band = last - back
        inside = (sets.sizes > 0) & (band >= 0)
        inside &= highs[np.maximum(band, 0)] >= sets.sizes
        members = np.flatnonzero(inside)
        if not len(members):
            continue
        band, k = band[members], ks[band[members]]
        small = k <= SMALL_K
        slack = np.where(small, 0, 1 + k // 20)
        need = np.where(small, 1, np.minimum(1 + k // NEED, NEED_MASK))
        cells = np.where(small, k + 2, k + need + 2 * slack)
        base = np.cumsum(cells) - cells
        sizes = sets.sizes[members]
        at = np.repeat(starts[members] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        salt = mix(band.astype(np.uint64) + np.uint64(1))
        cell = np.repeat(base, sizes) + ((spread[at] >> np.uint64(11)) % np.repeat(cells, sizes).astype(np.uint64)).astype(np.int64)
        total, count = np.zeros(cells.sum(), dtype=np.uint64), np.bincount(cell, minlength=cells.sum())
        np.add.at(total, cell, mix(sets.hashes[at] + np.uint64(0x51ED270B)))
        owner = np.repeat(np.arange(len(members)), cells)
        number = (np.arange(len(total)) - base[owner]).astype(np.uint64)
        # Large sets: each partition but the w weakest.
        large = np.flatnonzero(~small[owner])
        if len(large):
            order = large[np.lexsort((total[large], count[large], owner[large]))]
            rank = np.arange(len(order))
            rank = rank - np.maximum.accumulate(np.where(np.r_[True, owner[order][1:] != owner[order][:-1]], rank, 0))
            held = order[(rank >= slack[owner[order]]) | (count[order] > WEAK)]
            docs_out.append(members[owner[held]])
            found = mix(total[held] + salt[owner[held]] + mix(number[held] + np.uint64(7)))
            sigs_out.append((found & ~np.uint64(NEED_MASK)) | need[owner[held]].astype(np.uint64))
        # Small sets: every pair of partitions.
        for value in np.unique(k[small]):
            rows = np.flatnonzero(small & (k == value))
            of = total[base[rows][:, None] + np.arange(value + 2)]
            for pair, (a, b) in enumerate(combinations(range(value + 2), 2)):
                docs_out.append(members[rows])
                # Which partitions they are counts as well as what is in them.
                found = mix(mix(of[:, a] + np.uint64(3 * pair + 1)) + of[:, b] + salt[rows])
                sigs_out.append((found & ~np.uint64(NEED_MASK)) | np.uint64(1))
    assert not ((sets.sizes > 0) & (last >= 4) & (highs[np.maximum(last - 4, 0)] >= sets.sizes)).any()
    if not docs_out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(docs_out), np.concatenate(sigs_out).view(np.int64)


def _texts(column) -> list[str]:
    return [t or "" for t in column.to_pylist()]


class Unpacked(Sequence):
    """Texts that are unpacked when they are asked for."""

    def __init__(self, packed: list[bytes]):
        self.packed = packed

    def __len__(self) -> int:
        return len(self.packed)

    def __getitem__(self, at):
        if isinstance(at, slice):
            return [zlib.decompress(b).decode("utf-8", "surrogatepass") for b in self.packed[at]]
        return zlib.decompress(self.packed[at]).decode("utf-8", "surrogatepass")


def shingle_classes(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n_shingles, h1, h2) per row."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in worker.blocks(batches, limit=BLOCK):
            sets = shingle_sets(_texts(block.column(1)), words)
            h1, h2 = digests(sets)
            yield pa.RecordBatch.from_arrays(
                [block.column(0), pa.array(sets.sizes.astype(np.int64)), pa.array(h1), pa.array(h2)], ["doc_id", "n_shingles", "h1", "h2"]
            )

    return docs.select("doc_id", "text").mapInArrow(digest, "doc_id long, n_shingles long, h1 long, h2 long")


def signature_rows(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(signature, node): one document of each distinct set of a task gives the set's signatures."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for block in worker.blocks(batches, limit=BLOCK):
            sets = shingle_sets(_texts(block.column(1)), words)
            fresh = np.zeros(len(block), dtype=bool)
            for i, key in enumerate(zip(*(h.tolist() for h in digests(sets)))):
                if key not in seen:
                    seen.add(key)
                    fresh[i] = True
            kept = fresh[sets.doc]
            doc, signature = signatures(Sets(sets.doc[kept], sets.hashes[kept], np.where(fresh, sets.sizes, 0)), percent)
            ids = block.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(signature), pa.array(ids[doc])], ["signature", "node"])

    named = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    return named.mapInArrow(sign, "signature long, node long")


def similar(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose ``packed_texts`` reach the similarity."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in worker.blocks(batches, "size", BLOCK):
            left, right = (shingle_sets(Unpacked(block.column(c).to_pylist())[:], words) for c in ("packed_a", "packed_b"))
            both = common(left, right)
            linked = (both > 0) & (100 * both >= percent * (left.sizes + right.sizes - both))
            yield block.select(["a", "b"]).filter(pa.array(linked))

    of = lambda side: texts.select(F.col("node").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in ("size", "packed")))
    both = pairs.join(of("a"), "a").join(of("b"), "b").withColumn("size", F.col("size_a") + F.col("size_b"))
    return both.select("a", "b", "size", "packed_a", "packed_b").mapInArrow(compare, "a long, b long")


def packed_texts(texts: DataFrame) -> DataFrame:
    """(node, size, packed) of rows (node, text): the text's bytes and its compressed form."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in worker.blocks(batches, limit=BLOCK):
            raw = [t.encode("utf-8", "surrogatepass") for t in _texts(block.column(1))]
            yield pa.RecordBatch.from_arrays(
                [block.column(0), pa.array([len(b) for b in raw], pa.int64()), pa.array([zlib.compress(b, 1) for b in raw], pa.binary())],
                ["node", "size", "packed"],
            )

    return texts.select("node", "text").mapInArrow(pack, "node long, size long, packed binary")


def tile_links(texts: Sequence[str], words: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of positions whose texts reach the similarity."""
    sets = in_blocks(texts, words, BLOCK)
    _, column, count = np.unique(sets.hashes, return_inverse=True, return_counts=True)
    shared = count[column] > 1
    number = (np.cumsum(count > 1) - 1)[column[shared]]
    row = sets.doc[shared]
    both = np.zeros((len(texts), len(texts)), dtype=np.float32)
    for low in range(0, int(number.max(initial=-1)) + 1, COLUMNS):
        part = (number >= low) & (number < low + COLUMNS)
        has = np.zeros((len(texts), COLUMNS), dtype=np.float32)
        has[row[part], number[part] - low] = 1
        both += has @ has.T
    sizes = sets.sizes[:, None] + sets.sizes
    return np.nonzero(np.triu((both > 0) & (100 * both.astype(np.int64) >= percent * (sizes - both.astype(np.int64))), 1))


def links_in_clusters(clusters: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) that join the similar nodes of each cluster, from rows (node, cluster)."""
    held = clusters.join(texts.groupBy("node").agg(F.sum("size").alias("size")), "node").groupBy("cluster").agg(
        F.count("*").alias("n"), F.sum("size").alias("size")
    )
    blocks = F.ceil(F.greatest(F.col("n") / TILE, F.col("size") / TILE_BYTES)).cast("int")
    sizes = held.where("n > 1").select("cluster", F.greatest(blocks, F.lit(1)).alias("blocks"))
    placed = clusters.join(sizes, "cluster").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # A node's block meets every block of its cluster once.
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "node", "cluster", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")
    )

    def tile(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node", ignore_index=True)
        a, b = tile_links(Unpacked(rows["packed"].tolist()), words, percent)
        root = forest(a, b, len(rows))
        ids = rows["node"].to_numpy()
        moved = root != np.arange(len(rows))
        return pd.DataFrame({"a": ids[moved], "b": ids[root[moved]]})

    return met.join(texts.select("node", "packed"), "node").groupBy("cluster", "low", "high").applyInPandas(tile, "a long, b long")


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_table(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id), one per row of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = _stored(shingle_classes(docs, words), "shingle-sets")
    # Written first, so that the join back stands alone and a hot class's partition can be split.
    classes = _stored(
        rows.where("n_shingles > 0 and doc_id is not null").groupBy("h1", "h2").agg(F.min("doc_id").alias("class")), "class-ids"
    )
    members = _stored(rows.join(classes, ["h1", "h2"]).select("doc_id", "class").where("doc_id is not null").distinct(), "set-classes")

    by_signature, by_node = Window.partitionBy("signature"), Window.partitionBy("node")
    low, high = F.min("node").over(by_signature), F.max("node").over(by_signature)
    shared = _stored(
        signature_rows(docs, words, percent).select("signature", "node", low.alias("low"), high.alias("high"))
        .where("low < high").select("signature", "node"),
        "signatures",
    )
    # A copy stands for its class, so that signatures which only copies share go. An id with several sets stands for itself.
    standing = small_side(
        members.groupBy("doc_id").agg(F.min("class").alias("class"), F.count("*").alias("sets")).where("sets = 1 and class <> doc_id")
        .select(F.col("doc_id").alias("node"), "class")
    )
    shared = (
        shared.join(standing, "node", "left").select("signature", F.coalesce("class", "node").alias("node"))
        .repartition("signature").dropDuplicates(["signature", "node"])
        .select("signature", "node", low.alias("low"), high.alias("high"), F.count("*").over(by_signature).alias("n"))
        .where("low < high").drop("low", "high")
    )
    # Nodes with too few shared signatures go, as do the commonest of the others, and then signatures with one node left.
    place = F.row_number().over(Window.partitionBy("node", "need").orderBy(F.desc("n"), "signature"))
    shared = (
        shared.withColumn("need", F.col("signature").bitwiseAND(NEED_MASK)).withColumn("place", place).where("place >= need")
        .withColumn("weight", F.count("*").over(by_node)).select("signature", "node", "weight")
    )
    best = F.max(F.struct("weight", (-F.col("node")).alias("back"))).over(by_signature)
    centered = _stored(
        shared.select("signature", "node", low.alias("low"), high.alias("high"), best.alias("best")).where("low < high")
        .select("signature", "node", (-F.col("best.back")).alias("center"), F.col("best.weight").alias("heft")),
        "centers",
    )
    candidates = docs.join(small_side(centered.select("node").distinct()), F.col("doc_id") == F.col("node"), "left_semi")
    texts = _stored(packed_texts(candidates.select(F.col("doc_id").alias("node"), "text")), "candidate-texts")
    homes = _stored(
        centered.groupBy("node").agg((-F.max(F.struct("heft", (-F.col("center")).alias("back")))["back"]).alias("home")), "homes"
    )
    pairs = homes.where("node <> home").select(F.least("node", "home").alias("a"), F.greatest("node", "home").alias("b")).distinct()
    copies = members.where("doc_id <> class").select(F.col("doc_id").alias("a"), F.col("class").alias("b"))
    links = _stored(similar(pairs, texts, words, percent).unionByName(copies), "similar")
    found = _stored(connected_components(links), "components")
    # Signatures whose nodes are in more than one component.
    least, most = F.min("component").over(by_signature), F.max("component").over(by_signature)
    mixed = _stored(
        centered.join(found, "node", "left")
        .select("signature", "node", "center", F.coalesce("component", "node").alias("component"))
        .select("signature", "node", "center", least.alias("least"), most.alias("most"))
        .where("least < most").drop("least", "most").join(homes, "node"),
        "mixed-signatures",
    )
    if not mixed.isEmpty():
        first, last = F.min("home").over(by_signature), F.max("home").over(by_signature)
        across = mixed.select("node", "center", first.alias("first"), last.alias("last")).where("first < last")
        cluster = lambda kind, of: F.struct(F.lit(kind).alias("kind"), F.col(of).alias("of")).alias("cluster")
        clusters = _stored(
            mixed.select("node", cluster(0, "home")).distinct().unionByName(across.select("node", cluster(1, "center")).distinct()), "clusters"
        )
        links = links.unionByName(_stored(links_in_clusters(clusters, texts, words, percent), "similar"))
        found = _stored(connected_components(links), "components")
    component = members.select("doc_id").distinct().join(found.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").select(
        F.col("doc_id").alias("id"), F.coalesce("component", "doc_id").alias("component")
    )
    return rows.join(component, rows["doc_id"] == component["id"], "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")
    )
