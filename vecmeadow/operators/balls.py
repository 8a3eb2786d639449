"""Vector pairs by angle, without visiting all pairs.

Every unit vector lies in the ball of its nearest pivot. A vector meets another ball only
if both bounds allow a pair that is near enough: the angle to the pivot is at most
the wanted angle plus the ball's radius, and the vector is not further from the plane
between the two pivots than the wanted distance. Small balls that lie near each other share
a block, a large ball is cut into many, and a tile of bounded size is one task's work. On data
without any structure every bound holds and all pairs are compared, as in ``tiles``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecmeadow.functions import vectors as V
from vecmeadow.functions.arrow import matrix_of
from vecmeadow.operators.tiles import ROWS_PER_BLOCK, _arrow
from vecmeadow.session import checkpointed

MOST_PIVOTS = 4096
PIVOT_BYTES = 32 * 1024 * 1024
CANDIDATES = 8
SLAB = 1024
SLACK = 1e-6
MANY = 0.25  # share of visitors and balls from which a tile is compared as a whole


class Reach:
    """Which balls and blocks a vector has to meet for one threshold; goes along with the tasks."""

    def __init__(self, pivots, radius, pack_start, pack_of, block_pack, first_block, chunks, threshold, opposite):
        self.pivots, self.radius = pivots, radius
        self.pack_start, self.pack_of, self.block_pack = pack_start, pack_of, block_pack
        self.first_block, self.chunks = first_block, chunks
        self.angle = np.arccos(np.clip(threshold, -1.0, 1.0)) + SLACK
        self.chord = np.sqrt(max(0.0, 2.0 - 2.0 * threshold)) + SLACK
        self.opposite = opposite

    def balls(self, v, balls=slice(None)):
        """For each row of ``v``, the balls of the selection that may hold a partner."""
        cosines = v @ self.pivots.T
        nearest = cosines.argmax(axis=1)
        gap = cosines.max(axis=1, keepdims=True) - cosines[:, balls]
        apart = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (self.pivots[nearest] @ self.pivots[balls].T)))
        angle = np.arccos(np.clip(cosines[:, balls], -1.0, 1.0))
        return (angle <= self.angle + self.radius[balls]) & (gap <= self.chord * apart + SLACK)

    def own_block(self, ball, key):
        pack = self.pack_of[ball]
        return self.first_block[pack] + (key >> 20) % self.chunks[pack]

    def visits(self, v, ball, key):
        """Row and block of all visits. Of two blocks one visits the other; opposite vectors visit all, their own too."""
        packs = np.logical_or.reduceat(self.balls(-v if self.opposite else v), self.pack_start, axis=1)
        found = packs[:, self.block_pack]
        if not self.opposite:
            own, all_blocks = self.own_block(ball, key)[:, None], np.arange(found.shape[1])[None, :]
            found &= (own != all_blocks) & ((own < all_blocks) == ((own + all_blocks) % 2 == 0))
        return np.nonzero(found)


def _slabs(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for at in range(0, batch.num_rows, SLAB):
            yield batch.slice(at, SLAB)


def _spread(vectors: np.ndarray, most: int) -> np.ndarray:
    """Rows for pivots: the first half of ``most`` as they come, where the data are dense, then always the one furthest from all chosen."""
    chosen = list(range(min(len(vectors), max(1, most // 2))))
    nearest = np.full(len(vectors), -2.0)
    for at in chosen:
        np.maximum(nearest, vectors @ vectors[at], out=nearest)
    while len(chosen) < min(most, len(vectors)):
        chosen.append(int(nearest.argmin()))
        nearest[chosen[-1]] = 2.0
        np.maximum(nearest, vectors @ vectors[chosen[-1]], out=nearest)
    return np.array(chosen)


def _chain(pivots: np.ndarray) -> np.ndarray:
    """An order of the pivots in which each is followed by the nearest one that is left."""
    cosines = (pivots @ pivots.T).astype(np.float32)
    order, at = [], 0
    for _ in range(len(pivots)):
        order.append(at)
        cosines[:, at] = -2.0
        at = int(cosines[at].argmax())
    return np.array(order)


class Cover:
    """Balls over unit vectors ``v``; ``rows`` has their columns, the ball and a hash of the id.

    Rows whose ``v`` is zero or not finite are near nothing and are left out. The driver holds the vectors that pivots are
    chosen from, at most ``PIVOT_BYTES``, and a few numbers per block of ``rows_per_block`` vectors.
    """

    def __init__(self, nodes: DataFrame, id_col: str = "node", rows_per_block: int = ROWS_PER_BLOCK):
        self.rows_per_block = rows_per_block
        nodes = nodes.filter(V.dot(F.col("v"), F.col("v")).between(0.5, 2.0)).withColumn("__key", F.xxhash64(id_col))
        self.count, width = nodes.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
        self.rows = None
        if not self.count:
            return
        most = max(1, min(MOST_PIVOTS, PIVOT_BYTES // (8 * CANDIDATES * width), 2 * int(np.ceil(np.sqrt(self.count)))))
        sample = nodes.orderBy("__key", id_col).limit(CANDIDATES * most).select(id_col, "v").toArrow()
        vectors = matrix_of(sample.column("v"), width)
        chosen = _spread(vectors, most)
        chosen = chosen[_chain(vectors[chosen])]
        self.pivots, self.pivot_ids = vectors[chosen], sample.column(id_col).to_numpy()[chosen]
        self.rows = self._in_balls(nodes)
        self._pack()

    def _in_balls(self, nodes: DataFrame) -> DataFrame:
        pivots = self.pivots
        schema = T.StructType(nodes.schema.fields + [T.StructField("__ball", T.IntegerType()), T.StructField("__angle", T.DoubleType())])
        out = _arrow(schema)

        def assign(batches):
            for part in _slabs(batches):
                cosines = matrix_of(part.column(part.schema.get_field_index("v")), pivots.shape[1]) @ pivots.T
                ball = cosines.argmax(axis=1)
                angle = np.arccos(np.clip(cosines.max(axis=1), -1.0, 1.0))
                columns = part.columns + [pa.array(ball.astype(np.int32)), pa.array(angle)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, out)], schema=out)

        return checkpointed(nodes.mapInArrow(assign, schema))

    def _pack(self) -> None:
        """Balls in chain order fill blocks; a ball over the size of a block is cut into chunks by hash."""
        balls = len(self.pivots)
        sizes, self.radius = np.zeros(balls, dtype=np.int64), np.zeros(balls)
        for r in self.rows.groupBy("__ball").agg(F.count(F.lit(1)).alias("n"), F.max("__angle").alias("far")).collect():
            sizes[r["__ball"]], self.radius[r["__ball"]] = r.n, r.far
        starts, held = [0], 0
        for ball, size in enumerate(sizes):
            if held and held + size > self.rows_per_block:
                starts.append(ball)
                held = 0
            held += size
        self.pack_start = np.array(starts)
        self.pack_of = np.repeat(np.arange(len(starts)), np.diff(starts + [balls]))
        held = np.add.reduceat(sizes, self.pack_start)
        self.chunks = np.maximum(1, -(-held // self.rows_per_block))
        self.first_block = np.concatenate([[0], np.cumsum(self.chunks)[:-1]])
        self.block_pack = np.repeat(np.arange(len(starts)), self.chunks)

    def reach(self, threshold: float, opposite: bool = False) -> Reach:
        return Reach(
            self.pivots, self.radius, self.pack_start, self.pack_of, self.block_pack, self.first_block, self.chunks,
            threshold, opposite,
        )

    def parts(self, reach: Reach) -> np.ndarray:
        """Into how many parts the visitors of each block are cut."""
        blocks = len(self.block_pack)

        def count(batches):
            total = np.zeros(blocks, dtype=np.int64)
            for part in _slabs(batches):
                v, ball, key = (part.column(i) for i in range(3))
                total += np.bincount(reach.visits(matrix_of(v), ball.to_numpy(), key.to_numpy())[1], minlength=blocks)
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"block": pa.array(some), "n": pa.array(total[some])})

        found = np.ones(blocks, dtype=np.int64)
        visitors = self.rows.select("v", "__ball", "__key").mapInArrow(count, "block long, n long")
        for r in visitors.groupBy("block").agg(F.sum("n").alias("n")).collect():
            found[r.block] = max(1, -(-r.n // self.rows_per_block))
        return found

    def tiles(
        self, df: DataFrame, reach: Reach, parts: np.ndarray, fn: Callable[[pa.Table, pa.Table, bool], Iterator[pa.Table]],
        schema: T.StructType,
    ) -> DataFrame:
        """Run ``fn(some, members of a ball, same)`` so that every pair near enough is met once.

        ``df`` has the columns of ``rows`` or more, and some or all of their rows. With ``same`` both tables are one ball.
        """
        spread_schema = T.StructType(
            [T.StructField("__block", T.LongType()), T.StructField("__part", T.LongType()), T.StructField("__visitor", T.BooleanType())]
            + df.schema.fields
        )
        names, out, spread_out = df.columns, _arrow(schema), _arrow(spread_schema)
        at_v, at_ball, at_key = (names.index(c) for c in ("v", "__ball", "__key"))

        def spread(batches):
            for rows in _slabs(batches):
                v, ball, key = matrix_of(rows.column(at_v)), rows.column(at_ball).to_numpy(), rows.column(at_key).to_numpy()
                home = reach.own_block(ball, key)
                copies = parts[home]
                stay = np.repeat(np.arange(len(home)), copies)
                part = np.arange(len(stay)) - np.repeat(np.cumsum(copies) - copies, copies)
                row, block = reach.visits(v, ball, key)
                moved = [(stay, home[stay], part, False), (row, block, (key[row] >> 40) % parts[block], True)]
                for index, blocks, numbers, visitor in moved:
                    for at in range(0, len(index), 8192):
                        cut = slice(at, at + 8192)
                        taken = rows.take(pa.array(index[cut]))
                        columns = [pa.array(blocks[cut]), pa.array(numbers[cut]), pa.array(np.full(taken.num_rows, visitor))]
                        columns = [c.cast(f.type) for c, f in zip(columns + taken.columns, spread_out)]
                        yield pa.RecordBatch.from_arrays(columns, schema=spread_out)

        def compare(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(batches)
            visitor = table.column("__visitor").to_numpy()
            home = table.column("__ball").to_numpy()
            v = matrix_of(table.column("v"))
            balls = np.unique(home[~visitor])
            near = np.empty((len(v), len(balls)), dtype=bool)
            for at in range(0, len(v), SLAB):
                some = v[at : at + SLAB]
                near[at : at + SLAB] = reach.balls(-some if reach.opposite else some, balls)
            if not reach.opposite and near[visitor].size and near[visitor].mean() > MANY:
                # The bounds leave most pairs, so the balls are not looked at one by one.
                members = table.filter(pa.array(~visitor))
                if key[1].as_py() == 0:
                    yield from batches_of(fn(members, members, True))
                yield from batches_of(fn(table.filter(pa.array(visitor)), members, False))
                return
            for number, ball in enumerate(balls):
                inside = ~visitor & (home == ball)
                members = table.take(pa.array(np.flatnonzero(inside)))
                others = visitor
                if key[1].as_py() == 0 and not reach.opposite:
                    yield from batches_of(fn(members, members, True))
                    others = visitor | (home > ball)
                come = np.flatnonzero(others & near[:, number])
                if len(come):
                    yield from batches_of(fn(table.take(pa.array(come)), members, False))

        def batches_of(tables):
            for table in tables:
                yield from table.cast(out).to_batches()

        return df.mapInArrow(spread, spread_schema).groupBy("__block", "__part").applyInArrow(compare, schema)
