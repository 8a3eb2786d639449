"""All-pairs vector work in bounded tiles.

Rows are spread over blocks by a hash of their id, so no block depends on how
the vectors or labels are distributed. A task sees two blocks, multiplies them
and returns only what its function keeps (sums, extremes, or pairs above a
threshold) - never the full product.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401 - used as pa.compute in tasks
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS_PER_BLOCK = 16_384


def _blocks(rows: int, per_block: int) -> int:
    return max(1, -(-rows // per_block))


def _block_of(column: str, blocks: int):
    return F.pmod(F.xxhash64(column), F.lit(blocks)).cast("int")


def self_tiles(
    df: DataFrame, id_col: str, fn: Callable[[pa.Table, pa.Table, bool], Iterator[pa.Table]], schema: T.StructType,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Run ``fn(block_a, block_b, same)`` once for every unordered pair of blocks.

    ``fn`` yields tables as it goes, so a tile with many results is streamed out
    and never held as a whole.
    """
    blocks = _blocks(df.count(), rows_per_block)
    own = F.col("__own")
    spread = (
        df.withColumn("__own", _block_of(id_col, blocks))
        .withColumn("__other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        .withColumn("__a", F.least(own, F.col("__other")))
        .withColumn("__b", F.greatest(own, F.col("__other")))
        .drop("__other")
    )
    out = _arrow(schema)

    def apply(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = key[0].as_py(), key[1].as_py()
        table = pa.Table.from_batches(batches)
        owner = table.column("__own")
        one = table.filter(pa.compute.equal(owner, a))
        two = one if a == b else table.filter(pa.compute.equal(owner, b))
        if one.num_rows and two.num_rows:
            for part in fn(one, two, a == b):
                yield from part.cast(out).to_batches()

    return spread.groupBy("__a", "__b").applyInArrow(apply, schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)
