"""Exact row-order computations (rank, previous row, running sum and maximum) that survive hot keys.

A plain window sorts a whole key in one task. Here a key with more than
``limit`` rows is cut into chunks that follow its order, the window runs inside
each chunk, and one summary row per chunk carries the state across. Cut points
come from a bounded sketch, but any cut point gives the same exact result. When
one order value fills a chunk alone, that chunk is cut again on the tie column.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from vecmeadow.session import checkpointed, small_side

ROWS_PER_TASK = 2_000_000
TIE_CUTS = 256
BLOCK = 64
# Cut points of all hot groups are broadcast only up to this size.
POINT_BYTES = 64 * 1024 * 1024
CHUNK = "__chunk"


@dataclass(frozen=True)
class Step:
    """One computed column: what a chunk contributes, how contributions combine, and the row's own part."""

    value: Column | None
    per_chunk: Callable[[Column], Column]
    across: Callable[[Column], Column]
    local: Callable[[Column, WindowSpec], Column]
    join: Callable[[Column, Column], Column]


def position() -> Step:
    """Position in the group, from 1."""
    return Step(
        F.lit(1).cast("long"), F.count, F.sum, lambda v, w: F.row_number().over(w).cast("long"),
        lambda own, carry: own + F.coalesce(carry, F.lit(0)),
    )


def total(value: Column) -> Step:
    """Sum of ``value`` up to and including the row."""
    return Step(
        value, F.sum, F.sum, lambda v, w: F.sum(v).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        lambda own, carry: own + F.coalesce(carry, F.lit(0)),
    )


def highest(value: Column, inclusive: bool = True) -> Step:
    """Largest ``value`` so far, null while there is none; ``greatest`` skips nulls, so an absent carry changes nothing."""
    upto = 0 if inclusive else -1
    return Step(
        value, F.max, F.max, lambda v, w: F.max(v).over(w.rowsBetween(Window.unboundedPreceding, upto)), F.greatest
    )


def before(value: Column) -> Step:
    """``value`` of the row before, null on the first row of the group. It is wrapped so that a null value is kept."""
    return Step(
        F.struct(value.alias("v")), lambda v: F.max_by(v, F.col("__at")), F.last, lambda v, w: F.lag(v).over(w),
        lambda own, carry: F.coalesce(own, carry)["v"],
    )


@dataclass(frozen=True)
class Ordered:
    """Rows of each group in ascending (order, tie); ``split`` is true when hot groups were cut."""

    df: DataFrame
    keys: tuple[str, ...]
    order: str
    tie: str
    split: bool
    largest: int
    staged: bool = False

    def columns(self, **steps: Step) -> Ordered:
        """Add one column per step; the steps share one summary of the chunks and one join."""
        parts = [*self.keys, CHUNK] if self.split else list(self.keys)
        window = Window.partitionBy(*parts).orderBy(self.order, self.tie)
        if not self.split:
            none = F.lit(None)
            added = {out: _alone(s, window, none) for out, s in steps.items()}
            return replace(self, df=self.df.withColumns(added))
        # A summary reads its input a second time; storing the input of a later
        # stage keeps the reads from doubling with every stage.
        source = checkpointed(self.df) if self.staged else self.df
        names = list(steps)
        value = {out: f"__v{i}" for i, out in enumerate(names)}
        df = source.withColumns({value[out]: s.value for out, s in steps.items()})
        df = df.withColumn("__at", F.struct(F.col(self.order).alias("o"), F.col(self.tie).alias("t")))
        summary = df.filter(F.col(CHUNK) >= 0).groupBy(*self.keys, CHUNK).agg(
            *[s.per_chunk(F.col(value[out])).alias(f"__t{i}") for i, (out, s) in enumerate(steps.items())]
        )
        earlier = Window.partitionBy(*self.keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
        carry = summary.select(
            *self.keys, CHUNK,
            *[s.across(F.col(f"__t{i}")).over(earlier).alias(f"__c{i}") for i, s in enumerate(steps.values())],
        )
        df = df.join(carry, [*self.keys, CHUNK], "left")
        df = df.withColumns(
            {
                out: s.join(s.local(F.col(value[out]), window), F.col(f"__c{i}"))
                for i, (out, s) in enumerate(steps.items())
            }
        )
        temporary = ["__at", *value.values(), *[f"__c{i}" for i in range(len(names))]]
        return replace(self, df=df.drop(*temporary), staged=True)

    def result(self) -> DataFrame:
        return self.df.drop(CHUNK)


def _alone(step: Step, window: WindowSpec, none: Column) -> Column:
    """A step over whole groups, where nothing is carried."""
    own = step.local(step.value, window)
    return own if step.join is F.greatest else step.join(own, none)


def arrange(df: DataFrame, keys: list[str], order: str, tie: str, limit: int = ROWS_PER_TASK) -> Ordered:
    """Prepare ``df`` for ordered work per ``keys`` (non-null) by the numeric columns ``order`` then ``tie``.

    ``(order, tie)`` has to be unique inside a group. One counting job decides
    whether any group is hot; only hot groups are cut.
    """
    counts = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"), F.min(tie).alias("__lo"), F.max(tie).alias("__hi")
    )
    largest = counts.agg(F.max("__n")).first()[0] or 0
    if largest <= limit:
        return Ordered(df, tuple(keys), order, tie, False, largest)
    cuts = 4 * -(-largest // limit)
    fractions = [(i + 1) / (cuts + 1) for i in range(cuts)]
    hot = checkpointed(counts.filter(F.col("__n") > limit))
    points = (
        df.join(small_side(hot.select(*keys)), keys, "left_semi")
        .groupBy(*keys)
        .agg(F.percentile_approx(order, fractions, max(10_000, 4 * cuts)).alias("__points"))
        .withColumn("__points", F.array_sort(F.array_distinct("__points")))
        .withColumn("__coarse", F.filter("__points", lambda p, i: i % BLOCK == 0))
        .join(hot.select(*keys, "__lo", "__hi"), keys)
    )
    points = checkpointed(points)
    at = F.col(order)
    # Points below the value: whole blocks by their first points, then one block.
    block = F.size(F.filter("__coarse", lambda p: p < at))
    inner = F.slice("__points", F.greatest(block - 1, F.lit(0)) * BLOCK + 1, F.lit(BLOCK))
    below = F.when(block == 0, F.lit(0)).otherwise(
        (block - 1) * BLOCK + F.size(F.filter(inner, lambda p: p < at))
    )
    equal = F.coalesce(F.get("__points", F.col("__below")) == at, F.lit(False))
    width = F.col("__hi").cast("double") - F.col("__lo").cast("double") + 1.0
    inside = F.floor((F.col(tie).cast("double") - F.col("__lo").cast("double")) / width * TIE_CUTS)
    chunk = (F.col("__below") * 2 + equal.cast("long")) * (TIE_CUTS + 1) + F.when(equal, inside).otherwise(F.lit(0))
    cut = (
        df.join(small_side(points, max(1, POINT_BYTES // (cuts * 8))), keys, "left")
        .withColumn("__below", F.when(F.col("__points").isNotNull(), below))
        .withColumn(CHUNK, F.coalesce(chunk.cast("long"), F.lit(-1).cast("long")))
        .drop("__points", "__coarse", "__below", "__lo", "__hi")
    )
    return Ordered(cut, tuple(keys), order, tie, True, largest)


def numbered(df: DataFrame, keys: list[str], order: str, tie: str, out: str, limit: int = ROWS_PER_TASK) -> DataFrame:
    """``row_number`` per group without putting a hot group in one task."""
    return arrange(df, keys, order, tie, limit).columns(**{out: position()}).result()


def ranked_globally(df: DataFrame, order: list[Column], out: str = "rank") -> DataFrame:
    """Rank all rows by ``order`` with a distributed sort.

    The sorted rows are checkpointed, so each partition's size and row positions
    stay fixed; a rank is the position in the partition plus the sizes before it.
    """
    rows = checkpointed(df.orderBy(*order)).withColumn("__at", F.monotonically_increasing_id())
    part = F.shiftright("__at", 33)
    sizes = rows.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    # One row per shuffle partition.
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    joined = rows.withColumn("__part", part).join(F.broadcast(offsets), "__part")
    position = F.col("__at") - F.shiftleft("__part", 33)
    return joined.withColumn(out, position + F.col("__before") + 1).drop("__at", "__part", "__before")


def first_rows(df: DataFrame, keys: list[str], order: list[Column], n: int, out: str = "rank") -> DataFrame:
    """The first ``n`` rows per group. Spark keeps only ``n`` rows per group and task before it shuffles."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(window).cast("long")).filter(F.col(out) <= n)
