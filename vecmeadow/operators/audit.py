"""Quality rules as columns: every row keeps the reasons it fails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecmeadow.functions import vectors as V


def reasons(rules: dict[str, Column]) -> Column:
    """Names of the rules whose condition holds (a null condition counts as not holding)."""
    return F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]))


def clip_audit(
    df: DataFrame, rate: str = "rate", channels: str = "channels", frames: str = "frames",
    lowest: str = "lowest", highest: str = "highest", mean: str = "mean", rms: str = "rms", non_finite: str = "non_finite",
    want_rate: int = 48_000, want_frames: int = 144_000, dc: float = 0.01, least_rms: float = 0.001,
    peak_range: tuple[float, float] = (0.05, 1.0001),
) -> DataFrame:
    """Add ``reasons`` and ``passed`` to a table of per-clip statistics."""
    peak = F.greatest(F.abs(F.col(lowest)), F.abs(F.col(highest)))
    found = reasons(
        {
            "sample rate": F.col(rate) != want_rate,
            "channels": F.col(channels) != 1,
            "length": F.col(frames) != want_frames,
            "not finite": F.col(non_finite) > 0,
            "dc offset": F.abs(F.col(mean)) >= dc,
            "too quiet": F.col(rms) <= least_rms,
            "peak low": peak < peak_range[0],
            "peak high": peak > peak_range[1],
        }
    )
    return df.withColumn("reasons", found).withColumn("passed", F.size("reasons") == 0)


def vector_audit(
    df: DataFrame, variant: DataFrame, dim: int, least_cosine: float, id_col: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """Dimension, finiteness, unit norm and agreement with a second embedding of the same clips."""
    both = df.select(id_col, F.col(vector).alias("__v")).join(
        variant.select(id_col, F.col(vector).alias("__w")), id_col, "left"
    )
    v = F.col("__v")
    found = reasons(
        {
            "dimension": F.size(v) != dim,
            "not finite": F.exists(v, lambda x: F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))),
            "norm": F.abs(V.norm(v) - 1.0) >= 1e-5,
            "no variant": F.col("__w").isNull(),
            "variant": F.col("variant_cosine") < least_cosine,
        }
    )
    return (
        both.withColumn("variant_cosine", V.cosine(v, F.col("__w")))
        .withColumn("reasons", found)
        .withColumn("passed", F.size("reasons") == 0)
        .drop("__v", "__w")
    )
