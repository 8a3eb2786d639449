"""Session defaults, reliable checkpoints and size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A side is broadcast only when it is proven to hold at most so many rows and bytes.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 * 1024 * 1024
_LOCAL_DIRS: dict[str, str] = {}


def get_spark(app: str = "vecmeadow", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """Build a session; ``master`` and ``partitions`` are for local runs only."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "8192")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").config(
            "spark.ui.showConsoleProgress", "false"
        )
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``.

    A private folder is made only for a local master, where one machine is the
    whole cluster.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="vecmeadow-")
    return _LOCAL_DIRS[app]


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and cut its lineage."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def scratch_table(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder for a table written between stages."""
    root = shared_dir(spark)
    return os.path.join(root, f"{name}-{uuid.uuid4()}")


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes: texts and arrays of numbers by their length, other nested values by their JSON text."""
    size = F.lit(0).cast("long")
    for field in df.schema.fields:
        c, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, (T.StringType, T.BinaryType)):
            own = F.octet_length(c)
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType):
            own = 8 * F.size(c)
        elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            own = F.octet_length(F.to_json(F.struct(c)))
        else:
            own = F.lit(8)
        size = size + F.greatest(F.coalesce(own, F.lit(0)), F.lit(8))
    return size


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only if ``df`` is proven to hold at most ``limit`` rows and ``most_bytes``.

    Beyond a bound the frame comes back unhinted and the join shuffles.
    """
    rows, held = df.limit(limit + 1).agg(F.count(F.lit(1)), F.sum(row_bytes(df))).first()
    return F.broadcast(df) if rows <= limit and (held or 0) <= most_bytes else df
