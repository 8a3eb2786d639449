"""Event-time windows, running counts and progress metrics."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.types import StructType


def file_stream(
    spark: SparkSession, path: str, schema: StructType, glob: str | None = None, files_per_trigger: int | None = None
) -> DataFrame:
    """A Parquet folder as a stream. ``files_per_trigger`` bounds how much one micro-batch holds."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def event_time(stream: DataFrame, column: str, delay: str) -> DataFrame:
    """Make ``column`` a zoned event time (UTC session) with a watermark of ``delay``."""
    return stream.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def sliding(stream: DataFrame, time: str, size: str, hop: str, keys: list[str], aggregates: list[Column]) -> DataFrame:
    """Overlapping windows per key; ``stream`` carries a watermark on ``time``."""
    grouped = stream.groupBy(F.window(time, size, hop).alias("w"), *keys).agg(*aggregates)
    return grouped.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *[c for c in grouped.columns if c != "w"])


def tumbling(stream: DataFrame, time: str, size: str, keys: list[str], aggregates: list[Column]) -> DataFrame:
    """Adjacent windows: a hop as long as the window."""
    return sliding(stream, time, size, size, keys, aggregates)


def gap_sessions(stream: DataFrame, time: str, gap: str, keys: list[str], aggregates: list[Column]) -> DataFrame:
    """Sessions that close after a pause of ``gap``."""
    grouped = stream.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(*aggregates)
    return grouped.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *[c for c in grouped.columns if c != "w"])


def running_counts(stream: DataFrame, label: str, confidence: str) -> DataFrame:
    """Detections and mean confidence so far per label (complete or update mode)."""
    return stream.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.avg(confidence).alias("avg_confidence"))


def with_metrics(stream: DataFrame, value: str, active: Column, name: str = "windows") -> DataFrame:
    """Attach counters that every micro-batch reports with its progress."""
    x = F.col(value).cast("double")
    return stream.observe(
        name,
        F.count(F.lit(1)).alias("evaluated"),
        F.sum(active.cast("long")).alias("active"),
        F.sqrt(F.avg(x * x) + F.lit(1e-12)).alias("rms"),
    )


class MetricsListener(StreamingQueryListener):
    """Collects the counters of ``with_metrics`` as they are reported."""

    def __init__(self, name: str = "windows"):
        self.name = name
        self.reports: list[dict] = []

        self.last: dict[str, int] = {}

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        row = event.progress.observedMetrics.get(self.name)
        if row is not None:
            self.reports.append({"batch": event.progress.batchId, **row.asDict()})
        self.last[str(event.progress.runId)] = event.progress.batchId

    def wait_for(self, query, seconds: float = 30.0) -> None:
        """Reports arrive a little after their batch; wait for the last one of a finished query."""
        until = time.monotonic() + seconds
        while query.lastProgress and self.last.get(str(query.runId), -1) < query.lastProgress["batchId"]:
            if time.monotonic() > until:
                raise TimeoutError("the last report has not arrived")
            time.sleep(0.02)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass


def run_available(writer, checkpoint: str):
    """Process everything that is there now, then stop; returns the finished query.

    State is spread over as many partitions as the cluster has cores.
    """
    spark = writer._spark
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(spark.sparkContext.defaultParallelism))
    try:
        query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    query.awaitTermination()
    return query
