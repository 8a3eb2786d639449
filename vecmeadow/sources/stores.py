"""Parquet-backed stores: prototype bank, detection log, quarantine and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def upsert_by_key(old: DataFrame, new: DataFrame, key: str, now: Column) -> DataFrame:
    """New rows replace old ones of the same key but keep their ``created_at``; ``updated_at`` becomes ``now``.

    Of new rows that repeat a key the one with the largest values counts.
    """
    rest = [c for c in new.columns if c != key]
    new = new.groupBy(key).agg(F.max(F.struct(*rest)).alias("__r")).select(key, *[F.col(f"__r.{c}").alias(c) for c in rest])
    kept = old.join(new.select(key), key, "left_anti")
    born = old.select(key, F.col("created_at").alias("__born"))
    fresh = new.join(born, key, "left").withColumns(
        {"created_at": F.coalesce("__born", now), "updated_at": now}
    ).drop("__born")
    return kept.unionByName(fresh.select(*kept.columns))


class BankStore:
    """A versioned Parquet bank: every save writes a new version, readers take the newest that was written to its end."""

    def __init__(self, spark: SparkSession, path: str, key: str = "label"):
        self.spark, self.path, self.key = spark, path, key

    def version(self) -> int:
        """The newest complete version, 0 if there is none. Spark marks a finished write with a file."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        root = path(self.path)
        files = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(root):
            return 0
        folders = [status.getPath() for status in files.listStatus(root) if status.getPath().getName().startswith("version=")]
        return max((int(f.getName().split("=")[1]) for f in folders if files.exists(path(f, "_SUCCESS"))), default=0)

    def load(self, label=None, version: int | None = None) -> DataFrame:
        """The newest (or the given) version, or one label of it (pushed down to the scan)."""
        bank = self.spark.read.parquet(f"{self.path}/version={self.version() if version is None else version}")
        return bank if label is None else bank.filter(F.col(self.key) == label)

    def save(self, df: DataFrame, now: Column | None = None) -> None:
        """Insert or replace prototypes by label."""
        now = F.current_timestamp() if now is None else now
        version = self.version()
        if version:
            whole = upsert_by_key(self.load(), df, self.key, now)
        else:
            whole = df.withColumns({"created_at": now, "updated_at": now})
        self.write(whole, version + 1)

    def delete(self, labels: list) -> None:
        version = self.version()
        self.write(self.load().filter(~F.col(self.key).isin(labels)), version + 1)

    def labels(self) -> DataFrame:
        return self.load().select(self.key).orderBy(self.key)

    def write(self, df: DataFrame, version: int) -> None:
        """Write ``df`` as the given version."""
        df.write.mode("overwrite").parquet(f"{self.path}/version={version}")


def detections(
    df: DataFrame, source_id: str, label: Column, confidence: Column, content: Column, threshold: float, time: Column
) -> DataFrame:
    """Detection log rows. The id is a hash of the source row, so a retried write gives the same ids."""
    return df.select(
        F.xxhash64(source_id).alias("id"), F.col(source_id).alias("source_id"), time.alias("detected_at"),
        label.alias("label"), confidence.alias("confidence"), content.alias("content_hash"),
        F.lit(float(threshold)).alias("threshold"), F.to_date(time).alias("day"),
    )


def append_log(df: DataFrame, path: str) -> None:
    """Append to a log partitioned by day. Rows are brought together by day, and a day is split by its size, not by a fixed number."""
    df.hint("rebalance", "day").write.mode("append").partitionBy("day").parquet(path)


def read_log(spark: SparkSession, path: str, label_type: str = "string") -> DataFrame:
    """The detection log; the fixed schema also reads a log that was just emptied."""
    schema = (
        f"id long, source_id long, detected_at timestamp, label {label_type}, confidence double, "
        "content_hash string, threshold double, day date"
    )
    return spark.read.schema(schema).parquet(path)


def append_quarantine(rejected: DataFrame, path: str) -> None:
    """Append rejected vectors; ``best_match`` is always the real best label."""
    rejected.write.mode("append").parquet(path)


def clear_log(log: DataFrame, path: str, partition: str | None = "day") -> int:
    """Empty the table behind ``log`` and return how many rows it held."""
    removed = log.count()
    writer = log.sparkSession.createDataFrame([], log.schema).write.mode("overwrite").option("partitionOverwriteMode", "static")
    (writer.partitionBy(partition) if partition else writer).parquet(path)
    return removed


def write_reports(report: DataFrame, few_shot: DataFrame, json_path: str, csv_path: str) -> None:
    """The full report as JSON, and the few-shot rows (a small grid) as one CSV file."""
    report.write.mode("overwrite").json(json_path)
    few_shot.coalesce(1).write.mode("overwrite").option("header", True).csv(csv_path)
