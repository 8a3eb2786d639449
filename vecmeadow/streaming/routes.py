"""Stream scoring, routing to sinks and online bank updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecmeadow.operators.bank import fit_bank, merge_banks
from vecmeadow.operators.scoring import decide, score
from vecmeadow.sources.stores import BankStore


def score_stream(stream: DataFrame, bank: DataFrame, theta: float, margin: float | None, gate: Column | None = None, **options) -> DataFrame:
    """Gate first (the cheap test), then score each row against the static bank. Stateless and map-only."""
    rows = stream if gate is None else stream.filter(gate)
    return decide(score(rows, bank, **options), theta, margin)


def query_id(batch: DataFrame, default: str) -> str:
    """The id of the running stream: it stays the same when a stream goes on from its checkpoint, and a new checkpoint has a new one."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or default


def route(
    stream: DataFrame, store: BankStore, theta: float, margin: float | None, detections: str, quarantine: str,
    id_col: str = "vec_id", vector: str = "embedding", gate: Column | None = None, time: Column | None = None,
    content: Column | None = None, path: Column | None = None,
):
    """A ``foreachBatch`` writer: every row to ``detections``, rejected ones to ``quarantine`` too.

    The newest bank is read per micro-batch; while there is none, every row is
    ``Unknown``. Each batch of a stream owns one partition of both tables and
    overwrites it, so a replayed batch leaves no duplicates, and a stream with a
    new checkpoint does not touch what another one wrote. ``time``, ``content`` and
    ``path`` give the detection time, the content hash and the clip's place.
    """
    extra = {
        "__time": F.current_timestamp() if time is None else time,
        "__content": F.lit(None).cast("string") if content is None else content,
        "__path": F.lit(None).cast("string") if path is None else path,
    }

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = (batch if gate is None else batch.filter(gate)).withColumns(extra)
        bank = store.load() if store.version() else store.spark.createDataFrame([], "label string, centroid array<double>")
        scored = decide(score(rows, bank, vector=vector, keep_vector=True), theta, margin).persist()
        part = f"stream={query_id(batch, 'none')}/batch={batch_id}"
        try:
            scored.select(
                id_col, F.col("__time").alias("detected_at"), F.col("predicted").alias("label"), F.col("score").alias("confidence"),
                "is_known", F.col("__content").alias("content_hash"), F.lit(float(theta)).alias("threshold"),
            ).write.mode("overwrite").parquet(f"{detections}/{part}")
            scored.filter(~F.col("is_known")).select(
                id_col, vector, F.col("__time").alias("detected_at"), F.col("best_label").cast("string").alias("best_match"), "score",
                F.col("__path").alias("path"), F.lit(None).cast("long").alias("cluster_id"),
            ).write.mode("overwrite").parquet(f"{quarantine}/{part}")
        finally:
            scored.unpersist()

    return stream.writeStream.foreachBatch(write)


def update_bank_stream(stream: DataFrame, path: str, label: str = "label", vector: str = "embedding"):
    """A ``foreachBatch`` writer that adds each micro-batch of labelled vectors to the bank stored under ``path``.

    A batch goes on from the newest stored version, whoever wrote it, and writes
    the one above. It first records which version it starts from, so a replay
    starts there again and rewrites the same version. Other columns of the store
    stay as they are.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        store = BankStore(spark, path, label)
        starts = BankStore(spark, f"{path}-streams/stream={query_id(batch, 'none')}")
        known = starts.version()
        seen = {row["batch"]: row["base"] for row in starts.load(version=known).collect()} if known else {}
        if batch_id not in seen:
            seen[batch_id] = store.version()
            # Batches are replayed from the last one on, so two entries are enough.
            held = [(b, v) for b, v in seen.items() if b >= batch_id - 1]
            starts.write(spark.createDataFrame(held, "batch long, base long").coalesce(1), known + 1)
        base = seen[batch_id]
        fresh = fit_bank(batch, label, vector)
        if base:
            old = store.load(version=base)
            touched = merge_banks(old.join(fresh.select(label), label, "left_semi"), fresh, label)
            others = [c for c in old.columns if c not in touched.columns]
            if others:
                touched = touched.join(old.select(label, *others), label, "left")
                now = {c: F.current_timestamp() if c == "updated_at" else F.coalesce(c, F.current_timestamp()) for c in ("created_at", "updated_at") if c in others}
                touched = touched.withColumns(now)
            fresh = old.join(fresh.select(label), label, "left_anti").unionByName(touched)
        store.write(fresh, base + 1)

    return stream.writeStream.foreachBatch(write)
