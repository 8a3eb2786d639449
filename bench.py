"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores. Every query is
run to the end without collecting its rows. The last part measures scoring
throughput at several bank sizes on vectors that Spark derives from ``embeddings``.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import pyspark  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from vecmeadow import plans  # noqa: E402
from vecmeadow.operators import bank as B, evaluate as E, scoring as S  # noqa: E402
from vecmeadow.functions import vectors as V  # noqa: E402
from vecmeadow.session import get_spark, scratch_table  # noqa: E402
from vecmeadow.streaming import routes, windows as W  # noqa: E402

HEADLINE = (
    "a1_centroid m2_classify a8_label_report a12_roc_sweep a16_few_shot a29_pair_statistics j8_similar_pairs "
    "w4_gap_reset_smoothing w5_streaks w6_noise_floor w8_merge_intervals w13_loudest_share w15_recent_repeat "
    "s6_registry_upsert s9_label_list j3_named_detections j9_vocabulary_match j11_shared_ids a22_counts_with_total "
    "u4_top_up t1_sliding_windows"
).split()
COPIES = 100


def finish(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(fn) -> float:
    start = time.perf_counter()
    fn()
    return round(time.perf_counter() - start, 3)


def throughput(spark, sf_dir: str) -> dict:
    """Rows per second: centroid fit, pairs of the self-join, scoring against banks of several sizes (and once by column
    expressions instead of Arrow batches), and a scored stream."""
    base = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = base.count()
    many = base.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1)))).repartition(
        spark.sparkContext.defaultParallelism, "vec_id", "copy"
    ).withColumn("vec_id", F.col("vec_id") * COPIES + F.col("copy")).drop("copy").persist()
    n = many.count()
    found = {"vectors": n, "fit_rows_per_s": round(n / timed(lambda: finish(B.fit_bank(many))))}
    for size in (10, 100, 1000):
        bank = base.filter(F.col("vec_id") < size).select(F.col("vec_id").alias("label"), F.col("embedding").alias("centroid"))
        seconds = timed(lambda: finish(S.decide(S.score(many, bank), 0.2, 0.02)))
        found[f"scored_rows_per_s_{min(size, rows)}"] = round(n / seconds)
    few = [[float(x) for x in r["embedding"]] for r in base.orderBy("vec_id").limit(10).select("embedding").collect()]
    unit = V.l2(F.col("embedding"))
    by_column = F.greatest(*[V.dot(unit, V.l2(F.array(*[F.lit(x) for x in v]))) for v in few])
    found["scored_rows_per_s_10_by_columns"] = round(n / timed(lambda: finish(many.select("vec_id", by_column.alias("score")))))
    path = scratch_table(spark, "bench-stream")
    many.repartition(8).write.parquet(path)
    bank = base.filter(F.col("vec_id") < 100).select(F.col("vec_id").alias("label"), F.col("embedding").alias("centroid"))
    scored = routes.score_stream(W.file_stream(spark, path, many.schema), bank, 0.2, 0.02)
    seconds = timed(lambda: W.run_available(scored.writeStream.format("noop"), scratch_table(spark, "bench-checkpoint")))
    found["streamed_rows_per_s_100"] = round(n / seconds)
    many.unpersist()
    found["pairs_per_s"] = round(rows * (rows - 1) / 2 / timed(lambda: finish(E.pair_statistics(base))))
    return found


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark("bench", master=f"local[{cpus}]", partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    queries = plans.queries()
    finish(queries["m2_classify"](spark, sf_dir))  # starts the JVM's compiler and the Python workers
    seconds = {name: timed(lambda name=name: finish(queries[name](spark, sf_dir))) for name in HEADLINE}
    line = {
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir).removeprefix("sf"), "throughput": throughput(spark, sf_dir),
        "spark": pyspark.__version__, "cores": cpus, "partitions": spark.conf.get("spark.sql.shuffle.partitions"),
        "driver_memory": spark.conf.get("spark.driver.memory", ""),
    }
    spark.stop()
    print(json.dumps(line))


if __name__ == "__main__":
    main()
