"""Structured Streaming queries; each runs to the end of its input and returns the sink table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecmeadow.operators import bank as B
from vecmeadow.plans.registry import Tables, query
from vecmeadow.plans.series import CONTENT, DECISIONS, FLOOR, GAP, STREAM, six_places
from vecmeadow.plans.sql import RANKED, UNITS, centroids
from vecmeadow.plans.vectors import MARGIN, THETA, components, five_shot
from vecmeadow.session import scratch_table
from vecmeadow.sources.stores import BankStore
from vecmeadow.streaming import routes, state, windows as W


def whole(t: Tables, table: str) -> DataFrame:
    """The given Parquet file, or folder of files, as a stream."""
    schema = getattr(t, table).schema
    path = t.spark._jvm.org.apache.hadoop.fs.Path(t.path(table))
    if path.getFileSystem(t.spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return W.file_stream(t.spark, t.path(table), schema)
    return W.file_stream(t.spark, t.sf_dir, schema, glob=f"{table}.parquet")


class Parts:
    """``df`` arriving in ``parts`` steps in the order of a column: ``stream`` reads what ``arrivals`` has written."""

    def __init__(self, t: Tables, df: DataFrame, order: str, parts: int = 3, cuts: list | None = None):
        self.path = scratch_table(t.spark, "parts")
        self.df, self.order = df, order
        if cuts is None:
            cuts = df.agg(F.percentile_approx(order, [i / parts for i in range(1, parts)], 1000)).first()[0]
        self.bounds = [None, *cuts, None]
        df.limit(0).write.parquet(self.path)
        self.stream = W.file_stream(t.spark, self.path, df.schema)

    def arrivals(self):
        for low, high in zip(self.bounds, self.bounds[1:]):
            part = self.df
            if low is not None:
                part = part.filter(F.col(self.order) > low)
            if high is not None:
                part = part.filter(F.col(self.order) <= high)
            part.write.mode("append").parquet(self.path)
            yield


def run_parts(parts: Parts | None, writer, checkpoint: str) -> list:
    """Run ``writer()`` once per arrival (once in all without parts), continuing from the same checkpoint."""
    steps = parts.arrivals() if parts else [None]
    return [W.run_available(writer(), checkpoint) for _ in steps]


def collected(t: Tables, out: DataFrame, mode: str = "append", parts: Parts | None = None) -> DataFrame:
    """Run ``out`` into a Parquet table of the shared folder and read that table."""
    root = scratch_table(t.spark, "stream")

    def replace(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/table")

    def writer():
        if mode == "append":
            return out.writeStream.format("parquet").option("path", f"{root}/table")
        return out.writeStream.outputMode(mode).foreachBatch(replace)

    run_parts(parts, writer, f"{root}/checkpoint")
    return t.spark.read.schema(out.schema).parquet(f"{root}/table")


CLOSED = "WHERE w_end <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


def measures() -> list:
    return [F.count(F.lit(1)).alias("n"), F.round(F.max("value"), 4).alias("peak")]


@query(
    "t1_sliding_windows",
    "WITH w AS (SELECT user_id, value, time_bucket(INTERVAL 12 HOUR, ts) - i * INTERVAL 12 HOUR AS w_start, time_bucket(INTERVAL 12 HOUR, ts) - i * INTERVAL 12 HOUR + INTERVAL 24 HOUR AS w_end FROM events, range(2) r(i)) "
    f'SELECT epoch_us(w_start) AS start, epoch_us(w_end) AS "end", user_id, count(*) AS n, round(max(value), 4) AS peak FROM w {CLOSED} GROUP BY w_start, w_end, user_id',
)
def _(t):
    """One-day windows every 12 hours; windows still open at the watermark are not emitted."""
    s = W.event_time(whole(t, "events"), "ts", "1 hour")
    out = W.sliding(s, "ts", "24 hours", "12 hours", ["user_id"], measures())
    return micros(collected(t, out))


def micros(df: DataFrame) -> DataFrame:
    return df.withColumns({"start": F.unix_micros("start"), "end": F.unix_micros("end")})


@query(
    "t2_tumbling_windows",
    "WITH w AS (SELECT user_id, value, time_bucket(INTERVAL 24 HOUR, ts) AS w_start, time_bucket(INTERVAL 24 HOUR, ts) + INTERVAL 24 HOUR AS w_end FROM events) "
    f'SELECT epoch_us(w_start) AS start, epoch_us(w_end) AS "end", user_id, count(*) AS n, round(max(value), 4) AS peak FROM w {CLOSED} GROUP BY w_start, w_end, user_id',
)
def _(t):
    s = W.event_time(whole(t, "events"), "ts", "1 hour")
    return micros(collected(t, W.tumbling(s, "ts", "24 hours", ["user_id"], measures())))


@query(
    "t3_gap_sessions",
    "WITH m AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), "
    "s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM m), "
    "g AS (SELECT user_id, min(ts) AS a, max(ts) + INTERVAL 6 HOUR AS w_end, count(*) AS n, round(max(value), 4) AS peak FROM s GROUP BY user_id, k) "
    f'SELECT epoch_us(a) AS start, epoch_us(w_end) AS "end", user_id, n, peak FROM g {CLOSED}',
)
def _(t):
    """A session closes after six quiet hours."""
    s = W.event_time(whole(t, "events"), "ts", "1 hour")
    return micros(collected(t, W.gap_sessions(s, "ts", "6 hours", ["user_id"], measures())))


def timed(t: Tables) -> DataFrame:
    return t.events.select(
        "event_id", "user_id", "event_type", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")
    )


@query("t4_smooth_stream", f"WITH {DECISIONS}")
def _(t):
    """The decision on smoothed scores over three micro-batches equals the batch form over everything."""
    p = Parts(t, timed(t), "us")
    out = state.decision_stream(p.stream, "user_id", "event_type", "us", "event_id", "value", 0.55, GAP, theta=10.0, sure=60.0, margin=2.0)
    return six_places(collected(t, out, parts=p))


@query("t5_floor_stream", f"WITH RECURSIVE {FLOOR} SELECT user_id, event_id, round(floor + 1e-9, 6) AS noise_floor, triggered FROM tracked")
def _(t):
    """Six micro-batches; a user's frames wait until there are forty (all users of the table have more)."""
    p = Parts(t, timed(t), "us", parts=6)
    s = W.event_time(p.stream.withColumn("ts", F.timestamp_micros("us")), "ts", "1 hour")
    # A stream counts as ended only after more time than the table spans.
    out = state.floor_stream(s, "user_id", "ts", "event_id", "value", idle=90 * 24 * 3_600_000)
    return collected(t, out, parts=p).withColumn("noise_floor", F.round(F.col("noise_floor") + 1e-9, 6))


@query(
    "t6_drop_recent_stream",
    f"WITH RECURSIVE {STREAM}, {CONTENT}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS k FROM content), "
    "walk AS (SELECT user_id, event_id, k, [h] AS recent, true AS kept FROM n WHERE k = 1 UNION ALL "
    "SELECT n.user_id, n.event_id, n.k, CASE WHEN list_contains(w.recent, n.h) THEN w.recent ELSE list_append(w.recent, n.h)[-20:] END, "
    "NOT list_contains(w.recent, n.h) FROM walk w JOIN n ON n.user_id = w.user_id AND n.k = w.k + 1) SELECT user_id, event_id FROM walk WHERE kept",
)
def _(t):
    h = F.concat_ws(":", "event_type", F.floor(F.col("value") / 4).cast("string"))
    df = timed(t).select("event_id", "user_id", "us", h.alias("h"))
    p = Parts(t, df, "us")
    return collected(t, state.drop_recent_stream(p.stream, "user_id", "h", "us", "event_id"), parts=p)


@query("t6_dedup_within", "SELECT count(*) AS n, count(DISTINCT (user_id, event_type)) AS kinds FROM (SELECT DISTINCT user_id, event_type FROM events)")
def _(t):
    """With a watermark longer than the data, one row per (user, type) is left."""
    s = W.event_time(whole(t, "events"), "ts", "60 days").select("ts", "user_id", "event_type")
    kept = collected(t, state.dedup_within(s, ["user_id", "event_type"]))
    return kept.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id", "event_type").alias("kinds"))


ALL_ROWS = f"WITH {RANKED}, " + centroids("bank", "ranked", where="rn <= 5") + """,
scores AS (SELECT q.vec_id, b.label, list_dot_product(q.v, b.c) AS s FROM units q, bank b),
placed AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label) AS place FROM scores),
top AS (SELECT vec_id, max(CASE WHEN place = 1 THEN label END) AS best_label, max(CASE WHEN place = 1 THEN s END) AS score, max(CASE WHEN place = 2 THEN s END) AS second FROM placed GROUP BY vec_id)"""


@query(
    "t7_route",
    f"{ALL_ROWS} SELECT vec_id, CASE WHEN score >= {THETA} AND score - second >= {MARGIN} THEN best_label::VARCHAR ELSE 'Unknown' END AS label, round(score, 6) AS confidence, "
    f"CASE WHEN NOT (score >= {THETA} AND score - second >= {MARGIN}) THEN best_label::VARCHAR END AS quarantined_as, "
    f"{THETA}::DOUBLE AS threshold, sha256(vec_id::VARCHAR) AS content_hash, vec_id * 1000000 AS us FROM top",
)
def _(t):
    """Every vector is logged; rejected ones are also quarantined with their best match."""
    bank, _ = five_shot(t)
    root = scratch_table(t.spark, "route")
    store = BankStore(t.spark, f"{root}/bank")
    store.save(bank)
    p = Parts(t, t.embeddings, "vec_id")
    seconds = F.timestamp_seconds("vec_id")
    writer = lambda: routes.route(
        p.stream, store, THETA, MARGIN, f"{root}/detections", f"{root}/quarantine", time=seconds,
        content=F.sha2(F.col("vec_id").cast("string"), 256),
    )
    run_parts(p, writer, f"{root}/checkpoint")
    log = t.spark.read.parquet(f"{root}/detections")
    held = t.spark.read.parquet(f"{root}/quarantine").select("vec_id", F.col("best_match").alias("quarantined_as"))
    return log.join(held, "vec_id", "left").select(
        "vec_id", "label", F.round("confidence", 6).alias("confidence"), "quarantined_as", "threshold", "content_hash",
        F.unix_micros("detected_at").alias("us"),
    )


@query(
    "t7_route_without_bank",
    "SELECT vec_id, 'Unknown' AS label, 0.0::DOUBLE AS confidence, true AS quarantined FROM embeddings",
)
def _(t):
    """Before anything is enrolled every vector is logged as unknown and quarantined."""
    root = scratch_table(t.spark, "route")
    store = BankStore(t.spark, f"{root}/bank")
    stream = whole(t, "embeddings")
    W.run_available(routes.route(stream, store, THETA, MARGIN, f"{root}/detections", f"{root}/quarantine"), f"{root}/checkpoint")
    held = t.spark.read.parquet(f"{root}/quarantine").select("vec_id", F.lit(True).alias("quarantined"))
    log = t.spark.read.parquet(f"{root}/detections")
    return log.join(held, "vec_id", "left").select("vec_id", "label", "confidence", F.coalesce("quarantined", F.lit(False)).alias("quarantined"))


@query(
    "t8_score_stream",
    f"{ALL_ROWS} SELECT vec_id, best_label, round(score, 6) AS score, score >= {THETA} AND score - second >= {MARGIN} AS is_known FROM top JOIN embeddings USING (vec_id) WHERE list_max(list_transform(embedding, lambda x: abs(x))) >= 0.3",
)
def _(t):
    """Peak gate before scoring; the static bank is the five-shot bank (also the stream-static join)."""
    from vecmeadow.functions.signal import peak

    bank, _ = five_shot(t)
    out = routes.score_stream(whole(t, "embeddings"), bank, THETA, MARGIN, gate=peak(F.col("embedding")).cast("float") >= F.lit(0.3).cast("float"))
    return collected(t, out.select("vec_id", "best_label", "score", "is_known")).withColumn("score", F.round("score", 6))


@query(
    "j13_stream_static_join",
    f"{ALL_ROWS} SELECT vec_id, n_name AS name, round(score, 6) AS score FROM top JOIN nation ON n_nationkey = best_label",
)
def _(t):
    """Scored stream with label metadata attached."""
    bank, _ = five_shot(t)
    out = routes.score_stream(whole(t, "embeddings"), bank, THETA, MARGIN)
    named = out.join(t.nation, F.col("best_label") == F.col("n_nationkey")).select("vec_id", F.col("n_name").alias("name"), "score")
    return collected(t, named).withColumn("score", F.round("score", 6))


@query("t9_update_bank_stream", f"WITH {UNITS}, " + centroids("bank", "units") + " SELECT label, n AS n_support, i, round(x, 6) AS x FROM (SELECT label, n, unnest(c) AS x, generate_subscripts(c, 1) AS i FROM bank)")
def _(t):
    """The stored bank of the first five rows per label, then three micro-batches of the rest: the bank of one fit over all."""
    root = scratch_table(t.spark, "online")
    enrolled, rest = B.enrol_split(t.embeddings, 5)
    BankStore(t.spark, f"{root}/bank").save(B.fit_bank(enrolled))
    p = Parts(t, rest, "vec_id")
    run_parts(p, lambda: routes.update_bank_stream(p.stream, f"{root}/bank"), f"{root}/checkpoint")
    bank = BankStore(t.spark, f"{root}/bank").load()
    return components(B.with_centroid(bank, ["label"]), ["label", "n_support"], "centroid")


@query("t10_metrics", "SELECT count(*) AS evaluated, sum((value >= 20)::INT)::BIGINT AS active FROM events")
def _(t):
    """Counters reported by three micro-batches, added up."""
    root = scratch_table(t.spark, "metrics")
    p = Parts(t, timed(t), "us")
    out = W.with_metrics(p.stream, "value", F.col("value") >= 20)
    listener = W.MetricsListener()
    t.spark.streams.addListener(listener)
    try:
        runs = run_parts(p, lambda: out.writeStream.format("parquet").option("path", f"{root}/table"), f"{root}/checkpoint")
        # Every batch is reported to the listener; a query itself remembers only its last ones.
        listener.wait_for(runs[-1])
    finally:
        t.spark.streams.removeListener(listener)
    reports = [(int(r["evaluated"]), int(r["active"] or 0)) for r in listener.reports]
    return t.spark.createDataFrame(reports, "evaluated long, active long").agg(
        F.sum("evaluated").alias("evaluated"), F.sum("active").alias("active")
    )


@query("t11_running_counts", "SELECT event_type, count(*) AS n, round(avg(value), 4) AS avg_confidence FROM events GROUP BY event_type")
def _(t):
    p = Parts(t, timed(t), "us")
    out = W.running_counts(p.stream, "event_type", "value")
    return collected(t, out, "complete", parts=p).withColumn("avg_confidence", F.round("avg_confidence", 4))
