"""Time-series queries on ``events`` (user = stream, value = level, event_type = predicted label)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecmeadow.operators import sequences as Q
from vecmeadow.operators.ordered import ranked_globally
from vecmeadow.plans.registry import Tables, query
from vecmeadow.session import small_side

HOUR = 3_600_000_000
GAP = 6 * HOUR


def stream(t: Tables) -> DataFrame:
    return t.events.select(
        "event_id", "user_id", "event_type", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")
    )


STREAM = "stream AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) AS us FROM events)"
SESSIONS = STREAM + f""",
marked AS (SELECT *, CASE WHEN us - lag(us) OVER w <= {GAP} THEN 0 ELSE 1 END AS fresh FROM stream
  WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
sess AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM marked)"""
SMOOTHED = SESSIONS + """,
listed AS (SELECT event_id, list(value) OVER (PARTITION BY user_id, session, event_type ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS l,
  user_id, session, event_type, us, value FROM sess),
ema AS (SELECT *, list_reduce(l, lambda a, x: 0.55::DOUBLE * x + (1 - 0.55::DOUBLE) * a) AS smoothed FROM listed)"""


@query("w4_gap_reset_smoothing", f"WITH {SMOOTHED} SELECT event_id, session, round(smoothed + 1e-9, 6) AS smoothed FROM ema")
def _(t):
    df = Q.smooth(stream(t), "user_id", "event_type", "us", "event_id", "value", 0.55, GAP)
    return df.select("event_id", "session", F.round(F.col("smoothed") + 1e-9, 6).alias("smoothed"))


DECISIONS = SMOOTHED + """,
spread AS (SELECT e.event_id, e.user_id, e.us, l.event_type AS label,
  last_value(CASE WHEN e.event_type = l.event_type THEN e.smoothed END IGNORE NULLS) OVER (PARTITION BY e.user_id, e.session, l.event_type ORDER BY e.us, e.event_id ROWS UNBOUNDED PRECEDING) AS s
  FROM ema e, (SELECT DISTINCT event_type FROM events) l),
placed AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY s DESC, label) AS place FROM spread WHERE s IS NOT NULL),
best AS (SELECT event_id, user_id, us, max(CASE WHEN place = 1 THEN label END) AS label, max(CASE WHEN place = 1 THEN s END) AS s, coalesce(max(CASE WHEN place = 2 THEN s END), 0) AS second FROM placed GROUP BY ALL),
gated AS (SELECT *, s >= 10 AND s - second >= 2 AS gate, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS n FROM best),
linked AS (SELECT *, CASE WHEN gate AND coalesce(lag(gate AND true) OVER w AND lag(label) OVER w = label, false) THEN NULL ELSE n END AS begins FROM gated WINDOW w AS (PARTITION BY user_id ORDER BY n)),
counted AS (SELECT *, max(begins) OVER w AS run_start, max(CASE WHEN gate AND s >= 60 THEN n END) OVER w AS set_at FROM linked WINDOW w AS (PARTITION BY user_id ORDER BY n ROWS UNBOUNDED PRECEDING)),
decided AS (SELECT *, CASE WHEN NOT gate THEN 0 WHEN set_at >= run_start THEN n - set_at + 2 ELSE n - run_start + 1 END::BIGINT AS streak FROM counted)
SELECT event_id, user_id, label AS best_label, round(s + 1e-9, 6) AS smoothed, round(second + 1e-9, 6) AS second, streak, gate AND streak >= 2 AS is_known FROM decided"""


def six_places(df: DataFrame) -> DataFrame:
    rounded = {c: F.round(F.col(c) + 1e-9, 6).alias(c) for c in ("smoothed", "second")}
    return df.select(*[rounded.get(c, c) for c in ("event_id", "user_id", "best_label", "smoothed", "second", "streak", "is_known")])


@query("w5_streaks", f"WITH {DECISIONS}")
def _(t):
    """The best smoothed label, its margin to the second and its streak."""
    return six_places(Q.decisions(stream(t), "user_id", "event_type", "us", "event_id", "value", 0.55, GAP, theta=10.0, sure=60.0, margin=2.0))


FRAMED = STREAM + """,
nr AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - 1 AS n FROM stream),
framed AS (SELECT *, (n // 120)::BIGINT AS clip, (n % 120)::BIGINT AS frame FROM nr)"""
FLOOR = STREAM + """,
framed AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - 1 AS frame FROM stream),
first_level AS (SELECT user_id, greatest(1e-4::DOUBLE, quantile_cont(value, 0.15)) AS f0 FROM framed WHERE frame < 40 GROUP BY ALL),
walk AS (
  SELECT user_id, NULL::BIGINT AS event_id, -1::BIGINT AS frame, f0 AS floor, false AS triggered FROM first_level
  UNION ALL
  SELECT w.user_id, f.event_id, f.frame, greatest(1e-4::DOUBLE, CASE WHEN f.value > 3 * w.floor THEN w.floor
    WHEN f.value < w.floor THEN 0.95::DOUBLE * w.floor + 0.05::DOUBLE * f.value ELSE 0.99::DOUBLE * w.floor + 0.01::DOUBLE * f.value END), f.value > 3 * w.floor
  FROM walk w JOIN framed f ON f.user_id = w.user_id AND f.frame = w.frame + 1),
tracked AS (SELECT * FROM walk WHERE frame >= 0)"""
CHUNK = 50  # frames: the streams of the tables are short, and this cuts them all the same


def floors(t: Tables, per_chunk: int = Q.CHUNK_FRAMES) -> DataFrame:
    return Q.track_floor(stream(t), "user_id", "us", "event_id", "value", per_chunk)


def framed(t: Tables) -> DataFrame:
    return Q.frames(stream(t), "user_id", "us", "event_id")


@query("a25_start_level", f"WITH {FRAMED} SELECT user_id, clip, round(quantile_cont(value, 0.15), 6) AS start_level FROM framed WHERE frame < 40 GROUP BY user_id, clip")
def _(t):
    return Q.start_levels(framed(t), ["user_id", "clip"], "value").withColumn("start_level", F.round("start_level", 6))


@query("w6_noise_floor", f"WITH RECURSIVE {FLOOR} SELECT user_id, event_id, frame, round(floor + 1e-9, 6) AS noise_floor, triggered FROM tracked")
def _(t):
    """The floor of every user's whole stream."""
    return floors(t, CHUNK).select("user_id", "event_id", "frame", F.round(F.col("noise_floor") + 1e-9, 6).alias("noise_floor"), "triggered")


@query(
    "w7_triggered_runs",
    f"WITH RECURSIVE {FLOOR}, isl AS (SELECT *, frame - row_number() OVER (PARTITION BY user_id ORDER BY frame) AS i FROM tracked WHERE triggered), "
    "r AS (SELECT user_id, min(frame) AS a, max(frame) AS b, count(*) AS frames FROM isl GROUP BY user_id, i), "
    "e AS (SELECT user_id, max(frame) AS last FROM tracked GROUP BY user_id) "
    'SELECT user_id, a * 0.025::DOUBLE AS start, CASE WHEN b = last THEN last * 0.025::DOUBLE + 0.05::DOUBLE ELSE least(last * 0.025::DOUBLE + 0.05::DOUBLE, (b + 1) * 0.025::DOUBLE + 0.05::DOUBLE) END AS "end", frames '
    "FROM r JOIN e USING (user_id) WHERE frames >= 2",
)
def _(t):
    return Q.runs(floors(t), ["user_id"], "triggered", 2, 0.025, 0.05)


@query(
    "w8_merge_intervals",
    f"WITH {STREAM}, iv AS (SELECT user_id, event_id, us AS s, us + round(value * 60000000)::BIGINT AS e FROM stream), "
    "r AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv), "
    f"i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + {HOUR} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS UNBOUNDED PRECEDING) AS island FROM r) "
    "SELECT user_id, min(s) AS start_us, max(e) AS end_us, count(*) AS merged FROM i GROUP BY user_id, island",
)
def _(t):
    df = stream(t).select(
        "user_id", "event_id", F.col("us").alias("start_us"), (F.col("us") + F.round(F.col("value") * 60000000).cast("long")).alias("end_us")
    )
    return Q.merge_intervals(df, ["user_id"], "start_us", "end_us", HOUR, "event_id")


@query(
    "w9_scaled_mask",
    "WITH m AS (SELECT user_id, min(value) AS lo, max(value) AS hi FROM events GROUP BY user_id HAVING max(value) > min(value)) "
    "SELECT event_id, user_id, round((value - lo) / (hi - lo), 6) AS scaled FROM events JOIN m USING (user_id) WHERE (value - lo) / (hi - lo) > 0.2",
)
def _(t):
    df = Q.scaled_mask(t.events.select("event_id", "user_id", "value"), ["user_id"], "value")
    return df.select("event_id", "user_id", F.round("scaled", 6).alias("scaled"))


MASK = """types AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS band FROM (SELECT DISTINCT event_type FROM events)),
active AS (SELECT DISTINCT user_id, band, (epoch_us(ts) // 86400000000 - 19723)::BIGINT AS frame FROM events JOIN types USING (event_type) WHERE value > 15),
grid AS (SELECT count(*) AS n_bands FROM types), span AS (SELECT max(frame) + 1 AS n_frames FROM active),
offs AS (SELECT b, f FROM (SELECT unnest([-1, 0, 1]) AS b), (SELECT unnest([-2, -1, 0, 1, 2]) AS f)),
dil AS (SELECT DISTINCT user_id, band + b AS band, frame + f AS frame FROM active, offs, grid, span
  WHERE band + b BETWEEN 0 AND n_bands - 1 AND frame + f BETWEEN 0 AND n_frames - 1),
closed AS (SELECT user_id, band + b AS band, frame + f AS frame FROM dil, offs GROUP BY ALL HAVING count(*) = 15)"""


def activity_mask(t: Tables) -> DataFrame:
    """Band = event type, frame = day, active = any value above 15 that day."""
    bands = ranked_globally(t.events.select("event_type").distinct(), [F.col("event_type")])
    bands = bands.select("event_type", (F.col("rank") - 1).cast("long").alias("band"))
    sizes = bands.agg(F.count(F.lit(1)).alias("n_bands"))
    day = (F.floor(F.col("us") / 86_400_000_000) - 19723).cast("long")
    cells = stream(t).filter("value > 15").join(small_side(bands), "event_type").select("user_id", "band", day.alias("frame")).distinct()
    span = cells.agg((F.max("frame") + 1).alias("n_frames"))
    return cells.join(F.broadcast(sizes)).join(F.broadcast(span))


@query("w10_closed_mask", f"WITH {MASK} SELECT user_id, band, frame FROM closed")
def _(t):
    return Q.closed_mask(activity_mask(t), ["user_id"]).select("user_id", "band", "frame")


@query(
    "w10_blob_extents",
    f"WITH RECURSIVE {MASK}, reach AS (SELECT user_id, band, frame, band * 100000 + frame AS root FROM closed UNION "
    "SELECT c.user_id, c.band, c.frame, r.root FROM reach r JOIN closed c ON c.user_id = r.user_id AND abs(c.band - r.band) + abs(c.frame - r.frame) = 1), "
    "comp AS (SELECT user_id, band, frame, min(root) AS root FROM reach GROUP BY ALL) "
    "SELECT user_id, min(frame) AS first, max(frame) AS last FROM comp GROUP BY user_id, root",
)
def _(t):
    return Q.run_blobs(Q.closed_runs(activity_mask(t), ["user_id"]), ["user_id"]).select("user_id", "first", "last")


@query(
    "w12_loudest_windows",
    "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events WHERE value > 0.005 "
    "QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) <= 4",
)
def _(t):
    return Q.loudest(t.events.select("user_id", "event_id", "value"), ["user_id"], "value", "event_id", 4, 0.005).select("user_id", "event_id", "rank")


@query(
    "w13_loudest_share",
    "WITH r AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank, count(*) OVER (PARTITION BY event_type) AS n FROM events) "
    "SELECT event_type, event_id, rank FROM r WHERE rank <= greatest(floor(n * 0.4::DOUBLE), 1)",
)
def _(t):
    return Q.keep_share(t.events.select("event_type", "event_id", "value"), ["event_type"], "value", "event_id").select("event_type", "event_id", "rank")


@query(
    "w14_caps",
    "WITH a AS (SELECT l_suppkey, l_partkey, l_orderkey, l_linenumber FROM lineitem "
    "QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_orderkey, l_linenumber, l_extendedprice, l_quantity, l_shipdate) <= 2) "
    "SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS rank FROM a "
    "QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) <= 30",
)
def _(t):
    """At most 2 lines of a (supplier, part) recording and 30 of a supplier."""
    order = [F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")]
    df = t.lineitem.select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber")
    return Q.capped(df, ["l_suppkey"], ["l_partkey"], order, 2, 30).select("l_suppkey", "l_orderkey", "l_linenumber", "rank")


CONTENT = "content AS (SELECT event_id, user_id, us, event_type || ':' || floor(value / 4)::BIGINT AS h FROM stream)"


def contents(t: Tables) -> DataFrame:
    h = F.concat_ws(":", "event_type", F.floor(F.col("value") / 4).cast("string"))
    return stream(t).select("event_id", "user_id", "us", h.alias("h"))


@query(
    "w15_recent_repeat",
    f"WITH {STREAM}, {CONTENT}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS k FROM content) "
    "SELECT event_id, coalesce(k - lag(k) OVER (PARTITION BY user_id, h ORDER BY k) <= 20, false) AS is_repeat FROM n",
)
def _(t):
    return Q.recent_repeats(contents(t), "user_id", "h", "us", "event_id").select("event_id", "is_repeat")


@query(
    "w15_drop_recent",
    f"WITH RECURSIVE {STREAM}, {CONTENT}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS k FROM content), "
    "walk AS (SELECT user_id, event_id, k, [h] AS recent, true AS kept FROM n WHERE k = 1 UNION ALL "
    "SELECT n.user_id, n.event_id, n.k, CASE WHEN list_contains(w.recent, n.h) THEN w.recent ELSE list_append(w.recent, n.h)[-20:] END, "
    "NOT list_contains(w.recent, n.h) FROM walk w JOIN n ON n.user_id = w.user_id AND n.k = w.k + 1) "
    "SELECT user_id, event_id FROM walk WHERE kept",
)
def _(t):
    """Drop what is among the last 20 accepted contents of the stream."""
    return Q.drop_recent(contents(t), "user_id", "h", "us", "event_id").select("user_id", "event_id")


DAY_LEVELS = "SELECT user_id, epoch_us(ts) // 86400000000 AS day, max(abs(value)) AS peak, sqrt(avg(value * value) + 1e-12) AS rms, count(*) AS n FROM events GROUP BY ALL"


def day_levels(t: Tables, **gates) -> DataFrame:
    df = stream(t).withColumn("day", F.floor(F.col("us") / 86_400_000_000).cast("long"))
    return Q.level_gate(df, [F.col("user_id"), F.col("day")], "value", **gates)


@query("p7_peak_gate", f"SELECT user_id, day, round(peak, 6) AS peak, n FROM ({DAY_LEVELS}) WHERE peak >= 20")
def _(t):
    return day_levels(t, peak=20.0).select("user_id", "day", F.round("peak", 6).alias("peak"), "n")


@query("p8_rms_gate", f"SELECT user_id, day, round(rms, 6) AS rms, rms >= 1.5 * 12 AS is_active FROM ({DAY_LEVELS}) WHERE rms >= 12")
def _(t):
    """The window floor, and the stricter bound for an event inside it."""
    return day_levels(t, floor=12.0).select("user_id", "day", F.round("rms", 6).alias("rms"), (F.col("rms") >= 1.5 * 12).alias("is_active"))


@query(
    "p9_owned_events",
    "WITH e AS (SELECT event_id, (epoch_us(ts) % 14400000000) / 3600000000.0::DOUBLE AS s, value / 60.0::DOUBLE AS d FROM events) "
    "SELECT event_id, round(s + d / 2, 6) AS middle FROM e WHERE (s + (s + d)) / 2 >= 1 AND (s + (s + d)) / 2 < 3",
)
def _(t):
    """Four-hour windows; an event lasts ``value`` minutes."""
    start = (F.col("us") % 14_400_000_000) / 3_600_000_000
    df = stream(t).select("event_id", start.alias("s"), (F.col("value") / 60.0).alias("d"))
    kept = Q.owned_events(df, F.col("s"), F.col("s") + F.col("d"))
    return kept.select("event_id", F.round(F.col("s") + F.col("d") / 2, 6).alias("middle"))
