"""Per-stream time series: smoothing, streaks, runs, intervals, gates and caps.

Everything that looks at neighbouring rows goes through ``ordered.py``, so a
stream that holds a third of all rows is worked on by many tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vecmeadow.functions.floor import FLOOR_MIN, INIT_FRAMES, INIT_QUANTILE, FloorMap, chunk_map, composed, noise_floor
from vecmeadow.operators.ordered import ROWS_PER_TASK, arrange, before, first_rows, highest, numbered, position, total
from vecmeadow.session import checkpointed, small_side

SCORE_PLACES = 12  # places of smoothed scores, so that sums in another order decide the same
CHUNK_FRAMES = 2048  # frames of a stream that one array holds
FRAMES_PER_TASK = 50_000  # frames whose maps one task composes
FAN_IN = 256  # chunk maps that one task holds


def sessions(df: DataFrame, keys: list[str], time: str, tie: str, gap: int, limit: int = ROWS_PER_TASK) -> DataFrame:
    """Add ``session``: it grows by one after each pause longer than ``gap`` (``time`` is numeric)."""
    rows = arrange(df, keys, time, tie, limit).columns(__before=before(F.col(time)))
    fresh = (F.col("__before").isNull() | (F.col(time) - F.col("__before") > gap)).cast("long")
    return rows.columns(session=total(fresh)).result().drop("__before")


def smooth(
    df: DataFrame, stream: str, label: str, time: str, tie: str, value: str, alpha: float = 0.55, gap: int = 3_500_000,
    limit: int = ROWS_PER_TASK, out: str = "smoothed",
) -> DataFrame:
    """Gap-reset exponential smoothing per (stream, label).

    The first value after a pause of the *stream* enters unchanged, later ones as
    ``alpha * x + (1 - alpha) * before``. This linear recurrence is a weighted
    running sum, computed in blocks short enough that the weights stay in range;
    what a block inherits is its predecessor's last value, and anything older has
    decayed below the smallest difference a double can hold.
    """
    keys = [stream, "session", label]
    rows = arrange(sessions(df, [stream], time, tie, gap, limit), keys, time, tie, limit).columns(__n=position())
    keep = 1.0 - alpha
    block_rows = max(2, int(200 / -math.log10(keep))) if 0 < keep < 1 else 1 << 30
    numbered_rows = rows.result()
    at = F.col("__n") - 1
    blocks = numbered_rows.withColumn("__b", F.floor(at / block_rows)).withColumn("__j", at % block_rows)
    if keep == 0:
        return blocks.withColumn(out, F.col(value).cast("double")).drop("__n", "__b", "__j")
    order = Window.partitionBy(*keys, "__b").orderBy("__j").rowsBetween(Window.unboundedPreceding, 0)
    weight = F.when(F.col("__n") == 1, 1.0).otherwise(alpha)
    decay = F.pow(F.lit(keep), F.col("__j"))
    local = F.sum(weight * F.col(value) / decay).over(order) * decay
    blocks = blocks.withColumn(out, local)
    if rows.largest > block_rows:
        ends = blocks.filter(F.col("__j") == block_rows - 1).select(
            *keys, (F.col("__b") + 1).alias("__b"), F.col(out).alias("__last")
        )
        blocks = blocks.join(ends, [*keys, "__b"], "left")
        carried = F.coalesce("__last", F.lit(0.0)) * decay * keep
        blocks = blocks.withColumn(out, F.col(out) + carried).drop("__last")
    return blocks.drop("__n", "__b", "__j")


def streaks(
    df: DataFrame, stream: str, label: str, time: str, tie: str, gate: Column, sure: Column, needed: int = 2,
    limit: int = ROWS_PER_TASK,
) -> DataFrame:
    """Add ``streak`` and ``is_known``.

    Consecutive gated rows of the same label build a streak, a failed gate resets
    it, and a sure row sets it to ``needed`` at once. Known means a gated row whose streak
    has reached ``needed``.
    """
    base = df.withColumn("__gate", F.coalesce(gate, F.lit(False))).withColumn("__sure", F.coalesce(sure, F.lit(False)))
    state = F.struct(F.col(label).alias("l"), F.col("__gate").alias("g"))
    rows = arrange(base, [stream], time, tie, limit).columns(__n=position(), __prev=before(state))
    same = F.col("__gate") & F.coalesce(F.col("__prev.g") & (F.col("__prev.l") == F.col(label)), F.lit(False))
    begin = F.when(~same, F.col("__n"))
    rows = rows.columns(
        __begin=highest(begin), __set=highest(F.when(F.col("__gate") & F.col("__sure"), F.col("__n")))
    )
    from_begin = F.col("__n") - F.col("__begin") + 1
    from_set = F.when(F.col("__set") >= F.col("__begin"), F.col("__n") - F.col("__set") + needed)
    streak = F.when(F.col("__gate"), F.coalesce(from_set, from_begin)).otherwise(F.lit(0)).cast("long")
    df = rows.result().withColumn("streak", streak)
    df = df.withColumn("is_known", F.col("__gate") & (F.col("streak") >= needed))
    return df.drop("__gate", "__sure", "__n", "__prev", "__begin", "__set")


def decisions(
    df: DataFrame, stream: str, label: str, time: str, tie: str, value: str, alpha: float = 0.55, gap: int = 3_500_000,
    theta: float = 0.0, sure: float = 0.45, needed: int = 2, margin: float = 0.0, limit: int = ROWS_PER_TASK,
) -> DataFrame:
    """Add ``best_label``, ``smoothed`` (its score), ``second``, ``streak`` and ``is_known``, as ``streaming.state.decision_stream`` does.

    Each row carries the last smoothed score of every label of the session, so labels are as many as columns.
    """
    labels = sorted(r[0] for r in df.select(label).distinct().collect() if r[0] is not None)
    rows = smooth(df, stream, label, time, tie, value, alpha, gap, limit, out="__own")
    rows = arrange(rows, [stream, "session"], time, tie, limit).columns(__n=position())
    own = F.struct(F.col("__n").alias("n"), F.round("__own", SCORE_PLACES).alias("s"))
    rows = rows.columns(**{f"__l{i}": highest(F.when(F.col(label) == F.lit(name), own)) for i, name in enumerate(labels)}).result()
    # Sorted by falling score, then by label.
    scores = F.array_sort(F.filter(
        F.array(*[F.struct((-F.col(f"__l{i}.s")).alias("s"), F.lit(name).alias("l")) for i, name in enumerate(labels)]), lambda x: x.s.isNotNull()
    ))
    rows = rows.withColumn("__scores", scores).withColumns({
        "best_label": F.get("__scores", F.lit(0)).l, "smoothed": -F.get("__scores", F.lit(0)).s,
        "second": F.coalesce(-F.get("__scores", F.lit(1)).s, F.lit(0.0)),
    }).drop("__n", "__own", "__scores", "session", *[f"__l{i}" for i in range(len(labels))])
    gate = (F.col("smoothed") >= theta) & (F.col("smoothed") - F.col("second") >= margin)
    return streaks(rows, stream, "best_label", time, tie, gate, F.col("smoothed") >= sure, needed, limit)


def frames(df: DataFrame, stream: str, time: str, tie: str, per_clip: int = 120, limit: int = ROWS_PER_TASK) -> DataFrame:
    """Number the rows of a stream and cut them into clips of ``per_clip`` frames: adds ``clip`` and ``frame``."""
    rows = numbered(df, [stream], time, tie, "__n", limit)
    at = F.col("__n") - 1
    return rows.withColumns({"clip": F.floor(at / per_clip).cast("long"), "frame": (at % per_clip).cast("long")}).drop("__n")


def start_levels(framed: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Exact interpolated 15th percentile of the first frames of each clip."""
    head = framed.filter(F.col("frame") < INIT_FRAMES)
    return head.groupBy(*keys).agg(F.percentile(F.col(value), F.lit(INIT_QUANTILE)).alias("start_level"))


def chunk_entries(maps: DataFrame, starts: DataFrame, stream: str, fan_in: int = FAN_IN) -> DataFrame:
    """(stream, chunk, entry): the floor before each chunk. ``maps`` has the map ``m`` of every chunk from 0 on, ``starts`` the first ``entry``.

    A group of ``fan_in`` maps is composed to one map of a higher level, until a stream is one group; then floors come down
    level by level. So no task holds more than ``fan_in`` maps, however long the stream.
    """
    types = {f.name: f.dataType.simpleString() for f in maps.schema.fields}
    kept = f"{stream} {types[stream]}, chunk long, m struct<starts: array<double>, slopes: array<double>, fixed: array<double>>"
    maps = maps.withColumn("__group", F.floor(F.col("chunk") / fan_in).cast("long"))

    def pieces(m) -> FloorMap:
        return FloorMap(*(np.asarray(m[name], dtype=np.float64) for name in ("starts", "slopes", "fixed")))

    def compose(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = composed(list(map(pieces, rows.sort_values("chunk")["m"])))
        return pd.DataFrame({stream: [key[0]], "chunk": [key[1]], "m": [{n: getattr(found, n).tolist() for n in ("starts", "slopes", "fixed")}]})

    def carry(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("chunk")
        floor, before = float(rows["entry"].iloc[0]), []
        for m in rows["m"]:
            before.append(floor)
            floor = pieces(m)(floor)
        return pd.DataFrame({stream: rows[stream], "chunk": rows["chunk"], "entry": before})

    if maps.filter("__group > 0").isEmpty():
        first = starts.select(stream, F.lit(0).cast("long").alias("__group"), "entry")
    else:
        above = maps.groupBy(stream, "__group").applyInPandas(compose, kept)
        first = chunk_entries(checkpointed(above), starts, stream, fan_in).withColumnRenamed("chunk", "__group")
    return maps.join(first, [stream, "__group"]).groupBy(stream, "__group").applyInPandas(carry, f"{stream} {types[stream]}, chunk long, entry double")


def track_floor(
    df: DataFrame, stream: str, time: str, tie: str, value: str, per_chunk: int = CHUNK_FRAMES, limit: int = ROWS_PER_TASK, fan_in: int = FAN_IN
) -> DataFrame:
    """Per row of a stream of any length: ``frame`` (its place from 0), ``noise_floor`` and ``triggered``. Rows without a value are left out.

    The first frames give the start level. A longer stream is cut into chunks: each chunk's map from the floor before it to the floor after it is
    composed by itself, the maps hand the floor on, and then all chunks are tracked at once.
    """
    rows = numbered(df.filter(F.col(value).isNotNull()).select(stream, time, tie, value), [stream], time, tie, "__n", limit)
    rows = rows.withColumn("frame", F.col("__n") - 1).withColumn("chunk", F.floor(F.col("frame") / per_chunk).cast("long"))
    ordered = F.array_sort(F.collect_list(F.struct("frame", F.col(tie).alias("id"), F.col(value).cast("double").alias("x"))))
    chunks = rows.groupBy(stream, "chunk").agg(ordered.alias("a"))
    x = F.transform("a", lambda s: s["x"])
    chunks = checkpointed(chunks.select(stream, "chunk", F.transform("a", lambda s: s["frame"]).alias("f"), F.transform("a", lambda s: s["id"]).alias("id"), x.alias("x")))
    few = chunks.filter(F.col("chunk") * per_chunk < INIT_FRAMES)
    heads = few.select(stream, F.explode(F.arrays_zip("f", "x")).alias("z")).filter(F.col("z.f") < INIT_FRAMES)
    starts = heads.groupBy(stream).agg(F.greatest(F.lit(FLOOR_MIN), F.percentile(F.col("z.x"), F.lit(INIT_QUANTILE))).alias("entry"))
    cut, most = chunks.agg(F.max("chunk"), F.max(F.array_max("x"))).first()
    if not cut:
        entries = starts.withColumn("chunk", F.lit(0).cast("long"))
    else:
        # Composing takes time, not bytes: a task gets a bounded number of frames. A floor never lies over the highest level.
        tasks = max(1, chunks.count() * min(per_chunk, FRAMES_PER_TASK) // FRAMES_PER_TASK)
        maps = chunks.select(stream, "chunk", "x").repartition(tasks).select(stream, "chunk", chunk_map("x", max(most, FLOOR_MIN)).alias("m"))
        entries = chunk_entries(checkpointed(maps), starts, stream, fan_in)
    tracked = chunks.join(entries, [stream, "chunk"]).select(stream, "f", "id", "x", noise_floor("x", "entry").alias("t"))
    each = F.explode(F.arrays_zip("f", "id", "x", F.col("t.floor").alias("floor"), F.col("t.triggered").alias("triggered")))
    return tracked.select(stream, each.alias("z")).select(
        stream, F.col("z.f").alias("frame"), F.col("z.id").alias(tie), F.col("z.x").alias(value),
        F.col("z.floor").alias("noise_floor"), F.col("z.triggered").alias("triggered"),
    )


def runs(
    framed: DataFrame, keys: list[str], flag: str, least: int, hop: float, frame: float, length: Column | None = None,
    limit: int = ROWS_PER_TASK,
) -> DataFrame:
    """Runs of at least ``least`` flagged frames as ``start, end, frames`` in time units.

    A closed run ends at ``min(length, m * hop + frame)`` where ``m`` is the frame
    after it; a run that reaches the last frame ends at ``length``.
    """
    length = F.lit(float("inf")) if length is None else length
    on = numbered(framed.filter(F.col(flag)), keys, "frame", "frame", "__n", limit)
    islands = on.groupBy(*keys, (F.col("frame") - F.col("__n")).alias("__island")).agg(
        F.min("frame").alias("__from"), F.max("frame").alias("__to"), F.count(F.lit(1)).alias("frames")
    )
    ends = framed.groupBy(*keys).agg(F.max("frame").alias("__last"), (F.max("frame") * hop + frame).alias("__span"))
    whole = F.least(length, F.col("__span"))
    end = F.when(F.col("__to") == F.col("__last"), whole).otherwise(F.least(whole, (F.col("__to") + 1) * hop + frame))
    return islands.filter(F.col("frames") >= least).join(ends, keys).select(
        *keys, (F.col("__from") * hop).alias("start"), end.alias("end"), "frames"
    )


def merge_intervals(
    df: DataFrame, keys: list[str], start: str, end: str, tolerance: float, tie: str, limit: int = ROWS_PER_TASK
) -> DataFrame:
    """Join intervals that begin no later than ``tolerance`` after the furthest end so far."""
    rows = arrange(df, keys, start, tie, limit).columns(__reach=highest(F.col(end), inclusive=False))
    fresh = (F.col("__reach").isNull() | (F.col(start) > F.col("__reach") + tolerance)).cast("long")
    merged = rows.columns(__island=total(fresh)).result()
    return merged.groupBy(*keys, "__island").agg(
        F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("merged")
    ).drop("__island")


def scaled_mask(df: DataFrame, keys: list[str], value: str, threshold: float = 0.2) -> DataFrame:
    """Min-max scale per recording and keep cells above ``threshold``; constant recordings give nothing.

    Extremes are a partial aggregate joined back, not a window over the recording.
    """
    extremes = df.groupBy(*keys).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi")).filter("__hi > __lo")
    scaled = (F.col(value) - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))
    return df.join(extremes, keys).withColumn("scaled", scaled).filter(F.col("scaled") > threshold).drop("__lo", "__hi")


def mask_runs(cells: DataFrame, keys: list[str], limit: int = ROWS_PER_TASK) -> DataFrame:
    """Runs ``(keys, band, a, b)`` of neighbouring frames of each band; repeated cells count once."""
    rows = numbered(cells.select(*keys, "band", "frame").distinct(), [*keys, "band"], "frame", "frame", "__n", limit)
    islands = rows.groupBy(*keys, "band", (F.col("frame") - F.col("__n")).alias("__i"))
    return islands.agg(F.min("frame").alias("a"), F.max("frame").alias("b")).drop("__i")


def _sweep(runs_: DataFrame, keys: list[str], least: int, limit: int) -> DataFrame:
    """Longest runs of frames that at least ``least`` of a band's runs cover: two events per run, added up in frame order."""
    by = [*keys, "band"]
    step = lambda at, d: F.struct(at.alias("at"), F.lit(d).alias("d"))
    events = runs_.select(*by, F.explode(F.array(step(F.col("a"), 1), step(F.col("b") + 1, -1))).alias("e"))
    events = events.groupBy(*by, F.col("e.at").alias("at")).agg(F.sum("e.d").alias("d")).filter("d <> 0")
    levels = arrange(events, by, "at", "at", limit).columns(level=total(F.col("d"))).result()
    on = F.col("level") >= least
    turns = checkpointed(levels.filter(on != (F.col("level") - F.col("d") >= least)).select(*by, "at", on.alias("on")))
    ends = arrange(turns, by, "at", "at", limit).columns(a=before(F.col("at"))).result().filter("NOT on")
    return ends.select(*by, "a", (F.col("at") - 1).alias("b"))


def closed_runs(active: DataFrame, keys: list[str], bands: int = 3, frames_: int = 5, limit: int = ROWS_PER_TASK) -> DataFrame:
    """Binary closing of active cells ``(keys, band, frame, n_bands, n_frames)`` as runs ``(keys, n_bands, n_frames, band, a, b)``.

    Along frames, dilation and erosion move the ends of a run. Across bands, dilation is the union of the runs of the
    bands around and erosion is their intersection, so with three bands a run becomes at most six rows, however long it is. Cells
    outside the grid count as off. ``bands`` and ``frames_`` are odd.
    """
    by = [*keys, "n_bands", "n_frames"]
    wide = frames_ // 2
    around = F.explode(F.sequence(F.lit(-(bands // 2)), F.lit(bands // 2)))

    def moved(found: DataFrame, grow: int) -> DataFrame:
        a, b = F.col("a") - grow, F.col("b") + grow
        if grow > 0:
            a, b = F.greatest(F.lit(0), a), F.least(F.col("n_frames") - 1, b)
        ends = found.select(*by, "band", a.cast("long").alias("a"), b.cast("long").alias("b"), around.alias("__by"))
        shifted = ends.select(*by, (F.col("band") + F.col("__by")).alias("band"), "a", "b")
        return shifted.filter("a <= b AND band >= 0 AND band < n_bands")

    dilated = _sweep(moved(checkpointed(mask_runs(active, by, limit)), wide), by, 1, limit)
    return _sweep(moved(dilated, -wide), by, bands, limit)


def closed_mask(active: DataFrame, keys: list[str], bands: int = 3, frames_: int = 5) -> DataFrame:
    """The cells of ``closed_runs``."""
    found = closed_runs(active, keys, bands, frames_)
    return found.select(*keys, "band", F.explode(F.sequence("a", "b")).alias("frame"), "n_bands", "n_frames")


def blobs(cells: DataFrame, keys: list[str], limit: int = ROWS_PER_TASK) -> DataFrame:
    """Time extent ``first, last`` (frames) of each edge-connected group of cells."""
    return run_blobs(mask_runs(cells, keys, limit), keys)


def run_blobs(run: DataFrame, keys: list[str]) -> DataFrame:
    """Time extent ``first, last`` of each edge-connected group of runs ``(keys, band, a, b)``.

    Labels spread over overlapping runs of neighbouring bands, with pointer jumping, until nothing changes.
    """
    # A run is named by its place, so no two runs share a name.
    named = F.struct(*keys, "band", "a")
    run = checkpointed(run.select(*keys, "band", "a", "b", named.alias("node")))
    # Long runs are indexed by fixed frame buckets, so the overlap test is an equality join.
    bucket = 64
    spread = run.withColumn("__k", F.explode(F.sequence(F.floor(F.col("a") / bucket), F.floor(F.col("b") / bucket))))
    up = spread.select(
        *keys, (F.col("band") + 1).alias("band"), "__k", F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("node").alias("other")
    )
    touching = spread.join(up, [*keys, "band", "__k"]).filter("a <= b2 AND a2 <= b").select("node", "other").distinct()
    edges = checkpointed(touching.unionByName(touching.select(F.col("other").alias("node"), F.col("node").alias("other"))))
    labels = run.select("node", F.col("node").alias("root"))
    while True:
        near = edges.join(labels.withColumnsRenamed({"node": "other", "root": "r"}), "other").groupBy("node").agg(F.min("r").alias("r"))
        lowered = labels.join(near, "node", "left").select("node", F.least("root", "r").alias("root"), F.col("root").alias("old"))
        hop = lowered.select(F.col("node").alias("root"), F.col("root").alias("next"))
        jumped = checkpointed(lowered.join(hop, "root").select("node", F.least("root", "next").alias("root"), "old"))
        changed = jumped.filter(F.col("root") != F.col("old")).limit(1).count()
        labels = jumped.drop("old")
        if not changed:
            break
    return run.join(labels, "node").groupBy(*keys, "root").agg(F.min("a").alias("first"), F.max("b").alias("last")).drop("root")


def loudest(df: DataFrame, keys: list[str], value: str, tie: str, n: int, floor: float) -> DataFrame:
    """The ``n`` strongest rows above ``floor`` per recording."""
    return first_rows(df.filter(F.col(value) > floor), keys, [F.desc(value), F.asc(tie)], n)


def keep_share(df: DataFrame, keys: list[str], value: str, tie: str, share: float = 0.4, limit: int = ROWS_PER_TASK) -> DataFrame:
    """The strongest ``share`` of each label, at least one row."""
    ranked = numbered(df.withColumn("__down", -F.col(value)), keys, "__down", tie, "rank", limit).drop("__down")
    kept = F.greatest(F.floor(F.col("__n") * F.lit(float(share))), F.lit(1))
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    return ranked.join(small_side(checkpointed(sizes)), keys).filter(F.col("rank") <= kept).drop("__n")


def capped(
    df: DataFrame, label: list[str], recording: list[str], order: list[Column], per_recording: int, per_label: int
) -> DataFrame:
    """At most ``per_recording`` rows of a recording, then at most ``per_label`` rows of a label."""
    inner = first_rows(df, [*label, *recording], order, per_recording, "__r").drop("__r")
    return first_rows(inner, label, order, per_label)


def recent_repeats(
    df: DataFrame, stream: str, content: str, time: str, tie: str, within: int = 20, limit: int = ROWS_PER_TASK
) -> DataFrame:
    """Add ``is_repeat``: the same content occurred at most ``within`` rows earlier in the stream."""
    rows = numbered(df, [stream], time, tie, "__n", limit)
    rows = arrange(rows, [stream, content], "__n", "__n", limit).columns(__before=before(F.col("__n")))
    repeat = F.coalesce(F.col("__n") - F.col("__before") <= within, F.lit(False))
    return rows.result().withColumn("is_repeat", repeat).drop("__n", "__before")


def drop_recent(
    df: DataFrame, stream: str, content: str, time: str, tie: str, within: int = 20, limit: int = ROWS_PER_TASK
) -> DataFrame:
    """Keep a row unless its content is among the last ``within`` *kept* contents of the stream.

    Whether a row is kept depends on earlier rows only, so the decision is the
    single fixed point of "recount the kept rows, decide again". The loop ends when
    a round changes nothing, which makes the result exact.
    """
    rows = numbered(df.select(stream, content, time, tie), [stream], time, tie, "__n", limit)
    state = checkpointed(rows.withColumn("kept", F.lit(True)))
    while True:
        counted = arrange(state, [stream], "__n", "__n", limit).columns(__k=total(F.col("kept").cast("long")))
        counted = counted.result().withColumn("__k", F.col("__k") - F.col("kept").cast("long"))
        # __k: kept rows before this one; a kept row itself is number __k + 1.
        last = arrange(counted, [stream, content], "__n", "__n", limit).columns(
            __last=highest(F.when(F.col("kept"), F.col("__k") + 1), inclusive=False)
        )
        decided = last.result().withColumn(
            "now", F.coalesce(F.col("__k") - F.col("__last") >= within, F.lit(True))
        )
        decided = checkpointed(decided.select(*state.columns, "now"))
        changed = decided.filter(F.col("now") != F.col("kept")).limit(1).count()
        state = decided.withColumn("kept", F.col("now")).drop("now")
        if not changed:
            break
    return df.join(state.filter("kept").select(stream, tie), [stream, tie], "left_semi")


def level_gate(df: DataFrame, keys: list[Column], value: str, peak: float | None = None, floor: float | None = None) -> DataFrame:
    """Per window: ``peak`` and ``rms`` levels, keeping windows that reach the given bounds."""
    x = F.col(value).cast("double")
    levels = df.groupBy(*keys).agg(
        F.max(F.abs(x)).alias("peak"), F.sqrt(F.avg(x * x) + F.lit(1e-12)).alias("rms"), F.count(F.lit(1)).alias("n")
    )
    if peak is not None:
        levels = levels.filter(F.col("peak") >= peak)
    if floor is not None:
        levels = levels.filter(F.col("rms") >= floor)
    return levels


def owned_events(df: DataFrame, start: Column, end: Column, low: float = 1.0, high: float = 3.0) -> DataFrame:
    """Keep events whose middle falls in ``[low, high)`` of the window, so overlapping windows share none."""
    middle = (start + end) / 2
    return df.filter((middle >= low) & (middle < high))
