"""Keyed state across micro-batches: smoothing with streaks, noise floor, recent repeats.

State per stream is a few numbers (or the last hashes), kept in the state
store. One micro-batch of one stream is put in time order in memory, so the
source's rate limit (``maxFilesPerTrigger``, ``maxOffsetsPerTrigger``) bounds it;
for history use the batch operators in ``operators.sequences``, which split hot streams.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from vecmeadow.functions.floor import INIT_FRAMES, initial_floor, step_one
from vecmeadow.operators.sequences import SCORE_PLACES


def _in_order(parts: Iterator[pd.DataFrame], time: str, tie: str) -> pd.DataFrame:
    return pd.concat(list(parts)).sort_values([time, tie], kind="stable")


def decision_stream(
    stream: DataFrame, key: str, label: str, time: str, tie: str, value: str, alpha: float = 0.55,
    gap: int = 3_500_000, theta: float = 0.0, sure: float = 0.45, needed: int = 2, margin: float = 0.0,
) -> DataFrame:
    """The decision on smoothed scores; ``sequences.decisions`` is the batch form.

    A row updates its label's smoothed score. Then the best smoothed label of the stream is gated by ``theta`` and by
    ``margin`` to the second (0 if there is none), and the streak is the best label's. A pause longer than ``gap`` clears
    the scores but not the streak. Equal scores go to the smaller label; a null label updates none. Emits ``key, tie, best_label, smoothed, second, streak, is_known``.
    """
    types = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    out = f"{key} {types[key]}, {tie} {types[tie]}, best_label {types[label]}, smoothed double, second double, streak long, is_known boolean"
    held = f"last long, labels array<{types[label]}>, scores array<double>, streak_label {types[label]}, streak long"

    def fold(group, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = _in_order(parts, time, tie)
        last, labels, scores, streak_label, streak = state.get if state.exists else (None, [], [], None, 0)
        smoothed = dict(zip(labels, scores))
        results = []
        for at, name, x in zip(rows[time].tolist(), rows[label].tolist(), rows[value].tolist()):
            if last is not None and at - last > gap:
                smoothed.clear()
            last = at
            if name is not None:
                before = smoothed.get(name)
                smoothed[name] = x if before is None else alpha * x + (1.0 - alpha) * before
            if not smoothed:
                streak_label, streak = None, 0
                results.append((None, None, 0.0, 0, False))
                continue
            shown = {n: round(v, SCORE_PLACES) for n, v in smoothed.items()}
            best = min(shown, key=lambda n: (-shown[n], n))
            score, second = shown[best], max((v for n, v in shown.items() if n != best), default=0.0)
            if score < theta or score - second < margin:
                streak_label, streak = None, 0
            elif score >= sure:
                streak_label, streak = best, needed
            elif streak_label == best:
                streak += 1
            else:
                streak_label, streak = best, 1
            results.append((best, score, second, streak, streak_label is not None and streak >= needed))
        state.update((last, list(smoothed), list(smoothed.values()), streak_label, streak))
        done = pd.DataFrame(results, columns=["best_label", "smoothed", "second", "streak", "is_known"])
        yield pd.concat([rows[[key, tie]].reset_index(drop=True), done], axis=1)

    return stream.select(key, label, time, tie, value).groupBy(key).applyInPandasWithState(
        fold, out, held, "append", GroupStateTimeout.NoTimeout
    )


def floor_stream(stream: DataFrame, key: str, event_time: str, tie: str, value: str, idle: int = 3_600_000) -> DataFrame:
    """Adaptive noise floor with the start level of the batch operators, whatever the micro-batches: ``key, tie, noise_floor, triggered``.

    ``event_time`` is a timestamp with a watermark. A stream's frames are held until there are ``INIT_FRAMES``, or until the watermark
    is ``idle`` milliseconds past its last one, which ends a shorter stream; then all held rows are emitted. Later frames go on from there.
    """
    types = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    out = f"{key} {types[key]}, {tie} {types[tie]}, noise_floor double, triggered boolean"
    held = f"floor double, times array<long>, ties array<{types[tie]}>, levels array<double>"

    def fold(group, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        floor, times, ties, levels = state.get if state.exists else (None, [], [], [])
        rows = pd.DataFrame({"at": list(times), tie: list(ties), value: list(levels)})
        if not state.hasTimedOut:
            rows = _in_order(iter([p for p in (rows, *parts) if len(p)]), "at", tie)
            if floor is None and len(rows) < INIT_FRAMES:
                state.update((None, rows["at"].tolist(), rows[tie].tolist(), rows[value].tolist()))
                state.setTimeoutTimestamp(max(int(rows["at"].max()) // 1000 + idle, state.getCurrentWatermarkMs() + 1))
                return
        levels = rows[value].to_numpy(dtype=np.float64)
        if floor is None:
            floor = float(initial_floor(levels[None, :], np.array([len(levels)]))[0])
        floors, flags = [], []
        for level in levels.tolist():
            floor, triggered = step_one(floor, level)
            floors.append(floor)
            flags.append(triggered)
        state.update((floor, [], [], []))
        yield pd.DataFrame({key: group[0], tie: rows[tie].to_numpy(), "noise_floor": floors, "triggered": flags})

    frames = stream.select(key, event_time, F.unix_micros(event_time).alias("at"), tie, value)
    return frames.groupBy(key).applyInPandasWithState(fold, out, held, "append", GroupStateTimeout.EventTimeTimeout)


def drop_recent_stream(stream: DataFrame, key: str, content: str, time: str, tie: str, within: int = 20) -> DataFrame:
    """Drop a row whose content is among the last ``within`` accepted contents of its stream."""
    types = {f.name: f.dataType.simpleString() for f in stream.schema.fields}

    def fold(group, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = _in_order(parts, time, tie)
        recent = list(state.get[0]) if state.exists else []
        kept = []
        for name in rows[content].tolist():
            fresh = name not in recent
            kept.append(fresh)
            if fresh:
                recent = (recent + [name])[-within:]
        state.update((recent,))
        yield rows.loc[np.array(kept, dtype=bool), [key, tie]]

    return stream.select(key, content, time, tie).groupBy(key).applyInPandasWithState(
        fold, f"{key} {types[key]}, {tie} {types[tie]}", "recent array<string>", "append", GroupStateTimeout.NoTimeout
    )


def dedup_within(stream: DataFrame, columns: list[str]) -> DataFrame:
    """Drop repeats of ``columns`` as long as the watermark has not passed the first one.

    Hashing spreads contents over the state partitions, so a busy stream is no hot key.
    """
    return stream.dropDuplicatesWithinWatermark(columns)
