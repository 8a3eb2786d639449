"""Frame levels and activity of sample arrays, batch by batch."""

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from vecmeadow.functions.floor import FLOOR_MIN, MIN_FRAMES, track

RESULT = (
    "is_vocal boolean, peak_rms double, noise_floor double, frame_count long, triggered_frames long, "
    "intervals array<struct<start:double,end:double>>"
)


def frame_levels(samples: np.ndarray, frame: int, hop: int) -> np.ndarray:
    """RMS of overlapping frames; short input is padded to one frame."""
    if len(samples) == 0:
        return np.empty(0)
    if len(samples) < frame:
        samples = np.pad(samples, (0, frame - len(samples)))
    views = np.lib.stride_tricks.sliding_window_view(samples, frame)[::hop]
    return np.sqrt((views * views).mean(axis=1) + 1e-12)


def intervals_of(flags: np.ndarray, least: int, frame: int, hop: int, size: int, rate: int) -> list[dict]:
    """Runs of at least ``least`` frames in seconds; an open run ends with the clip."""
    edges = np.flatnonzero(np.diff(np.r_[0, flags.astype(np.int8), 0]))
    found = []
    for first, after in zip(edges[::2], edges[1::2]):
        if after - first >= least:
            end = size if after == len(flags) else min(size, after * hop + frame)
            found.append({"start": first * hop / rate, "end": end / rate})
    return found


def activity(samples: Column | str, rate: int = 48_000, least: int = MIN_FRAMES, frame_ms: float = 50.0, hop_ms: float = 25.0) -> Column:
    """Struct of activity measures for one bounded clip per row."""
    frame = max(1, round(rate * frame_ms / 1000))
    hop = max(1, round(rate * hop_ms / 1000))

    def run(clips: pd.Series) -> pd.DataFrame:
        arrays = [np.asarray(c, dtype=np.float64) for c in clips]
        levels = [frame_levels(a, frame, hop) for a in arrays]
        floors, flags = track(levels)
        rows = []
        for a, level, floor, flag in zip(arrays, levels, floors, flags):
            if len(a) == 0:
                rows.append((False, 0.0, FLOOR_MIN, 0, 0, []))
                continue
            loud = np.abs(a).max() >= 1e-4
            spans = intervals_of(flag, least, frame, hop, len(a), rate) if loud else []
            rows.append((len(spans) > 0, level.max(), floor.mean(), len(level), int(flag.sum()), spans))
        names = ["is_vocal", "peak_rms", "noise_floor", "frame_count", "triggered_frames", "intervals"]
        return pd.DataFrame(rows, columns=names)

    return F.pandas_udf(run, RESULT)(samples)
