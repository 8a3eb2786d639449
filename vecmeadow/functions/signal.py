"""Sample arrays: levels, windows and segments as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vecmeadow.functions.vectors import let


def peak(x: Column) -> Column:
    return F.array_max(F.transform(x, lambda s: F.abs(s.cast("double"))))


def mean_square(x: Column) -> Column:
    total = F.aggregate(x, F.lit(0.0), lambda acc, s: acc + s.cast("double") * s.cast("double"))
    return total / F.size(x)


def rms(x: Column) -> Column:
    """Root mean square with the 1e-12 guard."""
    return F.sqrt(mean_square(x) + F.lit(1e-12))


def sanitise(x: Column) -> Column:
    """NaN to 0, +Inf to 1, -Inf to -1."""
    return F.transform(
        x.cast("array<double>"),
        lambda s: F.when(F.isnan(s), 0.0)
        .when(s == float("inf"), 1.0)
        .when(s == float("-inf"), -1.0)
        .otherwise(s),
    )


def clip_unit(s: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), s))


def peak_normalise(x: Column, target: float = 0.95) -> Column:
    """Scale so that the peak is ``target``; near-silence is only clipped."""

    def scaled(samples: Column) -> Column:
        top = peak(samples)
        scale = F.when(top < 1e-6, F.lit(1.0)).otherwise(F.lit(target) / (top + F.lit(1e-10)))
        return let(scale, lambda k: F.transform(samples, lambda s: clip_unit(s * k)))

    return let(x.cast("array<double>"), scaled)


def pad_right(x: Column, n: Column | int) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    missing = F.greatest(F.lit(0), n - F.size(x)).cast("int")
    return F.concat(x.cast("array<double>"), F.array_repeat(F.lit(0.0), missing))


def fit_length(x: Column, n: int) -> Column:
    """Centre crop, or pad on both sides (the odd sample goes right)."""
    x = x.cast("array<double>")
    size = F.size(x)
    crop_from = F.floor((size - n) / 2).cast("int")
    left = F.floor((F.lit(n) - size) / 2).cast("int")
    zeros = lambda count: F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), count).cast("int"))
    return F.when(size >= n, F.slice(x, crop_from + 1, n)).otherwise(
        F.concat(zeros(left), x, zeros(F.lit(n) - size - left))
    )


def centred_window(x: Column, start: Column, end: Column, n: int, rate: int) -> Column:
    """``n`` samples around the middle of ``[start, end]`` seconds, moved inside the array and padded on the right."""
    x = x.cast("array<double>")
    length = F.size(x) / F.lit(float(rate))
    width = n / rate
    begin = F.greatest(F.lit(0.0), (start + end) / 2 - width / 2)
    late = begin + width > length
    begin = F.when(late, F.greatest(F.lit(0.0), length - width)).otherwise(begin)
    finish = F.when(late, length).otherwise(begin + width)
    first = F.floor(begin * rate).cast("int")
    last = F.floor(finish * rate).cast("int")
    return pad_right(F.slice(x, first + 1, F.greatest(F.lit(0), last - first)), n)


def downmix(interleaved: Column, channels: int) -> Column:
    """Mean of ``channels`` interleaved channels."""

    def mixed(x: Column) -> Column:
        frames = F.floor(F.size(x) / channels).cast("int")
        mean = lambda i: F.aggregate(
            F.slice(x, i * channels + 1, channels), F.lit(0.0), lambda acc, s: acc + s
        ) / F.lit(float(channels))
        return F.when(frames < 1, F.array().cast("array<double>")).otherwise(
            F.transform(F.sequence(F.lit(0), F.greatest(frames - 1, F.lit(0))), mean)
        )

    return let(interleaved.cast("array<double>"), mixed)


def segment_starts(size: Column, n: int, hop: int, pad_tail: bool = False, tail_min: int = 0, least: int = 100) -> Column:
    """Zero-based start of every segment cut from ``size`` samples.

    Fewer than ``least`` samples give none, fewer than ``n`` give one padded
    segment; a tail is kept only with ``pad_tail`` and at least ``tail_min`` samples.
    """
    size = size.cast("int")
    full = F.floor((size - n) / hop).cast("int") + 1
    grid = F.transform(F.sequence(F.lit(0), F.greatest(full - 1, F.lit(0))), lambda i: i * hop)
    nothing = F.array().cast("array<int>")
    starts = grid
    if pad_tail:
        tail = full * hop
        keep = (tail < size) & (size - tail >= tail_min)
        starts = F.when(keep, F.concat(grid, F.array(tail))).otherwise(grid)
    return F.when(size < least, nothing).when(size < n, F.array(F.lit(0))).otherwise(starts)


def frame_rms(x: Column, frame: int, hop: int) -> Column:
    """RMS of overlapping frames; an input shorter than one frame is padded to one."""

    def levels(padded: Column) -> Column:
        frames = F.greatest(F.lit(1), F.floor((F.size(padded) - frame) / hop).cast("int") + 1)
        return F.transform(F.sequence(F.lit(0), frames - 1), lambda i: rms(F.slice(padded, i * hop + 1, frame)))

    samples = F.when(F.size(x) < frame, pad_right(x, frame)).otherwise(x.cast("array<double>"))
    return F.when(F.size(x) == 0, F.array().cast("array<double>")).otherwise(let(samples, levels))
