"""Adaptive noise floor, vectorised over clips, and the composition of its steps.

One frame maps the floor before it to the floor after it, by a rising map of straight pieces: unchanged below a third of
the level, up slowly below the level, down fast above it, never under the least floor. Such maps compose, so what a whole chunk of frames does is
one list of pieces, at most two more per frame; pieces with the same values become one.
"""

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INIT_FRAMES = 40
INIT_QUANTILE = 0.15
TRIGGER_RATIO = 3.0
ALPHA_UP = 0.01
ALPHA_DOWN = 0.05
FLOOR_MIN = 1e-4
MIN_FRAMES = 12
ROUNDING = 1e-15


def initial_floor(levels: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Linearly interpolated 15th percentile of each row's first frames (rows padded with +inf)."""
    head = np.sort(levels[:, :INIT_FRAMES], axis=1)
    used = np.minimum(counts, INIT_FRAMES)
    at = INIT_QUANTILE * (used - 1)
    low = np.floor(at).astype(int)
    high = np.minimum(low + 1, used - 1)
    rows = np.arange(len(head))
    base = head[rows, low]
    return np.maximum(FLOOR_MIN, base + (head[rows, high] - base) * (at - low))


def step(floor: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One frame for many clips: a triggered frame freezes the floor, others move it down fast or up slowly."""
    triggered = level > TRIGGER_RATIO * floor
    rate = np.where(level < floor, ALPHA_DOWN, ALPHA_UP)
    moved = (1.0 - rate) * floor + rate * level
    return np.maximum(FLOOR_MIN, np.where(triggered, floor, moved)), triggered


def step_one(floor: float, level: float) -> tuple[float, bool]:
    """``step`` for a single clip in plain numbers."""
    if level > TRIGGER_RATIO * floor:
        return max(FLOOR_MIN, floor), True
    rate = ALPHA_DOWN if level < floor else ALPHA_UP
    return max(FLOOR_MIN, (1.0 - rate) * floor + rate * level), False


@dataclass(frozen=True)
class FloorMap:
    """``slopes * floor + fixed`` from each of ``starts`` up to the next; the first start is the least floor."""

    starts: np.ndarray
    slopes: np.ndarray
    fixed: np.ndarray

    def __call__(self, floor: float) -> float:
        i = max(0, int(np.searchsorted(self.starts, floor, side="right")) - 1)
        return float(self.slopes[i] * floor + self.fixed[i])


UNMOVED = FloorMap(np.array([FLOOR_MIN]), np.array([1.0]), np.array([0.0]))


@dataclass(frozen=True)
class Pieces:
    """Pieces of many maps behind one another; ``map_of`` rises."""

    map_of: np.ndarray
    starts: np.ndarray
    slopes: np.ndarray
    fixed: np.ndarray

    def of(self, chosen: np.ndarray) -> "Pieces":
        return Pieces(self.map_of[chosen], self.starts[chosen], self.slopes[chosen], self.fixed[chosen])

    def first(self) -> np.ndarray:
        """Whether a piece is its map's first."""
        return np.r_[True, self.map_of[1:] != self.map_of[:-1]][: len(self.map_of)]


def _last_before(keys: np.ndarray, values: np.ndarray, own_keys: np.ndarray, own: np.ndarray, equal: bool) -> np.ndarray:
    """Per (key, value) the number of the last of ``own`` (sorted by key and value) below it, or with ``equal`` not above it; maybe one of another key."""
    kind = np.r_[np.full(len(own), 0 if equal else 1), np.full(len(values), 1 if equal else 0)]
    order = np.lexsort((kind, np.r_[own, values], np.r_[own_keys, keys]))
    mine = order < len(own)
    out = np.empty(len(values), np.int64)
    out[order[~mine] - len(own)] = np.cumsum(mine)[~mine] - 1
    return out


def composed_pairs(before: Pieces, after: Pieces) -> Pieces:
    """For each map number ``before`` and, on its result, ``after``."""
    key, starts, slopes, fixed = before.map_of, before.starts, before.slopes, before.fixed
    values = slopes * starts + fixed
    values = values[np.lexsort((values, key))]  # where pieces meet, rounding must not turn their order
    # Cut the pieces where their values enter another piece of ``after``.
    cuts = after.of(np.flatnonzero(~after.first()))
    at = _last_before(cuts.map_of, cuts.starts, key, values, equal=False)
    inside = (at >= 0) & (key[at] == cuts.map_of)
    limits, at = cuts.starts[inside], at[inside]
    ends = np.where(np.append(key[1:], -1) == key, np.append(starts[1:], np.inf), np.inf)
    with np.errstate(invalid="ignore", divide="ignore"):
        cut = np.where(slopes[at] > 0, (limits - fixed[at]) / slopes[at], np.inf)
    # A piece that begins at a limit, but for rounding, lies above it.
    near = cut <= starts[at] * (1 + ROUNDING)
    values[at[near]] = limits[near]
    new = ~near & (cut < ends[at] * (1 - ROUNDING))
    where, source = at[new] + 1, at[new]
    starts, values = np.insert(starts, where, cut[new]), np.insert(values, where, limits[new])
    slopes, fixed, key = np.insert(slopes, where, slopes[source]), np.insert(fixed, where, fixed[source]), np.insert(key, where, key[source])
    piece = _last_before(key, values, after.map_of, after.starts, equal=True)
    piece = np.maximum(piece, np.searchsorted(after.map_of, key))  # no value lies under a map's first start, but for rounding
    fixed = after.slopes[piece] * fixed + after.fixed[piece]
    slopes = after.slopes[piece] * slopes
    # A piece whose values differ by less than doubles tell apart is level.
    same = key[1:] == key[:-1]
    ends = np.append(np.where(same, starts[1:], np.inf), np.inf)
    with np.errstate(invalid="ignore"):
        level = slopes * (ends - starts) <= 1e-17 * (fixed + slopes * starts)
    fixed = np.where(level, slopes * starts + fixed, fixed)
    slopes = np.where(level, 0.0, slopes)
    keep = np.r_[True, ~same | (slopes[1:] != slopes[:-1]) | (fixed[1:] != fixed[:-1])]
    return Pieces(key, starts, slopes, fixed).of(keep)


def frame_maps(levels: np.ndarray) -> Pieces:
    """The map of each frame."""
    x = np.asarray(levels, dtype=np.float64)
    low = x <= FLOOR_MIN  # every floor falls, at most to the least one
    third = ~low & (x / TRIGGER_RATIO > FLOOR_MIN)
    up, down = 1.0 - ALPHA_UP, 1.0 - ALPHA_DOWN
    least = np.full(len(x), FLOOR_MIN)
    starts = np.column_stack([
        least, np.where(low, (FLOOR_MIN - ALPHA_DOWN * x) / down, np.where(third, x / TRIGGER_RATIO, x)), x,
    ])
    slopes = np.column_stack([np.where(low, 0.0, np.where(third, 1.0, up)), np.where(third, up, down), np.full(len(x), down)])
    fixed = np.column_stack([
        np.where(low, FLOOR_MIN, np.where(third, 0.0, ALPHA_UP * x)), np.where(third, ALPHA_UP, ALPHA_DOWN) * x, ALPHA_DOWN * x,
    ])
    used = np.column_stack([np.ones(len(x), bool), np.ones(len(x), bool), third])
    return Pieces(np.repeat(np.arange(len(x)), 3).reshape(-1, 3)[used], starts[used], slopes[used], fixed[used])


def fold_maps(pieces: Pieces, counts: np.ndarray, most: float = np.inf) -> list[FloorMap]:
    """The composed map of each group of neighbouring maps (``counts`` of them, one at least): all neighbours are composed at once,
    then all neighbours of the results, and so on. Floors over ``most`` do not occur."""
    counts = np.asarray(counts)
    while True:
        pieces = pieces.of(pieces.first() | (pieces.starts <= most))
        if (counts <= 1).all():
            break
        place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        halves = (counts + 1) // 2
        target = np.repeat(np.cumsum(halves) - halves, counts) + place // 2
        second = place % 2 == 1
        paired = np.bincount(target, minlength=halves.sum())[target] == 2
        moved = Pieces(target[pieces.map_of], pieces.starts, pieces.slopes, pieces.fixed)
        is_second, is_paired = second[pieces.map_of], paired[pieces.map_of]
        joined = composed_pairs(moved.of(is_paired & ~is_second), moved.of(is_paired & is_second))
        alone = moved.of(~is_paired)
        both = [np.concatenate([getattr(joined, n), getattr(alone, n)]) for n in ("map_of", "starts", "slopes", "fixed")]
        pieces, counts = Pieces(*both).of(np.argsort(both[0], kind="stable")), halves
    ends = np.append(np.flatnonzero(pieces.first()), len(pieces.starts))
    return [FloorMap(pieces.starts[i:k], pieces.slopes[i:k], pieces.fixed[i:k]) for i, k in zip(ends[:-1], ends[1:])]


def composed(maps: list[FloorMap]) -> FloorMap:
    """All maps one after another."""
    if not maps:
        return UNMOVED
    number = np.repeat(np.arange(len(maps)), [len(m.starts) for m in maps])
    pieces = Pieces(number, *(np.concatenate([getattr(m, n) for m in maps]) for n in ("starts", "slopes", "fixed")))
    return fold_maps(pieces, np.array([len(maps)]))[0]


def track(clips: list[np.ndarray], entries: np.ndarray | None = None) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Floors and trigger flags of a batch of clips; the loop runs over frames, not clips.

    ``entries`` are the floors before the first frames, by default the start levels of the clips themselves.
    """
    counts = np.array([len(c) for c in clips])
    floors = [np.empty(n) for n in counts]
    flags = [np.zeros(n, dtype=bool) for n in counts]
    filled = np.flatnonzero(counts)
    if len(filled) == 0:
        return floors, flags
    width = counts.max()
    levels = np.full((len(filled), width), np.inf)
    for row, i in enumerate(filled):
        levels[row, : counts[i]] = clips[i]
    floor = initial_floor(levels, counts[filled]) if entries is None else np.asarray(entries, dtype=np.float64)[filled]
    all_floors = np.empty_like(levels)
    all_flags = np.zeros(levels.shape, dtype=bool)
    for m in range(width):
        floor, all_flags[:, m] = step(floor, levels[:, m])
        all_floors[:, m] = floor
    for row, i in enumerate(filled):
        floors[i] = all_floors[row, : counts[i]]
        flags[i] = all_flags[row, : counts[i]]
    return floors, flags


TRACKED = T.StructType(
    [
        T.StructField("floor", T.ArrayType(T.DoubleType())),
        T.StructField("triggered", T.ArrayType(T.BooleanType())),
    ]
)


PIECES = "starts array<double>, slopes array<double>, fixed array<double>"
SLAB = 256  # clips that are tracked together


def noise_floor(levels: Column | str, entry: Column | str | None = None) -> Column:
    """Column function over one array of frame levels per clip (clips have a bounded length), from ``entry`` or the clip's own start level."""

    def tracked(clips: pd.Series, entries: pd.Series | None) -> pd.DataFrame:
        clips = [np.asarray(c, dtype=np.float64) for c in clips]
        floors, flags = [], []
        for at in range(0, len(clips), SLAB):
            found = track(clips[at : at + SLAB], None if entries is None else entries.to_numpy()[at : at + SLAB])
            floors += found[0]
            flags += found[1]
        return pd.DataFrame({"floor": floors, "triggered": flags})

    def alone(clips: pd.Series) -> pd.DataFrame:
        return tracked(clips, None)

    def carried(clips: pd.Series, entries: pd.Series) -> pd.DataFrame:
        return tracked(clips, entries)

    return F.pandas_udf(alone, TRACKED)(levels) if entry is None else F.pandas_udf(carried, TRACKED)(levels, entry)


def chunk_map(levels: Column | str, most: float = np.inf) -> Column:
    """Column function: the composed map of an array of frame levels; no floor lies over ``most``."""

    def run(chunks: pd.Series) -> pd.DataFrame:
        chunks, maps = [np.asarray(c, dtype=np.float64) for c in chunks], []
        for at in range(0, len(chunks), 16):
            part = chunks[at : at + 16]
            maps += fold_maps(frame_maps(np.concatenate(part)), np.array([len(c) for c in part]), most)
        return pd.DataFrame({name: [getattr(m, name) for m in maps] for name in ("starts", "slopes", "fixed")})

    return F.pandas_udf(run, PIECES)(levels)
