"""The noise floor of streams of any length, by composed maps."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecmeadow.functions import floor as FL
from vecmeadow.operators import sequences as Q


def walked(entry: float, levels) -> float:
    for x in levels:
        entry, _ = FL.step_one(entry, x)
    return entry


def levels_of(kind: str, n: int, rng) -> np.ndarray:
    if kind == "steps":
        return np.repeat(rng.uniform(0.01, 1.0, n // 10 + 1), 10)[:n]
    if kind == "loud":
        return np.where(rng.random(n) < 0.3, rng.uniform(0.5, 5.0, n), rng.uniform(0.01, 0.05, n))
    if kind == "silent":
        return np.where(rng.random(n) < 0.5, 0.0, rng.uniform(0, 3e-4, n))
    return rng.uniform(0.0, 1.0, n)


@pytest.mark.parametrize("kind", ["steps", "loud", "silent", "even"])
def test_composed_maps_equal_the_walk(kind):
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 7, 200):
        levels = levels_of(kind, n, rng).tolist()
        most = max([6.0, *levels])
        whole = FL.fold_maps(FL.frame_maps(levels), [n], most)[0] if n else FL.UNMOVED
        parts = [c for c in (levels[: n // 3], levels[n // 3 :]) if c]
        halves = FL.composed(FL.fold_maps(FL.frame_maps(levels), [len(c) for c in parts])) if n else FL.UNMOVED
        for entry in np.r_[FL.FLOOR_MIN, rng.uniform(FL.FLOOR_MIN, 6.0, 60), levels[:5]]:
            entry = max(FL.FLOOR_MIN, float(entry))
            want = walked(entry, levels)
            assert whole(entry) == pytest.approx(want, rel=1e-9) and halves(entry) == pytest.approx(want, rel=1e-9)


def test_pieces_are_bounded():
    rng = np.random.default_rng(2)
    for kind in ("steps", "loud", "even"):
        levels = levels_of(kind, 2048, rng)
        assert len(FL.fold_maps(FL.frame_maps(levels), [2048])[0].starts) <= 2 * 2048 + 1
        assert len(FL.fold_maps(FL.frame_maps(levels), [2048], levels.max())[0].starts) < 1024


def test_one_stream_of_a_million_frames(spark):
    """489 chunks in many tasks, and a short stream beside it."""
    n = 1_000_000
    value = F.when(F.col("id") % 97 < 5, 40.0).otherwise(10 + 5 * F.sin(F.col("id") / 3000) + F.pmod(F.xxhash64("id"), F.lit(1000)) / 500)
    hot = spark.range(n).select(F.lit("hot").alias("s"), "id", F.col("id").alias("t"), value.alias("x"))
    short = hot.filter("id < 30").withColumn("s", F.lit("short"))
    got = Q.track_floor(hot.unionByName(short), "s", "t", "id", "x", fan_in=64)
    found = got.filter("s = 'hot'").orderBy("id").select("frame", "x", "noise_floor", "triggered").toPandas()
    assert len(found) == n and (found["frame"] == np.arange(n)).all()
    floors, flags = FL.track([found["x"].to_numpy()])
    assert np.allclose(found["noise_floor"], floors[0], rtol=1e-9, atol=0) and (found["triggered"].to_numpy() == flags[0]).all()
    some = got.filter("s = 'short'").orderBy("id").toPandas()
    floors, flags = FL.track([some["x"].to_numpy()])
    assert len(some) == 30 and np.allclose(some["noise_floor"], floors[0])


@pytest.mark.parametrize("per_chunk, fan_in", [(1, 2), (7, 2), (7, 3), (100, 1024)])
def test_any_cut_gives_the_same_floors(spark, per_chunk, fan_in):
    rng = np.random.default_rng(3)
    rows = [(s, int(t), i, float(x)) for s in "ab" for i, (t, x) in enumerate(zip(rng.integers(0, 30, 60), levels_of("loud", 60, rng)))]
    rows += [("b", 5, 99, None), ("c", 1, 1, None), (None, 1, 1, 0.5)]
    df = spark.createDataFrame(rows, "s string, t int, id long, x double")
    got = Q.track_floor(df, "s", "t", "id", "x", per_chunk, fan_in=fan_in).collect()
    for s in "ab":
        ordered = sorted((t, i, x) for k, t, i, x in rows if k == s and x is not None)
        floors, flags = FL.track([np.array([x for *_, x in ordered])])
        mine = sorted((r for r in got if r.s == s), key=lambda r: r.frame)
        assert [r.id for r in mine] == [i for _, i, _ in ordered]
        assert [r.noise_floor for r in mine] == pytest.approx(floors[0].tolist()) and [r.triggered for r in mine] == flags[0].tolist()
    assert not any(r.s == "c" for r in got)
