"""Series operators against plain loops, with and without cutting hot streams."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecmeadow.operators import sequences as Q

LIMITS = [10**6, 40]


@pytest.fixture(scope="module")
def data():
    rng = random.Random(3)
    at, rows = 0, []
    for i in range(500):
        at += rng.choice([1, 2, 3, 30])
        rows.append((0 if i % 4 else 1, at, i, rng.choice("ab"), round(rng.random(), 3)))
    return rows


@pytest.fixture(scope="module")
def df(spark, data):
    return spark.createDataFrame(data, "s int, t long, id long, l string, x double").checkpoint()


@pytest.mark.parametrize("limit", LIMITS)
@pytest.mark.parametrize("alpha, gap", [(0.55, 20), (0.999, 10**9), (1.0, 20)])
def test_smooth(df, data, limit, alpha, gap):
    got = {r.id: r.smoothed for r in Q.smooth(df, "s", "l", "t", "id", "x", alpha, gap, limit).collect()}
    want = {}
    for s in (0, 1):
        last, held = None, {}
        for _, t, i, l, x in (r for r in data if r[0] == s):
            if last is not None and t - last > gap:
                held.clear()
            last = t
            held[l] = x if l not in held else alpha * x + (1 - alpha) * held[l]
            want[i] = held[l]
    assert got.keys() == want.keys()
    assert all(abs(got[i] - want[i]) < 1e-9 for i in want)


@pytest.mark.parametrize("limit", LIMITS)
def test_streaks(df, data, limit):
    got = {r.id: (r.streak, r.is_known) for r in Q.streaks(df, "s", "l", "t", "id", F.col("x") >= 0.2, F.col("x") >= 0.8, 2, limit).collect()}
    want = {}
    for s in (0, 1):
        name, n = None, 0
        for _, _, i, l, x in (r for r in data if r[0] == s):
            if x < 0.2:
                name, n = None, 0
            elif x >= 0.8:
                name, n = l, 2
            else:
                n = n + 1 if name == l else 1
                name = l
            want[i] = (n, n >= 2)
    assert got == want


@pytest.mark.parametrize("limit", LIMITS)
def test_drop_recent(spark, limit):
    rng = random.Random(5)
    rows = [(0, i, rng.choice("abcdefgh")) for i in range(200)]
    df = spark.createDataFrame(rows, "s int, id long, h string")
    got = {r.id for r in Q.drop_recent(df, "s", "h", "id", "id", 3, limit).collect()}
    recent, want = [], set()
    for _, i, h in rows:
        if h not in recent:
            recent = (recent + [h])[-3:]
            want.add(i)
    assert got == want


@pytest.mark.parametrize("limit", LIMITS)
def test_merge_intervals(df, data, limit):
    spans = df.select("s", "id", F.col("t").alias("a"), (F.col("t") + F.round(F.col("x") * 20).cast("long")).alias("b"))
    got = sorted(map(tuple, Q.merge_intervals(spans, ["s"], "a", "b", 2, "id", limit).select("s", "a", "b", "merged").collect()))
    want = []
    for s in (0, 1):
        for r in sorted((r for r in spans.collect() if r.s == s), key=lambda r: (r.a, r.id)):
            if want and want[-1][0] == s and r.a <= want[-1][2] + 2:
                _, a, b, n = want[-1]
                want[-1] = (s, a, max(b, r.b), n + 1)
            else:
                want.append((s, r.a, r.b, 1))
    assert got == sorted(want)


@pytest.mark.parametrize("limit", LIMITS)
def test_keep_share(df, data, limit):
    got = {r.id for r in Q.keep_share(df, ["l"], "x", "id", 0.4, limit).collect()}
    want = set()
    for l in "ab":
        rows = sorted((r for r in data if r[3] == l), key=lambda r: (-r[4], r[2]))
        want |= {r[2] for r in rows[: max(int(len(rows) * 0.4), 1)]}
    assert got == want


def test_closing_and_blobs(spark):
    on = {(1, 3), (1, 5), (2, 4), (4, 10), (1, 11), (2, 11), (3, 12), (3, 13), (6, 3)}
    df = spark.createDataFrame([(0, b, f, 8, 20) for b, f in on], "k int, band long, frame long, n_bands long, n_frames long")
    near = [(b, f) for b in (-1, 0, 1) for f in (-2, -1, 0, 1, 2)]
    wide = {(b + i, f + j) for b, f in on for i, j in near if 0 <= b + i < 8 and 0 <= f + j < 20}
    closed = {(b, f) for b in range(8) for f in range(20) if all((b + i, f + j) in wide for i, j in near)}
    got = Q.closed_mask(df, ["k"])
    assert {(r.band, r.frame) for r in got.collect()} == closed
    left, want = set(closed), []
    while left:
        todo, seen = [left.pop()], set()
        while todo:
            b, f = todo.pop()
            seen.add((b, f))
            for c in ((b - 1, f), (b + 1, f), (b, f - 1), (b, f + 1)):
                if c in left:
                    left.remove(c)
                    todo.append(c)
        want.append((min(f for _, f in seen), max(f for _, f in seen)))
    assert sorted((r["first"], r["last"]) for r in Q.blobs(got, ["k"]).collect()) == sorted(want)


def test_closing_moves_the_ends_of_runs(spark):
    """Random grids of several keys with cut hot bands; repeated cells; a run of 100,000 frames stays one row."""
    rng = np.random.default_rng(11)
    rows, want = [], set()
    for key in range(4):
        on = rng.random((7, 60)) < (0.1, 0.3, 0.5, 0.0)[key]
        rows += [(key, int(b), int(f), 7, 60) for b, f in np.argwhere(on) for _ in range(2)]
        wide = np.zeros((9, 64), dtype=bool)
        for i in range(3):
            for j in range(5):
                wide[i : i + 7, j : j + 60] |= on
        wide[0] = wide[-1] = False
        wide[:, :2] = wide[:, -2:] = False
        closed = np.all([wide[i : i + 7, j : j + 60] for i in range(3) for j in range(5)], axis=0)
        want |= {(key, int(b), int(f)) for b, f in np.argwhere(closed)}
    schema = "k int, band long, frame long, n_bands long, n_frames long"
    df = spark.createDataFrame(rows, schema)
    assert {(r.k, r.band, r.frame) for r in Q.closed_mask(df, ["k"]).collect()} == want
    cut = Q.closed_runs(df, ["k"], limit=10).collect()
    assert {(r.k, r.band, f) for r in cut for f in range(r.a, r.b + 1)} == want
    long = spark.range(100_000).filter("id not between 500 and 502").selectExpr("1 k", "3L band", "id frame", "7L n_bands", "100000L n_frames")
    assert [tuple(r)[3:] for r in Q.closed_runs(long, ["k"]).collect()] == [(3, 2, 99_997)]
    assert Q.closed_runs(df.limit(0), ["k"]).isEmpty()
