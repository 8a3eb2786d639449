"""Every ordered computation has to give the same result with hot groups cut into chunks."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from vecmeadow.operators.ordered import arrange, before, highest, numbered, ranked_globally, total


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    # One key holds most rows, and one order value most of that key's rows.
    data = [(1 if i % 3 else i % 7 + 2, 5.0 if rng.random() < 0.5 else round(rng.random() * 9, 1), i, rng.randint(-5, 9)) for i in range(900)]
    return spark.createDataFrame(data, "k long, o double, id long, v long").checkpoint()


@pytest.fixture(scope="module")
def w(spark):
    return Window.partitionBy("k").orderBy("o", "id")


def same(got, want):
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_hot_groups_are_really_cut(rows):
    cut = arrange(rows, ["k"], "o", "id", limit=50)
    assert cut.split and cut.largest == 600
    sizes = cut.df.filter("__chunk >= 0").groupBy("k", "__chunk").count()
    assert sizes.agg(F.max("count")).first()[0] <= 50


@pytest.mark.parametrize("limit", [10**6, 50])
def test_number(rows, w, limit):
    same(numbered(rows, ["k"], "o", "id", "n", limit).select("id", "n"), rows.select("id", F.row_number().over(w)))


@pytest.mark.parametrize("limit", [10**6, 50])
def test_previous(rows, w, limit):
    got = arrange(rows, ["k"], "o", "id", limit).columns(p=before(F.col("v"))).result().select("id", F.coalesce("p", F.lit(-99)))
    same(got, rows.select("id", F.coalesce(F.lag("v").over(w), F.lit(-99))))


@pytest.mark.parametrize("limit", [10**6, 50])
@pytest.mark.parametrize("inclusive", [True, False])
def test_running(rows, w, limit, inclusive):
    base = arrange(rows, ["k"], "o", "id", limit)
    got = base.columns(s=total(F.col("v"))).columns(m=highest(F.col("v"), inclusive)).result()
    frame = w.rowsBetween(Window.unboundedPreceding, 0)
    before = w.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    want = rows.select("id", F.sum("v").over(frame).alias("s"), F.coalesce(F.max("v").over(before), F.lit(-99)).alias("m"))
    same(got.select("id", "s", F.coalesce("m", F.lit(-99))), want)


def test_previous_keeps_nulls(spark):
    df = spark.createDataFrame([(1, i, None if i % 2 else i) for i in range(40)], "k int, o long, v long")
    for limit in (100, 4):
        got = {r.o: r.p for r in arrange(df, ["k"], "o", "o", limit).columns(p=before(F.col("v"))).result().collect()}
        assert got == {i: (None if i == 0 or (i - 1) % 2 else i - 1) for i in range(40)}


def test_ranked_globally(rows):
    got = ranked_globally(rows, [F.desc("v"), F.asc("id")]).select("id", "rank").collect()
    order = sorted(rows.collect(), key=lambda r: (-r.v, r.id))
    assert {r.id: r["rank"] for r in got} == {r.id: i + 1 for i, r in enumerate(order)}
