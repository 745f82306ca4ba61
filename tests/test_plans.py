"""Skew-safe building blocks against brute force, with one key holding most rows."""

import random

import pytest
from pyspark.sql import functions as F

from telelake.plans.running import numbered, with_running


def observations(count=3000, seed=5):
    rng = random.Random(seed)
    rows = []
    for i in range(count):
        key = "hot" if rng.random() < 0.6 else rng.choice(["a", "b", None])
        rows.append((i, key, rng.randint(0, 400), rng.choice([None, None, rng.randint(1, 9)])))
    return rows


@pytest.mark.parametrize("segments", [1, 3, 16])
@pytest.mark.parametrize("keyed", [True, False])
def test_running_values(spark, segments, keyed):
    rows = observations()
    df = spark.createDataFrame(rows, "i int, key string, at int, v int").repartition(5)
    got = with_running(
        df,
        ["key"] if keyed else [],
        [F.col("at"), F.col("i")],
        sums={"total": F.lit(1).cast("bigint")},
        lasts={"upto": F.col("v")},
        before={"prior": F.col("v")},
        segments=segments,
    )
    assert sorted(got.columns) == sorted(["i", "key", "at", "v", "total", "upto", "prior"])
    found = {r.i: (r.total, r.upto, r.prior) for r in got.collect()}
    expected, state = {}, {}
    for i, key, _, v in sorted(rows, key=lambda r: (r[2], r[0])):
        count, last = state.get(key if keyed else 0, (0, None))
        now = v if v is not None else last
        expected[i] = (count + 1, now, last)
        state[key if keyed else 0] = (count + 1, now)
    assert found == expected


def test_running_values_backwards(spark):
    rows = observations(800, 9)
    df = spark.createDataFrame(rows, "i int, key string, at int, v int")
    got = with_running(df, ["key"], [F.desc("at"), F.desc("i")], lasts={"next": F.col("v")}, segments=7)
    found = {r.i: r.next for r in got.collect()}
    expected, state = {}, {}
    for i, key, _, v in sorted(rows, key=lambda r: (r[2], r[0]), reverse=True):
        state[key] = v if v is not None else state.get(key)
        expected[i] = state[key]
    assert found == expected


@pytest.mark.parametrize("segments", [1, 3, 16])
@pytest.mark.parametrize("keyed", [True, False])
def test_numbers(spark, segments, keyed):
    rows = observations()
    df = spark.createDataFrame(rows, "i int, key string, at int, v int").repartition(5)
    got = numbered(df, ["key"] if keyed else [], [F.col("at"), F.col("i")], "n", segments)
    assert sorted(got.columns) == ["at", "i", "key", "n", "v"]
    expected, state = {}, {}
    for i, key, _, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        expected[i] = state.get(key if keyed else 0, 0)
        state[key if keyed else 0] = expected[i] + 1
    assert {r.i: r.n for r in got.collect()} == expected
    assert numbered(df.limit(0), ["key"], [F.col("at")], "n", segments).collect() == []
