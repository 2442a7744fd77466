"""As-of joins and versioned dictionaries against versions that look at every row."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pagevault.operators.asof import as_of, micros
from pagevault.operators.dictionary import normalised, versions


def brute(left, right):
    out = []
    for i, k, t in left:
        held = [(rt, v) for rk, rt, v in right if None not in (k, t, rk, rt) and rk == k and rt <= t]
        out.append((i, k, t, max(held, key=lambda x: (x[0], x[1] is not None, x[1]))[1] if held else None))
    return sorted(map(repr, out))


@pytest.mark.parametrize("span", [7, 50, 10**9])
def test_equals_looking_at_all_rows(spark, span):
    rng = random.Random(span)
    key = lambda: rng.choice(["hot", "hot", "hot", "a", "b", "c", None])
    left = [(i, key(), rng.choice([None, *range(-100, 300)])) for i in range(400)]
    left += left[:20]  # repeated rows
    right = [(key(), rng.choice([None, *range(-100, 300)]), rng.choice([None, *range(9)])) for _ in range(150)]
    a, b = spark.createDataFrame(left, "row long, bucket string, at long"), spark.createDataFrame(right, "found string, value long, told long")
    named = b.withColumnRenamed("found", "bucket")
    got = as_of(a, named, by=["bucket"], left_time="at", right_time="value", values=["told"], span=span)
    assert got.columns == ["row", "bucket", "at", "told"] and sorted(repr(tuple(r)) for r in got.collect()) == brute(left, right)


def test_several_keys_and_empty_sides(spark):
    left = spark.createDataFrame([(1, "x", 5), (1, "y", 5), (2, "x", 9)], "a long, b string, t long")
    right = spark.createDataFrame([(1, "x", 5, 1.5), (1, "x", 4, 2.5), (2, "y", 1, 3.5)], "a long, b string, t2 long, v double")
    got = as_of(left, right, by=["a", "b"], left_time="t", right_time="t2", values=["v", "t2"])
    assert sorted(map(tuple, got.collect())) == [(1, "x", 5, 1.5, 5), (1, "y", 5, None, None), (2, "x", 9, None, None)]
    assert as_of(left.limit(0), right, by=["a"], left_time="t", right_time="t2", values=["v"]).count() == 0
    assert {r.v for r in as_of(left, right.limit(0), by=["a"], left_time="t", right_time="t2", values=["v"]).collect()} == {None}


def test_one_plan_without_pairs(spark):
    left, right = spark.range(10).selectExpr("id as k", "id as t"), spark.range(10).selectExpr("id as k", "id as t2", "id as v")
    plan = as_of(left, right, by=["k"], left_time="t", right_time="t2", values=["v"])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Window [last(" in plan


@pytest.mark.parametrize("zone", ["UTC", "Asia/Seoul", "America/New_York"])
def test_times_without_zone_are_the_same_in_any_session(spark, zone):
    times = [dt.datetime(1969, 12, 31, 23, 59, 59, 999999), dt.datetime(1970, 1, 1), dt.datetime(2024, 3, 10, 2, 30, 0, 1)]
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        frame = spark.createDataFrame([(t,) for t in times], "t timestamp_ntz")
        got = [r.m for r in frame.select(micros(F.col("t"), "timestamp_ntz").alias("m")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == [(t - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1) for t in times]


def test_versions(spark):
    told = [("a", 1, "x"), ("a", 2, "x"), ("a", 3, "y"), ("a", 3, "w"), ("a", 5, None), ("a", 6, None), ("a", 7, "x"), ("b", 4, None), (None, 1, "x"), ("c", None, "x")]
    made = versions(spark.createDataFrame(told, "e string, t long, v string"), entry="e", time="t", value="v")
    assert sorted(map(tuple, made.collect())) == [("a", 1, "x", 1, 3), ("a", 2, "y", 3, 5), ("a", 3, None, 5, 7), ("a", 4, "x", 7, None), ("b", 1, None, 4, None)]
    facts = spark.createDataFrame([(1, "a", 0), (2, "a", 2), (3, "a", 6), (4, "a", 99), (5, "z", 1)], "id long, e string, t long")
    got = {r.id: (r.version, r.value, r.valid_from) for r in normalised(facts, made, entry="e", time="t").collect()}
    assert got == {1: (None, None, None), 2: (1, "x", 1), 3: (3, None, 5), 4: (4, "x", 7), 5: (None, None, None)}
