"""Logistic regression and isotonic calibration against plain versions."""

import math
import random

import numpy as np
import pytest

from pagevault.learning import calibrate, fit, isotonic
from pagevault.learning.isotonic import pooled


def plain_newton(x, y, l2=0.0):
    x = np.column_stack([np.ones(len(x)), x])
    w, penalty = np.zeros(x.shape[1]), np.array([0.0, *[l2] * (x.shape[1] - 1)])
    for _ in range(40):
        p = 1 / (1 + np.exp(-x @ w))
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
    return w


def table(n=2000, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 3)) * [1, 10, 0.1] + [0, 5, 0]
    y = (rng.random(n) < 1 / (1 + np.exp(-(0.5 + x @ [1.0, -0.2, 4.0])))).astype(int)
    return x, y


@pytest.mark.parametrize("l2", [0.0, 30.0])
def test_coefficients(spark, l2):
    x, y = table()
    rows = [(*map(float, r), int(t)) for r, t in zip(x, y, strict=True)]
    nan = float("nan")
    odd = [(None, 1.0, 1.0, 1), (nan, 1.0, 1.0, 0), (1.0, float("inf"), 1.0, 1), (1.0, 1.0, 1.0, None), (1.0, 1.0, 1.0, 2)]
    df = spark.createDataFrame(rows + odd, "a double, `b.c` double, g double, y int").repartition(5)
    model = fit(df, ["a", "b.c", "g"], "y", l2=l2)
    assert np.allclose([model.intercept, *model.weights], plain_newton(x, y, l2), atol=1e-8)
    # the gradient over all rows vanishes, and probabilities are one expression
    got = df.select("a", "y", model.probability().alias("p")).collect()
    assert [r.p is None for r in got].count(True) == 3
    if not l2:
        assert abs(sum(r.p - r.y for r in got if r.p is not None and r.y in (0, 1))) < 1e-6


def test_classes_told_apart_and_empty_tables(spark):
    df = spark.createDataFrame([(float(i), int(i > 5)) for i in range(12)], "a double, y int")
    with pytest.raises(RuntimeError, match="l2"):
        fit(df, ["a"], "y", rounds=15)
    assert fit(df, ["a"], "y", l2=1.0).weights[0] > 0
    twice = fit(df.selectExpr("a", "a as b", "y"), ["a", "b"], "y", l2=1.0)
    assert twice.weights[0] == pytest.approx(twice.weights[1])
    none = fit(df.limit(0), ["a"], "y")
    assert none.intercept == 0 and none.weights == (0.0,)


def plain_isotonic(rows):
    """The value of each distinct score, by the min-max formula."""
    scores = sorted({s for s, _ in rows})
    y, n = ([sum(f(t) for s, t in rows if s == x) for x in scores] for f in (int, lambda t: 1))
    mean = lambda i, j: sum(y[i : j + 1]) / sum(n[i : j + 1])
    return {x: max(min(mean(i, j) for j in range(k, len(scores))) for i in range(k + 1)) for k, x in enumerate(scores)}


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_isotonic_equals_the_formula(spark, parts):
    rng = random.Random(parts)
    rows = [(s, int(rng.random() < s)) for s in (round(rng.random(), 2) for _ in range(600))] + [(-3.5, 1), (7.25, 0)]
    want = plain_isotonic(rows)
    df = spark.createDataFrame([*rows, (None, 1), (float("nan"), 1), (0.5, None), (0.5, 3)], "s double, y int")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        blocks = isotonic(df, "s", "y")
        got = sorted(map(tuple, blocks.collect()))
        placed = calibrate(df.selectExpr("s", "y", "1 as k", "2 as low"), blocks, "s").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert [b[3] for b in got] == sorted({b[3] for b in got}) and sum(b[2] for b in got) == len(rows)
    assert all(r.calibrated == pytest.approx(want[r.s]) for r in placed if r.s is not None and not math.isnan(r.s))
    assert sum(r.calibrated is None for r in placed) == 2 and len(placed) == len(rows) + 4
    outside = calibrate(spark.createDataFrame([(-9.0,), (0.0049,), (99.0,)], "s double"), blocks, "s").collect()
    below = max(s for s in want if s <= 0.0049)
    assert {r.s: r.calibrated for r in outside} == {-9.0: want[-3.5], 99.0: want[7.25], 0.0049: pytest.approx(want[below])}


def test_pooling_blocks_is_pooling_their_rows():
    rng = random.Random(2)
    rows = [(float(i), float(i), rng.randrange(4), 3) for i in range(200)]
    whole = pooled(rows)
    for cut in (1, 50, 133):
        assert pooled([*pooled(rows[:cut]), *pooled(rows[cut:])]) == whole
    assert pooled([]) == []


def test_isotonic_of_an_empty_table(spark):
    none = spark.createDataFrame([], "s double, y int")
    assert isotonic(none, "s", "y").count() == 0
    assert [r.calibrated for r in calibrate(spark.createDataFrame([(0.5,)], "s double"), isotonic(none, "s", "y"), "s").collect()] == [None]
