"""Hard-negative mining against a version that sorts all rows for each anchor."""

import math
import random

import pytest
from pyspark.sql import functions as F

from pagevault.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, modulus=10, positives=5, many=10, low=30, high=90):
    own = {}
    for i, v, label in rows:
        if None not in (i, v, label) and v and all(c is not None and math.isfinite(c) for c in v):
            own[i] = ((label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * c) for c in v])
    out = []
    for a, (label, x) in own.items():
        if a % modulus == 0:
            scored = sorted((-sum(p * q for p, q in zip(x, v, strict=True)), i, lab) for i, (lab, v) in own.items() if len(v) == len(x))
            for p, i in [(-s, i) for s, i, lab in scored if lab == label and i != a][:positives]:
                found = [(i2, -s) for s, i2, lab in scored if lab != label and low * p <= -100 * s <= high * p][:many]
                out += [(a, i, n + 1, i2, p, s) for n, (i2, s) in enumerate(found)]
    return sorted(out)


def got(df, modulus=10, **options):
    label = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(map(tuple, negatives.mine(df, anchors=F.col("id") % modulus == 0, label=label, **options).collect()))


def table(n=300, width=5, seed=2):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0.5, 1) for _ in range(width)], rng.randrange(4)) for i in range(n)]
    tied = [rng.gauss(0.5, 1) for _ in range(width)]
    return rows + [(n + i, tied, rng.randrange(2)) for i in range(n // 2)]  # a third of all rows are one vector: its scores tie


ODD = [(None, [1.0] * 5, 1), (9000, None, 1), (9010, [1.0] * 5, None), (9020, [1.0, None, 1.0, 1.0, 1.0], 1), (9030, [float("nan")] * 5, 1), (9040, [float("-inf")] * 5, 2), (9050, [], 1), (9060, [1e20] * 5, 1)]
WIDE = [(-70, [1.5, 2.0], 1), (-60, [1.0, 2.0], 1), (-61, [1.0, 1.0], 2), (-62, [0.4, 0.9], 3)]


def test_equals_sorting_all_rows(spark):
    rows = table() + WIDE
    want = brute(rows)
    assert len({r[:2] for r in want}) > 100
    df = spark.createDataFrame(rows + ODD, SCHEMA).repartition(4)
    assert got(df) == want
    assert got(df.selectExpr("*", "1 as id", "2 as v", "3 as w", "4 as score", "5 as bucket").unionAll(df.limit(40).selectExpr("*", "1", "2", "3", "4", "5"))) == want


def test_many_blocks_digits_and_passes(spark, monkeypatch):
    monkeypatch.setattr(negatives, "DIGIT", 2)
    monkeypatch.setattr(negatives, "ANCHORS", 7)
    monkeypatch.setattr(negatives, "CELLS", 64)
    rows = table(120)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(df, modulus=6) == brute(rows, modulus=6)


def test_large_scores_are_exact(spark):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-2e5, 2e5) for _ in range(4)], i % 3) for i in range(90)]
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


@pytest.mark.parametrize("rows", [[], ODD, [(10, [1.0], 1)], [(10, [1.0], 1), (11, [1.0], 1)], [(11, [1.0], 1), (12, [1.0], 2)]])
def test_without_windows(spark, rows):
    out = negatives.mine(spark.createDataFrame(rows, SCHEMA), anchors=F.col("id") % 10 == 0)
    assert out.count() == 0 and ", ".join(f"{c} {t}".replace("bigint", "long") for c, t in out.dtypes) == negatives.MINED
