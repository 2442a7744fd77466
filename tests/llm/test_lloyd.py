"""Centroid clustering against a version in plain integers."""

import hashlib
import math
import random

from pagevault.llm import lloyd

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, k=8, rounds=10, width=64, scale=1024, seed=3):
    """vec_id, cluster, distance, its cluster's and the whole inertia, hash: of vectors that take part."""
    kept = []
    for i, v, *_ in rows:
        if v is not None and len(v) == width and all(c is not None and math.isfinite(c) for c in v):
            kept.append((i, [math.floor(scale * c) for c in v]))
    digest = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda x: (digest(x[0]), x[1]))[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(centroids))

    for _ in range(rounds):
        owner = [nearest(v)[1] for _, v in kept]
        for c in range(len(centroids)):
            own = [v for (_, v), o in zip(kept, owner, strict=True) if o == c]
            if own:
                centroids[c] = [sum(column) // len(own) for column in zip(*own, strict=True)]
    found = [(i, *nearest(v)) for i, v in kept]
    return sorted((str(i), c, d, sum(x[1] for x in found if x[2] == c), sum(x[1] for x in found), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, d, c in found)


def got(df, **options):
    return sorted((str(r.vec_id), *tuple(r)[1:]) for r in lloyd.clusters(df, **options).collect())


def table(n=120, width=6, seed=4):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(i % 3, 1) for _ in range(width)], i % 4) for i in range(n)]
    rows += [(500 + i, [0.25] * width, 1) for i in range(60)]  # a third of the rows are equal, and tie between equal centroids
    return rows + [(500, [0.25] * width, 1), (None, [-0.001] * width, None), (1 << 60, [3.5] * width, 2), ((1 << 60) + 1, [-90_000.5] * width, 2)]


ODD = [(900, None, 1), (901, [], 1), (902, [1.0] * 5, 1), (903, [1.0, None] * 3, 1), (904, [float("nan")] * 6, 1), (905, [float("inf")] * 6, 1), (906, [1e30] * 6, 1)]


def test_equals_plain_rounds(spark):
    rows = table()
    df = spark.createDataFrame(rows + ODD, SCHEMA).repartition(5)
    assert got(df, k=5, rounds=4, width=6) == brute(rows, k=5, rounds=4, width=6)
    assert got(df.selectExpr("*", "1 as v", "'x' as cluster", "2 as i", "3 as n"), k=3, rounds=1, width=6) == brute(rows, k=3, rounds=1, width=6)


def test_few_vectors_and_none(spark):
    rows = table()[:3] + [(1, table()[1][1], 0)]
    assert got(spark.createDataFrame(rows, SCHEMA), k=8, rounds=2, width=6) == brute(rows, k=8, rounds=2, width=6)
    for none in (ODD, []):
        out = lloyd.clusters(spark.createDataFrame(none, SCHEMA), width=6)
        assert out.count() == 0 and ", ".join(f"{c} {t}".replace("bigint", "long") for c, t in out.dtypes) == lloyd.CLUSTERED


def test_ties_take_the_lowest_and_means_are_floors(spark):
    rows = [(i, [float(x)], 0) for i, x in enumerate([-3, -2, 5, 5, 5, 1, 0, -7])]
    df = spark.createDataFrame(rows, SCHEMA)
    for k in (1, 2, 3, 8):
        assert got(df, k=k, rounds=3, width=1, scale=1) == brute(rows, k=k, rounds=3, width=1, scale=1)
