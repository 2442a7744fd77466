"""Vector search, rank fusion and evaluation against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagevault.retrieval import evaluation, ivfpq

SCHEMA = "vec_id long, embedding array<double>, label int"


def vectors(n=1200, width=16, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((30, width))
    x = centres[rng.integers(0, 30, n)] + 0.6 * rng.standard_normal((n, width))
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(x)]
    rows += [(n + i, rows[7][1], 0) for i in range(n // 2)]  # a third of all rows are one vector
    nan = float("nan")
    odd = [(None, [1.0] * width, 0), (9000, None, 0), (9050, [0.0] * width, 0), (9100, [nan] * width, 0), (9150, [1.0, None] * (width // 2), 0), (9200, [1.0] * (width - 1), 0), (9250, [], 0), (9300, [float("inf")] * width, 0)]
    return rows, odd


def brute(rows, queries, k):
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in queries:
        score = np.round(x @ x[ids == q][0], 6)
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:k]
        out[q] = [(n + 1, int(ids[i]), float(score[i])) for n, i in enumerate(order)]
    return out


def found(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.rank, r.id, r.score))
    return out


def test_all_lists_and_all_candidates_are_exact(spark, monkeypatch):
    monkeypatch.setattr(ivfpq, "PART", 100)
    rows, odd = vectors(300)
    df = spark.createDataFrame(rows + odd, SCHEMA).selectExpr("*", "1 as list", "2 as id", "3 as v", "4 as part").repartition(4)
    got = found(ivfpq.search(df, F.col("id") % 50 == 0, width=16, blocks=4, lists=1, deep=10_000))
    want = brute(rows, [r[0] for r in rows if r[0] % 50 == 0], 10)
    assert got.keys() == want.keys()
    for q, best in want.items():
        assert [r[2] for r in got[q]] == pytest.approx([r[2] for r in best], abs=2e-6) and [r[0] for r in got[q]] == list(range(1, 11))
        assert sum(a[1] == b[1] for a, b in zip(got[q], best, strict=True)) >= 9  # products of another order may round apart


def test_recall_with_probed_lists(spark):
    """Ties aside: what is found is as near as what there is."""
    rows, odd = vectors()
    df = spark.createDataFrame(rows + odd, SCHEMA).repartition(3)
    model = ivfpq.fit(ivfpq.vectors(df, 16, "vec_id", "embedding"), blocks=4)
    assert len(model.centroids) > 10 and model.probes < len(model.centroids)
    got, want = found(ivfpq.search(df, F.col("id") % 20 == 0, width=16, blocks=4)), brute(rows, [r[0] for r in rows if r[0] % 20 == 0], 10)
    near = [sum(r[2] >= best[-1][2] - 1e-6 for r in got.get(q, [])) / 10 for q, best in want.items()]
    assert np.mean(near) >= 0.9


def test_few_rows_and_none(spark):
    rows, odd = vectors(10)
    assert ivfpq.search(spark.createDataFrame(odd, SCHEMA), F.lit(True), width=16).count() == 0
    assert ivfpq.search(spark.createDataFrame([], SCHEMA), F.lit(True), width=16).count() == 0
    got = found(ivfpq.search(spark.createDataFrame(rows[:3] + [rows[1]], SCHEMA), F.lit(True), width=16, blocks=4))
    assert {q: sorted(r[1] for r in best) for q, best in got.items()} == {0: [1, 2], 1: [0, 2], 2: [0, 1]}


def test_fusion(spark):
    a = [(1, 10, 1), (1, 11, 2), (1, 12, 3), (2, 10, 1), (1, None, 4), (1, 10, 5)]
    b = [(1, 12, 1), (1, 11, 2), (1, 13, 3), (3, 5, 1), (1, 14, None)]
    frames = [spark.createDataFrame(x, "query_id long, id long, rank int") for x in (a, b)]
    got = [tuple(r) for r in evaluation.fuse(frames, c=60).orderBy("query_id", "rank").collect()]
    score = {12: 1 / 63 + 1 / 61, 11: 2 / 62, 10: 1 / 61, 13: 1 / 63}
    want = [(1, n + 1, i, round(score[i], 9)) for n, i in enumerate(sorted(score, key=lambda i: (-score[i], i)))] + [(2, 1, 10, round(1 / 61, 9)), (3, 1, 5, round(1 / 61, 9))]
    assert got == want
    assert evaluation.fuse(frames, k=1).count() == 3 and evaluation.fuse([f.limit(0) for f in frames]).count() == 0


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3), (2, 10, 1), (4, 1, 1), (1, 13, 4)], "query_id long, id long, rank int")
    relevant = spark.createDataFrame([(1, 11), (1, 11), (1, 13), (1, 99), (2, 77), (3, 5), (None, 1)], "query_id long, id long")
    got = {r.query_id: tuple(r)[1:] for r in evaluation.by_query(ranked, relevant, k=3).collect()}
    ideal = 1 + 1 / math.log2(3) + 1 / 2
    assert got == {1: (pytest.approx(1 / math.log2(3) / ideal), 0.5, pytest.approx(1 / 3)), 2: (0.0, 0.0, 0.0), 3: (0.0, 0.0, 0.0)}
    assert evaluation.summary(evaluation.by_query(ranked, relevant.limit(0))).count() == 0


def test_intervals_cover_the_mean(spark):
    """Poisson numbers have mean and variance 1, and intervals of 95 % hold the true mean about that often."""
    n = spark.range(20_000).select(evaluation.poisson(F.col("id"), F.lit(3)).alias("n"))
    mean, var = n.agg(F.avg("n"), F.var_pop("n")).first()
    assert abs(mean - 1) < 0.03 and abs(var - 1) < 0.05
    rng = np.random.default_rng(3)
    covered = 0
    for t in range(12):
        values = rng.random(60)
        frame = spark.createDataFrame([(1000 * t + i, float(v), float(v), 0.5) for i, v in enumerate(values)], "query_id long, ndcg double, reciprocal_rank double, recall double")
        rows = {r.metric: r for r in evaluation.summary(frame).collect()}
        assert rows["recall"].low == rows["recall"].high == 0.5 and rows["ndcg"].queries == 60 and rows["ndcg"].mean == round(values.mean(), 6)
        assert rows["ndcg"].low < rows["ndcg"].mean < rows["ndcg"].high
        covered += rows["ndcg"].low <= 0.5 <= rows["ndcg"].high
    assert covered >= 9


def test_windows_found_by_pairs_of_words(spark, monkeypatch):
    """Windows whose pairs all occur are those that are shared, and a few more; without pairs, all of them."""
    import random

    from pagevault.plans import retrieval

    monkeypatch.setattr(retrieval, "WINDOW", 3)
    monkeypatch.setattr(retrieval, "TOGETHER", 4)
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(9))) for _ in range(60)] + [None, "", "a\u00a0b  c\td", "x y z"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    asked = retrieval.windows(docs.where("id % 16 = 3"), "id").distinct()

    def plain(text):
        words = (text or "").encode().split()
        return [b" ".join(words[i : i + 3]).decode() for i in range(len(words) - 2)]

    every = sorted((i, t) for i, text in enumerate(texts) for t in plain(text))
    known = {t for i, t in every if i % 16 == 3}
    assert sorted((r.id, r.t) for r in retrieval.windows(docs, "id").collect()) == every
    pairs = retrieval.pairs_of(asked)
    got = [(r.id, r.t) for r in retrieval.windows(docs, "id", pairs).collect()]
    assert sorted(x for x in got if x[1] in known) == [x for x in every if x[1] in known] and len(got) < len(every)
    monkeypatch.setattr(retrieval, "PAIRS", 2)
    assert retrieval.pairs_of(asked) is None
