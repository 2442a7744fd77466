"""Near duplicates and repeated passages against brute force."""

import hashlib
import math
import random

import numpy as np
import pytest

from pagevault.llm import minhash, phrases, vecdedup
from pagevault.llm.common import components

from cases import clashing, documents, odd_texts, words


class Sets:
    def __init__(self, nodes):
        self.up = {n: n for n in nodes}

    def top(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.top(a), self.top(b)
        self.up[max(a, b)] = min(a, b)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, i) for i in range(2000, 2400)] + [(7, 7)]
    want = Sets({n for e in edges for n in e})
    for a, b in edges:
        want.join(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {n for a, b in edges if a != b for n in (a, b)}
    assert got == {n: want.top(n) for n in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def near_texts(seed=4):
    rng = random.Random(seed)
    base = words(rng, 120, 5000).split()
    texts = odd_texts()
    for rate in (0.0, 0.005, 0.01, 0.02, 0.03, 0.05):
        for _ in range(14):
            copy = [f"c{rng.random()}" if rng.random() < rate else w for w in base]
            texts.append(" ".join(copy) if rng.random() < 0.5 else " ".join(copy).upper())
    texts += [words(rng, 80, 5000) for _ in range(40)]
    rng.shuffle(texts)
    return texts


def brute_near(texts, percent=85):
    sets = [shingles(t) for t in texts]
    want = Sets(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                want.join(i, j)
    return {i: (len(a), want.top(i), want.top(i) == i) for i, a in enumerate(sets)}


def test_minhash_loses_no_distant_pairs_that_meet(spark):
    assert all(minhash.farthest(p) >= minhash.FARTHEST for p in range(101)) and minhash.farthest(85) == 20
    rng = random.Random(21)
    texts = []
    for _ in range(60):  # 46 of 74 shingles in common: 0.62
        base = words(rng, 64, 5000).split()
        texts += [" ".join(base), " ".join([*base[:50], *words(rng, 14, 5000).split()])]
    want = brute_near(texts, 60)
    assert all(want[i][1] == i - 1 for i in range(1, 120, 2))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(documents(spark, texts), percent=60).collect()}
    assert sum(got[i] != want[i] for i in want) <= 2  # the keys miss one in 170


def test_minhash_equals_brute_force(spark, monkeypatch):
    texts = near_texts()
    want = brute_near(texts)
    frame = clashing(documents(spark, texts))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(frame).collect()}
    assert got == want
    monkeypatch.setattr(minhash, "BLOCK", 5)  # buckets in pairs of blocks
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(frame).collect()}
    assert got == want


def test_signature_keys_lose_no_pair_within_the_distance():
    rng = np.random.default_rng(1)
    for _ in range(200):
        apart = np.zeros(minhash.SYMBOLS, dtype=bool)
        apart[rng.choice(minhash.SYMBOLS, minhash.FARTHEST, replace=False)] = True
        assert (apart.reshape(minhash.CHUNKS, -1).sum(axis=1) <= 1).any()
    p = 0.15
    missed = sum(math.comb(32, k) * p**k * (1 - p) ** (32 - k) for k in range(minhash.FARTHEST + 1, 33))
    assert missed < 1e-5


def test_minhash_rows_that_share_or_lack_ids(spark):
    rows = [(5, "a b c d e f g"), (5, "h i j k l m n"), (9, "A B C D E F G"), (11, "h i j k l m n"), (None, "a b c d e f g"), (12, None), (12, None)]
    got = sorted(map(tuple, minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == sorted([(5, 3, 5, True), (5, 3, 5, True), (9, 3, 5, False), (11, 3, 5, False), (None, 3, None, True), (12, 0, 12, True), (12, 0, 12, True)], key=repr)
    empty = minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.count() == 0


def brute_vectors(rows, threshold=0.93):
    n, want = dict.fromkeys((r[0] for r in rows), 0), Sets({r[0] for r in rows})
    usable = [(i, np.array(v, dtype=float), label) for i, v, label in rows if label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    scaled = [(i, x / np.abs(x).max(), label) for i, x, label in usable]  # squares of tiny components would vanish
    real = [(i, x / np.linalg.norm(x), label) for i, x, label in scaled]
    for a, (i, x, l) in enumerate(real):
        for j, y, m in real[:a]:
            if l == m and len(x) == len(y) and float(x @ y) >= threshold:
                n[i] += 1
                n[j] += 1
                want.join(i, j)
    return {i: (n[i], want.top(i), want.top(i) == i) for i in n}


@pytest.mark.parametrize(("width", "stored", "aim"), [(3, 20, 15), (20, 60, 5), (64, 20, 4), (3, 5, 2), (20, 5, 15), (64, 5, 3), (64, 1000, 6)])
def test_vectors_equal_brute_force(spark, monkeypatch, width, stored, aim):
    rng = np.random.default_rng(width)
    base = rng.standard_normal((12, width))
    rows = [(i, (base[i % 12] + rng.standard_normal(width) * (0.02 + 0.35 * rng.random())).tolist(), int(i % 3)) for i in range(150)]
    rows += [(200 + i, base[0].tolist(), 0) for i in range(8)] + [(220, (base[0] * 1e-200).tolist(), 0), (221, (base[0] * 3).tolist(), 1)]
    nan = float("nan")
    rows += [(300, None, 0), (301, [0.0] * width, 0), (302, [nan] * width, 0), (303, [None] * width, 0), (304, base[0].tolist(), None), (305, [], 0), (306, [float("inf")] * width, 0), (307, [1.0] * (width + 1), 0)]
    for name, value in (("STORED", stored), ("AIM", aim), ("ASKING", 16), ("PAIRS", 50)):
        monkeypatch.setattr(vecdedup, name, value)
    again, count = vecdedup.finer, []
    monkeypatch.setattr(vecdedup, "finer", lambda *a: count.append(1) or again(*a))
    frame = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vecdedup.near_duplicates(frame).collect()}
    assert got == brute_vectors(rows) and bool(count) == (stored < 60)


def test_pairs_meet_once_in_a_fine_grid():
    """Vectors of one cell against all pairs, the number of fine coordinates aside."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((3000, 16))
    x[1500:] = x[:1500] + 0.05 * rng.standard_normal((1500, 16))
    raw = [v.astype("<f8").tobytes() for v in x]
    cell = vecdedup.Cell(0, 16, 0.93, list(range(3000)), [1] * 3000, raw)
    assert cell.grid > 1
    met = [(i + start, j) for start in range(0, 3000, 1000) for a, b in cell.meet(cell.turned[start : start + 1000], start) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
    own = cell.turned[:, :8]
    apart = ((own[:, None, :] - own[None, :, :]) ** 2).sum(axis=2)
    assert len(met) == len(set(met)) and set(map(frozenset, met)) == {frozenset((i, j)) for i, j in zip(*np.nonzero(np.triu(apart <= 0.07, 1)))}
    others = [p for a, b in cell.meet(cell.turned[:50], None) for p in zip(a.tolist(), b.tolist(), strict=True)]
    assert sorted(others) == sorted(zip(*(x.tolist() for x in np.nonzero(apart[:50] <= 0.07)), strict=True))


def test_vectors_of_an_empty_table(spark):
    assert vecdedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def brute_phrases(rows, size=50):
    owner = {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        w = (t or "").encode().split()
        for k in range(len(w) - size + 1):
            owner.setdefault(tuple(w[k : k + size]), i)
    out = {}
    for i, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if owner[tuple(w[k : k + size])] < i:
                gone[k : k + size] = [True] * size
        out[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())
    return out


def passages(seed=6):
    rng = random.Random(seed)
    shared = [words(rng, n, 3000) for n in (49, 50, 51, 75, 200)]
    texts = odd_texts()
    for _ in range(60):
        parts = [words(rng, rng.randrange(0, 90), 3000) for _ in range(3)]
        for p in rng.sample(shared, rng.randrange(3)):
            w = p.split()
            a = rng.randrange(len(w) // 3 + 1)
            parts.insert(rng.randrange(3), " ".join(w[a:]) if rng.random() < 0.4 else p)
        texts.append("\n".join(parts))
    texts += ["a " * 120, "a " * 70, words(random.Random(1), 12_000) + " tail"]
    rng.shuffle(texts)
    return texts


def test_repeated_passages_equal_brute_force(spark, monkeypatch):
    texts = passages()
    rows = list(enumerate(texts))
    frame = clashing(documents(spark, texts))
    for shard_bytes, flush in ((1_500_000, 200_000), (4_000, 300)):
        monkeypatch.setattr(phrases, "SHARD_BYTES", shard_bytes)
        monkeypatch.setattr(phrases, "FLUSH", flush)
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in phrases.deduplicate(frame, with_text=True).drop("kept_text").collect()}
        assert got == brute_phrases(rows)


def test_many_copies_of_a_passage_in_different_places(spark, monkeypatch):
    """One passage in most documents, each time among other words, and whole copies: passages differ, windows recur."""
    rng = random.Random(31)
    hot = words(rng, 60, 9000)
    texts = [" ".join([words(rng, rng.randrange(60), 9000), hot, words(rng, rng.randrange(60), 9000)]) for _ in range(150)]
    texts += [texts[i] for i in (3, 3, 50)] + [hot, hot + " end", " ".join(hot.split()[:50]), " ".join(hot.split()[5:54])]
    monkeypatch.setattr(phrases, "SHARD_BYTES", 9_000)
    monkeypatch.setattr(phrases, "FLUSH", 500)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in phrases.deduplicate(documents(spark, texts).repartition(6)).collect()}
    assert got == brute_phrases(list(enumerate(texts)))


def test_repeated_passages_without_ids_and_rows(spark):
    t = words(random.Random(9), 70)
    frame = spark.createDataFrame([(1, t), (1, t), (2, t), (None, t)], "doc_id long, text string")
    assert sorted(((r.doc_id, r.n_removed) for r in phrases.deduplicate(frame).collect()), key=repr) == [(1, 0), (1, 0), (2, 70), (None, 0)]
    assert phrases.deduplicate(frame.limit(0)).count() == 0


def test_only_hits_of_the_automata_remove_words(spark, monkeypatch):
    """Where most phrases of each automaton are unheard, what stands around them stays."""

    class Deaf(phrases.Shard):
        def hits(self, hashes):
            for at, phrase in super().hits(hashes):
                heard = phrase % 5 == 0
                yield at[heard], phrase[heard]

    class Deafer(phrases.Shard):
        def hits(self, hashes):
            return iter(())

    frame = documents(spark, passages())
    whole = {r.doc_id: r.n_removed for r in phrases.deduplicate(frame).collect()}
    monkeypatch.setattr(phrases, "Shard", Deaf)
    some = {r.doc_id: r.n_removed for r in phrases.deduplicate(frame).collect()}
    assert all(some[i] <= n for i, n in whole.items()) and 0 < sum(some.values()) < sum(whole.values())
    monkeypatch.setattr(phrases, "Shard", Deafer)
    assert not any(r.n_removed for r in phrases.deduplicate(frame).collect())


def test_hits_in_small_parts(spark, monkeypatch):
    monkeypatch.setattr(phrases, "HITS", 2)
    rng = np.random.default_rng(8)
    h = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    runs = phrases.Runs(h, 50)
    known = phrases.Shard(runs.phrases(), phrases.Spans(h).of(runs.first, runs.stop), runs.places(), np.full(len(runs.at), 7))
    copy = np.concatenate([rng.integers(0, 1 << 63, 40).astype(np.uint64), h, h[:20]])
    assert known.removed(copy, 8, 50).tolist() == [False] * 40 + [True] * 300 + [False] * 20
    assert known.removed(copy, 7, 50) is None and known.removed(copy[:49], 8, 50) is None


def test_tasks_follow_the_cluster(spark):
    frame = spark.range(1)
    wide = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    assert phrases.tasks(frame, 1) == 1
    assert phrases.tasks(frame, 10**12 // phrases.SHARD_BYTES) == phrases.tasks(frame, 10**14 // phrases.SHARD_BYTES) == phrases.TASKS_EACH * wide


def test_selected_phrases_are_a_function_of_the_window():
    rng = np.random.default_rng(3)
    h = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    other = np.concatenate([rng.integers(0, 1 << 63, 33).astype(np.uint64), h[100:180], rng.integers(0, 1 << 63, 9).astype(np.uint64)])
    a, b = phrases.selected(h, 50), phrases.selected(other, 50)
    assert [x - 100 for x in a[100:131]] == [x - 33 for x in b[33:64]]
    spans = [phrases.Spans(x).of(np.arange(at, at + 31), np.arange(at + 50, at + 81)) for x, at in ((h, 100), (other, 33))]
    assert (spans[0] == spans[1]).all() and len(set(spans[0].tolist())) == 31
    runs = phrases.Runs(h, 50)
    start, run = runs.windows()
    assert start.tolist() == list(range(len(a))) and (runs.at[run] == a).all() and runs.stop[-1] == len(h)
    naive = [k + int(np.argmin(phrases.grams(h, 8)[k : k + 43] & ~phrases._PLACE)) for k in range(len(a))]
    assert a.tolist() == naive
