"""Sessions of a stream: intervals, late rows, restarts."""

import random

import numpy as np

from pagevault.streaming import sessions as module
from pagevault.streaming.sessions import Run, drain, intervals, keyed_intervals, sessions

SCHEMA = "user long, time timestamp, amount long"


def plain(times, gap):
    out = []
    for t in sorted(times):
        if out and t - out[-1][1] <= gap:
            out[-1] = [out[-1][0], t, out[-1][2] + 1]
        else:
            out.append([t, t, 1])
    return out


def test_intervals_in_any_order_and_in_parts():
    rng = random.Random(3)
    for gap in (0, 3, 10):
        times = [rng.randrange(400) for _ in range(120)]
        now = [np.zeros(0, dtype=np.int64)] * 4
        for start in range(0, 120, 7):
            at = np.array(times[start : start + 7])
            new = (at, at, np.ones(len(at), dtype=np.int64), at * 2)
            now = list(intervals(*(np.concatenate(x) for x in zip(now, new, strict=True)), gap))
        assert [list(x) for x in zip(*(c.tolist() for c in now[:3]), strict=True)] == plain(times, gap)
        assert now[3].sum() == 2 * sum(times)


def test_intervals_of_many_keys_at_once():
    rng = random.Random(4)
    far = 10**17  # keys and times of any size
    times = [(rng.choice((-far, 0, 5, 6, far)), rng.choice((-far, 0, far)) + rng.randrange(200)) for _ in range(600)]
    now = [np.zeros(0, dtype=np.int64)] * 5
    for start in range(0, 600, 70):
        key, at = (np.array(x, dtype=np.int64) for x in zip(*times[start : start + 70], strict=True))
        new = (key, at, at, np.ones(len(at), dtype=np.int64), at % 7)
        now = keyed_intervals(*(np.concatenate(x) for x in zip(now, new, strict=True)), 3)
    want = [(k, *row) for k in sorted({k for k, _ in times}) for row in plain([t for x, t in times if x == k], 3)]
    assert list(zip(*(c.tolist() for c in now[:4]), strict=True)) == want
    assert now[4].sum() == sum(t % 7 for _, t in times)


def test_a_batch_costs_a_call_a_bucket(spark, tmp_path, monkeypatch):
    """400 keys in 3 buckets: sessions of each key, and no more calls than buckets and their timers."""
    calls = spark.sparkContext.accumulator(0)

    class Counted(module.Sessions):
        def handleInputRows(self, *rest):  # noqa: N802
            calls.add(1)
            yield from super().handleInputRows(*rest)

    monkeypatch.setattr(module, "Sessions", Counted)
    for i, rows in enumerate(([(u, 9000 + 60 * u % 5000) for u in range(400)], [(u, 13_000 + 60 * u % 5000) for u in range(400)], [(1, 10**6)])):
        spark.createDataFrame([(u, s) for u, s in rows], "user long, s long").selectExpr("user", "timestamp_seconds(s) as time", "user as amount").write.parquet(str(tmp_path / f"in/{i}"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in/*"))
        made = sessions(stream, key="user", time="time", amount="amount", gap="30 minutes", delay="2 hours", buckets=3)
        drain(spark, made, str(tmp_path / "out"), str(tmp_path / "state"), Run())
    got = sorted((r.user, r.started // 10**6, r.ended // 10**6, r.events) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted((u, *row) for u in range(400) for row in map(tuple, plain([9000 + 60 * u % 5000, 13_000 + 60 * u % 5000], 1800)))
    assert calls.value <= 7


def test_stream_with_late_rows_and_restarts(spark, tmp_path):
    """Minutes; the watermark is the last time less 10, and 30 minutes without an event end a session."""
    turns = [
        [(1, 0), (1, 20), (2, 0), (1, 5)],
        [(1, 45), (2, 100), (None, 50), (3, None)],  # watermark 90 after this
        [(1, 80), (2, 95), (1, 91), (4, 300)],  # 80 is late; 91 opens anew
        [(1, 250), (4, 310)],  # 250 is late
    ]
    run, out = Run(), str(tmp_path / "out")
    for turn in turns:
        rows = spark.createDataFrame([(u, None if m is None else 60 * (m + 10_000), m) for u, m in turn], "user long, s long, amount long")
        rows.selectExpr("user", "timestamp_seconds(s) as time", "amount").write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        drain(spark, sessions(stream, key="user", time="time", amount="amount", gap="30 minutes", delay="10 minutes"), out, str(tmp_path / "state"), run)
    got = sorted((r.user, r.started // 60_000_000 - 10_000, r.ended // 60_000_000 - 10_000, r.events, r.amount) for r in spark.read.parquet(out).collect())
    assert got == [(1, 0, 45, 4, 70), (1, 91, 91, 1, 91), (2, 0, 0, 1, 0), (2, 95, 100, 2, 195)]
    assert run.late == 2
