"""Sessions of event streams: keyed state under a watermark.

A key's rows belong to one session as long as the time from one to the next is at most `gap`, in whatever order they arrive. Open sessions are
state of their key; rows extend, join or open sessions, and a timer closes a session once the watermark has passed the last
moment at which a row could still extend it. Rows behind the watermark are late: they are dropped before they reach the state, and counted.

Scale: one shuffle by bucket of keys, whose state and timer its keys share, so that a batch costs a call a bucket, not a call a key; state holds a row for
each open session, not for each event; a batch's rows of a bucket are aggregated into intervals as they come, so a hot key costs one task's time, not its
memory. The number of buckets must stay while a stream has state. State is in RocksDB, and a stream that stops goes on from its checkpoint.

Defined results: rows with a null key or time are left out; repeated rows count repeatedly; null amounts count as 0; a session that is
still open when the stream ends is not emitted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER, PARTITIONS = "spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CLOSED = "key long, started long, ended long, events long, amount long"
_OPEN = "key array<long>, started array<long>, ended array<long>, events array<long>, amount array<long>"
#: Buckets that keys are dealt to.
BUCKETS = 512


def intervals(started: np.ndarray, ended: np.ndarray, events: np.ndarray, amount: np.ndarray, gap: int) -> tuple[np.ndarray, ...]:
    """Intervals joined where one starts at most `gap` after another's end (microseconds)."""
    order = np.argsort(started, kind="stable")
    started, ended, events, amount = (x[order] for x in (started, ended, events, amount))
    reach = np.maximum.accumulate(ended) if len(ended) else ended
    new = np.concatenate([[True], started[1:] - reach[:-1] > gap]) if len(started) else np.zeros(0, dtype=bool)
    first = np.flatnonzero(new)
    if not len(first):
        return started, ended, events, amount
    return started[first], np.maximum.reduceat(ended, first), np.add.reduceat(events, first), np.add.reduceat(amount, first)


def keyed_intervals(key: np.ndarray, started: np.ndarray, ended: np.ndarray, events: np.ndarray, amount: np.ndarray, gap: int) -> list[np.ndarray]:
    """The same for each key."""
    n = len(key)
    if not n:
        return [key, started, ended, events, amount]
    order = np.lexsort((started, key))
    key, started, ended, events, amount = (x[order] for x in (key, started, ended, events, amount))
    other = np.concatenate([[True], key[1:] != key[:-1]])
    ends, rank = np.unique(ended, return_inverse=True)
    base = (np.cumsum(other) - 1) * len(ends)  # ranks of a later key are higher, so the largest so far is the key's own
    reach = ends[np.maximum.accumulate(base + rank) - base]
    first = np.flatnonzero(other | np.concatenate([[True], started[1:] - reach[:-1] > gap]))
    return [key[first], started[first], np.maximum.reduceat(ended, first), np.add.reduceat(events, first), np.add.reduceat(amount, first)]


class Sessions(StatefulProcessor):
    def __init__(self, gap: int) -> None:
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", _OPEN)

    def close(self) -> None:
        pass

    def held(self) -> list[np.ndarray]:
        if not self.open.exists():
            return [np.zeros(0, dtype=np.int64)] * 5
        return [np.array(c, dtype=np.int64) for c in self.open.get()]

    def timer(self, ended: np.ndarray) -> np.ndarray:
        """The first whole millisecond after the last moment at which a row could extend a session."""
        return (ended + self.gap) // 1000 + 1

    def hold(self, now: list[np.ndarray]) -> None:
        """Keeps open sessions, and has a timer no later than the first of them closes."""
        if not len(now[0]):
            self.open.clear()
            return
        self.open.update(tuple(x.tolist() for x in now))
        due = int(self.timer(now[2]).min())
        if not any(t <= due for t in self.handle.listTimers()):
            self.handle.registerTimer(due)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        now = self.held()
        for frame in rows:
            own, at, amount = (frame[c].to_numpy(dtype=np.int64) for c in ("key", "at", "amount"))
            new = (own, at, at, np.ones(len(at), dtype=np.int64), amount)
            now = keyed_intervals(*(np.concatenate(x) for x in zip(now, new, strict=True)), self.gap)
        self.hold(now)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        now = self.held()
        expired = int(expiredTimerInfo.getExpiryTimeInMs())
        over = self.timer(now[2]) <= max(expired, int(timerValues.getCurrentWatermarkInMs()))
        self.handle.deleteTimer(expired)
        self.hold([x[~over] for x in now])
        if over.any():
            yield pd.DataFrame(dict(zip(("key", "started", "ended", "events", "amount"), (x[over] for x in now), strict=True)))


def sessions(stream: DataFrame, *, key: str, time: str, amount: str, gap: str, delay: str, buckets: int = BUCKETS) -> DataFrame:
    """Closed sessions of a stream: key, started and ended (microseconds since 1970), events, amount. time is a timestamp, amount a
    whole number; gap and delay are intervals such as `30 minutes`."""
    spark = stream.sparkSession
    micros = spark.sql(f"select unix_micros(timestamp_micros(0) + interval {gap}) - unix_micros(timestamp_micros(0)) as n").first().n
    rows = stream.select(F.col(key).cast("long").alias("key"), F.col(time).alias("time"), F.unix_micros(time).alias("at"), F.coalesce(F.col(amount).cast("long"), F.lit(0)).alias("amount"))
    rows = rows.where("key is not null and time is not null").withWatermark("time", delay)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    closed = rows.groupBy("bucket").transformWithStateInPandas(statefulProcessor=Sessions(micros), outputStructType=CLOSED, outputMode="Append", timeMode="EventTime")
    return closed.withColumnRenamed("key", key)


@dataclass
class Run:
    """What a stream has done so far: rows that it read, and rows that came too late."""

    read: int = 0
    late: int = 0


def drain(spark: SparkSession, made: DataFrame, out: str, checkpoint: str, run: Run) -> None:
    """Processes what there is, appends the closed sessions to a folder, and stops; the next call goes on from there. State has at
    most one partition a core: each is a store of its own, opened for every batch."""
    few = min(int(spark.conf.get(PARTITIONS)), max(1, spark.sparkContext.defaultParallelism))
    kept = {name: spark.conf.get(name) for name in (PROVIDER, PARTITIONS)}
    try:
        spark.conf.set(PROVIDER, ROCKS)
        spark.conf.set(PARTITIONS, str(few))
        query = made.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for name, value in kept.items():
            spark.conf.set(name, value)
    for progress in query.recentProgress:
        run.read += progress.numInputRows
        run.late += sum(x.numRowsDroppedByWatermark for x in progress.stateOperators)
