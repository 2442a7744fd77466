"""Queries over the table `events`: versioned dictionaries and sessions of a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagevault.operators.asof import DAY, micros
from pagevault.operators.dictionary import normalised, versions
from pagevault.shared import own_folder
from pagevault.streaming.sessions import Run, drain, sessions

GAP, DELAY, LATE = "8 hours", "2 hours", "9 hours"
#: Days that arrive together; every 13th event arrives late.
TOGETHER = 10


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def dictionary_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a user's signup events tell is the user's level from then on: every other event with the version that was valid."""
    events = _events(spark, sf_dir)
    level = F.from_json("props", "k int")["k"] % 4
    dictionary = versions(events.where("event_type = 'signup'").withColumn("level", level), entry="user_id", time="ts", value="level")
    facts = events.where("event_type != 'signup'").select("event_id", "user_id", "event_type", "ts")
    return normalised(facts, dictionary, entry="user_id", time="ts").select("event_id", "user_id", "event_type", "version", F.col("value").alias("level"), "valid_from")


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events in the order of their arrival, some days at a time, through a stream that stops and goes on between; the
    sessions it closed, and how many events came too late."""
    root, run = own_folder(spark, "sessions"), Run()
    events = _events(spark, sf_dir)
    at = micros(F.col("ts"), events.schema["ts"].dataType.typeName())
    came = F.when(F.col("event_id") % 13 == 0, F.lit(9 * DAY // 24)).otherwise(F.lit(0)) + at
    rows = events.select("user_id", F.timestamp_micros(at).alias("time"), F.round(F.col("value") * 100).cast("long").alias("amount"), F.floor(came / (TOGETHER * DAY)).cast("int").alias("turn"))
    for r in rows.select("turn").distinct().orderBy("turn").toLocalIterator():
        rows.where(F.col("turn").eqNullSafe(r.turn)).drop("turn").write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema("user_id long, time timestamp, amount long").parquet(f"{root}/in")
        drain(spark, sessions(stream, key="user_id", time="time", amount="amount", gap=GAP, delay=DELAY), f"{root}/out", f"{root}/state", run)
    closed = spark.read.schema("user_id long, started long, ended long, events long, amount long").parquet(f"{root}/out")
    return closed.withColumn("late", F.lit(run.late).cast("long"))


QUERIES = {"dictionary_versions": dictionary_versions, "event_sessions": event_sessions}
ORACLES = {
    "dictionary_versions": """with told as (select user_id, ts, max(cast(props->>'k' as integer) % 4) as k from events where event_type = 'signup' group by all),
c as (select *, lag(k) over o as before, row_number() over o as i from told window o as (partition by user_id order by ts)),
v as (select user_id, ts as valid_from, k, cast(row_number() over (partition by user_id order by ts) as integer) as version from c where i = 1 or k != before)
select e.event_id, e.user_id, e.event_type, v.version, v.k as level, v.valid_from from (select * from events where event_type != 'signup') as e asof left join v on e.user_id = v.user_id and e.ts >= v.valid_from""",
    "event_sessions": f"""with e as (select user_id, epoch_us(ts) as t, cast(round(value * 100) as bigint) as amount, (epoch_us(ts) + case when event_id % 13 = 0 then {9 * DAY // 24} else 0 end) // {TOGETHER * DAY} as turn from events),
w as (select turn, (max(max(t)) over (order by turn)) // 1000 * 1000 - {2 * DAY // 24} as mark from e group by turn),
k as (select e.*, coalesce(t <= (select max(mark) from w where w.turn < e.turn), false) as late from e),
s as (select *, sum(cast(new as int)) over (partition by user_id order by t rows unbounded preceding) as n from (select *, coalesce(t - lag(t) over (partition by user_id order by t) > {8 * DAY // 24}, true) as new from k where not late)),
c as (select user_id, min(t) as started, max(t) as ended, count(*) as events, cast(sum(amount) as bigint) as amount from s group by user_id, n)
select *, (select count(*) from k where late) as late from c where (ended + {8 * DAY // 24}) // 1000 * 1000 + 1000 <= (select max(mark) from w)""",
}
