"""Queries that fit models to the tables `events` and `orders`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagevault.learning import calibrate, fit, isotonic

KINDS = ("click", "error", "purchase", "view")


def win_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chance that an event's value is above 50, by its type: a model that has a closed solution, the log odds of each type."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = events.select(*[(F.col("event_type") == k).cast("int").alias(k) for k in KINDS], (F.col("value") > 50).cast("int").alias("won"))
    model = fit(rows, list(KINDS), "won")
    told = [("signup", model.intercept), *((k, model.intercept + w) for k, w in zip(KINDS, model.weights, strict=True))]
    return spark.createDataFrame(told, "event_type string, margin double").select("event_type", F.round("margin", 6).alias("log_odds"))


def win_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders above 150,000 by the customer's balance: the calibrated chance of each order."""
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("o_custkey"), F.col("c_acctbal").alias("score"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", (F.col("o_totalprice") > 150_000).cast("int").alias("won"))
    rows = orders.join(customers, "o_custkey").select("o_orderkey", "score", "won")
    return calibrate(rows, isotonic(rows, "score", "won"), "score", span=1000.0).select("o_orderkey", F.round("calibrated", 9).alias("calibrated"))


QUERIES = {"win_probability": win_probability, "win_calibration": win_calibration}
#: The calibration by the min-max formula: the largest least mean of scores from one at or below to one at or above.
ORACLES = {
    "win_probability": "select event_type, round(ln(p / (1 - p)), 6) as log_odds from (select event_type, avg(cast(value > 50 as int)) as p from events group by event_type)",
    "win_calibration": """with r as (select o_orderkey, c_acctbal as s, cast(o_totalprice > 150000 as int) as y from orders join customer on c_custkey = o_custkey),
d as materialized (select row_number() over (order by s) as i, s, sum(y) as y, count(*) as n from r group by s),
c as materialized (select i, s, sum(y) over (order by i) as y, sum(n) over (order by i) as n from d),
z as materialized (select * from c union all select 0, null, 0, 0),
least as materialized (select a.i as j, b.i as k, (b.y - a.y) / (b.n - a.n) as mean from z as a join c as b on b.i > a.i),
upto as (select j, k, min(mean) over (partition by j order by k rows between current row and unbounded following) as low from least),
v as (select k as i, max(low) as value from upto group by k)
select o_orderkey, round(value, 9) as calibrated from r join d using (s) join v using (i)""",
}
