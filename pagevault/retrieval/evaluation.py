"""Ranked lists: reciprocal rank fusion, and evaluation with bootstrap intervals.

Fusion adds 1 / (c + rank) over the lists that hold a document. Evaluation takes a query's first k results and its relevant
documents: nDCG (gain 1, discount log2(rank + 1)), the reciprocal rank of the first relevant result, and recall. Means over queries get
intervals by a Poisson bootstrap: in each replicate, a query counts as often as a Poisson number drawn from a hash of its id and the replicate's
number, so all replicates are sums in one aggregate, nothing is resampled, and reruns agree.

Scale: one shuffle by query and document for fusion and for evaluation; replicates multiply queries, not results.

Defined results: a document that a list holds twice counts with its best rank; scores are rounded to 9 digits, equal ones are ranked by id; queries without
relevant documents are not evaluated; queries with relevant documents and no results count with zeros; results with a null id or rank are left
out; empty tables give no rows.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METRICS = ("ndcg", "reciprocal_rank", "recall")
#: Draws below these, of 2**32, are Poisson numbers 0, 1, 2, ...
POISSON = [math.floor((1 << 32) * math.exp(-1) * sum(1 / math.factorial(i) for i in range(n + 1))) for n in range(9)]


def fuse(lists: list[DataFrame], *, c: int = 60, k: int | None = None) -> DataFrame:
    """lists: query_id, id, rank. Gives query_id, rank, id, score."""
    best = [x.where("id is not null and rank is not null").groupBy("query_id", "id").agg(F.min("rank").alias("rank")) for x in lists]
    every = functools.reduce(DataFrame.unionByName, best)
    fused = every.groupBy("query_id", "id").agg(F.round(F.sum(1 / (c + F.col("rank"))), 9).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    out = fused.withColumn("rank", rank).select("query_id", "rank", "id", "score")
    return out if k is None else out.where(F.col("rank") <= k)


def by_query(ranked: DataFrame, relevant: DataFrame, *, k: int = 10) -> DataFrame:
    """ranked: query_id, id, rank; relevant: query_id, id. Per query with relevant documents: METRICS."""
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    known = relevant.where("query_id is not null and id is not null").select("query_id", "id").distinct()
    first = ranked.where(f"id is not null and rank <= {int(k)}").groupBy("query_id", "id").agg(F.min("rank").alias("rank"))
    hits = known.join(first, ["query_id", "id"], "left")
    sums = hits.groupBy("query_id").agg(F.count("*").alias("n"), F.count("rank").alias("hits"), F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("gain"), F.min("rank").alias("top"))
    return sums.select("query_id", (F.coalesce("gain", F.lit(0.0)) / ideal).alias("ndcg"), F.coalesce(1 / F.col("top"), F.lit(0.0)).alias("reciprocal_rank"), (F.col("hits") / F.col("n")).alias("recall"))


def poisson(query_id: Column, replicate: Column) -> Column:
    """A Poisson number with mean 1."""
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", query_id.cast("string"), replicate.cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")
    return sum(((draw >= F.lit(limit)).cast("int") for limit in POISSON), F.lit(0))


def summary(metrics: DataFrame, *, replicates: int = 200, level: float = 0.95) -> DataFrame:
    """Per metric: metric, queries, mean, low and high (the interval of the mean at that level), rounded to 6 digits."""
    rows = metrics.select("query_id", F.explode(F.sequence(F.lit(0), F.lit(replicates))).alias("b"), *METRICS)
    weight = F.when(F.col("b") == 0, F.lit(1)).otherwise(poisson(F.col("query_id"), F.col("b")))  # replicate 0 is the queries themselves
    rows = rows.withColumn("w", weight)
    means = rows.groupBy("b").agg(F.count("*").alias("n"), *[(F.sum(F.col("w") * F.col(m)) / F.nullif(F.sum("w"), F.lit(0))).alias(m) for m in METRICS])
    long = means.select("b", "n", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS])).alias("x")).select("b", "n", "x.metric", "x.value")
    drawn = F.when(F.col("b") > 0, F.col("value"))
    return long.groupBy("metric").agg(
        F.max("n").alias("queries"),
        F.round(F.max(F.when(F.col("b") == 0, F.col("value"))), 6).alias("mean"),
        F.round(F.percentile(drawn, F.lit((1 - level) / 2)), 6).alias("low"),
        F.round(F.percentile(drawn, F.lit((1 + level) / 2)), 6).alias("high"),
    )
