"""Calibration by isotonic regression: pool-adjacent-violators on partition summaries, merged.

Labels are added up for each distinct score. Scores are dealt out by range, every task pools its own adjacent violators, and
neighbouring tasks' blocks are pooled again, FAN tasks at a time, until one holds all blocks: pooling blocks gives what pooling their rows
would. Sums are integers, and means are compared as products, so the result is exact and does not hang on how rows were dealt out.

Scale: one aggregate by score, one shuffle by range; after that only blocks travel, of which noisy labels leave few (about the cube root of
the rows' number for a smooth curve). The last task holds the blocks of all scores.

Defined results: rows with a null or non-finite score, or a label that is neither 0 nor 1, take no part; equal scores are one; an empty table gives no blocks;
calibrating gives a score the value of the last block that starts at or below it, below the first block that one's, and null to scores that are null or not finite.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagevault.operators.asof import as_of
from pagevault.shared import cut

#: Tasks whose blocks are pooled together in a round.
FAN = 16
BLOCKS = "part int, low double, high double, ones long, n long"


def pooled(rows: Iterable[tuple[float, float, int, int]]) -> list[tuple[float, float, int, int]]:
    """Blocks (low, high, ones, n) in ascending order of their means, from blocks in ascending order of scores."""
    out: list[tuple[float, float, int, int]] = []
    for block in rows:
        while out and out[-1][2] * block[3] >= block[2] * out[-1][3]:
            low, _, ones, n = out.pop()
            block = (low, block[1], ones + block[2], n + block[3])
        out.append(block)
    return out


def isotonic(df: DataFrame, score: str, label: str) -> DataFrame:
    """low, high (the scores of a block), n, value (the share of ones), ascending."""
    s = F.col(score).cast("double")
    rows = df.where(F.col(label).isin(0, 1) & (F.abs(s) < float("inf"))).select((s + 0.0).alias("low"), F.col(label).cast("long").alias("y"))
    sums = rows.groupBy("low").agg(F.sum("y").alias("ones"), F.count("*").alias("n"))
    session = df.sparkSession
    wide = max(1, int(session.conf.get("spark.sql.shuffle.partitions")))
    dealt = sums.repartitionByRange(wide, "low").select(F.spark_partition_id().alias("part"), "low", F.col("low").alias("high"), "ones", "n")

    def pool(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: list[tuple[float, float, int, int]] = []
        part = 0
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            part = columns[0][0] if columns[0] else part
            blocks = pooled([*blocks, *zip(*columns[1:], strict=True)])
        if blocks:
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(blocks), pa.int32()), *(pa.array(c) for c in zip(*blocks, strict=True))], names=[x.split()[0] for x in BLOCKS.split(", ")])

    def pool_group(group: pa.Table) -> pa.Table:
        group = group.sort_by("low")
        blocks = pooled(zip(*(group.column(c).to_pylist() for c in ("low", "high", "ones", "n")), strict=True))
        return pa.table([pa.array([group.column("part")[0].as_py()] * len(blocks), pa.int32()), *(pa.array(c) for c in zip(*blocks, strict=True))], names=[x.split()[0] for x in BLOCKS.split(", ")])

    blocks = cut(dealt.sortWithinPartitions("low").mapInArrow(pool, BLOCKS))
    while wide > 1:
        wide = -(-wide // FAN)
        blocks = blocks.withColumn("part", F.floor(F.col("part") / FAN).cast("int")).groupBy("part").applyInArrow(pool_group, BLOCKS)
    return blocks.select("low", "high", "n", (F.col("ones") / F.col("n")).alias("value"))


def calibrate(df: DataFrame, blocks: DataFrame, score: str, *, span: float = 1 / 64) -> DataFrame:
    """df's columns and `calibrated`. Scores are placed by a sorted merge with the blocks, in spans of scores that spread them."""
    least = blocks.agg(F.min("low")).first()[0]
    at = F.col(f"`{score}`").cast("double")
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    kept = df.select(row, F.lit(0).alias("k"), F.when(F.abs(at) < float("inf"), F.greatest(at, F.lit(least))).cast("double").alias("at"))
    known = blocks.select(F.lit(0).alias("k"), F.col("low").alias("at"), F.col("value").alias("calibrated"))
    placed = as_of(kept, known, by=["k"], left_time="at", right_time="at", values=["calibrated"], span=span)
    return placed.select(*[F.col("row").getField(c).alias(c) for c in df.columns], "calibrated")
