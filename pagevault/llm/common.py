"""What several of the operators share: blocks of Arrow rows, word hashes, lineage cuts, components."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagevault.shared import use_checkpoints

#: Rows of a small result that go to one file.
ROWS_A_FILE = 100_000
#: Word hashes that one Python worker keeps; beyond it the cache starts anew.
WORDS_KEPT = 250_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


#: Bytes of an Arrow batch; both sides of a Python worker hold a few.
BATCH_BYTES = 8 << 20


def bounded(spark: SparkSession) -> None:
    """Keeps the session's Arrow batches small: rows here hold whole documents."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key).rstrip("bB") == str(64 << 20):  # its default; other settings are the session's own
        spark.conf.set(key, f"{BATCH_BYTES}b")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def utf8(column: str) -> Column:
    """The whole text as UTF-8 bytes; null is empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")


def blocks(batches: Iterable[pa.RecordBatch], column: str | int, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows again, in slices of about most_bytes of a binary column (one row at least).

    Workers outlive their tasks: what earlier batches took is given back before the next one, and at the end.
    """
    pool = pa.default_memory_pool()
    for batch in batches:
        data = batch.column(column)
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(data), 0), dtype=np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most_bytes, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
        del batch, data
        pool.release_unused()


def in_place(df: DataFrame, run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], extra: int = 0) -> DataFrame:
    """The rows that run makes of df's, with df's columns, whatever their names; run tells columns by place. Of the last `extra`
    columns there are none in the result."""
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    kept = df.columns[: len(df.columns) - extra]
    return plain.mapInArrow(run, plain.select(*plain.columns[: len(kept)]).schema).toDF(*kept)


class WordHashes(dict):
    """64-bit hash of a word's bytes, kept for words seen before."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash for each n consecutive words; fewer than n words make one gram of all of them, none makes none."""
    if not len(hashes):
        return hashes
    n = min(n, len(hashes))
    out = np.zeros(len(hashes) - n + 1, dtype=np.uint64)
    for i in range(n):
        out = (out + hashes[i : len(hashes) - n + 1 + i]) * _ODD
        out ^= out >> np.uint64(29)
    return mix(out)


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """The same rows, written to the folder that all executors share, without their lineage.

    rows: how many there are at most, if that is known; a few rows are written to a few files, however wide the shuffle was.
    """
    use_checkpoints(df.sparkSession)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // ROWS_A_FILE)))
    return df.checkpoint(eager=True)


def split_join(rows: DataFrame, sums: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """rows joined to an aggregate by its own keys. The aggregate lies dealt out by them, so Spark would bring rows there and could
    not split a hot key; joined by a further key that follows from them, both sides are shuffled, and it can."""
    rows, sums = (x.withColumn("_split", F.xxhash64(*keys)) for x in (rows, sums))
    return rows.join(sums, [*keys, "_split"], how).drop("_split")


def components(edges: DataFrame, most_edges: int | None = None, most_rounds: int = 60) -> DataFrame:
    """The smallest id reachable over undirected edges.

    edges: columns a, b (long), most_edges of them at most, if that is known. Returns node, root for every node that has an edge to another one. Large-star and
    small-star steps alternate until no edge changes; the state is one edge table, cut each round, and a hot node's
    edges are minimised by partial aggregates before any shuffle.
    """
    edges = cut(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), most_edges)
    n, seen = edges.count(), None  # no round makes more edges
    for _ in range(most_rounds):
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = split_join(both.where("b > a"), low, ["a"]).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = split_join(large, low, ["a"]).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        edges = cut(small.where("a != b").distinct(), n)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(roots)
