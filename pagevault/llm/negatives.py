"""Hard-negative mining by distributed radix selection over integer scores.

An anchor's score with a row is their integer inner product. Every anchor has a window over the rows of its own label, in which its
first positives are selected, and every positive gives a window of scores over the rows of other labels, in which the first
negatives are. The first k of a window are found without sorting or gathering its rows: each task counts the window's rows by
the leading digit of their distance from the window's best score, the counts are summed by window and digit, and the digit
that holds the kth row is the next pass's narrower window, until its score is known exactly. If more rows have that score than
are wanted, the digits of their ids go on. Then the rows that qualify, k of a window at most, are gathered.

Scale: anchors are taken in blocks whose number of bytes is bounded, each shipped with tasks over all rows, dealt out by id; a hot label
or a group of equal vectors is spread like others, and ties cost further passes, not rows. A task's counts end with the digit
at which it alone has k rows, as the kth of all is no further: at most k counts a window and task are shuffled. The driver
holds one block of anchors with their windows.

Defined results: rows with a null id take no part, as rows with a null label, a null vector, or null or non-finite components;
nor do vectors with a component beyond intvectors.largest() after scaling (2**27 for 64 components, far above embeddings);
vectors of different lengths are not compared; rows that share an id are one row, the least by label and packed components; equal
vectors are ordered by id; anchors without positives or negatives have no rows; an empty table gives none; further columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagevault.shared import own_folder

from .common import cut
from .intvectors import packed, unpacked

#: Bits of a digit, anchors of a block, bytes of a block's vectors, cells of a matrix of scores.
DIGIT, ANCHORS, BLOCK_BYTES, CELLS = 9, 2048, 8 << 20, 4 << 20
MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
_FOUND = "anchor_id long, positive_id long, positive_score long, id long, score long"


@dataclass(frozen=True)
class Block:
    """Anchors, and windows over their rows: of anchor `at`, rows of its own label or of others with low <= score <= high."""

    ids: np.ndarray
    labels: np.ndarray
    x: np.ndarray
    same: bool
    at: np.ndarray
    low: np.ndarray
    high: np.ndarray
    positive: np.ndarray
    score: np.ndarray


@dataclass(frozen=True)
class Digits:
    """What a pass counts of each open window: scores from high down to low, or, where these are equal and `ties` is set, ids
    from first up to last; both in steps of 2**shift."""

    open: np.ndarray
    ties: np.ndarray
    low: np.ndarray
    high: np.ndarray
    first: np.ndarray
    last: np.ndarray
    shift: np.ndarray
    wanted: np.ndarray

    def narrowed(self) -> Digits:
        """With the step that makes at most 2**DIGIT digits of what is left of each window."""
        reach = np.where(self.ties, self.last - self.first, self.high - self.low)
        return replace(self, shift=np.array([max(0, int(r).bit_length() - DIGIT) for r in reach.tolist()], dtype=np.int64))


def scores(block: Block, vectors: np.ndarray) -> np.ndarray:
    """Integer inner products, one row per anchor: by doubles where these are exact."""
    bound = float(np.abs(block.x).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * vectors.shape[1]
    if bound < 1 << 53:
        return (block.x.astype(np.float64) @ vectors.astype(np.float64).T).astype(np.int64)
    return block.x @ vectors.T


def each(batches: Iterable[pa.RecordBatch], block: Block) -> Iterator[tuple[np.ndarray, np.ndarray, Callable[[int], np.ndarray]]]:
    """Slices of the rows that have the anchors' width: ids, scores with each anchor, and which rows an anchor's windows take."""
    width = block.x.shape[1]
    step = max(1, CELLS // max(1, len(block.ids)))
    for batch in batches:
        for start in range(0, batch.num_rows, step):
            part = batch.slice(start, step)
            ids, labels = part.column("id").to_numpy(), part.column("label").to_numpy()
            found = scores(block, unpacked(part.column("v").to_pylist(), width))

            def taken(a: int, ids: np.ndarray = ids, labels: np.ndarray = labels) -> np.ndarray:
                return (labels == block.labels[a]) & (ids != block.ids[a]) if block.same else labels != block.labels[a]

            yield ids, found, taken


def of_width(rows: DataFrame, block: Block) -> DataFrame:
    return rows.where(F.octet_length("v") == 4 * block.x.shape[1])


def counted(rows: DataFrame, block: Block, now: Digits) -> DataFrame:
    """w, digit, n: how many rows each open window has in each digit, as far as the k wanted ones may reach."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(now.open), 1 << DIGIT), dtype=np.int64)
        by_anchor = np.argsort(block.at[now.open], kind="stable")
        for ids, found, taken in each(batches, block):
            last, mine = -1, None
            for i in by_anchor.tolist():
                a = int(block.at[now.open[i]])
                if a != last:
                    last, mine = a, taken(a)
                    own, own_ids = found[a][mine], ids[mine]
                if now.ties[i]:
                    value = own_ids[own == now.high[i]] - now.first[i]
                    value = value[(value >= 0) & (value <= now.last[i] - now.first[i])]
                else:
                    value = now.high[i] - own[(own >= now.low[i]) & (own <= now.high[i])]
                if len(value):
                    n = np.bincount(value >> now.shift[i])
                    total[i, : len(n)] += n
        before = np.cumsum(total, axis=1) - total
        i, digit = np.nonzero((total > 0) & (before < now.wanted[:, None]))
        yield pa.RecordBatch.from_arrays([pa.array(now.open[i].astype(np.int64)), pa.array(digit.astype(np.int32)), pa.array(total[i, digit]), pa.array(now.wanted[i])], names=["w", "digit", "n", "k"])

    return of_width(rows, block).mapInArrow(run, "w long, digit int, n long, k long")


def reached(counts: DataFrame) -> list:
    """Of each window that has enough rows: the digit of the last wanted one, the rows of it, and those up to it."""
    sums = counts.repartition("w").groupBy("w", "digit", "k").agg(F.sum("n").alias("n"))  # tasks have summed already
    upto = F.sum("n").over(Window.partitionBy("w").orderBy("digit"))
    return sums.withColumn("upto", upto).where((F.col("upto") >= F.col("k")) & (F.col("upto") - F.col("n") < F.col("k"))).select("w", "digit", "n", "upto").collect()


def selected(rows: DataFrame, block: Block, k: int, id_range: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Of each window the least score that qualifies, and the last id of those that have just this score."""
    n = len(block.at)
    floor, last_id = block.low.copy(), np.full(n, id_range[1], dtype=np.int64)
    some = np.flatnonzero(block.low <= block.high)
    size = len(some)
    now = Digits(some, np.zeros(size, dtype=bool), block.low[some], block.high[some], np.full(size, id_range[0]), np.full(size, id_range[1]), np.zeros(size, dtype=np.int64), np.full(size, k)).narrowed()
    while len(now.open):
        place = {w: i for i, w in enumerate(now.open.tolist())}
        keep = []
        low, high, first, last, ties, more = (a.copy() for a in (now.low, now.high, now.first, now.last, now.ties, now.wanted))
        for r in reached(counted(rows, block, now)):  # windows that have fewer rows keep all of them
            i = place[r.w]
            more[i] -= r.upto - r.n
            step = int(now.shift[i])
            if ties[i]:
                first[i] += r.digit << step
                last[i] = min(int(last[i]), int(first[i]) + (1 << step) - 1)
                last_id[r.w] = last[i]
                if first[i] < last[i] and r.n > more[i]:
                    keep.append(i)
            else:
                high[i] -= r.digit << step
                low[i] = max(int(low[i]), int(high[i]) - (1 << step) + 1)
                floor[r.w] = low[i]
                if r.n > more[i]:
                    ties[i] = low[i] == high[i]
                    keep.append(i)
        at = np.array(keep, dtype=np.int64)
        now = Digits(now.open[at], ties[at], low[at], high[at], first[at], last[at], now.shift[at], more[at]).narrowed()
    return floor, last_id


def gathered(rows: DataFrame, block: Block, floor: np.ndarray, last_id: np.ndarray) -> DataFrame:
    """The rows that qualify, with the window's anchor, positive and positive score."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, found, taken in each(batches, block):
            out: list[tuple] = []
            mine, last = None, -1
            for w in np.argsort(block.at, kind="stable").tolist():
                a = int(block.at[w])
                if a != last:
                    last, mine = a, np.flatnonzero(taken(a))
                    own, own_ids = found[a][mine], ids[mine]
                good = np.flatnonzero((own >= floor[w]) & (own <= block.high[w]) & ((own > floor[w]) | (own_ids <= last_id[w])))
                if len(good):
                    out.append((np.full(len(good), block.ids[a]), np.full(len(good), block.positive[w]), np.full(len(good), block.score[w]), own_ids[good], own[good]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=[c.split()[0] for c in _FOUND.split(", ")])

    return of_width(rows, block).mapInArrow(run, _FOUND)


def squared_lengths(rows: DataFrame) -> dict[int, int]:
    """The largest squared length of each width's vectors."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("v").to_pylist()
            sizes = np.array([len(v) // 4 for v in raw], dtype=np.int32)
            for width in np.unique(sizes).tolist():
                x = unpacked([v for v in raw if len(v) == 4 * width], width)
                yield pa.RecordBatch.from_arrays([pa.array([width], pa.int32()), pa.array([(x * x).sum(axis=1).max()], pa.int64())], names=["width", "most"])

    found = rows.select("v").mapInArrow(run, "width int, most long").groupBy("width").agg(F.max("most").alias("most"))
    return {r.width: r.most for r in found.collect()}


def anchor_blocks(rows: DataFrame, anchors: Column) -> Iterator[Block]:
    """Blocks of anchors of one width; a bounded number of hashed buckets of bounded size is counted first."""
    chosen = cut(rows.where(anchors).withColumn("width", (F.octet_length("v") / 4).cast("int")))
    for width, n in sorted(map(tuple, chosen.groupBy("width").count().collect())):
        most = max(1, min(ANCHORS, BLOCK_BYTES // (4 * width)))
        buckets = 8 * (-(-n // most))
        bucket = F.pmod(F.xxhash64("id", F.lit("block")), F.lit(buckets))
        own = chosen.where(F.col("width") == width).withColumn("bucket", bucket)
        sizes = sorted(map(tuple, own.groupBy("bucket").count().collect()))
        start, held = 0, 0
        for at, size in [*sizes, (buckets, most + 1)]:
            if held and held + size > most:
                part = own.where(F.col("bucket").between(start, at - 1)).select("id", "label", "v").orderBy("id").collect()
                x = unpacked([bytes(r.v) for r in part], width)
                none = np.zeros(0, dtype=np.int64)
                yield Block(np.array([r.id for r in part], dtype=np.int64), np.array([r.label for r in part], dtype=np.int64), x, True, none, none, none, none, none)
                start, held = at, 0
            held += size


def with_windows(block: Block, same: bool, at: list[int], low: list[int], high: list[int], positive: list[int], score: list[int]) -> Block:
    return Block(block.ids, block.labels, block.x, same, *(np.array(c, dtype=np.int64) for c in (at, low, high, positive, score)))


def mine(
    df: DataFrame,
    *,
    anchors: Column | None = None,
    positives: int = 5,
    negatives: int = 10,
    least_percent: int = 30,
    most_percent: int = 90,
    scale: int = 256,
    label: Column | None = None,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
) -> DataFrame:
    """One row per anchor, positive and mined negative: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Of each anchor's first `positives` other rows of its label, the first `negatives` rows of other labels whose score is at least
    least_percent and at most most_percent of the positive's. anchors: a condition on `id` (by default ids that 100 divides);
    label: what becomes of `label`, which may depend on `id`.
    """
    spark = df.sparkSession
    rows = packed(df, scale=scale, vector_column=vector_column, id=id_column, label=label_column).where("id is not null and label is not null")
    rows = rows.withColumn("label", label if label is not None else F.col("label"))
    rows = cut(rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("row")).select("id", "row.label", "row.v"))
    first_id, last_id = rows.select(F.min("id"), F.max("id")).first()
    longest = squared_lengths(rows)
    folder = own_folder(spark, "negatives")
    empty = True
    for block in anchor_blocks(rows, anchors if anchors is not None else F.col("id") % 100 == 0) if longest else ():
        most = [math.isqrt(n * longest[block.x.shape[1]]) + 1 for n in (block.x * block.x).sum(axis=1).tolist()]  # no score is larger
        every = range(len(block.ids))
        own = with_windows(block, True, [*every], [-m for m in most], most, [0 for _ in every], [0 for _ in every])
        near = gathered(rows, own, *selected(rows, own, positives, (first_id, last_id))).collect()
        at = {a: i for i, a in enumerate(block.ids.tolist())}
        pairs = [(at[r.anchor_id], -(-least_percent * r.score // 100), most_percent * r.score // 100, r.id, r.score) for r in near]
        if not pairs:
            continue
        other = with_windows(block, False, *map(list, zip(*pairs, strict=True)))
        gathered(rows, other, *selected(rows, other, negatives, (first_id, last_id))).write.mode("append").parquet(folder)
        empty = False
    if empty:
        return spark.createDataFrame([], MINED)
    found = spark.read.schema(_FOUND).parquet(folder)
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "id"))
    return found.select("anchor_id", "positive_id", rank.alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def oracle() -> str:
    """DuckDB SQL for the registered query's rows, where ids are unique and scores below 2**53."""
    return """with x as materialized (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, [cast(floor(256 * cast(c as double)) as double) for c in embedding] as v from embeddings
  where label is not null and len(embedding) > 0 and len([c for c in embedding if c is not null and isfinite(c)]) = len(embedding)),
scored as materialized (select a.vec_id as anchor_id, a.label as anchor_label, x.vec_id, x.label, cast(list_inner_product(a.v, x.v) as bigint) as score from x as a, x where a.vec_id % 100 = 0 and len(a.v) = len(x.v)),
positive as (select * from (select *, row_number() over (partition by anchor_id order by score desc, vec_id) as n from scored where label = anchor_label and vec_id != anchor_id) where n <= 5),
negative as (select p.anchor_id, p.vec_id as positive_id, s.vec_id as negative_id, p.score as positive_score, s.score as negative_score, row_number() over (partition by p.anchor_id, p.vec_id order by s.score desc, s.vec_id) as n
  from positive as p join scored as s on s.anchor_id = p.anchor_id and s.label != p.anchor_label where 30 * p.score <= 100 * s.score and 100 * s.score <= 90 * p.score)
select anchor_id, positive_id, cast(n as integer) as rank, negative_id, positive_score, negative_score from negative where n <= 10"""
