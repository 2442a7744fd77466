"""Dense retrieval: an inverted file of product-quantised residuals, with exact re-ranking.

A bounded sample, drawn by a hash of the id, fits the index: coarse centroids (Lloyd), a codebook for each block of coordinates
of the residuals, and the number of lists to probe, the least with which the sample's own queries keep `covering` of their first k.
Every row is then indexed: its list and one byte for each block. A search sends each query to the lists it probes,
where all codes are scored by table lookup; a query's first `deep` candidates over all lists are joined with their vectors and
ranked by exact cosines in double precision.

Scale: indexing is narrow. A query travels once for each list it probes, as a unit vector; codes travel once. Lists that hold
more than PART codes are dealt to several tasks, each asked by all of the list's queries, so that a list with a third of all rows is no
hot key. A task sends `deep` candidates for each query and part of a list at most. What is shipped is centroids and codebooks.

Defined results: vectors that are null, zero, of another width, or hold null or non-finite components, and rows with a null id, are neither
found nor queries; a query does not find its own id; of equal scores (rounded to 6 digits) smaller ids come first; rows that share an id are
found once, at their best; with fewer than k others, all that the probed lists hold are returned; an empty table gives no rows. Recall below 1 comes from lists that are not
probed and from candidates that quantisation ranks behind `deep`.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagevault.shared import cut

#: Rows that fit the index, of these queries that choose the number of probes, codes of a list in one task, rounds of Lloyd.
SAMPLE, ASKING, PART, ROUNDS = 20_000, 200, 50_000, 8
#: Codes of a codebook: one byte.
CODES = 256


@dataclass(frozen=True)
class Model:
    centroids: np.ndarray  # lists x width, float32
    books: np.ndarray  # blocks x codes x width of a block
    probes: int

    @property
    def blocks(self) -> int:
        return len(self.books)


def unit(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column of doubles that can be compared, and their unit vectors."""
    lengths = np.asarray(pc.fill_null(pc.list_value_length(column), -1), dtype=np.int64)
    there = np.maximum(lengths, 0)
    starts = np.cumsum(there) - there
    flat = pc.fill_null(column.flatten(), float("nan")).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(lengths == width)
    x = flat[starts[rows, None] + np.arange(width)]
    largest = np.abs(x).max(axis=1, initial=0)
    good = np.isfinite(x).all(axis=1) & (largest > 0)
    x = x[good] / largest[good, None]
    return rows[good], x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def vectors(df: DataFrame, width: int, id_column: str, vector_column: str) -> DataFrame:
    """id, v: unit vectors as packed doubles."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = unit(batch.column("v"), width)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows)), pa.array([v.tobytes() for v in x], pa.binary())], names=["id", "v"])

    rows = df.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v"))
    return rows.mapInArrow(run, "id long, v binary")


def unpacked(raw: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), width)


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((centroids * centroids).sum(axis=1)[None, :] - 2 * x @ centroids.T).argmin(axis=1)


def lloyd(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    centroids = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(ROUNDS):
        own = nearest(x, centroids)
        n = np.bincount(own, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        centroids[n > 0] = sums[n > 0] / n[n > 0, None]
    return centroids


def fit(rows: DataFrame, *, lists: int | None = None, blocks: int = 16, covering: float = 0.97, k: int = 10) -> Model | None:
    """rows: vectors(). Learns from about SAMPLE of them; None if there are none."""
    n = rows.count()
    share = min(1.0, SAMPLE / max(1, n))
    drawn = F.pmod(F.xxhash64("id", F.lit("ivfpq")), F.lit(1 << 20)) < share * (1 << 20)
    got = rows.where(drawn).orderBy(F.xxhash64("id", "v")).limit(2 * SAMPLE).select("v").toArrow().column("v").to_pylist()
    if not got:
        return None
    width = len(got[0]) // 8
    x = unpacked(got, width)
    lists = min(lists or max(1, min(1024, int(n**0.5) // 2)), max(1, len(x) // 8))
    centroids = lloyd(x, lists, 1)
    own = nearest(x, centroids)
    rest = x - centroids[own]
    wide = width // blocks
    books = np.stack([lloyd(rest[:, b * wide : (b + 1) * wide], min(CODES, len(x)), 2 + b) for b in range(blocks)])
    # the least number of lists in which the queries' first k others lie
    asked = x[:ASKING]
    scores = asked @ x.T
    scores[np.arange(len(asked)), np.arange(len(asked))] = -2
    first = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    order = np.argsort(np.argsort(-(asked @ centroids.T) * 2 + (centroids * centroids).sum(axis=1), axis=1, kind="stable"), axis=1, kind="stable")
    needed = np.take_along_axis(order, own[first], axis=1).ravel()
    probes = int(np.quantile(needed, covering, method="higher")) + 1
    return Model(centroids, books, min(probes, lists))


def index(rows: DataFrame, model: Model) -> DataFrame:
    """list, id, code: every row."""
    width = model.centroids.shape[1]
    wide = width // model.blocks

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unpacked(batch.column("v").to_pylist(), width)
            own = nearest(x, model.centroids)
            rest = x - model.centroids[own]
            code = np.stack([nearest(rest[:, b * wide : (b + 1) * wide], model.books[b]) for b in range(model.blocks)], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), batch.column("id"), pa.array([c.tobytes() for c in code], pa.binary())], names=["list", "id", "code"])

    return rows.mapInArrow(run, "list int, id long, code binary")


def probed(queries: DataFrame, model: Model) -> DataFrame:
    """list, id, v: each query for each list it probes."""
    width = model.centroids.shape[1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unpacked(batch.column("v").to_pylist(), width)
            far = (model.centroids * model.centroids).sum(axis=1)[None, :] - 2 * x @ model.centroids.T
            lists = np.argsort(far, axis=1, kind="stable")[:, : model.probes]
            for start in range(0, len(x), 64):  # a query becomes as many rows as lists it probes
                part = lists[start : start + 64]
                take = pa.array(np.repeat(np.arange(start, start + len(part)), model.probes))
                yield pa.RecordBatch.from_arrays([pa.array(part.ravel().astype(np.int32)), batch.column("id").take(take), batch.column("v").take(take)], names=["list", "id", "v"])

    return queries.mapInArrow(run, "list int, id long, v binary")


def candidates(codes: DataFrame, asked: DataFrame, model: Model, deep: int) -> DataFrame:
    """query_id, id, near: for each query and part of a list, the first candidates by quantised inner product."""
    width = model.centroids.shape[1]
    wide = width // model.blocks
    sizes = codes.groupBy("list").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")).where("parts > 1")
    sizes = F.broadcast(sizes)  # a row a list at most
    stored = codes.join(sizes, "list", "left").select("list", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"), F.lit(0).alias("role"), "id", F.col("code").alias("data"))
    asking = asked.join(sizes, "list", "left").select("list", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"), F.lit(1).alias("role"), "id", F.col("v").alias("data"))
    rows = stored.unionAll(asking).repartition("list", "part").sortWithinPartitions("list", "part", "role", "id")

    def answered(at: tuple[int, int], held: list[tuple[np.ndarray, list[bytes]]], ids: np.ndarray, raw: list[bytes]) -> pa.RecordBatch:
        stored_ids = np.concatenate([i for i, _ in held])
        code = np.frombuffer(b"".join(c for _, part in held for c in part), np.uint8).reshape(len(stored_ids), model.blocks)
        x = unpacked(raw, width)
        base = x @ model.centroids[at[0]]
        out = []
        for n, query in enumerate(x):
            tables = np.stack([model.books[b] @ query[b * wide : (b + 1) * wide] for b in range(model.blocks)])
            near = base[n] + tables[np.arange(model.blocks)[None, :], code].sum(axis=1)
            near[stored_ids == ids[n]] = -np.inf
            first = np.argpartition(-near, deep - 1)[:deep] if len(near) > deep else np.arange(len(near))
            first = first[near[first] > -np.inf]
            out.append((np.full(len(first), ids[n]), stored_ids[first], near[first]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["query_id", "id", "near"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            lists, part, role = (batch.column(c).to_numpy() for c in ("list", "part", "role"))
            new = np.flatnonzero(np.concatenate([[True], (lists[1:] != lists[:-1]) | (part[1:] != part[:-1]) | (role[1:] != role[:-1])])) if len(lists) else []
            for start, stop in zip(new, [*new[1:], len(lists)], strict=True):
                at = (int(lists[start]), int(part[start]))
                if at != now:
                    now, held = at, []
                ids, data = batch.column("id").slice(start, stop - start).to_numpy(), batch.column("data").slice(start, stop - start).to_pylist()
                if role[start] == 0:
                    held.append((ids, data))
                elif held:
                    for i in range(0, len(ids), 64):
                        yield answered(at, held, ids[i : i + 64], data[i : i + 64])

    return rows.mapInArrow(run, "query_id long, id long, near double")


def search(df: DataFrame, queries: Column, *, k: int = 10, deep: int = 200, width: int = 64, lists: int | None = None, blocks: int = 16, covering: float = 0.97, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), id, score: of the rows for which `queries` (a condition on `id`) holds, the first k others."""
    schema = "query_id long, rank int, id long, score double"
    rows = cut(vectors(df, width, id_column, vector_column))
    model = fit(rows, lists=lists, blocks=blocks, covering=covering, k=k)
    if model is None:
        return df.sparkSession.createDataFrame([], schema)
    asked = rows.where(queries)
    found = candidates(index(rows, model), probed(asked, model), model, deep)
    order = Window.partitionBy("query_id").orderBy(F.desc("near"), "id")
    best = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= deep).select("query_id", "id").distinct()
    pairs = best.join(rows.select("id", "v"), "id").join(asked.select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id")

    def exact(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                p, q = (unpacked(batch.column(c).to_pylist(), width) for c in ("v", "q"))
                score = np.round(np.einsum("ij,ij->i", p, q), 6)
                yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("id"), pa.array(score)], names=["query_id", "id", "score"])

    scored = pairs.select("query_id", "id", "v", "q").mapInArrow(exact, "query_id long, id long, score double")
    scored = scored.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
