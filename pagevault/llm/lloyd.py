"""Centroid clustering by plain Lloyd rounds on integer vectors.

The vectors' integers are written once. Every round is one narrow pass: the centroids are shipped with the tasks, each task
computes the squared differences to every centroid in integers, assigns a vector to the nearest (of equally near ones the
lowest), and emits one row of integer sums for each centroid. These merge through a groupBy; only they, one row for each
centroid, reach the driver, which replaces every centroid that has vectors by the floor of its mean. Nothing is rounded or
depends on how the rows are dealt out, so results are exact and reruns agree.

Scale: a round shuffles at most one row a centroid and task, whatever the number of vectors or their clusters' sizes; what is
shipped is k vectors. A cluster that holds most rows is no hot key.

Defined results: vectors that have another number of components, are null, or hold null or non-finite components take no part
and have no row, as have vectors with a component beyond intvectors.largest() after scaling (2**27 for 64 components); a null
id hashes as the empty text; repeated rows are vectors of their own; rows that share an id are ordered by their integers where
the first centroids are chosen; equal vectors always share a cluster; with fewer vectors than centroids there are fewer
centroids; without vectors there are no rows; a sum beyond 64 bits is null; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .intvectors import packed, unpacked

CLUSTERED = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of x: the nearest centroid, the lowest of equally near ones, and the squared distance."""
    distances = np.empty((len(x), len(centroids)), dtype=np.int64)
    for i, c in enumerate(centroids):
        apart = x - c
        distances[:, i] = np.einsum("ij,ij->i", apart, apart)
    best = distances.argmin(axis=1)
    return best, distances[np.arange(len(x)), best]


def first_centroids(vectors: DataFrame, k: int, seed: int, width: int) -> np.ndarray:
    """The k vectors whose ids have the least hashes, in their order."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    least = vectors.select(digest.alias("h"), "vec_id", "v").orderBy("h", "vec_id", "v").limit(k)
    rows = sorted((r.h, tuple(unpacked([bytes(r.v)], width)[0].tolist())) for r in least.collect())
    return np.array([v for _, v in rows], dtype=np.int64).reshape(-1, width)


def sums(vectors: DataFrame, centroids: np.ndarray) -> list:
    """For each centroid that has vectors: i, their number n, the sum of their distances, and their componentwise sums."""
    width = centroids.shape[1]

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, far = np.zeros(len(centroids), dtype=np.int64), [0] * len(centroids)
        total = np.zeros((len(centroids), width), dtype=np.int64)
        for frame in frames:
            x = unpacked(frame["v"].tolist(), width)
            best, distance = nearest(x, centroids)
            for i in np.unique(best).tolist():
                own = best == i
                n[i] += own.sum()
                total[i] += x[own].sum(axis=0)
                far[i] += sum(distance[own].tolist())
        some = np.flatnonzero(n).tolist()
        yield pd.DataFrame({"i": some, "n": n[some], "far": [str(far[i]) for i in some], "total": [[str(s) for s in total[i].tolist()] for i in some]})

    partial = vectors.select("v").mapInPandas(run, "i int, n long, far string, total array<string>")
    wide = "decimal(38,0)"
    merged = [F.sum("n").alias("n"), F.sum(F.col("far").cast(wide)).alias("far"), *[F.sum(F.col("total")[j].cast(wide)).alias(f"s{j}") for j in range(width)]]
    return partial.groupBy("i").agg(*merged).collect()


def moved(centroids: np.ndarray, found: list) -> np.ndarray:
    out = centroids.copy()
    for r in found:
        out[r.i] = [int(r[f"s{j}"]) // r.n for j in range(centroids.shape[1])]
    return out


def clusters(
    df: DataFrame, *, k: int = 8, rounds: int = 10, width: int = 64, scale: int = 1024, seed: int = 3, id_column: str = "vec_id", vector_column: str = "embedding"
) -> DataFrame:
    """One row per vector that takes part: vec_id, cluster, distance (squared), cluster_inertia and inertia (sums of the distances
    over the cluster and over all) and the hash of the final centroid."""
    vectors = cut(packed(df, scale=scale, width=width, vector_column=vector_column, vec_id=id_column))
    centroids = first_centroids(vectors, k, seed, width)
    if not len(centroids):
        return df.sparkSession.createDataFrame([], CLUSTERED)
    for _ in range(rounds):
        centroids = moved(centroids, sums(vectors, centroids))
    inertia = {r.i: int(r.far) for r in sums(vectors, centroids)}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    def long(value: int) -> int | None:
        return value if value < 1 << 63 else None

    within, over_all = [long(inertia.get(i, 0)) for i in range(len(centroids))], long(sum(inertia.values()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:  # pandas would turn ids beside null ids into doubles
        for batch in batches:
            best, distance = nearest(unpacked(batch.column("v").to_pylist(), width), centroids)
            owned = [pa.array(of, kind).take(pa.array(best)) for of, kind in ((within, pa.int64()), ([over_all] * len(within), pa.int64()), (names, pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(best.astype(np.int32)), pa.array(distance), *owned], names=[c.split()[0] for c in CLUSTERED.split(", ")])

    return vectors.mapInArrow(run, CLUSTERED)


def oracle(k: int = 8, rounds: int = 10, width: int = 64, scale: int = 1024, seed: int = 3) -> str:
    """DuckDB SQL for the same rows, where ids are unique and components moderate."""
    steps = [
        f"x as materialized (select vec_id, [cast(floor({scale} * cast(c as double)) as bigint) for c in embedding] as v from embeddings where len(embedding) = {width} and len([c for c in embedding if c is not null and isfinite(c)]) = {width})",
        f"c0 as materialized (select row_number() over (order by sha256('{seed}:' || vec_id)) - 1 as i, v as c from x order by i limit {k})",
    ]
    for r in range(rounds + 1):
        steps.append(f"d{r} as materialized (select vec_id, v, i, list_sum([(v[j] - c[j]) * (v[j] - c[j]) for j in range(1, {width + 1})]) as d from x, c{r})")
        steps.append(f"a{r} as materialized (select vec_id, any_value(v) as v, cast(arg_min(i, d * 1000 + i) as integer) as i, cast(min(d) as bigint) as d from d{r} group by vec_id)")
        if r < rounds:
            mean = "(s - ((s % n) + n) % n) // n"
            steps.append(f"s{r} as materialized (select i, list(cast({mean} as bigint) order by j) as c from (select i, j, sum(v[j]) as s, count(*) as n from a{r}, range(1, {width + 1}) as t(j) group by i, j) group by i)")
            steps.append(f"c{r + 1} as materialized (select i, coalesce(s.c, o.c) as c from c{r} as o left join s{r} as s using (i))")
    return f"""with {", ".join(steps)}
select vec_id, a.i as cluster, d as distance, cast(sum(d) over (partition by a.i) as bigint) as cluster_inertia, cast(sum(d) over () as bigint) as inertia, sha256(array_to_string(c, ',')) as centroid_sha256
from a{rounds} as a join c{rounds} as c on c.i = a.i"""
