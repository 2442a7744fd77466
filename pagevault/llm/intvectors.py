"""Vectors of exact integers: floor(scale * x) of each component x, taken as double, packed as little-endian 32-bit integers.

The integers are bounded so that sums of products and of squared differences of two vectors stay within 64 bits; only vectors
with a component beyond that bound (for 64 components 2**27, far above what embeddings hold) are left out, as are vectors that
are null or hold null or non-finite components.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def largest(width: int) -> int:
    """The largest integer component of a vector of that width: (2 * largest) squared, times width, is at most 2**62."""
    return min((1 << 31) - 1, math.isqrt((1 << 60) // max(1, width)))


def floors(column: pa.Array, scale: int, width: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of a list column of doubles, and their integers, for each width (or for the given one); rows that are left out are missing."""
    lengths = np.asarray(pc.fill_null(pc.list_value_length(column), -1), dtype=np.int64)
    there = np.maximum(lengths, 0)
    starts = np.cumsum(there) - there  # flatten() leaves null lists out
    flat = pc.fill_null(column.flatten(), math.nan).to_numpy(zero_copy_only=False)
    for w in np.unique(lengths[lengths > 0]).tolist() if width is None else [width]:
        rows = np.flatnonzero(lengths == w)
        with np.errstate(invalid="ignore", over="ignore"):
            x = np.floor(flat[starts[rows, None] + np.arange(w)] * scale)
            good = (np.abs(x) <= largest(w)).all(axis=1)  # not for NaN and infinity
        yield rows[good], x[good].astype("<i4")


def packed(df: DataFrame, *, scale: int, vector_column: str, width: int | None = None, **columns: str) -> DataFrame:
    """columns: names of the result's long columns, each with the column it is taken from; beside them v, the packed integers."""
    names = [*columns, "v"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in floors(batch.column("v"), scale, width):
                if len(rows):
                    kept = [batch.column(c).take(pa.array(rows)) for c in columns]
                    yield pa.RecordBatch.from_arrays([*kept, pa.array([v.tobytes() for v in x], pa.binary())], names=names)

    rows = df.select(*[F.col(c).cast("long").alias(name) for name, c in columns.items()], F.col(vector_column).cast("array<double>").alias("v"))
    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in columns) + ", v binary")


def unpacked(raw: list[bytes], width: int) -> np.ndarray:
    """Packed vectors of one width as rows of 64-bit integers."""
    return np.frombuffer(b"".join(raw), dtype="<i4").reshape(len(raw), width).astype(np.int64)
