"""Quality classification: hashed word n-gram logistic regression trained with follow-the-regularised-leader updates.

A text's features are hashed words, pairs of neighbouring words, word shapes (runs of letters and digits reduced to one sign
each) and pairs of neighbouring shapes, which also tell whether the two words are equal. A feature's value is its share of
the text's features, times a constant. Training runs FTRL-proximal over a bounded sample of labelled rows; a score is the logistic
function of a sparse dot product, here the mean of the weights of the text's features.

Scoring is one narrow pass over whole texts, in slices bounded by bytes; it ships one weight vector of fixed width.
Labels never reach scoring. The sample's ids, whose number is a parameter, are broadcast to find their texts; features are
taken where the texts are, and only they reach the driver.

Defined results: null and empty texts have no features and get the score of the bias; without usable labels every
score is 0.5; equal texts get equal scores; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORDS_KEPT, blocks, utf8

BITS = 18
SCALE = 16.0
SCORED = "doc_id long, score double, predicted int"
_UPPER, _LOWER, _DIGITS, _SIGNS = (re.compile(p) for p in (rb"[A-Z]+", rb"[a-z\x80-\xff]+", rb"[0-9]+", rb"([^A-Za-z0-9])\1+"))


_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93))


class Words(dict):
    """The hash of a word in the low half, of its shape in the high half."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        shape = _SIGNS.sub(rb"\1\1", _DIGITS.sub(b"0", _LOWER.sub(b"a", _UPPER.sub(b"A", word))))
        value = self[word] = (xxhash.xxh32_intdigest(shape) << 32) | xxhash.xxh32_intdigest(word.lower())
        return value


def features(text: bytes, known: Words) -> np.ndarray:
    """Bucket numbers of all features, repeated as they occur."""
    words = text.split()
    both = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    if not len(both):
        return np.zeros(0, dtype=np.int64)
    word, shape = both & np.uint64(0xFFFFFFFF), both >> np.uint64(32)
    same = (word[1:] == word[:-1]).astype(np.uint64)
    words_2 = word[1:] * _MIX[0] + word[:-1] * _MIX[1]
    shapes_2 = shape[1:] * _MIX[0] + shape[:-1] * _MIX[2] + same
    # each kind has multipliers of its own, so that equal numbers of two kinds are two features
    kinds = [word * _MIX[0], (words_2 ^ (words_2 >> np.uint64(31))) * _MIX[1], (shape + np.uint64(1 << 33)) * _MIX[2], (shapes_2 ^ (shapes_2 >> np.uint64(29))) * _MIX[2]]
    return (np.concatenate(kinds) >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass
class Model:
    weights: np.ndarray
    bias: float


class Ftrl:
    """FTRL-proximal with per-coordinate rates; coordinate 2**BITS is the bias."""

    def __init__(self, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02) -> None:
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, x: np.ndarray, y: int, share: float) -> None:
        w = self.weights(at)
        g = share * (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
        self.z[at] += g - (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] += g * g


def fit(documents: DataFrame, labels: DataFrame, *, most: int = 4000, epochs: int = 4, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality") -> Model:
    """Learns from at most `most` labelled documents, chosen by a hash of the id; labels hold id_column and label_column."""
    usable = labels.where(F.col(label_column).isin(0, 1) & F.col(id_column).isNotNull())
    usable = usable.groupBy(F.col(id_column).cast("long").alias("doc_id")).agg(F.max(label_column).cast("int").alias("y"))
    share = min(1.0, 1.2 * most / max(1, usable.count()))
    drawn = F.xxhash64("doc_id", F.lit("quality"))
    chosen = usable.where(F.pmod(drawn, F.lit(1 << 20)) < share * (1 << 20)).orderBy(drawn, "doc_id").limit(most)

    def extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for batch in blocks(batches, "text"):
            at, x = [], []
            for text in batch.column("text").to_pylist():
                bucket, n = np.unique(features(text, known), return_counts=True)
                at.append(bucket.astype(np.uint32).tobytes())
                x.append((n * (SCALE / max(1, n.sum()))).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(at, pa.binary()), pa.array(x, pa.binary())], names=["doc_id", "y", "at", "x"])

    texts = documents.select(F.col(id_column).cast("long").alias("doc_id"), utf8(text_column).alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text").mapInArrow(extract, "doc_id long, y int, at binary, x binary")
    order = ["doc_id", F.xxhash64("at", "x")]  # rows that share an id may be more than were chosen
    got = rows.orderBy(*order).limit(2 * most).toArrow().to_pydict()
    model = Ftrl()
    ones = sum(got["y"])
    weight = {y: len(got["y"]) / (2 * max(1, n)) for y, n in ((1, ones), (0, len(got["y"]) - ones))}
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(got["y"])):
            at = np.append(np.frombuffer(got["at"][i], dtype=np.uint32).astype(np.int64), 1 << BITS)
            model.learn(at, np.append(np.frombuffer(got["x"][i], dtype=np.float32).astype(float), 1.0), got["y"][i], weight[got["y"][i]])
    learnt = model.weights(slice(None))
    return Model(learnt[:-1].astype(np.float64), float(learnt[-1]))


def score(df: DataFrame, model: Model, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of df: doc_id, score (0 to 1), predicted (1 from 0.5)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for batch in blocks(batches, "text"):
            found = [features(t, known) for t in batch.column("text").to_pylist()]
            dots = np.array([model.weights[f].mean() if len(f) else 0.0 for f in found])
            scores = np.round(1 / (1 + np.exp(-np.clip(SCALE * dots + model.bias, -35, 35))), 6)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return df.select(F.col(id_column).cast("long").alias("doc_id"), utf8(text_column).alias("text")).mapInArrow(run, SCORED)
