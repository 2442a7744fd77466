"""Language identification by the nearest of several centroids per language.

A text is a TF-IDF vector of hashed byte 2-grams and 3-grams (ASCII letters lower-cased; other ASCII is white space),
normalised to length 1. Fitting clusters a bounded sample of each language's vectors (spherical k-means); prediction
takes the language of the centroid with the largest cosine. Junk shares buckets with any centroid, the more the longer it
is: the cosine that a text's weight would have if it fell on buckets at random is taken off, and a text is rejected if
what remains is below its language's limit (a fraction of the sample's median), whatever its length; only for texts of a few
words the limit is lower.

Scoring is one narrow pass over whole texts in slices bounded by bytes; what it ships is the centroids, whose size
depends on the parameters and the number of languages alone. All languages of the labels are learned, each by one task;
only their centroids (64 KB each) and sums over the sample reach the driver.

Defined results: null texts and texts without a letter are `und`, score 0 and rejected; with nothing to learn from,
every text is; equal texts get equal rows; ties go to the language that sorts first; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, cut, in_place

#: Buckets of n-grams.
WIDTH = 4096
#: Clusters with fewer texts than one in so many of a language's sample are dropped.
RARE = 50
#: Bytes of a text that are counted at once, and of the texts of a slice.
PART = SLICE = 1 << 20
#: Bytes of letters below which the limit falls in proportion: the cosine of a few words says little.
FEW = 120
UNDETERMINED = "und"
PREDICTED = "doc_id long, lang_pred string, score double, rejected boolean"
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


@dataclass
class Model:
    languages: list[str]
    owner: np.ndarray  # of each centroid, the language's index
    centroids: np.ndarray
    idf: np.ndarray
    chance: np.ndarray  # of each centroid, the cosine that each unit of a vector's sum has at random buckets
    least: np.ndarray  # cosine beyond chance below which a text is rejected, by language


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or (not text.isascii() and any(map(str.isalpha, text.decode("utf-8", "replace"))))


def _grams(data: np.ndarray, n: int, rows: np.ndarray | int, out: np.ndarray) -> None:
    """Adds the 2-grams and 3-grams that start at the first n bytes; rows: where each one's buckets begin."""
    two = data[:-1] * np.uint32(0x9E3779B1) + data[1:] * np.uint32(0x85EBCA77)
    three = two[:-1] + data[2:] * np.uint32(0xC2B2AE3D)
    for gram, salt in ((two, 0x27D4EB2F), (three, 0x165667B1)):
        gram = (gram[:n] ^ (gram[:n] >> np.uint32(15))) * np.uint32(salt)
        out += np.bincount(rows + (gram >> np.uint32(20)), minlength=len(out))


def counts(texts: list[bytes]) -> np.ndarray:
    """Counts of hashed n-grams, one row per text. Blanks around each text keep its n-grams from reaching into the next. Long
    texts are counted part by part."""
    padded = [b"  " + t.translate(_LETTERS) + b"  " for t in texts]
    out = np.zeros((len(texts), WIDTH), dtype=np.int64)
    short = [i for i, t in enumerate(padded) if len(t) <= PART]
    if short:
        rows = np.repeat(np.arange(len(short), dtype=np.int64) * WIDTH, [len(padded[i]) for i in short])
        own = np.zeros(len(short) * WIDTH, dtype=np.int64)
        _grams(np.frombuffer(b"".join([*(padded[i] for i in short), b"  "]), dtype=np.uint8).astype(np.uint32), len(rows), rows, own)
        out[short] = own.reshape(len(short), WIDTH)
    for i, t in enumerate(padded):
        for at in range(0, len(t) if len(t) > PART else 0, PART):
            data = np.frombuffer((t + b"  ")[at : at + PART + 2], dtype=np.uint8).astype(np.uint32)
            _grams(data, len(data) - 2, 0, out[i])
    return out


def vectors(texts: list[bytes], idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts(texts).astype(np.float32)) * idf
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)


def by_chance(centroids: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Mean of each centroid over buckets, weighted as the n-grams in them are."""
    return centroids @ idf / idf.sum()


def nearest_centroid(x: np.ndarray, centroids: np.ndarray, chance: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each vector: the nearest centroid, its cosine, and the cosine beyond chance."""
    cosine = x @ centroids.T
    best = cosine.argmax(axis=1)
    top = cosine[np.arange(len(x)), best]
    return best, top, top - x.sum(axis=1) * chance[best]


def sample(df: DataFrame, per_language: int) -> DataFrame:
    """About per_language rows of each language, chosen by a hash of id and text; at most twice as many of any."""
    sizes = df.groupBy("lang").count().select("lang", F.least(F.lit(1.0), per_language / F.col("count")).alias("share"))
    drawn = F.pmod(F.xxhash64("doc_id", "text", F.lit("language")), F.lit(1 << 20))
    rows = df.join(F.broadcast(sizes), "lang").where(drawn < F.col("share") * (1 << 20)).drop("share")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", "text"))
    return rows.withColumn("_drawn", F.row_number().over(order)).where(F.col("_drawn") <= 2 * per_language).drop("_drawn")


def clustered(own: np.ndarray, idf: np.ndarray, clusters: int, rounds: int) -> tuple[np.ndarray, float]:
    """Centroids of one language's counts, and the median of their cosines beyond chance."""
    own = np.log1p(own.astype(np.float32)) * idf
    own /= np.maximum(np.sqrt((own * own).sum(axis=1, keepdims=True)), 1e-12)
    k = min(clusters, len(own))
    centre = own[np.linspace(0, len(own) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        nearest = (own @ centre.T).argmax(axis=1)
        for i in range(k):
            if (nearest == i).any():
                centre[i] = own[nearest == i].mean(axis=0)
        centre /= np.maximum(np.sqrt((centre * centre).sum(axis=1, keepdims=True)), 1e-12)
    size = np.bincount((own @ centre.T).argmax(axis=1), minlength=k)
    centre = centre[size * RARE >= len(own)]  # a few texts in several languages are no variety of one
    _, _, beyond = nearest_centroid(own, centre, by_chance(centre, idf))
    return centre, float(np.median(beyond))


def fit(labelled: DataFrame, *, per_language: int = 400, clusters: int = 4, rounds: int = 8, slack: float = 6.0) -> Model:
    """labelled: doc_id, text, lang. Learns every language, from a sample bounded by per_language (expected) rows of each."""
    rows = sample(labelled.where("lang is not null and text is not null").select("doc_id", "text", "lang"), per_language)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", SLICE):
            found = counts(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array([x.astype(np.uint32).tobytes() for x in found])], names=["lang", "counts"])

    def holding(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, of_all = np.zeros(WIDTH, dtype=np.int64), 0
        for batch in blocks(batches, "counts"):
            x = np.frombuffer(b"".join(batch.column("counts").to_pylist()), dtype=np.uint32).reshape(-1, WIDTH)
            total += (x > 0).sum(axis=0)
            of_all += len(x)
        yield pa.RecordBatch.from_arrays([pa.array([of_all]), pa.array([total.tobytes()])], names=["texts", "total"])

    counted = cut(rows.select("lang", F.col("text").cast("binary").alias("text")).mapInArrow(count, "lang string, counts binary"))
    sums = counted.select("counts").mapInArrow(holding, "texts long, total binary").toLocalIterator()
    texts, total = 0, np.zeros(WIDTH, dtype=np.int64)
    for r in sums:
        texts, total = texts + r.texts, total + np.frombuffer(r.total, dtype=np.int64)
    if not texts:
        return Model([], np.zeros(0, int), np.zeros((0, WIDTH), np.float32), np.ones(WIDTH, np.float32), np.zeros(0), np.zeros(0))
    idf = (np.log((1 + texts) / (1 + total)) + 0.1).astype(np.float32)

    def learn(group: pa.Table) -> pa.Table:
        raw = sorted(group.column("counts").to_pylist())  # independent of the order of arrival
        centre, median = clustered(np.frombuffer(b"".join(raw), dtype=np.uint32).reshape(-1, WIDTH), idf, clusters, rounds)
        return pa.table({"lang": group.column("lang")[:1], "centroids": pa.array([centre.astype(np.float32).tobytes()]), "median": pa.array([median])})

    got = counted.groupBy("lang").applyInArrow(learn, "lang string, centroids binary, median double").toArrow().sort_by("lang")
    own = [np.frombuffer(c, dtype=np.float32).reshape(-1, WIDTH) for c in got.column("centroids").to_pylist()]
    every = np.concatenate(own)
    owner = np.repeat(np.arange(len(own)), [len(c) for c in own])
    return Model(got.column("lang").to_pylist(), owner, every, idf, by_chance(every, idf), np.array(got.column("median").to_pylist()) / slack)


def judged(texts: list[bytes], model: Model) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, cosine and whether it is rejected, for each text."""
    langs, scores, rejected = [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
    known = [i for i, t in enumerate(texts) if has_letter(t)] if model.languages else []
    for part in range(0, len(known), 128):
        these = known[part : part + 128]
        best, top, beyond = nearest_centroid(vectors([texts[i] for i in these], model.idf), model.centroids, model.chance)
        for i, b in zip(these, model.owner[best].tolist(), strict=True):
            langs[i] = model.languages[b]
        letters = np.array([len(t) - t.count(b" ") for t in (texts[i].translate(_LETTERS) for i in these)])
        scores[these], rejected[these] = np.round(np.clip(top, 0, 1).astype(float), 4), beyond < model.least[model.owner[best]] * np.minimum(1, letters / FEW)
    return langs, scores, rejected


def predict(df: DataFrame, model: Model, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of df: doc_id, lang_pred, score (the cosine), rejected."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", SLICE):
            langs, scores, rejected = judged([t or b"" for t in batch.column("text").to_pylist()], model)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "rejected"])

    rows = df.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, PREDICTED)


def accepted_rows(df: DataFrame, model: Model, *, text_column: str = "text") -> DataFrame:
    """The rows of df whose text is not rejected, as they are; with nothing to learn from, those with a letter."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, at, SLICE):
            texts = [(t or "").encode() for t in part.column(at).to_pylist()]
            kept = ~judged(texts, model)[2] if model.languages else np.array([has_letter(t) for t in texts], dtype=bool)
            yield part.filter(pa.array(kept))

    at = df.columns.index(text_column)
    return in_place(df, run)


def remainder(id_column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))
