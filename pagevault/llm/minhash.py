"""Near-duplicate documents by a multi-index Hamming join of MinHash signatures.

A document's set is its distinct word shingles; a signature holds 32 symbols of 16 bits, each the low bits of one
minimum. Sets whose signatures differ in at most 15 symbols are found without loss: split into 8 chunks of 4 symbols,
two such signatures differ by at most one symbol in some chunk (pigeonhole), so enumerating each chunk with one symbol
left out, 32 keys for a set, makes every such pair meet. Pairs that differ in more symbols meet less surely: at similarity
0.85 one in 5e7 misses all keys, at 0.80 one in 9e5, at 0.60 one in 170. Pairs that meet are compared unless they differ in
more symbols than farthest() allows, which loses less than a hundredth of what the keys miss. All links are confirmed on
full sets (64-bit shingle hashes of whole texts).

Scale: equal sets are one class before anything is joined. A bucket never emits its pairs. First each member is compared
with the bucket's smallest id (a star); buckets whose other members then still lie in different components are dealt to
tasks whole, or in pairs of blocks if they are large, and compared there, nearest signatures first, skipping what is
already connected; only links leave a task. Texts travel compressed, and only to where members of a bucket need them.
Nothing is broadcast by hand or collected; lineage is cut in the shared checkpoint folder.

Defined results: null, empty and blank texts have an empty set and link with nothing; a text with fewer words than a
shingle is one shingle; rows that share an id are one document, linked with whatever either text is linked with; rows
with a null id link with nothing and are kept; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, blocks, components, cut, grams, mix, split_join, utf8

CHUNKS, PER_CHUNK = 8, 4
SYMBOLS = CHUNKS * PER_CHUNK
#: Differing symbols up to which no pair is missed: every chunk with two or more makes 16.
FARTHEST = 2 * CHUNKS - 1
#: Members of a bucket, or of a block of a larger one, that one task compares.
BLOCK = 1000
SIGNED = "doc_id long, n_shingles long, f1 long, f2 long, " + ", ".join(f"c{i} long" for i in range(CHUNKS))
CHUNK_COLUMNS = [f"c{i}" for i in range(CHUNKS)]
_FACTORS = mix(np.arange(1, SYMBOLS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def missed(percent: int) -> float:
    """The share of pairs of a similarity that share no key: two symbols or more differ in every chunk."""
    same = percent / 100
    return (1 - same**PER_CHUNK - PER_CHUNK * same ** (PER_CHUNK - 1) * (1 - same)) ** CHUNKS


def farthest(percent: int) -> int:
    """Differing symbols beyond which pairs of a similarity are less than a hundredth of those that share no key."""
    same, beyond = percent / 100, 0.0
    for n in range(SYMBOLS, FARTHEST, -1):
        beyond += math.comb(SYMBOLS, n) * (1 - same) ** n * same ** (SYMBOLS - n)
        if beyond >= missed(percent) / 100:
            return n
    return FARTHEST


def shingles(text: bytes, known: WordHashes, n: int) -> np.ndarray:
    """Sorted distinct shingle hashes; A-Z are lower-cased."""
    return np.unique(grams(known.of(text.lower().split()), n))


def signature(found: np.ndarray) -> np.ndarray:
    least = np.full(SYMBOLS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for start in range(0, len(found), 1 << 15):
        part = np.multiply.outer(_FACTORS, found[start : start + (1 << 15)])
        least = np.minimum(least, (part ^ (part >> np.uint64(31))).min(axis=1))
    return (mix(least) & np.uint64(0xFFFF)).astype(np.uint16)


def sign(df: DataFrame, n: int, id_column: str, text_column: str) -> DataFrame:
    """Rows of SIGNED: the set's size, a 128-bit fingerprint of the set, and the signature as 8 chunks."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in blocks(batches, "text"):
            out = np.zeros((batch.num_rows, 3 + CHUNKS), dtype=np.int64)
            for i, text in enumerate(batch.column("text").to_pylist()):
                found = shingles(text, known, n)
                if len(found):
                    out[i, 0] = len(found)
                    out[i, 1] = mix(found).sum(dtype=np.uint64).astype(np.int64)
                    out[i, 2] = np.bitwise_xor.reduce(mix(found + np.uint64(0x632BE59BD9B4E019))).astype(np.int64)
                    out[i, 3:] = signature(found).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c) for c in out.T]], names=["doc_id", "n_shingles", "f1", "f2", *CHUNK_COLUMNS])

    return df.select(F.col(id_column).cast("long").alias("doc_id"), utf8(text_column).alias("text")).mapInArrow(run, SIGNED)


def differing(a: str, b: str) -> Column:
    """Symbols in which the signatures of two aliases differ."""
    total = F.lit(0)
    for c in CHUNK_COLUMNS:
        x = F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))
        for i in range(PER_CHUNK):
            total = total + (F.shiftrightunsigned(x, 16 * i).bitwiseAND(F.lit(0xFFFF)) != 0).cast("int")
    return total


def buckets(classes: DataFrame) -> DataFrame:
    """rep, leader, slot, k: the members of every key that two classes or more share."""
    keys = []
    for c in range(CHUNKS):
        for i in range(PER_CHUNK):
            mask = int(np.invert(np.uint64(0xFFFF << (16 * i))).astype(np.int64))
            keys.append(F.struct(F.lit(c * PER_CHUNK + i).cast("byte").alias("slot"), F.col(CHUNK_COLUMNS[c]).bitwiseAND(F.lit(mask)).alias("k")))
    rows = classes.select("rep", F.explode(F.array(*keys)).alias("at")).select("rep", "at.slot", "at.k")
    shared = rows.groupBy("slot", "k").agg(F.min("rep").alias("leader"), F.count("*").alias("members")).where("members > 1")
    return split_join(rows, shared.drop("members"), ["slot", "k"])


def joined(members: DataFrame, roots: DataFrame) -> DataFrame:
    """slot, k, rep and the root of each member."""
    members = members.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left")
    return members.select("slot", "k", "rep", F.coalesce("root", "rep").alias("root"))


def compressed(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """rep, z: whole texts, compressed before they are dealt out."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in blocks(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array([pack.compress(t) for t in batch.column("text").to_pylist()], pa.binary())], names=["rep", "z"])

    rows = df.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("rep"), utf8(text_column).alias("text"))
    return rows.mapInArrow(run, "rep long, z binary")


class Sets:
    """Shingle sets of compressed texts, kept by id up to a number of hashes."""

    def __init__(self, n: int, most: int = 4_000_000) -> None:
        self.n, self.most, self.held, self.sets = n, most, 0, {}
        self.known, self.unpack = WordHashes(), zstandard.ZstdDecompressor()

    def of(self, rep: int, z: bytes) -> np.ndarray:
        at = (rep, z)
        if at not in self.sets:
            found = shingles(self.unpack.decompress(z), self.known, self.n)
            if self.held + len(found) > self.most:
                self.sets.clear()
                self.held = 0
            self.sets[at] = found
            self.held += len(found)
        return self.sets[at]


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small) or 100 * len(small) < percent * len(large):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def star_links(star: DataFrame, classes: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs of star (a, b) that are linked."""
    near = star.join(classes.select(F.col("rep").alias("a"), F.struct("n_shingles", *CHUNK_COLUMNS).alias("x")), "a")
    near = near.join(classes.select(F.col("rep").alias("b"), F.struct("n_shingles", *CHUNK_COLUMNS).alias("y")), "b")
    sizes = [F.col("x.n_shingles"), F.col("y.n_shingles")]
    near = near.where((differing("x", "y") <= farthest(percent)) & (100 * F.least(*sizes) >= percent * F.greatest(*sizes))).select("a", "b")
    rows = near.join(texts.select(F.col("rep").alias("b"), F.col("z").alias("zb")), "b").join(texts.select(F.col("rep").alias("a"), F.col("z").alias("za")), "a")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Sets(n)
        for batch in batches:
            a, b, za, zb = (batch.column(c).to_pylist() for c in ("a", "b", "za", "zb"))
            good = [linked(sets.of(i, zi), sets.of(j, zj), percent) for i, j, zi, zj in zip(a, b, za, zb, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return rows.select("a", "b", "za", "zb").mapInArrow(run, "a long, b long")


def compare(rep: np.ndarray, root: list[int], size: np.ndarray, sig: np.ndarray, side: np.ndarray, z: list[bytes], slot: int, percent: int, sets: Sets) -> list[tuple[int, int]]:
    """Links that join different components of one bucket. side: of a pair of blocks, which holds the member, or -1."""
    symbols = sig.view(np.uint16).reshape(len(rep), SYMBOLS)
    roots = np.array(root)
    names, counts = np.unique(roots, return_counts=True)
    rest = np.flatnonzero(roots != names[counts.argmax()])  # pairs inside the largest component are no news
    later = np.ones(len(rep), dtype=bool)
    found, most = [], farthest(percent)
    for i in rest:
        later[i] = False
        other = np.flatnonzero((later | (roots == names[counts.argmax()])) & (roots != roots[i]) & ((side == -1) | (side != side[i])))
        other = other[100 * np.minimum(size[other], size[i]) >= percent * np.maximum(size[other], size[i])]
        apart = symbols[other] != symbols[i]
        total = apart.sum(axis=1)
        by_chunk = apart.reshape(-1, CHUNKS, PER_CHUNK)
        chunk = (by_chunk.sum(axis=2) <= 1).argmax(axis=1)
        # the first key that two signatures share: other buckets leave the pair to it
        first = chunk * PER_CHUNK + by_chunk[np.arange(len(other)), chunk].argmax(axis=1)
        ok = (total <= most) & (first == slot)
        found += [(int(t), int(i), int(j)) for t, j in zip(total[ok], other[ok], strict=True)]
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while x in up:
            x = up[x]
        return x

    links = []
    for _, i, j in sorted(found):
        a, b = top(root[i]), top(root[j])
        if a != b and linked(sets.of(int(rep[i]), z[i]), sets.of(int(rep[j]), z[j]), percent):
            up[max(a, b)] = min(a, b)
            links.append((int(rep[i]), int(rep[j])))
    return links


def rest_links(members: DataFrame, roots: DataFrame, classes: DataFrame, texts: DataFrame, n: int, percent: int, most_members: int) -> DataFrame:
    """Links between members of a bucket that the stars left in different components."""
    members = cut(joined(members.where("rep != leader"), roots), most_members)
    split = members.groupBy("slot", "k").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("members"))
    split = split.where("low != high").select("slot", "k", F.ceil(F.col("members") / BLOCK).cast("int").alias("n_blocks"))
    rows = split_join(members, split, ["slot", "k"]).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("n_blocks")).cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    rows = rows.select("slot", "k", "rep", "root", F.least("own", "with").alias("p"), F.greatest("own", "with").alias("q"), F.when(F.col("own") == F.col("with"), -1).otherwise(F.col("own")).alias("side"))
    rows = rows.join(classes.select("rep", "n_shingles", *CHUNK_COLUMNS), "rep").join(texts, "rep")
    order = ["slot", "k", "p", "q"]
    # a block with itself is its own group; a pair of blocks holds each with its side
    rows = rows.repartition(*order).sortWithinPartitions(*order, "rep").select(*order, "rep", "root", "side", "n_shingles", *CHUNK_COLUMNS, "z")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Sets(n)

        def links(group: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(group)
            col = lambda c: t.column(c).to_numpy()
            sig = np.stack([col(c) for c in CHUNK_COLUMNS], axis=1)
            got = compare(col("rep"), t.column("root").to_pylist(), col("n_shingles"), np.ascontiguousarray(sig), col("side"), t.column("z").to_pylist(), int(col("slot")[0]), percent, sets)
            if got:
                a, b = zip(*got, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        held, at = [], None
        for batch in batches:
            keys = [batch.column(c).to_numpy() for c in order]
            starts = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1 if batch.num_rows else []
            for start, stop in zip([0, *starts], [*starts, batch.num_rows], strict=True):
                if stop > start:
                    now = tuple(int(k[start]) for k in keys)
                    if now != at and held:
                        yield from links(held)
                        held = []
                    held.append(batch.slice(start, stop - start))
                    at = now
        if held:
            yield from links(held)

    return rows.mapInArrow(run, "a long, b long")


def near_duplicates(df: DataFrame, *, shingle: int = 5, percent: int = 85, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest id reachable over links), kept (it is its own)."""
    signed = cut(sign(df, shingle, id_column, text_column))
    real = signed.where("n_shingles > 0 and doc_id is not null")
    same = ["f1", "f2", "n_shingles"]
    n = signed.count()
    classes = cut(real.groupBy(*same).agg(F.min("doc_id").alias("rep"), *[F.min(c).alias(c) for c in CHUNK_COLUMNS]), 4 * n)  # wide rows
    n_keys = SYMBOLS * classes.count()
    members = cut(buckets(classes), n_keys)
    texts = compressed(df, id_column, text_column).join(members.select("rep").distinct(), "rep", "left_semi")
    texts = cut(texts.dropDuplicates(["rep", "z"]), 40 * n)  # long rows
    star = members.where("rep != leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
    placed = signed.join(classes.select(*same, "rep"), same, "left").select("doc_id", "n_shingles", "rep")
    # rows that share an id are one document, whichever class they are in
    shared = placed.groupBy("doc_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low != high and doc_id is not null")
    shared = placed.join(shared, "doc_id").where("rep != low").select(F.col("low").alias("a"), F.col("rep").alias("b"))
    links = cut(star_links(star, classes, texts, shingle, percent))
    roots = components(links, n_keys)
    links = links.unionAll(rest_links(members, roots, classes, texts, shingle, percent, n_keys))
    roots = components(links.unionAll(shared), n_keys + n)
    out = placed.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "rep", "doc_id")).alias("component_id")
    out = out.select("doc_id", "n_shingles", component)
    return out.select("*", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
