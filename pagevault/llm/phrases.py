"""Substring deduplication with repeated-phrase automata: passages are confirmed, compiled, then located everywhere.

Each window of 50 words chooses the 8-word phrase in it that has the least hash (winnowing), so equal windows choose equal
phrases. Neighbouring windows that choose the same phrase are a run, and a run's words are a passage of 50 to 92 words.

1. Confirm. Passages are told apart by their phrase's letters (64 bits) and a hash of all their words (64 bits). A passage
   whose phrase and hash occur in two documents recurs with all its windows. Passages that share the phrase but not the
   hash may still share some windows: each distinct one is cut into its windows, in the smallest document that has it, and
   windows are compared by the same 128 bits. What is confirmed names no document that holds it, only the smallest: the phrase, where
   it lies in the passage or window, the length and hash of that, and the smallest id.
2. Compile. A shard's automaton (Aho-Corasick, a word being one of 256 letters) holds the phrases of the confirmed passages that
   its documents may hold, each once.
3. Stream. All documents run through their shard's automaton. Its hits, and nothing else, tell where to look: around each hit, the
   spans that the phrase's confirmed passages would take are hashed and compared, and the words of equal ones go if the
   passage's smallest id is smaller than the document's.

Scale: a document has about one run in 17 words. Recurring phrases are found by partial sums, and joined by shuffles whose hot
keys Spark can split; a passage of a third of all documents is one row for each shard after that. Only distinct passages whose
phrase has several are cut into windows, and of equal windows in a task only the first leaves it unresolved. Patterns travel to
the documents' shards and not documents to the patterns' ones: a text is shipped once however many passages it shares. A shard's
text bounds its automaton, of which a task keeps one; a task takes any number of shards, and the number of tasks follows
the cluster, not the data. Texts are compressed before they are dealt out.

Defined results: null text has no words; texts below 50 words lose none; rows that share an id do not count as smaller
than each other, and each loses what its own text repeats; rows with a null id lose nothing and take nothing from others; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHashes, blocks, cut, grams, mix, utf8

#: Words of a phrase: with a letter of 8 bits for each, it is one long.
PHRASE = 8
#: Bytes of a shard's texts, shards of a task at least (several, so that tasks are alike), and tasks for each core or shuffle
#: partition at most.
SHARD_BYTES, TASK_SHARDS, TASKS_EACH = 1_500_000, 8, 3
#: Windows that a task holds before it sends the first of each, and hits that are looked at together.
FLUSH, HITS = 200_000, 20_000
#: Columns of what is confirmed.
FOUND = ("p", "h", "place", "low")
_BASE = 0x9E3779B97F4A7C15
_PLACE = np.uint64((1 << 28) - 1)


class Powers:
    """Powers of an odd number and of its inverse, as far as they were needed."""

    def __init__(self) -> None:
        self.up = self.back = np.ones(1, dtype=np.uint64)

    def grow(self, n: int) -> None:
        if n > len(self.up):
            n = 1 << n.bit_length()
            self.up, self.back = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, b, dtype=np.uint64)]), dtype=np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64)))


_POWERS = Powers()


class Spans:
    """Hashes of any spans of a document's words: a polynomial over 64-bit word hashes, by differences of prefix sums."""

    def __init__(self, hashes: np.ndarray) -> None:
        _POWERS.grow(len(hashes))
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(hashes * _POWERS.up[: len(hashes)], dtype=np.uint64)])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        total = (self.sums[stop] - self.sums[start]) * _POWERS.back[start]
        return mix(total + (stop - start).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)).view(np.int64)


def selected(hashes: np.ndarray, size: int) -> np.ndarray:
    """For each window, where the phrase with the least hash starts (the first of equal ones)."""
    if len(hashes) < size:
        return np.zeros(0, dtype=np.int64)
    phrase = grams(hashes, PHRASE)
    least = (phrase & ~_PLACE) | np.arange(len(phrase), dtype=np.uint64)
    span, done = size - PHRASE + 1, 1
    while done < span:
        step = min(done, span - done)
        least = np.minimum(least[:-step], least[step:])
        done += step
    return (least & _PLACE).astype(np.int64)


def letters(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(56)).astype(np.uint8)


def placed(offset: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    return (offset << 20 | length).astype(np.int32)


class Runs:
    """A document's runs: where the phrase starts, the first window, and the end of the last one."""

    def __init__(self, hashes: np.ndarray, size: int) -> None:
        chosen = selected(hashes, size)
        new = np.concatenate([[True], chosen[1:] != chosen[:-1]]) if len(chosen) else np.zeros(0, dtype=bool)
        self.size, self.hashes = size, hashes
        self.first = np.flatnonzero(new)
        self.at = chosen[self.first]
        self.stop = np.append(self.first[1:], len(chosen)) - 1 + size if len(chosen) else self.first

    def places(self) -> np.ndarray:
        """Where the phrase lies in the passage, and the passage's length, in one number."""
        return placed(self.at - self.first, self.stop - self.first)

    def phrases(self) -> np.ndarray:
        return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(letters(self.hashes), PHRASE)[self.at]).view("<i8").ravel()

    def take(self, which: np.ndarray) -> Runs:
        out = object.__new__(Runs)
        out.size, out.hashes, out.first, out.at, out.stop = self.size, self.hashes, self.first[which], self.at[which], self.stop[which]
        return out

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """The windows' starts, and the run that each is in."""
        n = self.stop - self.size + 1 - self.first
        run = np.repeat(np.arange(len(n)), n)
        return np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n) + self.first[run], run


def zipped(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """doc_id, z: whole texts, compressed."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in blocks(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([pack.compress(t) for t in batch.column("text").to_pylist()], pa.binary())], names=["doc_id", "z"])

    return df.select(F.col(id_column).cast("long").alias("doc_id"), utf8(text_column).alias("text")).mapInArrow(run, "doc_id long, z binary")


def passages(df: DataFrame, size: int, id_column: str, text_column: str) -> DataFrame:
    """doc_id, lists p, b and place: the phrase, the hash and the place of the phrase, of each distinct passage of a document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in blocks(batches, "text"):
            ids, ends, ps, bs, places = [], [0], [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                hashes = known.of(text.split())
                runs = Runs(hashes, size)
                if len(runs.at):
                    p, b = runs.phrases(), Spans(hashes).of(runs.first, runs.stop)
                    order = np.lexsort((p, b))
                    p, b = p[order], b[order]
                    new = np.concatenate([[True], (p[1:] != p[:-1]) | (b[1:] != b[:-1])])
                    ids.append(doc_id)
                    ps.append(p[new])
                    bs.append(b[new])
                    places.append(runs.places()[order][new])
                    ends.append(ends[-1] + len(ps[-1]))
            if ids:
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(x))) for x in (ps, bs, places)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *lists], names=["doc_id", "p", "b", "place"])

    rows = df.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("doc_id"), utf8(text_column).alias("text"))
    return cut(rows.mapInArrow(run, "doc_id long, p array<long>, b array<long>, place array<int>"))


class Held:
    """Windows of a task until they are sent: of each, its first document without, and later ones with a smaller id."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.n = 0

    def add(self, p: np.ndarray, w: np.ndarray, place: np.ndarray, doc_id: int) -> None:
        self.parts.append((p, w, place, np.full(len(w), doc_id)))
        self.n += len(w)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            p, w, place, doc = (np.concatenate(x) for x in zip(*self.parts, strict=True))
            self.parts, self.n = [], 0
            order = np.lexsort((doc, w, p))
            p, w, place, doc = p[order], w[order], place[order], doc[order]
            new = np.concatenate([[True], (w[1:] != w[:-1]) | (p[1:] != p[:-1])])
            low = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
            some = new | (doc > low) & np.concatenate([[True], doc[1:] != doc[:-1]])
            yield pa.RecordBatch.from_arrays([pa.array(p[some]), pa.array(w[some]), pa.array(place[some]), pa.array(doc[some]), pa.array(low[some], mask=new[some])], names=["p", "w", "place", "doc_id", "low"])


def windows(texts: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """p, w, place, doc_id, low: the windows of the wanted passages (doc_id, list b) of documents; low if a smaller id is known."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, unpack, held = WordHashes(), zstandard.ZstdDecompressor(), Held()
        for batch in batches:
            for i, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                hashes = known.of(unpack.decompress(batch.column("z")[i].as_py()).split())
                runs, spans = Runs(hashes, size), Spans(hashes)
                runs = runs.take(np.isin(spans.of(runs.first, runs.stop), batch.column("b")[i].values.to_numpy()))
                if len(runs.at):
                    start, of = runs.windows()
                    held.add(runs.phrases()[of], spans.of(start, start + size), placed(runs.at[of] - start, size), doc_id)
                    if held.n >= FLUSH:
                        yield from held.flush()
        yield from held.flush()

    return texts.join(wanted, "doc_id").select("doc_id", "z", "b").mapInArrow(run, "p long, w long, place int, doc_id long, low long")


def confirmed(df: DataFrame, size: int, id_column: str, text_column: str, shard: Callable[[Column], Column]) -> DataFrame:
    """shard, p, h, place, low: passages and windows (phrase, hash, place of the phrase and length) that recur, and the smallest
    document that holds them, for each shard with documents that may hold them beside a smaller one; no row twice."""
    lists = passages(df, size, id_column, text_column)  # the texts are read once, and rows are made from it as often as needed
    n = lists.agg(F.sum(F.size("p"))).first()[0] or 0
    every = lists.select("doc_id", F.explode(F.arrays_zip("p", "b", "place")).alias("x")).select("doc_id", "x.p", "x.b", "x.place")
    recurring = every.groupBy("p").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("p")
    every = every.join(cut(recurring, n), "p")  # written, so that both sides are shuffled and a hot phrase is split
    distinct = cut(every.groupBy("p", "b").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.max("place").alias("place")), n)
    holding = every.select("doc_id", "p", "b").join(distinct.where("low < high").select("p", "b", "place", "low"), ["p", "b"]).where("doc_id > low")
    whole = holding.select(shard(F.col("doc_id")), "p", F.col("b").alias("h"), "place", "low").distinct()
    several = cut(distinct.groupBy("p").count().where("count > 1").select("p"), n)
    wanted = distinct.join(several, "p", "left_semi").groupBy(F.col("low").alias("doc_id")).agg(F.collect_list("b").alias("b"))
    texts = zipped(df.where(F.col(id_column).isNotNull()), id_column, text_column)
    parts = windows(texts, wanted, size)
    # what is resolved already is spread by its document, so that a hot window gathers only what isn't
    parts = parts.withColumn("at", F.when(F.col("low").isNull(), F.col("w")).otherwise(F.col("w").bitwiseXOR(F.xxhash64("doc_id"))))
    least = F.min(F.when(F.col("low").isNull(), F.col("doc_id"))).over(Window.partitionBy("p", "at"))
    parts = parts.withColumn("low", F.coalesce("low", least)).where("doc_id > low").select(shard(F.col("doc_id")), "p", F.col("w").alias("h"), "place", "low")
    return whole.unionAll(parts)


class Shard:
    """The confirmed passages of a shard, their phrases compiled into an automaton."""

    def __init__(self, p: np.ndarray, h: np.ndarray, place: np.ndarray, low: np.ndarray) -> None:
        import ahocorasick

        self.phrases, number = np.unique(p, return_inverse=True)
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        data = self.phrases.astype("<i8").tobytes().decode("latin-1")
        for i in range(len(self.phrases)):
            self.machine.add_word(data[i * PHRASE : (i + 1) * PHRASE], i)
        if data:
            self.machine.make_automaton()
        # the spans around a hit that a phrase's passages take, each once, phrase by phrase
        spans = np.unique(number.astype(np.int64) << 40 | place)
        self.first = np.searchsorted(spans >> 40, np.arange(len(self.phrases) + 1))
        self.offset, self.length = spans >> 20 & 0xFFFFF, spans & 0xFFFFF
        key = self.key(p, h)
        order = np.lexsort((low, h, p, key))
        p, h, low, key = p[order], h[order], low[order], key[order]
        new = np.concatenate([[True], (p[1:] != p[:-1]) | (h[1:] != h[:-1])]) if len(p) else np.zeros(0, dtype=bool)
        self.p, self.h, self.low, self.keys = p[new], h[new], low[new], key[new]

    @staticmethod
    def key(p: np.ndarray, h: np.ndarray) -> np.ndarray:
        return mix(p.view(np.uint64)) ^ h.view(np.uint64)

    def hits(self, hashes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Where phrases start, and which ones."""
        found = self.machine.iter(letters(hashes).tobytes().decode("latin-1"))
        while some := list(itertools.islice(found, HITS)):
            ends, phrase = np.array(some, dtype=np.int64).T
            yield ends - PHRASE + 1, phrase

    def removed(self, hashes: np.ndarray, doc_id: int, size: int) -> np.ndarray | None:
        """Which words go; None if none does."""
        if not len(self.phrases) or len(hashes) < size:
            return None
        spans, edge = None, None
        for at, phrase in self.hits(hashes):
            n = self.first[phrase + 1] - self.first[phrase]
            which = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - self.first[phrase], n)
            start = np.repeat(at, n) - self.offset[which]
            stop, p = start + self.length[which], np.repeat(self.phrases[phrase], n)
            inside = (start >= 0) & (stop <= len(hashes))
            start, stop, p = start[inside], stop[inside], p[inside]
            if spans is None:
                spans, edge = Spans(hashes), np.zeros(len(hashes) + 1, dtype=np.int64)
            gone = self.smaller(p, spans.of(start, stop), doc_id)
            np.add.at(edge, start[gone], 1)
            np.add.at(edge, stop[gone], -1)
        if edge is None or not edge.any():
            return None
        return np.cumsum(edge)[:-1] > 0

    def smaller(self, p: np.ndarray, h: np.ndarray, doc_id: int) -> np.ndarray:
        """Whether a span is confirmed, and from a smaller document."""
        key = self.key(p, h)
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return (self.p[place] == p) & (self.h[place] == h) & (self.low[place] < doc_id)


def tasks(df: DataFrame, shards: int) -> int:
    """How many tasks take the shards: as many as the cluster runs in a few turns at most, whatever the number of shards."""
    session = df.sparkSession
    wide = max(session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))
    return min(-(-shards // TASK_SHARDS), TASKS_EACH * wide)


def deduplicate(df: DataFrame, *, size: int = 50, id_column: str = "doc_id", text_column: str = "text", with_text: bool = False) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept_text (kept words joined by one space)."""
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"][: 4 + with_text]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, unpack = WordHashes(), zstandard.ZstdDecompressor()
        now, held, machine = None, [], None
        for batch in blocks(batches, "z", 1 << 20):
            shards, data = batch.column("shard").to_numpy(), batch.column("z")
            is_text = np.asarray(data.is_valid())
            bounds = np.flatnonzero(np.concatenate([[True], (shards[1:] != shards[:-1]) | (is_text[1:] != is_text[:-1])])) if len(shards) else []
            out: list[tuple] = []
            for start, stop in zip(bounds, [*bounds[1:], len(shards)], strict=True):
                if shards[start] != now:
                    now, held, machine = shards[start], [], None
                part = batch.slice(start, stop - start)
                if not is_text[start]:
                    held.append([part.column(c).to_numpy() for c in FOUND])
                    continue
                if machine is None:
                    machine = Shard(*(np.concatenate([x[i] for x in held]) if held else np.zeros(0, dtype=np.int64) for i in range(len(FOUND))))
                    held = []
                for doc_id, z in zip(part.column("doc_id").to_pylist(), part.column("z").to_pylist(), strict=True):
                    words = unpack.decompress(z).split()
                    n = len(words)
                    gone = machine.removed(known.of(words), doc_id, size) if doc_id is not None else None
                    if gone is not None:
                        words = [words[i] for i in np.flatnonzero(~gone).tolist()]
                    kept = b" ".join(words)
                    out.append((doc_id, n, n - len(words), hashlib.sha256(kept).hexdigest(), *[kept.decode()] * with_text))
            if out:
                kinds = [*[pa.int64()] * 3, pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds)], names=names)

    n = -(-(df.agg(F.sum(F.octet_length(F.col(text_column).cast("string")))).first()[0] or 1) // SHARD_BYTES)

    def shard(key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias("shard")

    nothing = {"p": "long", "h": "long", "place": "int", "low": "long"}
    found = confirmed(df, size, id_column, text_column, shard).select("shard", F.lit(None).cast("long").alias("doc_id"), *FOUND, F.lit(None).cast("binary").alias("z"))
    texts = zipped(df, id_column, text_column)
    own = F.when(F.col("doc_id").isNull(), F.xxhash64("z")).otherwise(F.col("doc_id"))
    texts = texts.select(shard(own), "doc_id", *[F.lit(None).cast(nothing[c]).alias(c) for c in FOUND], "z")
    rows = found.unionAll(texts).repartition(tasks(df, n), "shard").sortWithinPartitions("shard", F.col("z").isNotNull())
    return rows.mapInArrow(run, schema)
