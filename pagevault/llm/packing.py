"""Bounded-space online best-fit packing of token sequences.

Documents become token ids and one end id; only documents above the capacity are cut, into full pieces and a rest.
Pieces arrive one by one: each goes to the open bin that it fills most (best fit). A fixed number of bins is open;
their free space keys a bitset (one Python integer), so the best bin is the lowest set bit at or above the piece's
length. When one bin too many is open, the fullest closes first.

Tokenising is a narrow pass over the texts, whose Arrow slices are bounded by bytes. Only (id, piece, length) rows are
dealt out by a hash of the row, so no source or group of copies is hot, and each task packs its share with its own
bins: a task's unfinished bins are the only loss against one global packing. Nothing is broadcast or collected, and a
lost task is redone from the same sorted rows.

Defined results: null text counts as empty; an empty text is its end id alone; equal rows are packed as separate
documents, also when they share an id; ties are settled by id and piece; an empty table gives no rows; further columns
are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, utf8

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, sequence_id long, offset long"
#: Runs of letters or signs whose ids one worker keeps; beyond it, what the slice at hand lacks is forgotten.
RUNS_KEPT = 400_000
#: A string that is Latin letters, which neither NFC nor lower-casing treats by context, then perhaps ASCII signs but the
#: apostrophe.
PLAIN = "^(?P<letters>[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)(?P<signs>[!-&(-/:-@\\[-`{-~]*)$"
#: Runs that the tokenizer gets in one line, and bytes of a slice of texts.
TOGETHER, SLICE = 200, 4 << 20
#: How a vocabulary must treat texts for its strings to be tokenized one by one (fixed values of the file format).
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITS = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
_LOADED: dict[str, Ids] = {}


class Ids:
    """Token ids, as little-endian unsigned 32-bit bytes, of texts.

    A tokenizer that drops white space never joins what it separates, so a text's ids are those of its strings in order, and
    those of a plain string are the ids of its letters, lower-cased, and of its signs. Arrow splits the texts and finds the
    distinct strings and runs of a slice; unknown runs are tokenized many in a line, without the steps that leave them as they
    are, the end of each told by its last id. Any other tokenizer gets whole texts. Strings that name a special token become
    that token, as the tokenizer has it by default.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.runs = Tokenizer.from_file(path), Tokenizer.from_file(path)
        kind = json.loads(self.tokenizer.to_str())
        steps = (kind["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        self.by_string = kind["normalizer"] == NORMALIZER and steps[0] == SPLITS and [x["type"] for x in steps[1:]] == ["ByteLevel"] and kind["model"].get("end_of_word_suffix") == "</w>"
        self.runs.normalizer = None
        self.runs.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)  # ids that end a run
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}

    @classmethod
    def at(cls, path: str) -> Ids:
        """The same object for all tasks of a worker."""
        if path not in _LOADED:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
            _LOADED[path] = cls(path)
        return _LOADED[path]

    def encode(self, strings: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]

    def of(self, texts: pa.Array) -> list[bytes]:
        texts = texts.cast(pa.string())
        if not self.by_string:
            return self.encode(texts.to_pylist())
        if not len(texts):
            return []
        split = pc.ascii_split_whitespace(texts)
        strings = split.flatten().dictionary_encode()
        ids = self.of_strings(strings.dictionary).take(strings.indices)
        offsets = np.frombuffer(ids.buffers()[1], dtype=np.int32)[ids.offset : ids.offset + len(ids) + 1]
        ends = offsets[np.cumsum(pc.list_value_length(split).to_numpy())].tolist()
        data = ids.buffers()[2]
        return [data[a:b].to_pybytes() for a, b in zip([int(offsets[0]), *ends[:-1]], ends, strict=True)]

    def of_strings(self, strings: pa.Array) -> pa.Array:
        """The ids of distinct strings without white space."""
        parts = pc.extract_regex(strings, PLAIN)
        plain = parts.is_valid()
        letters = pc.utf8_lower(pc.struct_field(parts, "letters").filter(plain)).dictionary_encode()
        signs = pc.struct_field(parts, "signs").filter(plain).dictionary_encode()
        found = [self.of_runs(x.dictionary.to_pylist()).take(x.indices) for x in (letters, signs)]
        other = strings.filter(pc.invert(plain)).to_pylist()
        every = pa.concat_arrays([pc.binary_join_element_wise(*found, b""), pa.array(self.encode(other), pa.binary())])
        which = np.asarray(plain)
        place = np.empty(len(strings), dtype=np.int64)
        place[which], place[~which] = np.arange(which.sum()), np.arange(which.sum(), len(strings))
        return every.take(pa.array(place))

    def of_runs(self, runs: list[str]) -> pa.Array:
        """The ids of distinct runs of letters in lower case, or of signs."""
        new = [x for x in runs if x and x not in self.known]
        if len(self.known) + len(new) > RUNS_KEPT:
            self.known = {x: self.known[x] for x in runs if x in self.known}
        for at in range(0, len(new), 100 * TOGETHER):
            lines = [new[i : i + TOGETHER] for i in range(at, min(at + 100 * TOGETHER, len(new)), TOGETHER)]
            for line, e in zip(lines, self.runs.encode_batch_fast([" ".join(x) for x in lines], add_special_tokens=False), strict=True):
                ids = np.asarray(e.ids, dtype="<u4")
                data, stops = ids.tobytes(), (4 * np.flatnonzero(self.last[ids]) + 4).tolist()
                self.known.update(zip(line, [data[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)], strict=True))
        self.known[""] = b""
        return pa.array([self.known[x] for x in runs], pa.binary())


def pieces(batches: Iterable[pa.RecordBatch], path: str, capacity: int, end_id: int) -> Iterator[pa.RecordBatch]:
    """Arrow rows (doc_id, text as bytes) to rows of PIECES."""
    ids, end = Ids.at(path), np.asarray([end_id], dtype="<u4").tobytes()
    step = 4 * capacity
    for batch in blocks(batches, "text", SLICE):
        rows: list[tuple] = []
        for doc_id, data in zip(batch.column("doc_id").to_pylist(), ids.of(batch.column("text")), strict=True):
            data += end
            for n, at in enumerate(range(0, len(data), step)):
                part = data[at : at + step]
                rows.append((doc_id, n, at // 4, len(part) // 4, zlib.crc32(part)))
        columns = list(zip(*rows, strict=True))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), *[pa.int64()] * 3), strict=True)],
            names=["doc_id", "piece", "start", "length", "ids_crc32"],
        )


class OpenBins:
    """At most `most` open bins; free space keys the bitset, and each bit's bins wait in a list."""

    def __init__(self, capacity: int, most: int) -> None:
        self.capacity, self.most = capacity, most
        self.bits, self.by_free, self.open, self.made = 0, {}, 0, 0

    def put(self, length: int) -> tuple[int, int]:
        """The bin and the offset that a piece gets."""
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            number = self._take(free)
        else:
            free, number, self.made = self.capacity, self.made, self.made + 1
        left = free - length
        if left:
            if self.open == self.most:
                fullest = (self.bits & -self.bits).bit_length() - 1
                if fullest <= left:
                    self._take(fullest)
                    self._add(left, number)
            else:
                self._add(left, number)
        return number, self.capacity - free

    def _add(self, free: int, number: int) -> None:
        self.by_free.setdefault(free, []).append(number)
        self.bits |= 1 << free
        self.open += 1

    def _take(self, free: int) -> int:
        waiting = self.by_free[free]
        number = waiting.pop()
        self.open -= 1
        if not waiting:
            del self.by_free[free]
            self.bits ^= 1 << free
        return number


def place(batches: Iterable[pa.RecordBatch], capacity: int, open_bins: int) -> Iterator[pa.RecordBatch]:
    """Rows of PIECES to rows of PACKED; the task's number is the high part of its sequence ids."""
    from pyspark import TaskContext

    high = TaskContext.get().partitionId() << 40
    bins = OpenBins(capacity, open_bins)
    for batch in batches:
        placed = [bins.put(n) for n in batch.column("length").to_pylist()]
        where = np.asarray(placed, dtype=np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(where[:, 0] + high), pa.array(where[:, 1])], names=[*batch.schema.names, "sequence_id", "offset"])


def pack(df: DataFrame, path: str, *, capacity: int = 4096, end_id: int = 1, open_bins: int = 1024, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    path names a vocabulary file of the `tokenizers` library.
    """
    texts = df.select(F.col(id_column).cast("long").alias("doc_id"), utf8(text_column).alias("text"))
    cut_up = texts.mapInArrow(lambda batches: pieces(batches, path, capacity, end_id), PIECES)
    dealt = cut_up.repartition(F.xxhash64("doc_id", "piece", "ids_crc32")).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "piece", "ids_crc32")
    return dealt.mapInArrow(lambda batches: place(batches, capacity, open_bins), PACKED)
