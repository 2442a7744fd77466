"""Quality rules as a short-circuit cascade: cheap rules that reject much come first.

A rule compares one count of a text with a limit or with a share of another count. Counts are computed when a rule asks for
them and kept for the rules that follow. On a sample, the cost of each count (processor time) and each rule's verdict are
measured; rules are then ordered greedily by rejected texts per cost among the texts that the rules before leave, where a
count that an earlier rule computed costs nothing more. A text is judged up to its first failed rule. The order changes what
is computed, never the verdict: a text is kept if it breaks no rule.

Scale: judging is one narrow pass over whole texts, in slices bounded by bytes; long texts are cut into words and lines part by
part. The sample is drawn by a hash of the id, `sample_rows` rows expected; one row for each combination of broken rules
reaches the driver.

Defined results: null text is the empty text, and all its counts are 0; very long texts are counted whole; equal texts get equal
rows; repeated rows and null ids are judged like others; an empty table gives no rows; further columns are ignored. Repeated
windows of words are found by 64-bit hashes.
"""

from __future__ import annotations

import time
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, blocks, grams, in_place, utf8

WINDOW = 8
#: Bytes of a text that are cut into words or lines at once.
PART = 1 << 20
BLANKS = b" \t\n\v\f\r"
SYMBOLS = b"#*$%&|<>"
_CONTINUED = bytes(range(0x80, 0xC0))
_CAPITALS = bytes(range(65, 91))
_NO_LETTERS = bytes(c for c in range(256) if not (65 <= c <= 90 or 97 <= c <= 122))
_IS_BLANK = np.isin(np.arange(256), list(BLANKS))


@dataclass(frozen=True)
class Rule:
    """Fails where the count `part` is above (or below) `limit` percent of the count `of`, or above (below) `limit` itself."""

    name: str
    part: str
    limit: int
    of: str | None = None
    below: bool = False

    def fails(self, counts: Counts) -> bool:
        value, bound = counts[self.part], self.limit
        if self.of is not None:
            value, bound = 100 * value, bound * counts[self.of]
        return value < bound if self.below else value > bound

    def sql(self) -> str:
        left, right = (f"100 * {self.part}", f"{self.limit} * {self.of}") if self.of is not None else (self.part, str(self.limit))
        return f"{left} {'<' if self.below else '>'} {right}"


#: The first two are the base; of the others, the limits leave wide room around prose in any language.
BASE = (Rule("few words", "n_words", 20, below=True), Rule("repeated windows", "n_repeat_words", 30, "n_words"))
RULES = (
    *BASE,
    Rule("symbols", "n_symbols", 25, "n_words"),
    Rule("short words", "word_chars", 200, "n_words", below=True),
    Rule("long words", "word_chars", 2500, "n_words"),
    Rule("capitals", "n_capitals", 60, "n_letters"),
    Rule("duplicate lines", "n_dup_lines", 40, "n_lines"),
    Rule("stuttering", "n_same_words", 20, "n_words"),
)


def parts(text: bytes, ends: bytes) -> Iterator[bytes]:
    """The text in parts of about PART bytes, cut behind one of the ending bytes."""
    at = 0
    while at < len(text):
        stop = len(text)
        if stop - at > PART:
            found = [i for e in ends if (i := text.find(bytes([e]), at + PART)) >= 0]
            stop = min(found) + 1 if found else stop
        yield text[at:stop]
        at = stop


class Counts(dict):
    """The counts of one text, each computed when it is first asked for; spent: nanoseconds that each took, without the others."""

    def __init__(self, text: bytes, known: WordHashes) -> None:
        self.text, self.known, self.spent, self._inner = text, known, {}, 0

    def __missing__(self, name: str):  # noqa: ANN204
        outer, self._inner, began = self._inner, 0, time.thread_time_ns()
        value = self[name] = getattr(self, f"_{name}")()
        took = time.thread_time_ns() - began
        self.spent[name] = took - self._inner
        self._inner = outer + took
        return value

    def _n_words(self) -> int:
        if len(self.text) <= PART:
            return len(self.text.split())
        blank = True
        n = 0
        for at in range(0, len(self.text), PART):
            inside = ~_IS_BLANK[np.frombuffer(self.text, np.uint8, min(PART, len(self.text) - at), at)]
            n += int(inside[0] and blank) + int((inside[1:] & ~inside[:-1]).sum())
            blank = not inside[-1]
        return n

    def _word_chars(self) -> int:
        return len(self.text.translate(None, BLANKS + _CONTINUED))

    def _n_symbols(self) -> int:
        return len(self.text) - len(self.text.translate(None, SYMBOLS))

    def _n_letters(self) -> int:
        return len(self.text.translate(None, _NO_LETTERS))

    def _n_capitals(self) -> int:
        return len(self.text) - len(self.text.translate(None, _CAPITALS))

    def _lines(self) -> tuple[int, int]:
        seen: set[bytes] = set()
        n = 0
        for part in parts(self.text, b"\n"):
            own = [x for x in part.split(b"\n") if x.strip(BLANKS)]
            n += len(own)
            seen.update(own)
        return n, n - len(seen)

    def _n_lines(self) -> int:
        return self["lines"][0]

    def _n_dup_lines(self) -> int:
        return self["lines"][1]

    def _hashes(self) -> np.ndarray:
        found = [self.known.of(part.split()) for part in parts(self.text, BLANKS)]
        return np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)

    def _n_same_words(self) -> int:
        return int((self["hashes"][1:] == self["hashes"][:-1]).sum())

    def _n_repeat_words(self) -> int:
        if len(self["hashes"]) < WINDOW:
            return 0
        window = grams(self["hashes"], WINDOW)
        order = np.argsort(window, kind="stable")
        same = window[order[1:]] == window[order[:-1]]
        edge = np.zeros(len(window) + WINDOW + 1, dtype=np.int64)
        repeated = np.zeros(len(window), dtype=bool)
        repeated[order[1:][same]] = repeated[order[:-1][same]] = True
        starts = np.flatnonzero(repeated)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + WINDOW, -1)
        return int((np.cumsum(edge) > 0).sum())


@dataclass(frozen=True)
class Plan:
    """The order of the rules, with what the sample told of each: the share of texts it rejects, of those that reach it, and the
    nanoseconds it costs for such a text."""

    rules: tuple[Rule, ...]
    rejects: tuple[float, ...] = ()
    costs: tuple[float, ...] = ()

    def broken(self, counts: Counts) -> Rule | None:
        return next((rule for rule in self.rules if rule.fails(counts)), None)


#: Nanoseconds of a rule's own comparison.
COMPARING = 300


def ordered(rules: tuple[Rule, ...], seen: list[tuple[int, int, dict[str, float]]]) -> Plan:
    """seen: a bit for each broken rule, the number of texts that break just these, and the time that their counts took."""
    needs = {rule: {c for c in (rule.part, rule.of) if c is not None} for rule in rules}
    inner = {"n_lines": {"lines"}, "n_dup_lines": {"lines"}, "n_same_words": {"hashes"}, "n_repeat_words": {"hashes"}}
    needs = {rule: own.union(*(inner.get(c, set()) for c in own)) for rule, own in needs.items()}
    left, done = list(enumerate(rules)), set()
    out, rejects, costs = [], [], []
    while left:
        texts = max(1, sum(n for _, n, _ in seen))

        def value(place: tuple[int, Rule]) -> tuple[float, float, float]:
            bit, rule = place
            rejected = sum(n for mask, n, _ in seen if mask >> bit & 1) / texts
            cost = COMPARING + sum(spent.get(c, 0) for _, _, spent in seen for c in needs[rule] - done) / texts
            return rejected / cost, rejected, cost

        best = max(left, key=lambda place: (*value(place)[:1], -value(place)[2], -place[0]))  # of useless ones the cheapest first
        _, rejected, cost = value(best)
        left.remove(best)
        out.append(best[1])
        rejects.append(rejected)
        costs.append(cost)
        done |= needs[best[1]]
        seen = [x for x in seen if not x[0] >> best[0] & 1]
    return Plan(tuple(out), tuple(rejects), tuple(costs))


def plan(df: DataFrame, rules: tuple[Rule, ...] = RULES, *, sample_rows: int = 2000, id_column: str = "doc_id", text_column: str = "text") -> Plan:
    """The cascade for df's texts, from about sample_rows of them."""
    share = min(1.0, sample_rows / max(1, df.count()))
    drawn = F.pmod(F.xxhash64(F.col(id_column), F.lit("cascade")), F.lit(1 << 20)) < share * (1 << 20)
    counts = sorted({c for rule in rules for c in (rule.part, rule.of) if c is not None} | {"lines", "hashes"})

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in blocks(batches, "text"):
            masks, spent = [], [[] for _ in counts]
            for text in batch.column("text").to_pylist():
                own = Counts(text, known)
                masks.append(sum(rule.fails(own) << i for i, rule in enumerate(rules)))
                for times, name in zip(spent, counts, strict=True):
                    times.append(own.spent.get(name, 0))
            yield pa.RecordBatch.from_arrays([pa.array(masks, pa.int64()), *(pa.array(t, pa.int64()) for t in spent)], names=["mask", *counts])

    rows = df.where(drawn).select(utf8(text_column).alias("text")).mapInArrow(run, "mask long, " + ", ".join(f"{c} long" for c in counts))
    found = rows.groupBy("mask").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in counts]).collect()
    return ordered(rules, [(r["mask"], r["n"], {c: float(r[c]) for c in counts}) for r in found])


REPORTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(df: DataFrame, cascade: Plan, *, with_counts: tuple[str, ...] = (), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of df: doc_id, kept; with_counts: counts to compute whatever the rules asked for, as further columns."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in blocks(batches, "text"):
            kept, found = [], [[] for _ in with_counts]
            for text in batch.column("text").to_pylist():
                counts = Counts(text, known)
                kept.append(cascade.broken(counts) is None)
                for column, name in zip(found, with_counts, strict=True):
                    column.append(counts[name])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(kept, pa.bool_()), *(pa.array(c, pa.int64()) for c in found)], names=["doc_id", "kept", *with_counts])

    rows = df.select(F.col(id_column).cast("long").alias("doc_id"), utf8(text_column).alias("text"))
    return rows.mapInArrow(run, "doc_id long, kept boolean" + "".join(f", {c} long" for c in with_counts))


def kept_rows(df: DataFrame, cascade: Plan, *, text_column: str = "text") -> DataFrame:
    """The rows of df whose text breaks no rule, as they are."""
    at = df.columns.index(text_column)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in blocks(batches, at):
            good = [cascade.broken(Counts((t or "").encode(), known)) is None for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(good, pa.bool_()))

    return in_place(df, run)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def oracle(rules: tuple[Rule, ...] = RULES) -> str:
    """DuckDB SQL for doc_id, the counts, base_failed and kept."""
    blank = r"[\x20\x09-\x0D]"

    def without(signs: str) -> str:
        return f"length(regexp_replace(t, '{signs}', '', 'g'))"

    following = ", ".join(f"lead(x, {i}) over o" for i in range(1, WINDOW))
    return rf"""with texts as materialized (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
split as materialized (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w, [x for x in string_split(t, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] as l from texts),
words as (select r, unnest(w) as x, generate_subscripts(w, 1) as i from split),
windows as materialized (select r, i, x = lag(x) over o as same, lead(x, {WINDOW - 1}) over o is not null as whole, concat_ws(' ', x, {following}) as k from words window o as (partition by r order by i)),
repeated as (select r, i from (select r, i, count(*) over (partition by r, k) as n from windows where whole) where n > 1),
covered as (select r, count(distinct i + j) as n from repeated, range(0, {WINDOW}) as t(j) group by r),
same as (select r, count(*) as n from windows where same group by r),
counted as (select doc_id, cast(len(w) as bigint) as n_words, {without(blank)} as word_chars, length(t) - {without("[#*$%&|<>]")} as n_symbols, {without("[^A-Za-z]")} as n_letters, {without("[^A-Z]")} as n_capitals,
  cast(len(l) as bigint) as n_lines, cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines, cast(coalesce(c.n, 0) as bigint) as n_repeat_words, coalesce(s.n, 0) as n_same_words from split left join covered as c using (r) left join same as s using (r))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {" or ".join(x.sql() for x in BASE)} as base_failed, not ({" or ".join(x.sql() for x in rules)}) as kept from counted"""
