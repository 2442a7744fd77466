"""Personal data: exact base kinds, and identifiers found by bootstrapped contextual extraction.

Base spans (email, ip, card, phone) and, if wanted, strings that look like credentials seed the search; what has the form of a card or
ip and fails its check is known not to be one. Every seed, and every other string
that holds a digit or an @, is an instance (neighbouring groups of digits are one). Its lexical patterns are the two words
before it; the word before with the word after; and the word before with the signs between and the instance's shape, which
generalises most. On the graph of patterns and distinct instances, Spark alternates two scores: a pattern's is the smoothed mean of its
instances' scores, whatever kinds its seeds are of, an instance's is how surely at least one of its patterns tells an identifier (seeds
stay at 1, refuted ones at 0). Patterns that score high and hold several distinct seeds, or instances as sure, mark what stands beside them and is
no base span as `found`; unseen instances that score high are marked wherever they occur, unless they are shorter than DISTINCT.

Scale: texts are read in one narrow pass in slices bounded by bytes; the graph is aggregated with partial sums and holds each
pair once, so copies neither weigh nor crowd; joins shuffle both sides, so that Spark can split a hot pattern. Patterns are joined, not broadcast, except that redact() hands at most
PATTERNS_HELD of them, and of instances, to its workers and otherwise joins spans to texts.

Defined results: null text is empty and has no spans; very long texts are searched whole, in time that grows with their length;
base spans may overlap between kinds; found spans never overlap base spans; equal rows get equal spans; rows without id or with
a repeated one are judged by their own text; an empty table gives no rows; further columns are ignored or, in redact, kept.
"""

from __future__ import annotations

import bisect
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, cut, in_place, split_join, utf8

#: Kinds in the order of results; what patterns find comes last.
KINDS = ("email", "ip", "card", "phone")
FOUND = "found"
#: The kind of seeds that look like credentials; they are no base spans, and are marked only beside trusted patterns.
SECRET = "secret"
#: The kind of instances that have the form of a base kind and fail its check: known not to be one, they speak against their
#: patterns; a pattern that is trusted all the same marks them.
REFUTED = "refuted"
#: Characters from which on an instance is taken for the same identifier in any context.
DISTINCT = 5
#: Patterns and instances that redact() keeps in its workers' memory (16 bytes each or so); more are joined.
PATTERNS_HELD = 100_000
SEEN = "array<struct<pattern: long, instance: long, kind: string, start: int, stop: int>>"
SCANNED = f"doc_id long, th long, n_email long, n_ip long, n_card long, n_phone long, base string, seen {SEEN}"
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile("[0-9]")
# a run of digits that fails at its start fails at each later one, so matches start at runs
_IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_STRING = re.compile(r"[^\s\"'`<>=|{}\[\]]+")
_TOKEN = re.compile(r"\w+")
_CREDENTIAL = re.compile(r"[A-Za-z0-9+/_-]{32,}={0,2}")
_MIXED = re.compile(r"(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9+/_-]{16,}={0,2}")
_RUN = re.compile(r"[0-9]+|[^\W\d_]+|\s+")
# groups of one number: after at most three letters, or without small letters; between them blanks, also in brackets
_GROUP = re.compile(r"[A-Za-z]{0,3}[0-9][0-9/().-]*")
_GAP = re.compile(r"[()]?[ \t\u00a0]+[()]?")
_SIGNS = re.compile(r"\s+|\S+")
_EDGE = "\"'`.,;:!?()[]{}<>|*#$%&=~"


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            free = domain.end()
            found.append((start, free))
        at = text.find("@", domain.end() if domain else at + 1)
    return found


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    out["email"] = emails(text)
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in (m[0].partition(".")[0], *m.groups())):
                out["ip"].append(m.span())
        for m in _CARD.finditer(text):
            if 13 <= m.end() - m.start():
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out["card"].append(m.span())
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_DIGIT.findall(m[0])) <= 15:
                    out["phone"].append(m.span())
    return out


def _hash(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\x1f".join(parts).encode()) - (1 << 63)


def shape(instance: str) -> str:
    """Runs of digits by their number, runs of letters as one; a long string of both by its length."""
    if _MIXED.fullmatch(instance):
        return f"x{len(instance)}"
    return _RUN.sub(lambda m: f"{len(m[0])}d" if m[0][0] in "0123456789" else " " if m[0].isspace() else "a", instance)


class Context:
    """The words of a text, by place. What stands between a word and the spans behind it is read once, however many there are."""

    def __init__(self, text: str) -> None:
        self.text, self.starts, self.ends = text, array("q"), array("q")
        for m in _TOKEN.finditer(text):
            self.starts.append(m.start())
            self.ends.append(m.end())
        self.last, self.before, self.at, self.blank, self.gap = (-1, -1), "", 0, False, xxhash.xxh64()

    def between(self, i: int, end: int, start: int) -> None:
        """Makes gap the state of a hash over the word i, as far as end, and the signs from there to start, with runs of blanks as one."""
        if self.last != (i, end) or start < self.at:
            self.last, self.before, self.at, self.blank = (i, end), self.text[self.starts[i] : end].lower(), end, False
            self.gap = xxhash.xxh64(f"shaped\x1f{self.before}\x1f".encode())
        for m in _SIGNS.finditer(self.text, self.at, start):
            blank = m[0].isspace()
            if not (blank and self.blank):
                self.gap.update(b" " if blank else m[0].encode())
            self.blank = blank
        self.at = start

    def patterns(self, start: int, stop: int) -> list[int]:
        """Hashes of the lexical patterns around a span, of whole words; fewer when words are missing."""
        i, out = bisect.bisect_left(self.starts, start) - 1, []
        if i < 0:
            return out
        self.between(i, min(self.ends[i], start), start)
        if i:
            out.append(_hash("before", self.text[self.starts[i - 1] : self.ends[i - 1]].lower(), self.before))
        j = bisect.bisect_left(self.starts, stop)
        after = self.text[stop : self.ends[j - 1]] if self.ends[j - 1] > stop else self.text[self.starts[j] : self.ends[j]] if j < len(self.starts) else ""
        if after:
            out.append(_hash("around", self.before, after.lower()))
        shaped = self.gap.copy()
        shaped.update(f"\x1f{shape(self.text[start:stop])}".encode())
        out.append(shaped.intdigest() - (1 << 63))
        return out


def candidates(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Strings with a digit or an @ that overlap nothing taken (sorted spans); neighbouring groups of digits are one."""
    runs: list[tuple[int, int]] = []
    open_, at, reach = False, 0, 0  # whether the last run can go on; spans of taken that begin before, and how far they reach
    for m in _STRING.finditer(text):
        core = m[0].strip(_EDGE)
        start = m.start() + m[0].find(core)
        stop = start + len(core)
        while at < len(taken) and taken[at][0] < stop:
            reach = max(reach, taken[at][1])
            at += 1
        number = bool(_DIGIT.search(core))
        if not (number or "@" in core.strip("@")) or reach > start:
            open_ = False
            continue
        joins = number and (bool(_GROUP.fullmatch(core)) or core == core.upper())
        if open_ and joins and _GAP.fullmatch(text, runs[-1][1], start):
            runs[-1] = runs[-1][0], stop
        else:
            runs.append((start, stop))
        open_ = joins
    return runs


def refuted(instance: str) -> bool:
    """Whether it has the form of a card or an ip without being one (base spans are taken before)."""
    digits = _DIGIT.findall(instance)
    return bool(_CARD.fullmatch(instance) and 13 <= len(digits) <= 19 or _IP.fullmatch(instance))


def kind_of(instance: str, credentials: bool) -> str | None:
    if refuted(instance):
        return REFUTED
    if credentials and _CREDENTIAL.fullmatch(instance) and min(len(_DIGIT.findall(instance)), len(re.findall("[A-Za-z]", instance))) >= 6:
        return SECRET
    return None


def instances(text: str, base: dict[str, list[tuple[int, int]]], credentials: bool = True) -> list[tuple[int | None, int, str | None, int, int]]:
    """pattern, instance, kind (of seeds), start, stop; without words before it, an instance has the pattern None."""
    if "@" not in text and not _DIGIT.search(text):
        return []
    spans = [(s, e, k) for k in KINDS for s, e in base[k]]
    spans += [(s, e, kind_of(text[s:e], credentials)) for s, e in candidates(text, sorted((s, e) for s, e, _ in spans))]
    context = Context(text) if spans else None
    return [(p, _hash("instance", " ".join(text[s:e].lower().split())), k, s, e) for s, e, k in spans for p in context.patterns(s, e) or [None]]


def listed(base: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in KINDS for s, e in base[k])


def lists(rows: list[list[tuple]]) -> pa.Array:
    """A column of the type SEEN."""
    flat = list(zip(*[x for row in rows for x in row], strict=True)) or [()] * 5
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32())
    items = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(flat, kinds, strict=True)], names=["pattern", "instance", "kind", "start", "stop"])
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), items)


def scan(df: DataFrame, *, credentials: bool = True, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows of SCANNED; th is the text's hash. credentials: whether strings that look like these are seeds."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", 1 << 20):
            counts, base, seen = [], [], []
            for raw in batch.column("text").to_pylist():
                text = raw.decode("utf-8", "replace")
                spans = base_spans(text)
                counts.append([len(spans[k]) for k in KINDS])
                base.append(listed(spans))
                seen.append(instances(text, spans, credentials))
            columns = [batch.column("doc_id"), batch.column("th"), *(pa.array(c) for c in np.array(counts, dtype=np.int64).reshape(-1, 4).T), pa.array(base, pa.string()), lists(seen)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "th", *(f"n_{k}" for k in KINDS), "base", "seen"])

    text = utf8(text_column)
    return df.select(F.col(id_column).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text")).mapInArrow(run, SCANNED)


def accepted(scanned: DataFrame, *, rounds: int = 3, smoothing: float = 1.0, least_score: float = 0.7, least_seeds: int = 3) -> tuple[DataFrame, DataFrame]:
    """The patterns that are trusted after some rounds of scoring, and the unseen instances that are as sure."""
    seen = scanned.select(F.explode("seen").alias("s")).where("s.pattern is not null")
    kind = F.when(F.col("s.kind") == REFUTED, REFUTED).when(F.col("s.kind").isNotNull(), "seed").alias("kind")
    edges = seen.select("s.pattern", "s.instance", kind, (F.col("s.stop") - F.col("s.start") >= DISTINCT).alias("distinct"))
    edges = cut(edges.groupBy("pattern", "instance").agg(F.min("kind").alias("kind"), F.max("distinct").alias("distinct")))
    n = edges.count()
    size = edges.groupBy("pattern").agg(F.count("*").alias("size")).where(F.col("size") >= least_seeds)
    first = edges.where(F.col("kind") != REFUTED).groupBy("instance", "kind").agg(F.lit(1.0).alias("score"))
    unseen = edges.where("kind is null and distinct").select("pattern", "instance").join(first.select("instance"), "instance", "left_anti")

    def told(scores: DataFrame) -> DataFrame:
        sums = edges.select("pattern", "instance").join(scores, "instance").groupBy("pattern", "kind").agg(F.sum("score").alias("sum"), F.sum((F.col("score") >= least_score).cast("int")).alias("own"))
        return sums.where(F.col("own") >= least_seeds).join(size, "pattern").select("pattern", "kind", (F.col("sum") / (F.col("size") + smoothing)).alias("score"))

    scores = first
    for i in range(rounds):
        patterns = cut(told(scores), n) if i == rounds - 1 else told(scores)
        trusted = patterns.where(F.col("score") >= least_score / 2).select("pattern", "kind", F.least("score", F.lit(0.99)).alias("p"))
        new = cut(split_join(unseen, trusted, ["pattern"]).groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("p"))))).alias("score")), n)
        scores = first.unionAll(new)
    return patterns.where(F.col("score") >= least_score).select("pattern").distinct(), new.where(F.col("score") >= least_score).select("instance").distinct()


def markable(kind: str | None) -> bool:
    return kind is None or kind in (SECRET, REFUTED)


def found(scanned: DataFrame, trusted: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, th, spans: sorted distinct (start, stop) of instances beside trusted patterns, and of known unseen ones."""
    seen = scanned.select("doc_id", "th", F.explode("seen").alias("s")).where(F.col("s.kind").isNull() | F.col("s.kind").isin(SECRET, REFUTED))
    seen = seen.select("doc_id", "th", "s.pattern", "s.instance", "s.start", "s.stop")
    marked = split_join(seen, trusted, ["pattern"], "left_semi").unionByName(split_join(seen, known, ["instance"], "left_semi"))
    marked = marked.groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    return marked.select("doc_id", "th", F.array_sort("spans").alias("spans"))


def detect(df: DataFrame, *, credentials: bool = True, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone (of base spans), base_sha256, spans (kind:start:stop, comma-joined,
    base kinds first), n_found, n_spans (base and found)."""
    scanned = cut(scan(df, credentials=credentials, id_column=id_column, text_column=text_column))
    out = scanned.alias("a").join(found(scanned, *accepted(scanned)).alias("b"), F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.th") == F.col("b.th")), "left")
    extra = F.coalesce("b.spans", F.array().cast("array<struct<start:int,stop:int>>"))
    more = F.array_join(F.transform(extra, lambda s: F.concat_ws(":", F.lit(FOUND), s["start"].cast("string"), s["stop"].cast("string"))), ",")
    spans = F.concat_ws(",", *[F.when(x != "", x) for x in (F.col("a.base"), more)])
    n_found = F.size(extra).cast("long")
    n_spans = F.col("a.n_email") + F.col("a.n_ip") + F.col("a.n_card") + F.col("a.n_phone") + n_found
    return out.select("a.doc_id", *[f"a.n_{k}" for k in KINDS], F.sha2(F.col("a.base"), 256).alias("base_sha256"), spans.alias("spans"), n_found.alias("n_found"), n_spans.alias("n_spans"))


def without(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span, or each run of overlapping ones, replaced by its first kind in brackets."""
    parts, at = [], 0
    for start, stop, kind in sorted(spans):
        if start >= at:
            parts += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, stop)
    return "".join([*parts, text[at:]])


def redact(df: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """df with every span of its text replaced; other columns as they are. Null texts stay null."""
    scanned = scan(df, id_column=id_column, text_column=text_column)
    trusted, known = accepted(scanned)
    held: frozenset[int] = frozenset()
    instances_held: frozenset[int] = frozenset()
    at, rows, names = df.columns.index(text_column), df, list(df.columns)
    if trusted.count() + known.count() <= PATTERNS_HELD:
        held = frozenset(r.pattern for r in trusted.collect())
        instances_held = frozenset(r.instance for r in known.collect())
    else:  # spans come as the last column, by a name that is longer than any other
        row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
        keyed = df.select(row, F.col(id_column).cast("long").alias("id"), F.xxhash64(utf8(text_column)).alias("hash")).alias("a")
        extra = found(scanned, trusted, known).alias("b")
        joined = keyed.join(extra, F.col("a.id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.hash") == F.col("b.th")), "left")
        rows = joined.select(*[F.col("a.row").getField(c).alias(c) for c in names], F.col("b.spans").alias("s" * (1 + max(map(len, names)))))

    def clean(text: str, more: list[dict] | None) -> str:
        base = base_spans(text)
        spans = [(s, e, k) for k in KINDS for s, e in base[k]] + [(x["start"], x["stop"], FOUND) for x in more or []]
        if held or instances_held:
            spans += [(s, e, FOUND) for p, i, k, s, e in instances(text, base) if markable(k) and (p in held or i in instances_held)]
        return without(text, spans) if spans else text

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, at, 1 << 20):
            more = batch.column(len(names)).to_pylist() if batch.num_columns > len(names) else [None] * batch.num_rows
            texts = [t if t is None else clean(t, x) for t, x in zip(batch.column(at).to_pylist(), more, strict=True)]
            columns = list(batch.columns[: len(names)])
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[: len(names)])

    return in_place(rows, run, extra=len(rows.columns) - len(names))
