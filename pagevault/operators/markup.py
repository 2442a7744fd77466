"""Notes out of markup: sections, list items and changes, each with what stands around it.

A scanner takes a page's bytes in parts of any size and tells start tags, end tags and text as soon as they are whole; it keeps only
what is not. Comments, declarations, scripts and styles are passed over. An outline follows the tags: headings open sections by
their level, blocks (paragraphs, list items, cells, terms) gather text, and a block of the form `name: old → new` is a change. Elements that
are left open end where their parent does, or where one begins that cannot be within them (an item in its list, a paragraph).

Scale: one narrow pass, page by page; a page's rows leave as they are found, and memory is the open elements and the block at hand.

Defined results: a null or empty page has no rows; end tags of nothing open are ignored; markup that the page's end cuts off is
text if it begins no tag, and else left out; bytes that are no UTF-8 are replaced; character references are read and blanks made one as HTML
has it, or as the caller's function has it; blocks without text are no rows; repeated rows and null ids are pages of their own; further columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NOTES = "page_id long, n int, kind string, section string, path string, text string, name string, old string, new string"
#: Bytes that are scanned at once.
PART = 1 << 16
# elements by what they mean, fixed by the format
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_RAW = frozenset("script style".split())
_HEADINGS = {f"h{i}": i for i in range(1, 7)}
_BLOCKS = frozenset([*_HEADINGS, *"p li td th dt dd title caption figcaption blockquote pre summary".split()])
_BREAKING = _BLOCKS | frozenset("html head body div ul ol table tr thead tbody tfoot dl nav main header footer section article aside form details figure br hr".split())
#: What an element ends, up to the nearest of the elements that keep it apart.
_ENDS = {
    "li": (frozenset(["li"]), frozenset("ul ol".split())),
    "tr": (frozenset("tr td th".split()), frozenset(["table"])),
    "td": (frozenset("td th".split()), frozenset(["tr", "table"])),
    "th": (frozenset("td th".split()), frozenset(["tr", "table"])),
    "dt": (frozenset("dt dd".split()), frozenset(["dl"])),
    "dd": (frozenset("dt dd".split()), frozenset(["dl"])),
}
_TAG = re.compile(rb"<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>")
_ARROW = re.compile(r"([^:]{1,200}?)\s*:\s*(\S.{0,400}?)\s*(?:→|⇒|➜|->|=>)\s*(\S.{0,400})")
START, END, TEXT = "start", "end", "text"


class Scanner:
    """Bytes in parts to (kind, name or text)."""

    def __init__(self) -> None:
        self.rest, self.raw = b"", b""

    def feed(self, part: bytes, last: bool = False) -> Iterator[tuple[str, str]]:
        data, at = self.rest + part, 0
        while at < len(data):
            if self.raw:  # up to the end tag of a script or style
                end = data.lower().find(b"</" + self.raw, at)
                if end < 0:
                    at = len(data) if last else max(at, len(data) - len(self.raw) - 2)
                    break
                self.raw, at = b"", end
            if data[at] != 60:
                stop = data.find(b"<", at)
                if stop < 0:
                    stop = len(data)
                    if not last:  # the text goes on, and so may a character or an entity at its end
                        break
                yield TEXT, data[at:stop].decode("utf-8", "replace")
                at = stop
                continue
            if data.startswith((b"<!", b"<?"), at):
                comment = data.startswith(b"<!--", at)
                if not last and not comment and len(data) - at < 4:
                    break
                end = data.find(b"-->" if comment else b">", at + (4 if comment else 2))
                if end < 0:
                    at = len(data) if last else at
                    break
                at = end + (3 if comment else 1)
                continue
            tag = _TAG.match(data, at)
            if tag:
                name = tag[2].decode().lower()
                yield (END if tag[1] else START), name
                at = tag.end()
                if not tag[1] and name in _RAW:
                    self.raw = name.encode()
                continue
            after = data[at + 1 : at + 3]
            if not last and (len(after) < 2 or re.match(rb"/?[A-Za-z]", after)):
                break  # more of the tag is to come
            if re.match(rb"/?[A-Za-z]", after):
                at = len(data)  # a tag that the end cuts off
                break
            yield TEXT, "<"
            at += 1
        self.rest = data[at:]


def read_text(text: str) -> str:
    """All of HTML's character references, also those that lack their semicolon, and any blanks."""
    return " ".join(html.unescape(text).split())


def unescaped(text: str) -> str:
    """Only what escapes markup: `&lt;`, `&gt;` and `&amp;`; ASCII blanks, but for form feeds."""
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = text.replace(name, sign)
    return re.sub("[ \n\t\r]+", " ", text).strip(" ")


class Outline:
    """Tags and text to rows (kind, section, path, text, name, old, new)."""

    def __init__(self, read: Callable[[str], str] = read_text) -> None:
        self.read = read
        self.open: list[str] = []
        self.headings: dict[int, str] = {}
        self.words: list[str] = []

    def flush(self) -> Iterator[tuple]:
        text = self.read("".join(self.words))
        self.words = []
        if not text:
            return
        block = next((x for x in reversed(self.open) if x in _BLOCKS), "")
        level = _HEADINGS.get(block)
        if level:
            self.headings = {n: t for n, t in self.headings.items() if n < level} | {level: text}
        section = " > ".join(t for _, t in sorted(self.headings.items()))
        change = _ARROW.fullmatch(text) if not level else None
        kind = "section" if level else "change" if change else "item" if block in ("li", "dd", "td") else "text"
        yield kind, section, "/".join(self.open), text, *(change.groups() if change else (None, None, None))

    def take(self, kind: str, value: str) -> Iterator[tuple]:
        if kind == TEXT:
            self.words.append(value)
            return
        if value in _BREAKING:
            yield from self.flush()
        if kind == END:
            if value in self.open:
                del self.open[len(self.open) - 1 - self.open[::-1].index(value) :]
            return
        if value in _BREAKING and "p" in self.open and value != "br":
            del self.open[self.open.index("p") :]
        ends, apart = _ENDS.get(value, (frozenset(), frozenset()))
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i] in apart:
                break
            if self.open[i] in ends:
                del self.open[i:]
                break
        if value not in _VOID:
            self.open.append(value)

    def rows(self, tokens: Iterable[tuple[str, str]]) -> Iterator[tuple]:
        for token in tokens:
            yield from self.take(*token)
        yield from self.flush()


def scanned(data: bytes, part: int = PART) -> Iterator[tuple[str, str]]:
    scanner = Scanner()
    for at in range(0, len(data), part):
        yield from scanner.feed(data[at : at + part], at + part >= len(data))


def notes(pages: DataFrame, *, id_column: str = "page_id", html_column: str = "html", read: Callable[[str], str] = read_text) -> DataFrame:
    """Rows of NOTES, in the order n of the page: sections, items, changes (name, old, new) and other text, each with its section
    (the headings above it) and path (the open elements). read makes a block's text of what stands between its tags."""
    kinds = [pa.int64(), pa.int32(), *[pa.string()] * 7]
    names = [x.split()[0] for x in NOTES.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page_id, data in zip(batch.column("page_id").to_pylist(), batch.column("html").to_pylist(), strict=True):
                out: list[tuple] = []
                for n, row in enumerate(Outline(read).rows(scanned(data or b""))):
                    out.append((page_id, n, *row))
                    if len(out) == 2000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                        out.clear()
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    rows = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(html_column).cast("string").cast("binary").alias("html"))
    return rows.mapInArrow(run, NOTES)
