"""HTTP sources: a Python data source for a list of targets, and an operator for a relation of them.

Reading is a side effect: write the result once and read it back rather than running two actions on it.
"""

from __future__ import annotations

import gzip
import hashlib
import http.client
import json
import ssl
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from urllib.parse import quote, urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith

from pagevault.schemas import RAW_PAGE, USER_AGENT

MOST_REDIRECTS = 20
FAIL, KEEP = "fail", "keep"


class StatusError(Exception):
    """The final response is not a success."""


@dataclass(frozen=True)
class Limits:
    """Seconds for connecting and for each later wait, not for the whole; what to do with other statuses than 2xx."""

    connect: float = 5.0
    timeout: float = 10.0
    user_agent: str = USER_AGENT
    on_status: str = FAIL


@dataclass(frozen=True)
class Response:
    status: int
    headers: dict[str, str]  # lower-case names; repeated headers joined by `, `
    content: bytes


def _once(url: str, limits: Limits) -> Response:
    at = urlsplit(url)
    if at.scheme not in ("http", "https") or not at.hostname:
        raise ValueError(f"not an HTTP address: {url}")
    host = at.hostname.encode("idna").decode("ascii")
    if at.scheme == "https":
        link = http.client.HTTPSConnection(host, at.port, timeout=limits.connect, context=ssl.create_default_context())
    else:
        link = http.client.HTTPConnection(host, at.port, timeout=limits.connect)
    try:
        link.connect()
        link.sock.settimeout(limits.timeout)
        path = quote(at.path or "/", safe="/%:@!$&'()*+,;=~-._") + (f"?{quote(at.query, safe='/?%:@!$&()*+,;=~-._')}" if at.query else "")
        link.request("GET", path, headers={"User-Agent": limits.user_agent, "Accept": "*/*", "Accept-Encoding": "gzip, deflate"})
        answer = link.getresponse()
        headers: dict[str, str] = {}
        for name, value in answer.getheaders():
            name = name.lower()
            headers[name] = f"{headers[name]}, {value}" if name in headers else value
        return Response(answer.status, headers, _decoded(answer.read(), headers.get("content-encoding", "")))
    finally:
        link.close()


def _decoded(body: bytes, encodings: str) -> bytes:
    for encoding in reversed([e.strip().lower() for e in encodings.split(",")]):
        if not body:
            return body
        if encoding in ("gzip", "x-gzip"):
            body = gzip.decompress(body)
        elif encoding == "deflate":
            try:
                body = zlib.decompress(body)
            except zlib.error:
                body = zlib.decompress(body, -zlib.MAX_WBITS)
    return body


def get(url: str, limits: Limits = Limits()) -> Response:
    """One GET with redirects followed; the status is the last one's."""
    for _ in range(MOST_REDIRECTS + 1):
        answer = _once(url, limits)
        if answer.status not in (301, 302, 303, 307, 308) or "location" not in answer.headers:
            if limits.on_status == FAIL and not 200 <= answer.status <= 299:
                raise StatusError(f"status {answer.status} for {url}")
            return answer
        url = urljoin(url, answer.headers["location"])
    raise StatusError(f"more than {MOST_REDIRECTS} redirects, last to {url}")


def page(patch: str, locale: str, source_url: str, limits: Limits) -> tuple:
    """A row of RAW_PAGE; the clock is read once the body is there."""
    answer = get(source_url, limits)
    named = [answer.headers.get(n) for n in ("content-type", "etag", "last-modified")]
    return ((patch, locale, source_url), datetime.now(UTC), answer.status, *named, answer.content, hashlib.sha256(answer.content).hexdigest())


#: Columns of a target that filters can be pushed on, and the filters.
_PLACES = {("target", name): i for i, name in enumerate(("patch", "locale", "source_url"))}
_TESTS = {
    EqualTo: str.__eq__,
    In: lambda own, values: own in values,
    StringStartsWith: str.startswith,
    StringEndsWith: str.endswith,
    StringContains: str.__contains__,
}


@dataclass
class Share(InputPartition):
    """Targets that one task fetches, one after the other."""

    targets: list[tuple[str, str, str]]


class HttpPages(DataSource):
    """spark.read.format("http_pages"): one raw page for each target of a list; fetch_pages() takes a relation of any size.

    Options: targets (JSON list of {patch, locale, source_url}), timeout, connectTimeout, userAgent, onStatus (fail, keep),
    partitions (the most tasks; one target each by default), pushFilters (true: filters on the target decide what is fetched; Spark
    then needs spark.sql.python.filterPushdown.enabled).
    """

    @classmethod
    def name(cls) -> str:
        return "http_pages"

    def schema(self):  # noqa: ANN201
        return RAW_PAGE

    def reader(self, schema) -> HttpReader:  # noqa: ANN001
        options = dict(self.options)
        pushes = {k.lower(): v for k, v in options.items()}.get("pushfilters", "false").lower() == "true"
        return PushingReader(options) if pushes else HttpReader(options)


class HttpReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        by_name = {k.lower(): v for k, v in options.items()}
        self.targets = [(t["patch"], t["locale"], t["source_url"]) for t in json.loads(by_name.get("targets", "[]"))]
        self.limits = Limits(float(by_name.get("connecttimeout", 5)), float(by_name.get("timeout", 10)), by_name.get("useragent", USER_AGENT), by_name.get("onstatus", FAIL))
        self.most = int(by_name.get("partitions", len(self.targets) or 1))

    def partitions(self) -> list[Share]:
        n = max(1, min(self.most, len(self.targets)))
        return [Share(self.targets[i::n]) for i in range(n)]

    def read(self, partition: Share) -> Iterator[tuple]:
        for target in partition.targets:
            yield page(*target, self.limits)


class PushingReader(HttpReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Targets that a filter on patch, locale or source_url leaves out are never fetched; other filters are applied to what was.
        Each query takes its own load(): Spark keeps what a DataFrame's first query pushed."""
        for f in filters:
            place = _PLACES.get(getattr(f, "attribute", None))
            test = _TESTS.get(type(f))
            if place is None or test is None:
                yield f
            else:
                self.targets = [t for t in self.targets if test(t[place], f.value)]


def fetch_pages(targets: DataFrame, *, partitions: int | None = None, per_host: int = 1, limits: Limits = Limits()) -> DataFrame:
    """Raw pages of a relation of targets (patch, locale, source_url), fetched where its rows are.

    With partitions, targets are dealt by host, so one host is asked by at most per_host tasks at a time; a host with a large
    part of the targets needs more than one.
    """
    if partitions:
        lane = F.pmod(F.xxhash64("source_url"), F.lit(per_host))
        targets = targets.repartition(partitions, F.regexp_extract("source_url", "^[a-z]+://([^/?#]*)", 1), lane)
    rows = targets.select("patch", "locale", "source_url").mapInArrow(lambda batches: fetch_batches(batches, limits), FETCHED)
    return rows.select(F.struct("patch", "locale", "source_url").alias("target"), *[x.split()[0] for x in FETCHED.split(", ")[3:]])


FETCHED = "patch string, locale string, source_url string, fetched_at timestamp, status_code int, content_type string, etag string, last_modified string, content binary, sha256 string"


def fetch_batches(batches: Iterable[pa.RecordBatch], limits: Limits = Limits()) -> Iterator[pa.RecordBatch]:
    """Rows of patch, locale, source_url to rows of FETCHED, one page at a time."""
    kinds = [pa.string()] * 3 + [pa.timestamp("us", tz="UTC"), pa.int32(), *[pa.string()] * 3, pa.binary(), pa.string()]
    names = [x.split()[0] for x in FETCHED.split(", ")]
    for batch in batches:
        for target in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            whole = page(*target, limits)
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((*whole[0], *whole[1:]), kinds, strict=True)], names=names)
