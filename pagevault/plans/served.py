"""A fetch of every page of the table `pages` over HTTP: each task serves its own rows on its own machine and fetches them.

Bodies are the pages' html. Some answers are redirects, some are compressed, some are no success and kept.
"""

from __future__ import annotations

import gzip
import threading
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagevault.operators import metadata
from pagevault.schemas import USER_AGENT
from pagevault.shared import own_folder
from pagevault.sources.http import FETCHED, KEEP, Limits, fetch_batches

CONTENT_TYPE, MODIFIED, MOVED = "text/html; charset=utf-8", "Sun, 02 Mar 2025 10:00:00 GMT", "/moved"


class Answers(BaseHTTPRequestHandler):
    """server.pages: the html by the last part of the path."""

    def do_GET(self) -> None:  # noqa: N802
        name = self.path.rpartition("/")[2]
        n, body = int(name), self.server.pages[name]
        if n % 5 == 0 and not self.path.startswith(MOVED):
            return self.answer(302, b"", {"Location": MOVED + self.path})
        headers = {"Content-Type": CONTENT_TYPE, "eTAG": f'"{n}"', "X-Agent": self.headers["User-Agent"]}
        if n % 2:
            headers["Last-Modified"] = MODIFIED
        if n % 3 == 0:
            body, headers["Content-Encoding"] = gzip.compress(body), "gzip"
        return self.answer(404 if n % 7 == 0 or self.headers["User-Agent"] != USER_AGENT else 200, body, headers)

    def answer(self, status: int, body: bytes, headers: dict[str, str]) -> None:
        self.send_response(status)
        for name, value in (headers | {"Content-Length": str(len(body))}).items():
            self.send_header(name, value)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args: object) -> None:
        pass


def served(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of patch, locale, path, html to rows of FETCHED; paths stand for the addresses."""
    server = ThreadingHTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    address = f"http://127.0.0.1:{server.server_port}"
    try:
        for batch in batches:
            paths = batch.column("path").to_pylist()
            server.pages = dict(zip((p.rpartition("/")[2] for p in paths), batch.column("html").to_pylist(), strict=True))
            targets = pa.RecordBatch.from_arrays([batch.column("patch"), batch.column("locale"), pa.array([address + p for p in paths])], names=["patch", "locale", "source_url"])
            for path, page in zip(paths, fetch_batches([targets], Limits(on_status=KEEP)), strict=True):
                yield page.set_column(2, "source_url", pa.array([path]))
    finally:
        server.shutdown()
        server.server_close()


def http_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pages import _pages, keys

    folder, began = own_folder(spark, "fetched"), datetime.now(UTC)
    pages = _pages(spark, sf_dir)
    path = F.concat_ws("/", F.lit(""), "locale", "patch", F.col("page_id").cast("string")).alias("path")
    wanted = pages.select(F.encode("html", "UTF-8").alias("html"), "page_id", *keys())
    wanted.select("patch", "locale", path, "html").mapInArrow(served, FETCHED).write.mode("overwrite").parquet(folder)  # once: reading is a side effect
    rows = spark.read.parquet(folder)
    rows = rows.select(F.struct("patch", "locale", "source_url").alias("target"), *rows.columns[3:])
    told = metadata(rows.withColumn("in_time", F.col("fetched_at").between(F.lit(began), F.current_timestamp())), "in_time")
    return told.drop("fetched_at", "schema_version", "collector_version")


def oracle(patch: str, locale: str) -> str:
    """patch, locale: SQL of a page's keys."""
    return f"""select {patch} as patch, {locale} as locale, '/' || {locale} || '/' || {patch} || '/' || page_id as source_url, cast(case when page_id % 7 = 0 then 404 else 200 end as integer) as status_code,
'{CONTENT_TYPE}' as content_type, '"' || page_id || '"' as etag, case when page_id % 2 = 1 then '{MODIFIED}' end as last_modified, sha256(html) as sha256, cast(strlen(html) as bigint) as size_bytes, true as in_time from pages"""
