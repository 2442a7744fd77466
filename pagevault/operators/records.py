from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagevault.functions import digest, header, iso_utc, size_bytes
from pagevault.schemas import COLLECTOR_VERSION, SCHEMA_VERSION


def raw_pages(responses: DataFrame, *keep: str) -> DataFrame:
    """Raw page records, after any columns to keep, from rows of patch, locale, source_url, fetched_at, status_code,
    headers, content."""
    headers = F.col("headers")
    return responses.select(
        *keep,
        F.struct("patch", "locale", "source_url").alias("target"),
        "fetched_at",
        F.col("status_code").cast("int").alias("status_code"),
        header(headers, "content-type").alias("content_type"),
        header(headers, "etag").alias("etag"),
        header(headers, "last-modified").alias("last_modified"),
        "content",
        digest(F.col("content")).alias("sha256"),
    )


def metadata(raw: DataFrame, *keep: str) -> DataFrame:
    """The 12 metadata columns of raw page records, after any columns to keep; the body is replaced by its size."""
    return raw.select(
        *keep,
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        F.lit(COLLECTOR_VERSION).alias("collector_version"),
        "target.patch",
        "target.locale",
        "target.source_url",
        iso_utc(F.col("fetched_at")).alias("fetched_at"),
        "status_code",
        "content_type",
        "etag",
        "last_modified",
        "sha256",
        size_bytes(F.col("content")).alias("size_bytes"),
    )


def _success() -> Column:
    return F.coalesce(F.col("status_code").between(200, 299), F.lit(False))


def require_success(pages: DataFrame) -> DataFrame:
    """Fails the query if any row's status is not 2xx. The check is a filter, so that no projection prunes it."""
    message = F.concat(F.lit("status "), F.coalesce(F.col("status_code").cast("string"), F.lit("null")))
    return pages.where(F.when(_success(), F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))


def successful(pages: DataFrame) -> DataFrame:
    """The rows with status 2xx, for those who go on without the others."""
    return pages.where(_success())


def quarantined(pages: DataFrame) -> DataFrame:
    """The other rows."""
    return pages.where(~_success())


def last_write_wins(pages: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """For each key the row that comes last in order, as a sequence of saves to one place leaves it.

    One aggregate per key: rows are reduced before the shuffle, so a hot key costs no more than others. order must be
    total, or equal last rows are told apart by their other columns.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in pages.columns])
    best = pages.groupBy(*keys).agg(F.max_by(row, F.struct(*order)).alias("row"))
    return best.select("row.*")


def last_write_wins_wide(pages: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The same for rows with bodies, or with columns that max_by cannot hold; of equal last rows of a key one stays.

    Rows are read once and shuffled once: the limit on the rank is applied before the shuffle too, where a task keeps one row a key.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*[o.desc() for o in order]))
    return pages.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def integrity(pages: DataFrame) -> DataFrame:
    """pages (content, sha256, size_bytes) with hash_ok and size_ok, both recomputed from the bytes."""
    return pages.withColumns({"hash_ok": digest(F.col("content")) == F.col("sha256"), "size_ok": size_bytes(F.col("content")) == F.col("size_bytes")})


def report_lines(receipts: DataFrame, *keep: str) -> DataFrame:
    """Three lines for each receipt (html_path, metadata_path, sha256), after any columns to keep: n (0 to 2), line."""
    named = (("HTML saved", "html_path"), ("Metadata saved", "metadata_path"), ("SHA-256", "sha256"))
    lines = F.array(*[F.concat(F.lit(f"{label}: "), F.col(column)) for label, column in named])
    return receipts.select(*keep, F.posexplode(lines).alias("n", "line"))
