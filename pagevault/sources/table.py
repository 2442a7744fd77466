"""A table of pages in the place of the network: the same records without a fetch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagevault.operators.records import last_write_wins_wide
from pagevault.schemas import TARGET

FAIL, KEEP = "fail", "keep"


def targets(spark: SparkSession, rows: list[tuple[str, str, str]]) -> DataFrame:
    """A relation of (patch, locale, source_url)."""
    return spark.createDataFrame(rows, TARGET)


def url_path(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("PATH"))


def through_table(wanted: DataFrame, pages: DataFrame, *, missing: str = FAIL) -> DataFrame:
    """Targets with the response that a table holds for their url: columns of RAW_PAGE's source rows, one for each target.

    pages: url, fetched_at, status_code, headers, content; of several rows for a url the last fetched answers. A target without
    a row fails the query, as an address that nobody serves would; with missing="keep" it has no status, which the
    status checks sort out, and no content.
    """
    order = [F.col("fetched_at"), F.col("status_code"), F.sha2("content", 256)]
    answers = last_write_wins_wide(pages.select(F.col("url").alias("source_url"), "fetched_at", "status_code", "headers", "content"), ["source_url"], order)
    rows = wanted.join(answers, "source_url", "left").select("patch", "locale", "source_url", "fetched_at", "status_code", "headers", "content")
    if missing == KEEP:
        return rows
    message = F.concat(F.lit("no answer for "), F.col("source_url"))
    return rows.where(F.when(F.col("status_code").isNotNull(), F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))
