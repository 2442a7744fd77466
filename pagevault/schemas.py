"""Declared schemas and the constants that are stamped into records."""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMA_VERSION = 1
COLLECTOR_VERSION = "0.1.0"
USER_AGENT = "pagevault/0.1 (raw page collector)"

_s = T.StringType()

#: What to fetch. Versions are text: 3.1 and 3.10 are two versions.
TARGET = T.StructType([T.StructField(n, _s, False) for n in ("patch", "locale", "source_url")])

#: One fetched page with its HTTP facts. The hash is lower-case hex over the decoded body.
RAW_PAGE = T.StructType(
    [
        T.StructField("target", TARGET, False),
        T.StructField("fetched_at", T.TimestampType(), False),
        T.StructField("status_code", T.IntegerType(), False),
        T.StructField("content_type", _s, True),
        T.StructField("etag", _s, True),
        T.StructField("last_modified", _s, True),
        T.StructField("content", T.BinaryType(), False),
        T.StructField("sha256", _s, False),
    ]
)

#: The versioned description that is stored beside a page.
METADATA = T.StructType(
    [
        T.StructField("schema_version", T.IntegerType(), False),
        T.StructField("collector_version", _s, False),
        T.StructField("patch", _s, False),
        T.StructField("locale", _s, False),
        T.StructField("source_url", _s, False),
        T.StructField("fetched_at", _s, False),
        T.StructField("status_code", T.IntegerType(), False),
        T.StructField("content_type", _s, True),
        T.StructField("etag", _s, True),
        T.StructField("last_modified", _s, True),
        T.StructField("sha256", _s, False),
        T.StructField("size_bytes", T.LongType(), False),
    ]
)

HEALTH = T.StructType([T.StructField("status", _s, False)])
