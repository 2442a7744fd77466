"""Reading the raw store back: <root>/<patch>/<locale>/page.html and metadata.json.

Tasks list the root's folders, each its share by a hash of the name, and read the files that lie in them: neither names nor sizes of files pass through
the driver, and a page's two files come in one row, without a join. root is as for writing: a folder that driver and executors share.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagevault.schemas import METADATA
from pagevault.sinks.store import META, PAGE, STAGING, local_path

FILES = "patch string, locale string, page binary, metadata binary"
#: Tasks for each core; bytes and pages that leave a task together.
TASKS, TOGETHER, PAGES = 4, 8 << 20, 1000


def names(place: str, share: int = 0, of: int = 1) -> Iterator[str]:
    """Folders in a folder: those of a share. Names stay bytes until they are found to be of the share, as each task goes through all."""
    with os.scandir(os.fsencode(place)) as found:
        for x in found:
            if (of == 1 or zlib.crc32(x.name) % of == share) and not x.name.startswith(STAGING.encode()) and x.is_dir():
                yield os.fsdecode(x.name)


def _content(place: str) -> bytes | None:
    try:
        with open(place, "rb") as f:
            return f.read()
    except (FileNotFoundError, IsADirectoryError):
        return None


def _files(spark: SparkSession, root: str, *wanted: str) -> DataFrame:
    """FILES, of the files with these names; folders that lack one of them are left out."""
    local, tasks = local_path(root), TASKS * spark.sparkContext.defaultParallelism
    columns = [x.split()[0] for x in FILES.split(", ")]

    def share(n: int) -> Iterator[tuple]:
        for patch in names(local, n, tasks):
            for locale in names(os.path.join(local, patch)):
                held = {name: _content(os.path.join(local, patch, locale, name)) for name in wanted}
                if None not in held.values():
                    yield patch, locale, held.get(PAGE), held.get(META)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.string(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=columns)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n in (n for x in batches for n in x.column("id").to_pylist()):
            rows, size = [], 0
            for row in share(n):
                rows.append(row)
                size += sum(len(x) for x in row[2:] if x)
                if size >= TOGETHER or len(rows) == PAGES:
                    yield batch(rows)
                    rows, size = [], 0
            if rows:
                yield batch(rows)

    return spark.range(0, tasks, 1, tasks).mapInArrow(run, FILES)


def _metadata(files: DataFrame, *keep: str) -> DataFrame:
    return files.select(F.from_json(F.decode("metadata", "UTF-8"), METADATA, {"mode": "FAILFAST"}).alias("m"), *keep).select("m.*", *keep)


def read_bodies(spark: SparkSession, root: str) -> DataFrame:
    """patch, locale, content."""
    return _files(spark, root, PAGE).select("patch", "locale", F.col("page").alias("content"))


def read_metadata(spark: SparkSession, root: str) -> DataFrame:
    """The 12 metadata columns, with the declared types; a file that is no such JSON fails the query."""
    return _metadata(_files(spark, root, META))


def read_metadata_files(spark: SparkSession, root: str) -> DataFrame:
    """patch, locale, content: the metadata files' bytes, whatever they hold."""
    return _files(spark, root, META).select("patch", "locale", F.col("metadata").alias("content"))


def read_store(spark: SparkSession, root: str) -> DataFrame:
    """Metadata with each page's bytes; patch and locale are those of the folder."""
    files = _files(spark, root, PAGE, META).withColumnsRenamed({"patch": "_patch", "locale": "_locale", "page": "content"})
    rows = _metadata(files, "_patch", "_locale", "content")
    return rows.where("patch = _patch and locale = _locale").drop("_patch", "_locale")
