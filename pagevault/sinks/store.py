"""The raw store: <root>/<patch>/<locale>/ with page.html (the fetched bytes) and metadata.json.

A first job stages pages: each task attempt writes to a folder of its own below the root, and a table in the shared folder
lists what successful attempts have staged. A second job moves the listed pages into place, each task its share, and its rows
are the receipts. So a failed first job changes nothing, a repeated attempt of either leaves one copy, pages are neither read nor
listed in the driver, and saving runs the plan above it once. A new page appears as a whole; of a page that is there already each
file is replaced by one rename, the body first, and the hash in the metadata tells which body it belongs to.

root must be a folder that driver and executors share. One file for each row is the stored form asked for, not one to query at
scale: see table.py.
"""

from __future__ import annotations

import contextlib
import json
import os
import re
import shutil
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagevault.operators.records import last_write_wins_wide, metadata
from pagevault.schemas import METADATA
from pagevault.shared import delete, own_folder

PAGE, META = "page.html", "metadata.json"
_NAME = re.compile(r"(?!\.{1,2}$)[\w.+ -]{1,128}")
STAGING = ".staging-"
STAGED = "patch string, locale string, place string, sha256 string"
RECEIPTS = "html_path string, metadata_path string, sha256 string"


def pretty(values: dict) -> bytes:
    """The metadata file's bytes: sorted keys, two blanks of indentation, non-ASCII as it is, a line feed at the end."""
    return (json.dumps(values, ensure_ascii=False, indent=2, sort_keys=True) + "\n").encode("utf-8")


def folder(root: str, patch: str, locale: str) -> str:
    """A page's folder; names that could leave the root are refused."""
    for name in (patch, locale):
        if not isinstance(name, str) or not _NAME.fullmatch(name):
            raise ValueError(f"not a name for a folder: {name!r}")
    return os.path.join(root, patch, locale)


def local_path(root: str) -> str:
    """A root as tasks open it: a path, or an address of the scheme file."""
    path = re.sub("^file:(?://(?=/))?", "", root).rstrip("/")
    if re.match("[A-Za-z][A-Za-z0-9+.-]*:", path):
        raise ValueError(f"not a folder that tasks can write files to: {root}")
    return path


def stage(rows: Iterable[dict], staging: str) -> Iterator[tuple[str, str, str, str]]:
    """Writes rows of METADATA and content to a new folder below staging; yields rows of STAGED."""
    place, made = os.path.join(staging, uuid.uuid4().hex), set()
    for row in rows:
        at = folder(place, row["patch"], row["locale"])
        for new in (os.path.dirname(at), at):
            if new not in made:
                os.mkdir(new) if made else os.makedirs(new)
                made.add(new)
        for name, data in ((PAGE, bytes(row["content"])), (META, pretty({n: row[n] for n in METADATA.names}))):
            with open(os.path.join(at, name), "wb") as f:
                f.write(data)
        yield row["patch"], row["locale"], place, row["sha256"]


def move(place: str, root: str, patch: str, locale: str) -> bool:
    """Puts a staged page into its place; does the rest if an earlier attempt did a part. A patch without folders yet gets all that the
    place holds of it by one rename, and nothing else is asked of the root: what goes into, out of or through a folder that many tasks
    use waits for the others. True if that was it, so that nothing is left to tidy."""
    source, to = folder(place, patch, locale), folder(root, patch, locale)
    with contextlib.suppress(OSError):  # there are folders of the patch, or an earlier attempt did it
        os.rename(os.path.dirname(source), os.path.dirname(to))
        return True
    for _ in range(2):  # again if another task's folder of the patch came meanwhile
        if os.path.isdir(source) and not os.path.isdir(to):
            os.makedirs(os.path.dirname(to), exist_ok=True)
            with contextlib.suppress(OSError):
                os.rename(source, to)
    for name in (PAGE, META):
        if os.path.exists(os.path.join(source, name)):
            os.replace(os.path.join(source, name), os.path.join(to, name))
        elif not os.path.exists(os.path.join(to, name)):
            raise FileNotFoundError(f"{name} of {patch}/{locale} is neither staged nor stored")
    return False


def tidy(place: str, patch: str, locale: str) -> None:
    """Removes what moving a page has left empty."""
    source = folder(place, patch, locale)
    for at in (source, os.path.dirname(source)):
        with contextlib.suppress(OSError):  # not empty yet, or gone
            os.rmdir(at)


def save_pages(raw: DataFrame, root: str) -> DataFrame:
    """Stores raw page records; of several for one target the last fetched stays. Returns receipts: html_path,
    metadata_path, sha256, one row for each target."""
    spark, local = raw.sparkSession, local_path(root)
    staging = os.path.join(local, STAGING + uuid.uuid4().hex)
    order = [F.col("fetched_at"), F.col("status_code"), F.col("sha256")]
    last = last_write_wins_wide(raw.select("*", "target.patch", "target.locale"), ["patch", "locale"], order).drop("patch", "locale")
    names = [x.split()[0] for x in STAGED.split(", ")]

    def staged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(stage((batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)), staging))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.string())] * 4, names=names)

    def moved(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                if not move(r["place"], local, r["patch"], r["locale"]):
                    tidy(r["place"], r["patch"], r["locale"])
            paths = [[f"{root.rstrip('/')}/{r['patch']}/{r['locale']}/{name}" for r in rows] for name in (PAGE, META)]
            yield pa.RecordBatch.from_arrays([*(pa.array(p, pa.string()) for p in paths), batch.column("sha256")], names=["html_path", "metadata_path", "sha256"])

    listed = own_folder(spark, "receipts")
    try:
        metadata(last, "content").mapInArrow(staged, STAGED).write.parquet(f"{listed}/staged")
        spark.read.schema(STAGED).parquet(f"{listed}/staged").mapInArrow(moved, RECEIPTS).write.parquet(f"{listed}/stored")
        delete(spark, f"{listed}/staged")
    finally:
        shutil.rmtree(staging, ignore_errors=True)
    return spark.read.schema(RECEIPTS).parquet(f"{listed}/stored")
