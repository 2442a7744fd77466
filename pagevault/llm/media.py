"""Media columns: payloads stored as progressive JPEG coefficients, and JPEG columns decoded to RGB tensors.

A payload's bytes are the quantised coefficients of a 4:2:0 image, one byte each, less a constant; quantisation steps are 1
and nothing is transformed on the way in, so the stored form is lossless. Reading back accumulates all scans
(spectral selection and successive approximation) into coefficient arrays, from which come both the payload and, by an
inverse transform in numpy and upsampled chroma, the full-resolution RGB tensor.

Scale: one narrow pass in slices bounded by bytes; images of a slice are coded and decoded together. Nothing is shuffled.

Defined results: null and empty texts are one unit of blanks; very long texts are one large image; equal texts give equal
values; a column of media holding null gives null tensors, and files that are broken or no progressive JPEG give null tensors
and the reason in a column error; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jpeg
from .common import blocks, utf8

#: Payloads are filled up with blanks to a multiple of this.
UNIT = 192
#: What a byte's coefficient is less by: frequent letters become small values.
CENTRE = 101
SLICE = 1 << 20
STORED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int"


def filled(data: bytes) -> bytes:
    return data + b" " * (-len(data) % UNIT if data else UNIT)


def store(payloads: list[bytes], comments: list[bytes]) -> list[bytes]:
    """Progressive images whose coefficients are the payloads; their lengths are in the comments."""
    coefficients, shapes = [], []
    for data in payloads:
        units = -(-len(data) // 384)
        wide = int(np.ceil(np.sqrt(units)))
        shapes.append((wide, -(-units // wide)))
        rows = np.zeros(shapes[-1][0] * shapes[-1][1] * 384, dtype=np.int16)
        rows[: len(data)] = np.frombuffer(data, dtype=np.uint8)
        rows[: len(data)] -= CENTRE
        coefficients.append(rows.reshape(-1, 64))
    return jpeg.encode(coefficients, shapes, [b"payload=%d;%s" % (len(d), c) for d, c in zip(payloads, comments, strict=True)])


def payload(image: jpeg.Image, coefficients: np.ndarray) -> bytes:
    n = int(image.comment.partition(b";")[0].partition(b"=")[2])
    base = image.components[0].base
    return (coefficients[base : base - (-n // 64)].reshape(-1)[:n] + CENTRE).astype(np.uint8).tobytes()


def feature(tensor: np.ndarray) -> str:
    """Size, mean colours in hundredths, and a bit for each cell of an 8 by 8 grid that is lighter than the image."""
    high, wide, _ = tensor.shape
    total = tensor.sum(axis=(0, 1), dtype=np.int64) * 100 // (high * wide)
    light = tensor.sum(axis=2, dtype=np.int64)
    rows, cols = (np.arange(8) * high // 8, np.arange(8) * wide // 8)
    cell = np.add.reduceat(np.add.reduceat(light, rows, axis=0), cols, axis=1)
    area = np.diff(np.append(rows, high))[:, None] * np.diff(np.append(cols, wide))[None, :]
    bits = np.packbits((cell * (high * wide) > light.sum() * area).reshape(-1)).tobytes().hex()
    return f"{wide}x{high}:{total[0]},{total[1]},{total[2]}:{bits}"


def store_texts(df: DataFrame, *, with_media: bool = False, with_rgb: bool = False, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows of STORED for each whole text, all but n_bytes' source computed from the stored bytes; the stored form and the
    tensor (height x width x 3 bytes) if asked for."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", SLICE):
            texts = batch.column("text").to_pylist()
            media = store([filled(t) for t in texts], [b"bytes=%d" % len(t) for t in texts])
            images, coefficients = jpeg.decode(media)
            samples = jpeg.samples(coefficients)
            rows, tensors = [], []
            for stored, image in zip(media, images, strict=True):
                data, tensor = payload(image, coefficients), jpeg.rgb(image, coefficients, samples)
                n = int(image.comment.rpartition(b"=")[2])
                rows.append((n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(tensor), image.width, image.height))
                if with_rgb:
                    tensors.append(tensor.tobytes())
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32()]
            columns = [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))]
            names = [x.split()[0] for x in STORED.split(", ")]
            if with_media:
                columns, names = [*columns, pa.array(media, pa.binary())], [*names, "media"]
            if with_rgb:
                columns, names = [*columns, pa.array(tensors, pa.binary())], [*names, "rgb"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = STORED + ", media binary" * with_media + ", rgb binary" * with_rgb
    return df.select(F.col(id_column).cast("long").alias("doc_id"), utf8(text_column).alias("text")).mapInArrow(run, schema)


def decoded(files: list[bytes]) -> list[tuple[int | None, int | None, bytes | None, str | None]]:
    """width, height, rgb, error of each file; all together, or one by one if some cannot be decoded."""
    try:
        images, coefficients = jpeg.decode(files)
        return [(i.width, i.height, jpeg.rgb(i, coefficients).tobytes(), None) for i in images]
    except Exception as error:  # broken files fail in every way
        if len(files) == 1:
            return [(None, None, None, f"{type(error).__name__}: {error}")]
        return [x for f in files for x in decoded([f])]


def decode_column(df: DataFrame, *, id_column: str = "doc_id", media_column: str = "media") -> DataFrame:
    """doc_id, width, height, rgb (height x width x 3 bytes), error of a column of progressive JPEG files."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "media", SLICE):
            files = batch.column("media").to_pylist()
            found = iter(decoded([f for f in files if f is not None]))
            rows = [(None, None, None, None) if f is None else next(found) for f in files]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "width", "height", "rgb", "error"])

    rows = df.select(F.col(id_column).cast("long").alias("doc_id"), F.col(media_column).cast("binary").alias("media"))
    return rows.mapInArrow(run, "doc_id long, width int, height int, rgb binary, error string")
