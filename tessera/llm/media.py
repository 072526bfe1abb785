"""Media columns: payloads kept in progressive JPEG files, read back as bytes and as RGB tensors."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import jpeg
from tessera.llm.common import bounded_batches, table

UNIT = 576

DECODED = "width int, height int, rgb binary, error string"
READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def encode_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, media): each whole text's UTF-8, filled with 255 to a positive multiple of UNIT, as JPEG coefficients.

    Null text counts as empty; the unfilled length stands in the file's comment.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media = []
            for text in batch.column(1).to_pylist():
                raw = (text or "").encode("utf-8", "surrogatepass")
                media.append(jpeg.encode(raw + b"\xff" * (-len(raw) % UNIT if raw else UNIT), b"bytes=%d" % len(raw)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(media, pa.binary())], ["doc_id", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, media binary")


def decode_images(images: DataFrame, column: str = "media") -> DataFrame:
    """``images`` with width, height, rgb (row-major 8-bit samples) and error for each progressive JPEG in ``column``.

    What cannot be read gives nulls and a message; null gives nulls alone.
    Columns of ``images`` with one of these names are replaced.
    """
    names = [c for c in images.columns if c not in ("width", "height", "rgb", "error")]
    schema = T.StructType(images.select(*names).schema.fields + T.StructType.fromDDL(DECODED).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, h, out, err = [], [], [], []
            for data in batch.column(names.index(column)).to_pylist():
                try:
                    pixels = jpeg.rgb(jpeg.decode(data)) if data is not None else None
                    err.append(None)
                except (ValueError, IndexError, KeyError, StopIteration, TypeError) as e:
                    pixels = None
                    err.append(f"{type(e).__name__}: {e}")
                w.append(None if pixels is None else pixels.shape[1])
                h.append(None if pixels is None else pixels.shape[0])
                out.append(None if pixels is None else pixels.tobytes())
            columns = [*batch.columns, pa.array(w, pa.int32()), pa.array(h, pa.int32()), pa.array(out, pa.binary()), pa.array(err, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*names, "width", "height", "rgb", "error"])

    return images.select(*names).mapInArrow(run, schema)


def described(pixels: np.ndarray) -> str:
    """Mean and spread of each channel and of the image's quarters, from exact sums."""
    flat = pixels.reshape(-1, 3)
    n = len(flat)
    total = flat.sum(0, dtype=np.int64)
    square = np.einsum("ij,ij->j", flat, flat, dtype=np.int64)
    mean = total / n
    spread = np.sqrt(np.maximum(square / n - mean * mean, 0))
    h = pixels.shape[0] // 2
    halves = [pixels[:h].sum(dtype=np.int64) / max(1, 3 * h * pixels.shape[1]), pixels[h:].sum(dtype=np.int64) / (3 * (pixels.shape[0] - h) * pixels.shape[1])]
    return f"{pixels.shape[1]}x{pixels.shape[0]}:" + ",".join(f"{x:.3f}" for x in (*mean, *spread, *halves))


def read_back(media: DataFrame) -> DataFrame:
    """Digests of what the stored files hold, and features of their pixels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for data in batch.column(1).to_pylist():
                image = jpeg.decode(data)
                n = int(image.comment.removeprefix(b"bytes="))
                payload = jpeg.payload_of(image)[: max(UNIT, -(-n // UNIT) * UNIT)]
                rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), described(jpeg.rgb(image))))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.mapInArrow(run, READ)


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts of ``documents`` as progressive JPEG files, read back."""
    bounded_batches(spark)
    return read_back(encode_texts(table(spark, sf_dir, "documents")))
