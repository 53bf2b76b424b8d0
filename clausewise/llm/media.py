"""Media columns: byte payloads stored as lossless WebP images and read back as pixel arrays.

``encode`` adds the stored form of a text to its rows, ``decode`` reads stored images of any kind into
pixel arrays, and ``read_back`` restores payloads from the stored bytes and describes them.  All three
are passes over Arrow batches without a shuffle; a batch is cut into blocks of about eight MB, whose streams are read in step.

Edge cases: a null text is empty; an empty text is 64 zero bytes; a text of any length is one image file (above
``webp.LARGEST``, 268 million bytes, the format ends, and several lie end to end), whose index of parts lets a long one be read in step too; a null or broken image has a null in place of its
pixels and the reason in ``error``; repeated rows are repeated in the result, equal texts have equal bytes and
values; no row, no result; columns other than the id and the text (or the media) are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewise.llm import webp

UNIT = 64
_BLOCK = 1 << 23


def payload(text: bytes) -> bytes:
    return text + b"\0" * (-len(text) % UNIT or (0 if text else UNIT))


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, payload_bytes, media (binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            texts = batch.column(1)
            while at < batch.num_rows:
                block, size, first = [], 0, at
                while at < batch.num_rows and size < _BLOCK:
                    raw = texts[at].as_buffer()
                    block.append(raw.to_pybytes() if raw is not None else b"")
                    size += len(block[-1])
                    at += 1
                whole = [payload(x) for x in block]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, at - first), pa.array([len(x) for x in block], pa.int64()),
                     pa.array([len(x) for x in whole], pa.int64()), pa.array(webp.encode_bytes(whole), pa.binary())],
                    names=[key, "n_bytes", "payload_bytes", "media"])

    return docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("binary").alias(text)).mapInArrow(
        run, f"{key} long, n_bytes long, payload_bytes long, media binary")


def describe(samples: bytes) -> str:
    """Statistics of the samples: mean, deviation, entropy in bits, and the share of each eighth of the range."""
    v = np.frombuffer(samples, np.uint8)
    n = np.bincount(v, minlength=256)
    p = n / v.size
    level = np.arange(256)
    mean = float(p @ level)
    dev = float(np.sqrt(max(0.0, p @ (level - mean) ** 2)))
    q = p[p > 0]
    eighths = n.reshape(8, 32).sum(axis=1) * 10_000 // v.size
    return f"mean={mean:.4f};dev={dev:.4f};bits={abs(float(-(q * np.log2(q)).sum())):.4f};hist={','.join(map(str, eighths.tolist()))}"


def read_back(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """Digests and features of the payloads that the stored bytes hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sha, tail, stored, feature = [], [], [], []
            files, sizes, held = [], [], 0
            for k, (n, raw) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3)), 1):
                files.append(raw.as_buffer().to_pybytes())
                sizes.append(n)
                held += n
                if held < _BLOCK and k < batch.num_rows:
                    continue
                for data, got in zip(files, webp.decode_bytes(files, sizes)):
                    sha.append(hashlib.sha256(got).hexdigest())
                    tail.append(zlib.crc32(got[-UNIT:]))
                    stored.append(hashlib.sha256(data).hexdigest())
                    feature.append(describe(got))
                files, sizes, held = [], [], 0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(sha, pa.string()), pa.array(tail, pa.int64()),
                 pa.array([len(x.as_buffer()) for x in batch.column(3)], pa.int64()), pa.array(stored, pa.string()), pa.array(feature, pa.string())],
                names=[key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.select(key, "n_bytes", "payload_bytes", "media").mapInArrow(
        run, f"{key} long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def decode(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """One row for each image of each stored form: key, frame, width, height, pixels (four bytes red, green, blue, alpha each), error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    if not data:
                        raise ValueError("no bytes")
                    for frame, image in enumerate(webp.decode(data)):
                        pixels = webp._split(image)[..., [2, 1, 0, 3]].tobytes()
                        rows.append((k, frame, image.shape[1], image.shape[0], pixels, None))
                except (ValueError, KeyError, IndexError, struct.error, zlib.error) as e:
                    rows.append((k, 0, None, None, None, str(e) or type(e).__name__))
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string())
            columns = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[key, "frame", "width", "height", "pixels", "error"])

    return media.select(F.col(key).cast("long").alias(key), column).mapInArrow(run, f"{key} long, frame int, width int, height int, pixels binary, error string")
