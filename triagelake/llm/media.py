"""Media columns: lossless PNG bytes and cosine-transform hashes in binary columns.

``encode_gray`` writes 8-bit greyscale PNG by chunks (signature, IHDR, IDAT,
IEND, a CRC each); ``decode_gray`` walks the chunks, tests every checksum,
inflates the data and undoes all five scan-line filters with numpy.
``cosine_hash`` is the sign pattern of the 8 x 8 lowest frequencies of a
two-dimensional cosine transform against their median.

Defined cases: a null or empty text is one row of 64 zero bytes; texts of any
length are one image of 64 samples a row; equal texts give equal values.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._common import documents, id_text, small_batches

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 64
LEVEL = 1


class MediaError(ValueError):
    """The stored bytes are not the media they should be."""


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def filter_rows(image: np.ndarray, kind: int) -> np.ndarray:
    """Scan lines under one of the five filters, each with its filter byte."""
    x = image.astype(np.int16)
    left = np.zeros_like(x)
    left[:, 1:] = x[:, :-1]
    up = np.zeros_like(x)
    up[1:] = x[:-1]
    corner = np.zeros_like(x)
    corner[1:, 1:] = x[:-1, :-1]
    base = [0, left, up, (left + up) >> 1, None][kind] if kind < 4 else _paeth(left, up, corner)
    out = np.empty((image.shape[0], image.shape[1] + 1), np.uint8)
    out[:, 0] = kind
    out[:, 1:] = (x - base) & 255
    return out


def _paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    p = a + b - c
    pa_, pb, pc = abs(p - a), abs(p - b), abs(p - c)
    return np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, b, c))


def unfilter(lines: np.ndarray) -> np.ndarray:
    """Undo the filters of ``lines`` (rows of filter byte and samples).

    None, Sub and Up are sums along a row or down a run of rows, all at once.
    If a row has Average or Paeth, the image goes by its diagonals, whose
    samples need only those of the two diagonals before.
    """
    kinds, data = lines[:, 0], lines[:, 1:]
    if kinds.size and kinds.max() > 4:
        raise MediaError("unknown filter")
    if kinds.size and kinds.max() > 2:
        return _by_diagonals(kinds, data.astype(np.int16))
    out = data.copy()
    out[kinds == 1] = np.cumsum(data[kinds == 1], axis=1, dtype=np.uint8)
    up = kinds == 2
    if up.any():
        down = np.cumsum(out, axis=0, dtype=np.uint8)
        own = np.maximum.accumulate(np.where(up, -1, np.arange(len(kinds))))  # the last row above that isn't under Up
        top = np.where((own > 0)[:, None], down[np.maximum(own - 1, 0)], 0)
        out[up] = (down - top)[up]
    return out


def _by_diagonals(kinds: np.ndarray, data: np.ndarray) -> np.ndarray:
    h, w = data.shape
    out = np.zeros((h + 1, w + 1), np.int16)  # a row above and a column before the image
    for d in range(h + w - 1):
        y = np.arange(max(0, d - w + 1), min(h - 1, d) + 1)
        x = d - y
        a, b, c = out[y + 1, x], out[y, x + 1], out[y, x]
        base = np.choose(kinds[y], [np.zeros_like(a), a, b, (a + b) >> 1, _paeth(a, b, c)])
        out[y + 1, x + 1] = (data[y, x] + base) & 255
    return out[1:, 1:].astype(np.uint8)


SUMS = (0, 1, 2)  # filters that sums undo: None, Sub, Up


def chosen_lines(image: np.ndarray) -> np.ndarray:
    """Each scan line under that of the filters ``SUMS`` with the least sum of absolute differences (the first on ties)."""
    x = image.view(np.int8)
    sub, up = image.copy(), image.copy()
    sub[:, 1:] -= image[:, :-1]
    up[1:] -= image[:-1]
    made = np.stack([x, sub.view(np.int8), up.view(np.int8)])
    kinds = np.abs(made.astype(np.int16)).sum(axis=2, dtype=np.int64).argmin(axis=0)
    out = np.empty((image.shape[0], image.shape[1] + 1), np.uint8)
    out[:, 0] = kinds
    out[:, 1:] = made.view(np.uint8)[kinds, np.arange(len(kinds))]
    return out


def encode_gray(payload: bytes, width: int = WIDTH, filter_kind: int | None = None, level: int = LEVEL) -> bytes:
    """PNG of a payload whose length is a positive multiple of ``width``; without ``filter_kind`` each line has its own."""
    if not payload or len(payload) % width:
        raise MediaError("the payload is no whole number of rows")
    image = np.frombuffer(payload, np.uint8).reshape(-1, width)
    lines = chosen_lines(image) if filter_kind is None else filter_rows(image, filter_kind)
    head = struct.pack(">IIBBBBB", width, image.shape[0], 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines, level)) + _chunk(b"IEND", b"")


def decode_gray(media: bytes) -> np.ndarray:
    """The image of an 8-bit greyscale PNG, after all checksum tests."""
    if media[:8] != SIGNATURE:
        raise MediaError("no PNG signature")
    at, head, parts, ended = 8, None, [], False
    while at < len(media) and not ended:
        if at + 12 > len(media):
            raise MediaError("cut short")
        (n,) = struct.unpack_from(">I", media, at)
        kind, data = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if len(data) < n or at + 12 + n > len(media):
            raise MediaError("cut short")
        if struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(data, zlib.crc32(kind)):
            raise MediaError(f"checksum of {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", data)
        elif kind == b"IDAT":
            parts.append(data)
        elif kind == b"IEND":
            ended = True
        elif not kind[0] & 32:
            raise MediaError(f"unknown critical chunk {kind!r}")
        at += 12 + n
    if head is None or not ended:
        raise MediaError("no header or end")
    if head[2:] != (8, 0, 0, 0, 0):
        raise MediaError("not 8-bit greyscale")
    try:
        raw = zlib.decompress(b"".join(parts))
    except zlib.error as e:
        raise MediaError(str(e)) from e
    if len(raw) != head[1] * (head[0] + 1):
        raise MediaError("wrong number of samples")
    return unfilter(np.frombuffer(raw, np.uint8).reshape(head[1], head[0] + 1))


def _cosines(size: int, keep: int) -> np.ndarray:
    k, x = np.arange(keep)[:, None], np.arange(size)[None]
    return np.cos(np.pi * (2 * x + 1) * k / (2 * size))


SIDE, KEEP = 32, 8
COSINES = _cosines(SIDE, KEEP)


def _shrink(image: np.ndarray, side: int = SIDE) -> np.ndarray:
    """Area means on a grid of ``side`` rows; works for images of any height."""
    h = image.shape[0]
    total = np.zeros((h + 1, image.shape[1]))
    np.cumsum(image, axis=0, out=total[1:])
    at = np.arange(side + 1) * (h / side)
    low = np.minimum(at.astype(int), h - 1)
    area = total[low] + (at - low)[:, None] * image[low]
    return np.diff(area, axis=0) * (side / h)


def cosine_hash(image: np.ndarray) -> bytes:
    """8 bytes: which low-frequency coefficients lie above their median."""
    grid = _shrink(_shrink(image.astype(np.float64)).T).T
    low = (COSINES @ grid @ COSINES.T).ravel().round(6)
    low[0] = np.median(low[1:])
    return np.packbits(low > np.median(low[1:])).tobytes()


def payload_of(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % WIDTH if raw else WIDTH), len(raw)


MEDIA_SCHEMA = "doc_id long, n_bytes long, media binary"
FEATURE_SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long,"
    " media_bytes long, media_sha256 string, feature string, phash binary"
)


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the text's payload as a PNG in a binary column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [payload_of(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([n for _, n in made], pa.int64()), pa.array([encode_gray(p) for p, _ in made], pa.binary())],
                ["doc_id", "n_bytes", "media"],
            )

    small_batches(docs.sparkSession)
    return id_text(docs).mapInArrow(run, MEDIA_SCHEMA)


def read_back(media: DataFrame) -> DataFrame:
    """Decode stored media and compute digests and features from what was read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for stored in b.column(2).to_pylist():
                image = decode_gray(stored)
                payload = image.tobytes()
                mark = cosine_hash(image)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), mark.hex(), mark))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "phash"]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_bytes", *names])

    small_batches(media.sparkSession)
    return media.mapInArrow(run, FEATURE_SCHEMA)


def op1_png_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(store(documents(spark, sf_dir)))
