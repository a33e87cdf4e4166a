"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint has a bit set where over half of the text's shingle hashes have
it.  Two fingerprints that differ in at most ``radius`` bits share a variant
at most ``radius / 2`` bits from each.  So every distinct fingerprint emits its
variants within half the radius, rows meet by variant, and neighbours in a
variant's bucket are links.  A bucket holds at most as many distinct
fingerprints as the half ball (65 at radius 2), whatever the data, and all of
them lie within the radius of each other, so linking neighbours in order
loses no component and needs no pairs.

Defined cases: a null text is empty; no words give fingerprint zero, linked
like any other; fewer words than a shingle are one shingle; equal texts are
one fingerprint and so one node however many they are; a null id takes its
component from others of its fingerprint (null if it has none with an id).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import documents, id_text, small_batches, spool
from .components import components

SHINGLE = 3
RADIUS = 2
SEED = 42
#: Shingles whose bits are unpacked at once.
BLOCK = 1 << 14


def shingle_digests(text: bytes | None, size: int, seed: int = SEED) -> bytes:
    """8 bytes (big-endian XXH64) of each shingle of the lower-cased words, repeats included."""
    words = (text or b"").lower().split()
    if not words:
        return b""
    digest = xxhash.xxh64_digest
    if len(words) <= size:
        return digest(b" ".join(words), seed)
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda a, n: a + n + 1))
    starts = [0, *(e + 1 for e in ends)]
    return b"".join([digest(joined[a:b], seed) for a, b in zip(starts, ends[size - 1 :], strict=False)])


def fingerprint(text: bytes | None, size: int = SHINGLE) -> int:
    """The 64-bit fingerprint as a signed number."""
    raw = np.frombuffer(shingle_digests(text, size), np.uint8).reshape(-1, 8)
    if not len(raw):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(raw), BLOCK):
        ones += np.unpackbits(raw[at : at + BLOCK], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(raw)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id and fp (long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [fingerprint(t, size) for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.int64())], ["doc_id", "fp"])

    small_batches(docs.sparkSession)
    return id_text(docs).mapInArrow(run, "doc_id long, fp long")


def half_ball(radius: int, bits: int = 64) -> list[int]:
    """Masks of at most ``radius / 2`` bits, as signed numbers."""
    if radius < 0 or radius % 2:
        raise ValueError("the radius must be even: each side covers half of it")
    masks = [sum(1 << i for i in c) for k in range(radius // 2 + 1) for c in combinations(range(bits), k)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def ball_links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links ``(u, v)`` between nodes ``(node, fp)`` of distinct fingerprints, enough to connect all pairs within the radius."""
    masks = F.array(*[F.lit(m).cast("long") for m in half_ball(radius)])
    variants = nodes.select("node", "fp", F.explode(masks).alias("mask")).select("node", "fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
    order = Window.partitionBy("variant").orderBy("fp")
    met = variants.select("node", "fp", F.lag("node").over(order).alias("other"), F.lag("fp").over(order).alias("other_fp"))
    close = F.bit_count(F.col("fp").bitwiseXOR(F.col("other_fp"))) <= radius
    return met.filter(F.col("other").isNotNull() & close).select(F.col("node").alias("u"), F.col("other").alias("v"))


def near_duplicates(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable) of each row."""
    marked = spool(fingerprints(docs, size), "fp")
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("node"))
    found = components(ball_links(nodes.filter(F.col("node").isNotNull()), radius))
    classes = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return marked.join(classes, "fp", "left")


def op2_simhash_balls(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(documents(spark, sf_dir))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
