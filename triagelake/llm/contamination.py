"""Benchmark decontamination by spaced seeds, in DataFrame operations only.

A mask names the tokens of a stretch that count; the others may differ.  For
every position of every text and every mask the chosen tokens are hashed, and
the hashes meet those of the test items by an equi-join.  Around each hit the
aligned tokens are compared, and an overlap counts where ``WINDOW`` tokens in
a row have at most ``WINDOW - NEED`` substitutions.  The two masks hit every
such window wherever its two substitutions stand, so nothing is missed.

A bit table of fixed size (``TABLE_BITS``), filled from the test items, drops
nearly all text positions before rows are made of them.  The seeds of the test
items are broadcast only if they are counted and are at most
``BROADCAST_SEEDS``; beyond that Spark joins by a shuffle on the hash.

Defined cases: a null text has no tokens; items under ``SHORTEST`` tokens are
no evidence and match nothing; items of ``SHORTEST`` to ``WINDOW - 1`` tokens
must occur whole; rows of one id are one result; empty tables give no row.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents, id_text

WINDOW, NEED = 13, 11
MASKS = ((0, 1, 2, 3, 5, 6), (0, 1, 2, 4, 7, 8))
SHORTEST = 7
TABLE_BITS = 20
BROADCAST_SEEDS = 200_000
AROUND = WINDOW - 1
SPACE = r"[\x20\x09-\x0D]+"


def tokens(text: str = "text") -> Column:
    """Hashes of the lower-cased words; an empty edge is a token that no item has."""
    words = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), SPACE)
    return F.transform(words, lambda w: F.xxhash64(w))


def _seeds(mask: int) -> Column:
    """Hash of the mask's tokens at each position of ``th``, none for short texts."""
    places = MASKS[mask]
    last = F.size("th") - F.lit(places[-1] + 1)
    made = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.lit(mask), *(F.get("th", i + p) for p in places)))
    return F.when(last >= 0, made).otherwise(F.array().cast("array<bigint>"))


def _around(i: Column) -> Column:
    """The tokens about position i, null beyond the edges."""
    return F.transform(F.sequence(F.lit(-AROUND), F.lit(AROUND + WINDOW - 5)), lambda o: F.get("th", i + o))


def _hit(seeds: str):
    return lambda i: F.struct(F.get(seeds, i).alias("seed"), _around(i).alias("ours"))


def _slot(seed: Column) -> Column:
    return F.shiftrightunsigned(seed, 6).bitwiseAND(F.lit((1 << (TABLE_BITS - 6)) - 1))


def item_seeds(items: DataFrame) -> DataFrame:
    """seed, item_id, the tokens around it, and how many of a window must be equal."""
    clean = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), rf"^{SPACE}|{SPACE}$", "")
    held = (
        items.select(F.col("item_id").cast("long").alias("item_id"), clean.alias("text"))
        .select("item_id", tokens().alias("th"))
        .filter(F.size("th") >= SHORTEST)
    )
    held = held.withColumn("need", F.when(F.size("th") >= WINDOW, F.lit(NEED)).otherwise(F.size("th")))
    parts = [held.select("item_id", "need", "th", F.posexplode(_seeds(m)).alias("at", "seed")) for m in range(len(MASKS))]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionAll(p)
    return both.select("seed", "item_id", "need", _around(F.col("at")).alias("theirs")).distinct()


def bit_table(seeds: DataFrame) -> np.ndarray:
    """One bit for each hash of a seed; its size never changes."""
    bit = F.expr("shiftleft(1L, cast(seed & 63 as int))")
    rows = seeds.groupBy(_slot(F.col("seed")).alias("slot")).agg(F.bit_or(bit).alias("bits")).collect()
    table = np.zeros(1 << (TABLE_BITS - 6), np.int64)
    for r in rows:
        table[r["slot"]] = r["bits"]
    return table


def hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, text_hash, item_id, n_matched of every verified overlap."""
    seeds = item_seeds(items)
    table = bit_table(seeds)
    if seeds.count() <= BROADCAST_SEEDS:
        seeds = F.broadcast(seeds)
    rows = id_text(docs).select("doc_id", F.xxhash64("text").alias("text_hash"), tokens().alias("th"), F.lit(table).alias("bits"))
    for m in range(len(MASKS)):
        rows = rows.withColumn(f"s{m}", _seeds(m))
    found = []
    for m in range(len(MASKS)):
        some = F.expr(f"filter(sequence(0, size(s{m}) - 1), i -> size(s{m}) > 0 and getbit(get(bits, cast(shiftrightunsigned(get(s{m}, i), 6) & {(1 << (TABLE_BITS - 6)) - 1} as int)), cast(get(s{m}, i) & 63 as int)) = 1)")
        found.append(F.transform(some, _hit(f"s{m}")))
    near = rows.select("doc_id", "text_hash", F.explode(F.concat(*found)).alias("x")).select("doc_id", "text_hash", "x.seed", "x.ours")
    same = F.zip_with("ours", "theirs", lambda a, b: F.when(a == b, 1).otherwise(0))
    most = F.array_max(F.transform(F.sequence(F.lit(1), F.lit(2 * AROUND - 3)), lambda s: F.aggregate(F.slice("same", s, F.lit(WINDOW)), F.lit(0), lambda n, x: n + x)))
    return (
        near.join(seeds, "seed")
        .withColumn("same", same)
        .withColumn("n_matched", most)
        .filter("n_matched >= need")
        .groupBy("doc_id", "text_hash", "item_id")
        .agg(F.max("n_matched").cast("long").alias("n_matched"))
    )


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id and the most equal tokens in a window, for each pair with an overlap."""
    return hits(docs, items).groupBy("doc_id", "item_id").agg(F.max("n_matched").alias("n_matched"))


def without_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, all columns as they are, that overlap no item."""
    found = hits(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), items)
    bad = found.select(F.col("doc_id").alias("__bad_id"), F.col("text_hash").alias("__bad_hash")).distinct()
    match = F.col(id_col).cast("long").eqNullSafe(F.col("__bad_id")) & (F.xxhash64(F.col(text_col).cast("string")) == F.col("__bad_hash"))
    return docs.join(bad, match, "left_anti")


def op4_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP4_SQL = rf"""
WITH d AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS p
           FROM (SELECT doc_id, regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+') AS w FROM documents)),
b0 AS (SELECT item_id, regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '[\x20\x09-\x0D]+') AS w FROM benchmark),
b AS (SELECT item_id, len(w) AS n, unnest(w) AS w, generate_subscripts(w, 1) AS p FROM b0 WHERE len(w) >= {SHORTEST}),
m AS (SELECT d.doc_id, b.item_id, d.p - b.p AS diag, b.p AS p, CASE WHEN b.n >= {WINDOW} THEN {NEED} ELSE b.n END AS need
      FROM d JOIN b ON d.w = b.w),
c AS (SELECT doc_id, item_id, need, count(*) OVER (PARTITION BY doc_id, item_id, diag ORDER BY p RANGE BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS k FROM m)
SELECT doc_id, item_id, CAST(max(k) AS BIGINT) AS n_matched FROM c WHERE k >= need GROUP BY doc_id, item_id
"""
