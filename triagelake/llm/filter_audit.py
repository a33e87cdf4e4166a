"""Which filter removes what, for every order of the filters.

Each document has five bits, one for each filter that it fails; all orders of
the filters are then answered from the counts of the bit masks (at most 32
cells a part).  Orders are visited by adjacent transpositions, so each visit
recomputes the two steps that were swapped and nothing else; the Shapley sums
of removed rows accumulate along the walk.

Defined cases: a null text is empty; a null source is the part of the empty
string; a null doc_id is smaller than none and has no label; rows that repeat a
doc_id with the same text count each and none of them fails E by the others;
of several labels of a doc_id any 1 counts; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents, spool

FILTERS = "ABCDE"
MASKS = np.arange(1 << len(FILTERS))
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
REPORT = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)


def text_failures(text: Column) -> Column:
    """Bits of the filters that look at one text: A 1, B 2, C 4, D 8."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")

    def judged(w: Column) -> Column:
        n, distinct = F.size(w), F.size(F.array_distinct(w))
        capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
        fails = (n < 50, distinct * 100 < n * 65, capitals.cast("long") * 100 > F.length(text).cast("long") * 5, text.rlike("[#$%&*|]"))
        bits = [F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)]
        return bits[0] + bits[1] + bits[2] + bits[3]

    return F.get(F.transform(F.array(words), judged), F.lit(0))


def failure_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, n, good, toxic``: rows of each part by the set of filters that they fail.

    Texts travel as digests.  Copies are counted by part before they meet, so a
    text that a third of all rows hold is a row for each part and no more.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("key"), text_failures(text).cast("int").alias("mask"))
    rows = slim.groupBy("doc_id", "part", "key", "mask").agg(F.count(F.lit(1)).alias("n"))
    marks = labels.filter("doc_id is not null and (quality = 1 or toxic = 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("bad"))
    rows = rows.join(marks, "doc_id", "left").select("doc_id", "part", "key", "mask", "n", *((F.coalesce(c, F.lit(0)) * F.col("n")).alias(c) for c in ("good", "bad")))
    known = F.col("doc_id").isNotNull()
    sums = lambda when, tail: [F.sum(F.when(when, F.col(c)).otherwise(0)).alias(c + tail) for c in ("n", "good", "bad")]
    first = F.min(F.when(known, F.struct("doc_id", "n", "good", "bad"))).alias("first")
    copies = spool(rows.groupBy("key", "part", "mask").agg(*sums(F.lit(True), ""), *sums(~known, "_free"), first), "copies")
    least = copies.groupBy("key").agg(F.min("first.doc_id").alias("least"))
    met = copies.join(least, "key")
    leads = F.coalesce(F.col("first.doc_id") == F.col("least"), F.lit(False))
    lead = lambda c: F.col(c + "_free") + F.when(leads, F.col(f"first.{c}")).otherwise(0)
    split = F.array(
        F.struct(F.col("mask"), *(lead(c).alias(c) for c in ("n", "good", "bad"))),
        F.struct((F.col("mask") + 16).alias("mask"), *((F.col(c) - lead(c)).alias(c) for c in ("n", "good", "bad"))),
    )
    return met.select("part", F.inline(split)).groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("bad").alias("toxic"))


def plain_changes(n: int) -> Iterator[int]:
    """Places whose thing is swapped with the next one's, so that all orders of ``n`` things are visited once."""
    if n < 2:
        return
    inner, down = plain_changes(n - 1), True
    while True:
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        step = next(inner, None)
        if step is None:
            return
        yield step + down  # the last thing now stands before the others, or after them
        down = not down


def walk(n: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> Iterator[tuple[str, np.ndarray]]:
    """Every order with its counts, an array (COUNTS, steps, parts); the arguments are (parts, masks).

    The Shapley sums are whole only after the last order, so they come with it:
    all yielded arrays share them.
    """
    order = list(range(len(FILTERS)))
    out = np.zeros((len(COUNTS), len(order), len(n)), np.int64)
    shapley = np.zeros((len(order), len(n)), np.int64)
    total = n.sum(axis=1)

    def settle(step: int) -> None:
        mine, before = 1 << order[step], sum(1 << f for f in order[:step])
        here, late = (MASKS & mine > 0) & (MASKS & before == 0), (MASKS & mine > 0) & (MASKS & before > 0)
        removed = n[:, here].sum(axis=1)
        kept = (out[0, step - 1] if step else total) - removed
        out[:6, step] = kept, removed, n[:, late].sum(axis=1), n[:, mine], good[:, here].sum(axis=1), toxic[:, here].sum(axis=1)

    for step in range(len(order)):
        settle(step)
    changes = plain_changes(len(order))
    while True:
        for step, f in enumerate(order):
            shapley[f] += out[1, step]
        yield "".join(FILTERS[f] for f in order), out.copy()
        at = next(changes, None)
        if at is None:
            break
        order[at], order[at + 1] = order[at + 1], order[at]
        settle(at)
        settle(at + 1)
    yield "", shapley


def audit_report(cells: DataFrame) -> DataFrame:
    """``cells`` of ``failure_cells`` to one row for each part, order of the filters and step."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            table = np.zeros((3, len(pdf), len(MASKS)), np.int64)
            for i, rows in enumerate(pdf["cells"]):
                for r in rows:
                    table[:, i, r["mask"]] = r["n"], r["good"], r["toxic"]
            *orders, (_, shapley) = walk(*table)
            for name, counts in orders:
                counts[6] = shapley[[FILTERS.index(f) for f in name]]
                for step in range(len(name)):
                    yield pd.DataFrame({"part": pdf["part"], "filter_order": name, "step": step + 1} | {c: counts[k, step] for k, c in enumerate(COUNTS)})

    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 32 entries at most
    return parts.mapInPandas(run, REPORT)


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return audit_report(failure_cells(docs, labels))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part FROM documents),
w AS (SELECT doc_id, part, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
f AS (SELECT doc_id, part, (CASE WHEN len(words) < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 2 ELSE 0 END)
  + (CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text) THEN 4 ELSE 0 END)
  + (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END) + (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END) AS mask FROM w),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, mask),
x AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(name, bit)),
o AS (SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM x a, x b, x c, x d, x e
  WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, step, bits[step] AS mine, list_sum(bits[1:step]) AS upto, list_sum(bits[1:step]) - bits[step] AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, step, mine, sum(CASE WHEN mask & CAST(upto AS BIGINT) = 0 THEN n ELSE 0 END) AS kept,
  sum(CASE WHEN mask & mine > 0 AND mask & CAST(before AS BIGINT) = 0 THEN n ELSE 0 END) AS removed, sum(CASE WHEN mask & mine > 0 AND mask & CAST(before AS BIGINT) > 0 THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN mask = mine THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN mask & mine > 0 AND mask & CAST(before AS BIGINT) = 0 THEN good ELSE 0 END) AS good_lost,
  sum(CASE WHEN mask & mine > 0 AND mask & CAST(before AS BIGINT) = 0 THEN toxic ELSE 0 END) AS toxic_lost FROM c, s GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, mine) AS BIGINT) AS shapley FROM r"""


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
