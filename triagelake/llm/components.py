"""Connected components of a link table, all of it distributed.

Alternating large-star and small-star rounds turn the links into stars whose
centre is the smallest node of each component.  A round is two aggregations
with map-side minima and two equi-joins (which adaptive execution may split
where one centre holds many links); each round's links are written to the
shared folder.  Only a count and a checksum reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import spool


def _mark(links: DataFrame) -> tuple[int, int]:
    row = links.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def _large(links: DataFrame) -> DataFrame:
    both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    seen = links.join(least, "u")
    return (
        seen.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        .unionAll(least.select("u", F.col("m").alias("v")))
        .distinct()
    )


def components(links: DataFrame) -> DataFrame:
    """``links(u, v)`` of longs to ``(node, component)``; component: its smallest node.

    Nodes without a link to another are not returned.  Repeated links, loops
    and links in both directions count once; an empty table gives no row.
    """
    now = spool(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    mark = _mark(now)
    while mark[0]:
        now = spool(_small(_large(now)), "links")
        before, mark = mark, _mark(now)
        if mark == before:
            break
    pairs = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return pairs.unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
