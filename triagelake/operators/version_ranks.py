"""Versions as places: each text is read once, and every later comparison is one of integers.

A dictionary gives every distinct version text its place in PEP 440 order, the
same for all packages; equal versions share a place.  Affected ranges become
intervals of places, candidates and releases rows, so that targets and
backports are searches over sorted integers instead of keys built again for
every row, range and release.

Text that is no version has no place (NULL).  An unreadable bound leaves its
interval open on that side, an unreadable start covers everything, as does
``functions.versions.is_affected``; an unreadable version counts as affected
where its scope has any range.  Empty tables give no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triagelake.functions import versions as V

from .graph import checkpointed

HIGHEST = (1 << 31) - 1


def dictionary(rows: DataFrame, part_rows: int = 500_000) -> DataFrame:
    """``v, place, major, canonical`` of every distinct version text in ``rows(v)``.

    Ranges of the order are ranked apart, and begin after the places of those
    before them: no task sorts more than about ``part_rows`` texts.
    """
    v = F.col("v")
    texts = rows.select("v").distinct().select("v", V.sort_key(v).alias("key"), V.release(v)[0].alias("major"), V.canonical(v).alias("canonical"))
    texts = checkpointed(texts).filter("key is not null")  # a filter before the write would be pushed below the distinct
    parts = 1 + texts.count() // part_rows
    dealt = texts.withColumn("part", F.lit(0))
    if parts > 1:  # equal keys lie in one range; the cut is written, so that a second run of a task can't move it
        dealt = checkpointed(texts.repartitionByRange(parts, "key").withColumn("part", F.spark_partition_id()))
    within = dealt.withColumn("within", F.dense_rank().over(Window.partitionBy("part").orderBy("key")))
    if parts == 1:
        return within.select("v", F.col("within").alias("place"), "major", "canonical")
    size = within.groupBy("part").agg(F.max("within").alias("n"))  # a row for each range
    before = size.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return within.join(before, "part").select("v", (F.col("before") + F.col("within")).cast("int").alias("place"), "major", "canonical")


def intervals(ranges: DataFrame, places: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, low, high`` (both inside) of ``ranges(keys, introduced, fixed, last_affected)``."""
    bounds = ["introduced", "fixed", "last_affected"]
    each = ranges.select(*keys, *(F.nullif(F.col(b), F.lit("")).alias(b) for b in bounds)).distinct()
    melted = each.select("*", F.explode(F.array(*(F.struct(F.lit(b).alias("side"), F.col(b).alias("v")) for b in bounds))).alias("b")).select(*keys, *bounds, "b.*")
    met = melted.join(places.select("v", "place"), "v", "left")
    at = lambda b: F.max(F.when(F.col("side") == b, F.col("place"))).alias(f"at_{b}")
    rows = met.groupBy(*keys, *bounds).agg(*map(at, bounds))
    open_start = F.col("introduced").isNotNull() & F.col("at_introduced").isNull()
    high = F.when(open_start, HIGHEST).when(F.col("fixed").isNotNull(), F.coalesce(F.col("at_fixed") - 1, F.lit(HIGHEST))).otherwise(F.coalesce("at_last_affected", F.lit(HIGHEST)))
    return rows.select(*keys, F.coalesce("at_introduced", F.lit(0)).alias("low"), high.cast("int").alias("high"))


def affected(points: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """``points(keys, place, …)`` with ``affected``: whether an interval of its scope covers the place.

    One sort of a scope: the furthest end of all intervals that start at or
    before a place tells whether one reaches it.  No pair of a point and an
    interval is made.
    """
    rest = [c for c in points.columns if c not in (*keys, "place")]
    row = F.struct(*rest) if rest else F.struct(F.lit(0).alias("__none"))
    both = points.select(*keys, F.col("place").alias("at"), F.lit(1).alias("side"), F.lit(None).cast("int").alias("high"), row.alias("row"))
    both = both.unionAll(spans.select(*keys, F.col("low").alias("at"), F.lit(0), F.col("high"), F.lit(None).cast(both.schema["row"].dataType)))
    scope = Window.partitionBy(*keys)
    furthest = F.max("high").over(scope.orderBy("at", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = both.withColumns({"__furthest": furthest, "__any": F.max("high").over(scope)}).filter("side = 1")
    covered = F.when(F.col("at").isNull(), F.col("__any").isNotNull()).otherwise(F.coalesce(F.col("__furthest") >= F.col("at"), F.lit(False)))
    return out.select(*keys, F.col("at").alias("place"), covered.alias("affected"), *(F.col(f"row.{c}").alias(c) for c in rest))


def targets(installed: DataFrame, candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Lowest candidate above the installed version, on its major if there is one: ``keys, target, target_place``.

    ``installed(keys, place, major)`` holds a row for each key, ``candidates(keys, v, place, major)`` any number.
    """
    own = installed.select(*keys, F.col("place").alias("__own"), F.col("major").alias("__major"))
    above = candidates.join(own, keys).filter("place > __own")
    best = above.groupBy(*keys).agg(F.min(F.struct((F.col("major") != F.col("__major")).alias("off"), "place", "v")).alias("b"))
    return best.select(*keys, F.col("b.v").alias("target"), F.col("b.place").alias("target_place"))


def backports(installed: DataFrame, fixed: DataFrame, ranges: DataFrame, released: DataFrame, keys: list[str], by: list[str] | None = None) -> DataFrame:
    """Lowest unaffected release above the installed one on its major, where no fix is listed there: ``keys, back, back_place``.

    ``installed(keys, place, major)``, ``fixed`` and ``released(keys, v, place,
    major)``, ``ranges(keys, low, high)`` as intervals; keys without a range
    have no backport.  Releases may hold for many keys: ``by`` names those that they have.
    """
    own = installed.select(*keys, F.col("place").alias("__own"), F.col("major").alias("__major")).filter("__own is not null")
    there = fixed.select(*keys, F.col("major").alias("__major")).distinct()
    asked = own.join(ranges.select(*keys).distinct(), keys, "left_semi").join(there, [*keys, "__major"], "left_anti")
    near = released.join(asked, by or keys).filter("major = __major and place > __own").select(*keys, "place", "v")
    free = affected(near, ranges.join(asked, keys, "left_semi"), keys).filter("not affected")
    best = free.groupBy(*keys).agg(F.min(F.struct("place", "v")).alias("b"))
    return best.select(*keys, F.col("b.v").alias("back"), F.col("b.place").alias("back_place"))


def readable(spec: Column) -> Column:
    return V.specifier(spec).isNotNull()


def judged(pairs: DataFrame) -> DataFrame:
    """``target, constraint`` with ``allowed`` and ``readable``, once for each distinct pair."""
    each = pairs.select("target", "constraint").distinct()
    return each.withColumn("readable", readable(F.col("constraint"))).withColumn("allowed", F.coalesce(V.satisfies(F.col("target"), F.col("constraint")), F.lit(False)))
