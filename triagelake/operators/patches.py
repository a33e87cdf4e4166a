"""Fix diffs: reduction to the library's changed lines, under a character budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from triagelake.functions.names import fetchable, repo_module

#: Characters of a patch that is still one fix, and of reduced diffs that are kept.
PATCH_CHARS, DIFF_CHARS = 80_000, 12_000


def reduce_diffs(patches: DataFrame) -> DataFrame:
    """``patches(patch_id, patch)`` to ``patch_id, pos, line`` of what is kept, in order.

    A ``+++ b/`` line of a library module becomes a header naming the module;
    below it hunk, added, removed and two-space lines stay, others go, and so
    does everything below a path that is skipped.
    """
    lines = patches.select("patch_id", F.posexplode(F.split("patch", "\n")).alias("pos", "raw"))
    lines = lines.withColumn("module", F.when(F.startswith("raw", F.lit("+++ b/")), repo_module(F.trim(F.expr("substring(raw, 7)")))).when(F.startswith("raw", F.lit("+++ ")), ""))
    w = Window.partitionBy("patch_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("inside", F.last("module", ignorenulls=True).over(w))
    header = F.col("module").isNotNull()
    body = F.col("raw").rlike(r"^(@@|\+|-|  )") & ~F.col("raw").rlike(r"^(\+\+\+|---)")
    kept = lines.filter((F.coalesce("inside", F.lit("")) != "") & (header | body))
    return kept.select("patch_id", "pos", F.when(header, F.concat(F.lit("--- "), F.col("inside"), F.lit(" ---"))).otherwise(F.col("raw")).alias("line"), header.alias("is_header"))


def budgeted(lines: DataFrame, budget: int = DIFF_CHARS) -> DataFrame:
    """Lines while their running length (line ends included) fits; headers count but aren't checked."""
    w = Window.partitionBy("patch_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("used", F.sum(F.length("line") + 1).over(w))
    over = F.min(F.when(~F.col("is_header") & (F.col("used") > budget), F.col("pos"))).over(Window.partitionBy("patch_id"))
    return rows.withColumn("cut", over).filter("cut is null or pos < cut").select("patch_id", "pos", "line", "used")


def share_budget(diffs: DataFrame, budget: int = DIFF_CHARS) -> DataFrame:
    """``diffs(advisory_id, ord, diff)`` cut to one budget in order; each takes its full length off."""
    w = Window.partitionBy("advisory_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    rows = diffs.withColumn("left", F.lit(budget) - F.coalesce(F.sum(F.length("diff")).over(w), F.lit(0)))
    return rows.filter("left > 0").select("advisory_id", "ord", F.expr("substring(diff, 1, cast(left as int))").alias("diff"))


def patch_states(patches: DataFrame, limit: int = PATCH_CHARS) -> DataFrame:
    """``patches(patch_id, url, patch)`` to ``patch_id, state, diff``, as a cache keeps them.

    ``skipped``: no commit link, diff NULL.  ``failed``: no patch could be had,
    diff NULL, so it is asked again.  ``refused``: longer than the limit, diff
    empty.  ``reduced``: the kept lines, or empty where nothing was useful; an
    empty diff is an answer and isn't asked again.
    """
    state = F.when(~F.coalesce(fetchable(F.col("url")), F.lit(False)), "skipped").when(F.col("patch").isNull(), "failed").when(F.length("patch") > limit, "refused").otherwise("reduced")
    rows = patches.select("patch_id", "patch", state.alias("state"))
    lines = budgeted(reduce_diffs(rows.filter("state = 'reduced'")))
    texts = lines.groupBy("patch_id").agg(F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")).alias("text"))
    answered = F.col("state").isin("refused", "reduced")
    return rows.join(texts, "patch_id", "left").select("patch_id", "state", F.when(answered, F.coalesce("text", F.lit(""))).alias("diff"))
