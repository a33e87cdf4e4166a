"""Whom to ask what about symbols: control of a model's questions from the log of its answers.

No model is called here.  ``control`` reads the questions of a scan, the
answers that a cache holds and the log of attempts so far, and says for every
question where it stands and what a client may do next:

cached       an earlier scan has the answer; nothing is asked
unavailable  no key, offline, or no import names to match an answer against
ask          not asked yet, and may be now
retry        failed once; may be asked again after ``wait`` seconds
answered     this scan's answer (``symbols``), to be kept for ever
failed       failed twice; not kept, so a later scan asks again
stopped      after a second refusal for quota nothing more is asked in this scan

Only the first refusal that ends a scan's questions matters to the others, so
the state that one question leaves for the next is a minimum over their order:
one aggregation a scan, no fold over its rows.

Defined cases: attempts of a question that should not have been asked (cached,
or after the end) are not read; a third attempt and later ones are not read;
equal attempts count once; empty tables give no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.functions.names import plausible_symbol, safe_key

#: The longest wait that is honoured, the refusal's code, where prose states the wait, and the version of the questions.
MOST_WAIT = 60.0
REFUSED = 429
PROSE_WAIT = r"retry in ([0-9.]+)s"
QUESTIONS = 5


def answer_key(advisory_id: Column, version: int = QUESTIONS) -> Column:
    """Key of a kept answer; another version of the questions has other keys."""
    return safe_key(F.concat(F.lit(f"v{version}_"), advisory_id))


def wait_seconds(header: Column, text: Column) -> Column:
    """Pause that a refusal asks for, at most ``MOST_WAIT``: the header's whole seconds, else what its prose says."""
    stated = F.regexp_extract(F.coalesce(text, F.lit("")), PROSE_WAIT, 1)
    asked = F.when(F.trim(header).rlike("^[0-9]+$"), F.trim(header).try_cast("double")).otherwise(F.coalesce(stated.try_cast("double"), F.lit(0.0)))
    return F.least(asked, F.lit(MOST_WAIT))


def control(questions: DataFrame, cached: DataFrame, log: DataFrame, settings: DataFrame) -> DataFrame:
    """``questions`` with ``state``, ``wait`` and ``symbols``.

    ``questions``: scan_id, ord, advisory_id, import_names; ``cached``: key (of
    ``answer_key``), symbols; ``log``: scan_id, advisory_id, attempt (1, 2),
    code, retry_after, text, symbols (NULL where the reply could not be read);
    ``settings``: scan_id, configured.
    """
    row = F.struct("code", "retry_after", "text", "symbols")
    tries = log.filter("attempt in (1, 2)").groupBy("scan_id", "advisory_id").agg(F.max(F.when(F.col("attempt") == 1, row)).alias("one"), F.max(F.when(F.col("attempt") == 2, row)).alias("two"))
    held = cached.select("key", F.col("symbols").alias("kept")).groupBy("key").agg(F.max("kept").alias("kept"))
    rows = questions.withColumn("key", answer_key(F.col("advisory_id"))).join(held, "key", "left").drop("key").join(settings.select("scan_id", "configured"), "scan_id", "left").join(tries, ["scan_id", "advisory_id"], "left")
    may = F.coalesce("configured", F.lit(False)) & F.coalesce(F.size("import_names") > 0, F.lit(False))
    good = lambda a: F.coalesce((F.col(a)["code"] == 200) & F.col(a)["symbols"].isNotNull(), F.lit(False))
    asked = F.col("kept").isNull() & may & F.col("one").isNotNull()
    last = asked & ~good("one") & F.coalesce(F.col("two")["code"] == REFUSED, F.lit(False))
    ends = rows.filter(last).groupBy("scan_id").agg(F.min("ord").alias("end"))
    rows = rows.join(ends, "scan_id", "left")
    found = F.when(good("one"), F.col("one")["symbols"]).when(good("two"), F.col("two")["symbols"])
    refused = F.col("one")["code"] == REFUSED
    state = (
        F.when(F.col("kept").isNotNull(), "cached").when(~may, "unavailable").when(F.col("ord") > F.col("end"), "stopped")
        .when(F.col("one").isNull(), "ask").when(found.isNotNull(), "answered").when(F.col("two").isNull(), "retry").otherwise("failed")
    )
    rows = rows.withColumn("state", state).withColumn("wait", F.when(F.col("state") == "retry", F.when(refused, wait_seconds(F.col("one")["retry_after"], F.col("one")["text"])).otherwise(0.0)))
    kept = F.array_distinct(F.filter(found, lambda s: F.coalesce(plausible_symbol(s, F.col("import_names")), F.lit(False))))
    symbols = F.when(F.col("state") == "cached", F.col("kept")).when(F.col("state") == "answered", kept)
    return rows.withColumn("symbols", symbols).drop("kept", "configured", "one", "two", "end")


def to_keep(controlled: DataFrame) -> DataFrame:
    """``key, symbols`` of this scan's answers; failures are never kept."""
    return controlled.filter("state = 'answered'").groupBy(answer_key(F.col("advisory_id")).alias("key")).agg(F.max("symbols").alias("symbols"))


def counters(controlled: DataFrame) -> DataFrame:
    """``scan_id, cache_hits, extractions_failed, quota_exhausted``."""
    state = F.col("state")
    return controlled.groupBy("scan_id").agg(F.count_if(state == "cached").alias("cache_hits"), F.count_if(state == "failed").alias("extractions_failed"), F.coalesce(F.bool_or(state == "stopped"), F.lit(False)).alias("quota_exhausted"))
