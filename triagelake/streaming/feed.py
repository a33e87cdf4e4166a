"""Advisory answers as a stream (an extension): the newest answer of each key inside a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def newest_answers(stream: DataFrame, keys: list[str], ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """State is one row a key; answers older than the watermark are dropped."""
    rest = [c for c in stream.columns if c not in keys]
    return stream.withWatermark(ts, late).groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(ts)).alias("r")).select(*keys, "r.*")
