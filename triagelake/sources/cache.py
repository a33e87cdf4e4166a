"""Keyed caches as tables: the newest answer of each key, fresh or not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TTL_HOURS = 24


def newest(rows: DataFrame, keys: list[str], ts: str = "ts", tie: str | None = None) -> DataFrame:
    """The latest row of each key (one aggregation, no sort)."""
    rest = [c for c in rows.columns if c not in keys]
    order = F.struct(ts, tie) if tie else F.col(ts)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def fresh(rows: DataFrame, keys: list[str], now: Column, ts: str = "ts", tie: str | None = None, hours: int = TTL_HOURS) -> DataFrame:
    """Latest rows whose age is at most the time to live."""
    return newest(rows, keys, ts, tie).filter(F.col(ts) >= now - F.expr(f"INTERVAL {hours} HOURS"))


def pending(wanted: DataFrame, cached: DataFrame, keys: list[str]) -> DataFrame:
    return wanted.join(cached.select(*keys), keys, "left_anti")


def batches(rows: DataFrame, order: list[str], size: int = 100) -> DataFrame:
    """Numbers requests in batches, inside each project."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("project_id").orderBy(*order)) - 1
    return rows.withColumn("batch", F.floor(n / size).cast("int"))
