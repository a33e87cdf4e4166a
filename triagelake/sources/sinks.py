"""Findings as JSON lines: analysis inputs are left out, nothing is collapsed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INPUTS = ("details", "references", "fix_commits")


def to_json(findings: DataFrame) -> DataFrame:
    kept = [c for c in findings.columns if c not in INPUTS]
    return findings.select(F.to_json(F.struct(*kept)).alias("value"))


def write_json(findings: DataFrame, path: str) -> None:
    to_json(findings).write.mode("overwrite").text(path)
