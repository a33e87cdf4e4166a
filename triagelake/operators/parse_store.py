"""Parsed facts by content: equal source is parsed once, and only where something asks for it.

The key of a source is its SHA-256; facts are stored with names relative to
the module, so that a file that a thousand projects hold, at whatever place,
is one row.  New facts are written as a batch beside the earlier ones: nothing
is rewritten, a lost executor repeats its own part of a batch, and a store in
a lasting folder serves later runs too.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from . import pysource
from .graph import checkpointed, measured_joins, spread, table_path


def digest(source: Column) -> Column:
    """Key of a source; one that could not be read (NULL) has the empty key, and no facts."""
    return F.coalesce(F.sha2(source, 256), F.lit(""))


def listed(modules: DataFrame) -> DataFrame:
    """``project_id, fqn, is_package, digest`` of modules with sources; of rows with one name the least key counts."""
    rows = modules.groupBy("project_id", "fqn").agg(F.min(F.struct(digest(F.col("source")).alias("digest"), "is_package")).alias("m"))
    return rows.select("project_id", "fqn", "m.is_package", "m.digest")


def environments(listing: DataFrame) -> DataFrame:
    """``project_id, env``: projects with equal modules have equal keys (two 64-bit fingerprints that ignore order)."""
    one, two = F.bit_xor(F.xxhash64("fqn", "digest", "is_package")), F.bit_xor(F.xxhash64(F.lit(1), F.col("digest"), F.col("is_package"), F.col("fqn")))
    return listing.groupBy("project_id").agg(F.concat_ws("-", F.count(F.lit(1)).cast("string"), F.hex(one), F.hex(two)).alias("env"))


class ParseStore:
    """Facts of the sources in ``texts(digest, source)``, parsed on demand.

    ``folder`` keeps them for later runs; without it they lie in the shared
    folder of this one.  Writers that add the same source at once store equal
    rows, of which one is read.
    """

    def __init__(self, spark: SparkSession, texts: DataFrame, folder: str | None = None) -> None:
        self.texts = texts
        self.folder = folder or table_path(spark, "facts")
        self.schema = StructType([StructField("digest", StringType()), *spark.createDataFrame([], pysource.PARSED).schema.fields])
        spark.createDataFrame([], self.schema).coalesce(1).write.parquet(f"{self.folder}/batch-{uuid.uuid4().hex}")

    @classmethod
    def of(cls, *modules: DataFrame, folder: str | None = None) -> ParseStore:
        """A store over all sources of module tables; each distinct source is kept once."""
        rows = modules[0].select("source")
        for m in modules[1:]:
            rows = rows.unionAll(m.select("source"))
        texts = rows.filter("source is not null").groupBy(digest(F.col("source")).alias("digest")).agg(F.any_value("source").alias("source"))
        return cls(modules[0].sparkSession, checkpointed(texts), folder)

    def held(self) -> DataFrame:
        return self.texts.sparkSession.read.schema(self.schema).parquet(f"{self.folder}/batch-*")

    def _add(self, wanted: DataFrame) -> None:
        """Parse what ``wanted(digest)`` asks for and is not held."""
        new = self.texts.join(wanted, "digest", "left_semi").join(self.held().select("digest"), "digest", "left_anti")

        @F.arrow_udf(pysource.PARSED)
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for sources in batches:
                yield pysource.facts(sources, [""] * len(sources))

        with measured_joins(new.sparkSession):
            spread(new, "digest").select("digest", run("source").alias("p")).select("digest", "p.*").write.parquet(f"{self.folder}/batch-{uuid.uuid4().hex}")

    def parsed(self, modules: DataFrame) -> DataFrame:
        """``modules(…, fqn, digest)`` with the facts of their sources, names as of the module."""
        keys = modules.select("digest").distinct()
        self._add(keys)
        facts = self.held().join(keys, "digest", "left_semi").dropDuplicates(["digest"])
        full = lambda name: F.concat("fqn", name)
        rows = modules.join(facts, "digest", "left")
        named = {
            "parse_ok": F.coalesce("parse_ok", F.lit(False)),
            "definitions": F.transform("definitions", lambda d: F.struct(full(d["fqn"]).alias("fqn"), d["kind"].alias("kind"), d["line"].alias("line"))),
            "calls": F.transform("calls", lambda c: F.struct(full(c["caller"]).alias("caller"), c["name"].alias("name"), c["line"].alias("line"))),
            "dynamic": F.transform("dynamic", full),
            "bases": F.transform("bases", lambda b: F.struct(full(b["cls"]).alias("cls"), b["base"].alias("base"))),
        }
        return rows.withColumns(named).drop("digest")
