"""Keyed caches that many writers add to while others read: generations and their commits.

A write is a generation: a folder of rows under a name of its own, and then
one small commit file, which appears whole by a rename.  What a reader takes
is the generations whose commits it sees when it starts, the newest row of
each key, so it never meets half of a write, and no write can undo another's:
writers share no file.  ``compact`` writes the newest rows as one generation
whose commit names those that it replaces; readers leave replaced ones out, and
``vacuum`` deletes them once no reader of theirs is left.

``version`` is part of the folder and changes with the meaning of the rows:
another version neither sees nor harms this one's.  The rename must be atomic,
as on HDFS and local disks; in object stores the commit's single PUT is.

Defined cases: nothing written yet is an empty table; equal keys go to the
greatest ``ts``, and then to the greatest row, whichever writer came first; a
generation without a commit (a lost writer's) is never read.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Generations:
    """A cache table below ``folder``: rows of ``schema``, newest by ``ts`` for each of ``keys``."""

    def __init__(self, spark: SparkSession, folder: str, schema: str | StructType, keys: list[str], ts: str = "ts", version: int = 1) -> None:
        self.spark, self.keys, self.ts = spark, keys, ts
        self.base = f"{folder.rstrip('/')}/v{version}"
        self.schema = spark.createDataFrame([], schema).schema
        self.jvm = spark.sparkContext._jvm
        self.files = self._path(self.base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, text: str):  # noqa: ANN202
        return self.jvm.org.apache.hadoop.fs.Path(text)

    def _commits(self) -> dict[str, list[str]]:
        """Committed generations and what each replaces."""
        folder = self._path(f"{self.base}/commits")
        if not self.files.exists(folder):
            return {}
        names = [s.getPath().getName() for s in self.files.listStatus(folder)]
        out = {}
        for name in sorted(n for n in names if n.endswith(".json")):
            with_stream = self.files.open(self._path(f"{self.base}/commits/{name}"))
            text = self.jvm.org.apache.commons.io.IOUtils.toString(with_stream, "UTF-8")
            with_stream.close()
            out[name[: -len(".json")]] = json.loads(text)["replaces"]
        return out

    def _commit(self, name: str, replaces: list[str]) -> None:
        made, final = self._path(f"{self.base}/commits/.{name}.tmp"), self._path(f"{self.base}/commits/{name}.json")
        stream = self.files.create(made, False)
        stream.write(bytearray(json.dumps({"replaces": replaces}).encode()))
        stream.close()
        if not self.files.rename(made, final):
            raise OSError(f"commit of {name} could not be renamed")

    def live(self) -> list[str]:
        commits = self._commits()
        gone = {r for replaced in commits.values() for r in replaced}
        return sorted(set(commits) - gone)

    def write(self, rows: DataFrame) -> str:
        """Add rows (latest wins); returns the generation's name."""
        return self._written(rows, [])

    def _written(self, rows: DataFrame, replaces: list[str]) -> str:
        name = f"gen-{uuid.uuid4().hex}"
        rows.select(*(F.col(f.name).cast(f.dataType) for f in self.schema)).write.parquet(f"{self.base}/data/{name}")
        self._commit(name, replaces)
        return name

    def _newest(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).parquet(*(f"{self.base}/data/{n}" for n in names))
        rest = [f.name for f in self.schema if f.name not in self.keys]
        order = F.struct(self.ts, *(c for c in rest if c != self.ts))
        return rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*self.keys, "r.*").select(*self.schema.names)

    def read(self) -> DataFrame:
        """The newest row of each key, as of now."""
        return self._newest(self.live())

    def compact(self) -> str | None:
        """One generation in place of those that are live; writes meanwhile stay beside it."""
        names = self.live()
        return self._written(self._newest(names), names) if len(names) > 1 else None

    def vacuum(self) -> int:
        """Delete replaced generations; call it when no reader started before their replacement is left."""
        commits = self._commits()
        gone = sorted({r for replaced in commits.values() for r in replaced} & set(commits))
        for name in gone:
            self.files.delete(self._path(f"{self.base}/commits/{name}.json"), False)
            self.files.delete(self._path(f"{self.base}/data/{name}"), True)
        return len(gone)


def split(wanted: DataFrame, cached: DataFrame, keys: list[str], offline: bool = False) -> DataFrame:
    """``wanted`` with ``status``: cached, pending (to be asked), or failed (offline, so it can't be).

    The count of cached rows is the number of cache hits.
    """
    held = cached.select(*keys).distinct().withColumn("__held", F.lit(True))
    rest = F.lit("failed" if offline else "pending")
    return wanted.join(held, keys, "left").withColumn("status", F.when(F.col("__held"), "cached").otherwise(rest)).drop("__held")
