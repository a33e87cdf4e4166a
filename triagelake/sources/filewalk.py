"""Source trees as a Spark data source: folders are partitions, and skipped ones are never entered.

The walk is pruned where it happens.  The driver lists only the upper levels,
until there are enough folders to share out; each task walks and reads its
own.  A listing of all files first, filtered later, would list and read
environments and caches that outweigh the sources many times.

Paths are of any file system that pyarrow opens (local, hdfs://, s3://) and
must be readable by all executors.  Defined cases: a folder that isn't there
and an empty one give no row; a file that is no UTF-8, or vanished meanwhile,
has a NULL source; links to folders are followed by the file system's own rules.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Folders that hold no project source; so do all that start with a dot.
SKIP_DIRS = (".venv", "venv", "env", "site-packages", "build", "dist", "__pycache__", "node_modules")
SCHEMA = "root string, path string, source string"
BATCH_BYTES = 8 << 20


def entered(name: str) -> bool:
    return name not in SKIP_DIRS and not name.startswith(".")


class Folder(InputPartition):
    """A folder of a root; its subfolders too, unless they are partitions of their own."""

    def __init__(self, root: str, path: str, deep: bool) -> None:
        self.root, self.path, self.deep = root, path, deep


def _open(root: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(root) if "://" in root else (pafs.LocalFileSystem(), root)


def _listed(files: pafs.FileSystem, path: str) -> tuple[list[str], list[str]]:
    """Names of the Python files of a folder, and of the folders to enter."""
    found = files.get_file_info(pafs.FileSelector(path, recursive=False, allow_not_found=True))
    rank = sorted(found, key=lambda i: i.base_name)
    return [i.path for i in rank if i.base_name.endswith(".py") and i.type != pafs.FileType.Directory], [i.path for i in rank if i.type == pafs.FileType.Directory and entered(i.base_name)]


class TreeReader(DataSourceReader):
    def __init__(self, roots: list[str], parts: int) -> None:
        self.roots, self.parts = roots, parts

    def partitions(self) -> list[Folder]:
        todo = [Folder(r, _open(r)[1].rstrip("/"), True) for r in self.roots]
        done: list[Folder] = []
        while todo and len(todo) + len(done) < self.parts:
            level, todo = todo, []
            for f in level:
                below = _listed(_open(f.root)[0], f.path)[1]
                done.append(Folder(f.root, f.path, False))
                todo += [Folder(f.root, p, True) for p in below]
        return done + todo

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        files, top = _open(partition.root)
        top = top.rstrip("/")
        rows: list[tuple[str, str, str | None]] = []
        size, todo = 0, [partition.path]
        while todo:
            here, below = _listed(files, todo.pop())
            for path in here:
                try:
                    with files.open_input_stream(path) as f:
                        text = f.read().decode()
                except (OSError, UnicodeDecodeError):
                    text = None
                rows.append((partition.root, path[len(top) + 1 :], text))
                size += len(text or "") + 100
                if size > BATCH_BYTES:
                    yield _batch(rows)
                    rows, size = [], 0
            if partition.deep:
                todo += below
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple[str, str, str | None]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*rows, strict=True)], ["root", "path", "source"])


class SourceTree(DataSource):
    """``spark.read.format("sourcetree").option("roots", json list).option("parts", n).load()``"""

    @classmethod
    def name(cls) -> str:
        return "sourcetree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:  # noqa: ANN001
        return TreeReader(json.loads(self.options["roots"]), int(self.options.get("parts", "1")))


def read_trees(spark: SparkSession, roots: list[str], parts: int | None = None) -> DataFrame:
    """``root, path, source`` of all Python files below the roots that a project's own source may hold."""
    spark.dataSource.register(SourceTree)
    wanted = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return spark.read.format("sourcetree").option("roots", json.dumps(roots)).option("parts", str(wanted)).load()
