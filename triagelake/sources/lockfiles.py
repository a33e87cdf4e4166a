"""Resolved lockfiles (TOML) to entries; what can't be read is a status, not an error."""

from __future__ import annotations

import re
import tomllib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake.functions.names import normalise
from triagelake.operators.graph import spread

ENTRY = pa.struct({"name": pa.string(), "version": pa.string(), "is_root": pa.bool_(), "dependencies": pa.list_(pa.string()), "declared": pa.list_(pa.struct({"name": pa.string(), "specifier": pa.string()}))})
ENTRIES = "array<struct<name:string,version:string,is_root:boolean,dependencies:array<string>,declared:array<struct<name:string,specifier:string>>>>"

PIECE = 1 << 16  # bytes of a lockfile that are parsed at once, at least
BATCH = 1 << 23  # bytes of lockfiles in a batch, beyond the last one
HEADER = re.compile(rb"^[ \t]*\[\[[ \t]*package[ \t]*\]\][ \t]*(?:#[^\n]*)?\r?$", re.MULTILINE)


def _pieces(text: memoryview) -> Iterator[dict]:
    """Documents that together say what the whole text says, each read at once; an error where it can't be read.

    A piece ends before a line that opens a package.  A piece that is no
    document by itself (the line stood in a string) takes in what follows,
    twice as much each time; where all pieces are documents, so is the whole.
    """
    at, size = 0, 0  # what stands before the first package is a piece
    while at < len(text):
        cut = HEADER.search(text, min(at + size, len(text)))
        end = cut.start() if cut else len(text)
        try:
            data = tomllib.loads(bytes(text[at:end]).decode())
        except (ValueError, RecursionError):
            if end == len(text):
                raise
            size = max(2 * size, PIECE)
            continue
        yield data
        at, size = end, PIECE


def _entries(packages: list) -> pa.Array:
    rows = []
    for e in packages:
        if not isinstance(e, dict) or not isinstance(e.get("name"), str) or not isinstance(e.get("version"), str):
            continue
        source = e["source"] if isinstance(e.get("source"), dict) else {}
        names = [d["name"] for d in e.get("dependencies") or [] if isinstance(d, dict) and isinstance(d.get("name"), str)]
        meta = e["metadata"] if isinstance(e.get("metadata"), dict) else {}
        asked = [{"name": d["name"], "specifier": d["specifier"]} for d in meta.get("requires-dist") or [] if isinstance(d, dict) and isinstance(d.get("name"), str) and isinstance(d.get("specifier"), str) and d["specifier"]]
        rows.append((e["name"], e["version"], "virtual" in source or "editable" in source, names, asked))
    return pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), ENTRY, strict=True)], fields=list(ENTRY)) if rows else pa.array([], ENTRY)


def read_lock(text: bytes | memoryview | None) -> tuple[str, list[pa.Array]]:
    """Status and entries, in columns; of the parsed text only a piece is held at a time."""
    if text is None:
        return "missing", []
    text, out = memoryview(text), []
    try:
        pieces = _pieces(text)
        top = next(pieces, {})
        whole, listed = "package" in top, isinstance(top.get("package"), list)
        for data in pieces:
            if whole or set(data) != {"package"}:  # what other tables may say together, only the whole text tells
                top = tomllib.loads(bytes(text).decode())
                whole, listed = True, isinstance(top.get("package"), list)
                break
            listed = True
            out.append(_entries(data["package"]))
        if whole:
            out = [_entries(top["package"])] if listed else []
    except (ValueError, RecursionError):
        return "not_toml", []
    if top.get("version") != 1:
        return "version", []
    if not listed:
        return "no_packages", []
    out = [x for x in out if len(x)]
    return ("ok" if out else "no_entries"), out


def parse_lockfiles(files: DataFrame) -> DataFrame:
    """``files(project_id, text)`` to ``project_id, status, entries``.

    A task holds the bytes of one lockfile and its entries in columns, besides
    the objects of one piece.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                text = b.column(1)[i]
                status, parts = read_lock(text.as_buffer() if text.is_valid else None)
                held = pa.concat_arrays(parts) if parts else pa.array([], ENTRY)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), pa.array([status]), pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), held)], ["project_id", "status", "entries"])

    files.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))
    key = files.schema["project_id"].dataType.simpleString()
    rows = spread(files.select("project_id", F.col("text").cast("binary")), "project_id")
    return rows.mapInArrow(run, f"project_id {key}, status string, entries {ENTRIES}")


def entries(parsed: DataFrame) -> DataFrame:
    """One row an entry: names normalised, the first virtual or editable entry is the root."""
    rows = parsed.select("project_id", F.posexplode("entries").alias("ordinal", "e")).select("project_id", "ordinal", normalise(F.col("e.name")).alias("name"), "e.version", "e.is_root", F.transform("e.dependencies", normalise).alias("dependencies"), "e.declared")
    first = rows.filter("is_root").groupBy("project_id").agg(F.min("ordinal").alias("root_at"))
    return rows.join(first, "project_id", "left").withColumn("is_root", F.coalesce(F.col("ordinal") == F.col("root_at"), F.lit(False))).drop("root_at")


def declared(rows: DataFrame) -> DataFrame:
    """``project_id, name, specifier`` that the root asks for; of repeated names the last counts."""
    asked = rows.filter("is_root").select("project_id", F.posexplode("declared").alias("pos", "d"))
    return asked.groupBy("project_id", normalise(F.col("d.name")).alias("name")).agg(F.max_by("d.specifier", "pos").alias("specifier"))


def read_lockfiles(spark: SparkSession, path: str) -> DataFrame:
    """All ``uv.lock`` files under a path; a project is its folder.

    Bytes that are no UTF-8 become a text that is no TOML, so their status is
    ``not_toml`` and not ``missing``.
    """
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "uv.lock").option("recursiveFileLookup", "true").load(path)
    return raw.select(F.xxhash64(F.regexp_replace("path", "/[^/]*$", "")).alias("project_id"), F.coalesce(F.expr("try_validate_utf8(cast(content as string))"), F.lit("\0")).alias("text"), F.regexp_replace("path", "/[^/]*$", "").alias("folder"))


def with_missing(parsed: DataFrame, projects: DataFrame) -> DataFrame:
    """Parsed lockfiles and a ``missing`` row for each project (``project_id``) without one."""
    none = projects.select("project_id").distinct().join(parsed.select("project_id"), "project_id", "left_anti")
    return parsed.unionByName(none.select("project_id", F.lit("missing").alias("status"), F.array().cast(parsed.schema["entries"].dataType).alias("entries")))
