"""Sharding through fixed virtual slots.

Every record hashes into one of ``N_SLOTS`` virtual slots, a number that never
changes.  Bytes and rows are aggregated per slot (map-side first), and a small
versioned map sends slots to shards.  Rebalancing edits that map and adds a
version; records never rehash.  All of the main path is DataFrame operations;
the only thing that reaches the driver is one row a slot, a fixed bound.

Defined cases: a null text has no bytes (size 1, crc 0); a null id hashes like
any value; an empty table gives an empty result and a map of empty slots;
repeated rows are placed like others, each with a slot number of its own.  Rows
that are equal in id and text hash alike; where that makes a virtual slot hold
over ``1 / HOT`` of all bytes or rows, its rows spread by their place in the
table as well, so no shard and no sort has to take them all.
"""

from __future__ import annotations

import heapq
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import documents, id_text, shared_dir, spool

N_SLOTS = 4096
HOT = 256
MAP_SCHEMA = "version int, vslot int, shard int"


def with_slots(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, vslot, place of each record; the text goes no further than the scan."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return (
        id_text(docs)
        .select("doc_id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
        .withColumns({"vslot": F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(n_slots)).cast("int"), "place": F.monotonically_increasing_id()})
    )


def slot_stats(slotted: DataFrame) -> dict[int, tuple[int, int]]:
    """Bytes and rows per slot: at most ``N_SLOTS`` rows come to the driver."""
    rows = slotted.groupBy("vslot").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect()
    return {r["vslot"]: (r["b"], r["n"]) for r in rows}


def spread(slotted: DataFrame, stats: dict[int, tuple[int, int]], n_slots: int = N_SLOTS) -> tuple[DataFrame, bool]:
    """Rows of hot slots (``2 * HOT`` slots at most) hash by their place too; whether there are any."""
    size, rows = (sum(v[i] for v in stats.values()) for i in (0, 1))
    hot = [k for k, (b, n) in stats.items() if n > 1 and (b * HOT > size or n * HOT > rows)]
    again = F.pmod(F.xxhash64("doc_id", "text_crc32", "place"), F.lit(n_slots)).cast("int")
    return slotted.withColumn("vslot", F.when(F.col("vslot").isin(hot), again).otherwise(F.col("vslot"))) if hot else slotted, bool(hot)


def first_map(stats: dict[int, tuple[int, int]], n_shards: int, n_slots: int = N_SLOTS) -> dict[int, int]:
    """Largest slot first onto the lightest shard; ties by number."""
    heap = [(0, s) for s in range(n_shards)]
    placed = {}
    for slot in sorted(range(n_slots), key=lambda k: (-stats.get(k, (0, 0))[0], k)):
        load, shard = heapq.heappop(heap)
        placed[slot] = shard
        heapq.heappush(heap, (load + stats.get(slot, (0, 0))[0], shard))
    return placed


def rebalanced(old: dict[int, int], stats: dict[int, tuple[int, int]], n_shards: int, slack: float = 0.01) -> dict[int, int]:
    """Edit a map for new statistics or a new shard count, moving few slots.

    Slots leave shards above ``(1 + slack)`` of the mean, largest that still
    fits first, and go to the lightest shard.  Slots of shards that no longer
    exist all move.
    """
    size = {k: stats.get(k, (0, 0))[0] for k in old}
    mean = sum(size.values()) / n_shards
    new, load, moving = dict(old), [0] * n_shards, []
    by_shard: dict[int, list[int]] = {}
    for slot, shard in old.items():
        by_shard.setdefault(shard, []).append(slot)
        if shard < n_shards:
            load[shard] += size[slot]
    for shard, slots in sorted(by_shard.items()):
        for slot in sorted(slots, key=lambda k: (-size[k], k)):
            if shard >= n_shards:
                moving.append(slot)
            elif load[shard] > mean * (1 + slack) and load[shard] - size[slot] >= mean * (1 - slack):
                load[shard] -= size[slot]
                moving.append(slot)
    heap = [(b, s) for s, b in enumerate(load)]
    heapq.heapify(heap)
    for slot in sorted(moving, key=lambda k: (-size[k], k)):
        b, shard = heapq.heappop(heap)
        new[slot] = shard
        heapq.heappush(heap, (b + size[slot], shard))
    return new


def _table(spark: SparkSession, rows: list[tuple[int, ...]], names: list[str]) -> DataFrame:
    """One row a slot, from a literal that the JVM splits; no Python on executors."""
    text = F.lit(" ".join(":".join(map(str, r)) for r in rows))
    cells = spark.range(1).select(F.posexplode(F.split(text, " ")).alias("vslot", "cell"))
    return cells.select("vslot", *(F.split("cell", ":")[i].cast("long").alias(n) for i, n in enumerate(names)))


def store_map(spark: SparkSession, path: str, version: int, placed: dict[int, int]) -> None:
    """Add one version of the slot map; earlier versions stay readable, and a version that is there already is an error."""
    table = _table(spark, [(placed[k],) for k in range(len(placed))], ["shard"])
    table.select("vslot", F.col("shard").cast("int")).coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, dict[int, int]]:
    """A stored version, the newest by default (one row a slot)."""
    table = spark.read.schema(MAP_SCHEMA).parquet(path)
    version = table.agg(F.max("version")).first()[0] if version is None else version
    return version, {r["vslot"]: r["shard"] for r in table.filter(F.col("version") == version).collect()}


def place(slotted: DataFrame, placed: dict[int, int], stats: dict[int, tuple[int, int]], version: int) -> DataFrame:
    """Send every record to its shard and number a shard's records without gaps.

    The number is the count of rows in earlier slots of the shard plus the
    rank within the slot, so the sort is per slot and never per shard.
    """
    start, seen = {}, {}
    for slot in sorted(placed):
        start[slot] = seen.get(placed[slot], 0)
        seen[placed[slot]] = start[slot] + stats.get(slot, (0, 0))[1]
    table = _table(slotted.sparkSession, [(placed[k], start[k]) for k in range(len(placed))], ["shard", "start"])
    rank = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size", "place"))
    return (
        slotted.withColumn("rank", rank)
        .join(F.broadcast(table), "vslot")  # N_SLOTS rows, fixed
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
            (F.col("start") + F.col("rank") - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"), "vslot", F.lit(version).alias("map_version"),
        )
    )


def shard_documents(docs: DataFrame, n_shards: int = 16, n_slots: int = N_SLOTS, map_path: str | None = None) -> DataFrame:
    """Shard all records by bytes; with ``map_path`` holding a map, edit it and store the next version."""
    spark = docs.sparkSession
    slotted = spool(with_slots(docs, n_slots), "slots")
    stats = slot_stats(slotted)
    slotted, hot = spread(slotted, stats, n_slots)
    if hot:
        stats = slot_stats(slotted)
    version, placed = 1, None
    if map_path is not None:
        try:
            version, placed = load_map(spark, map_path)
        except AnalysisException as e:  # no map yet
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    if placed is None:
        placed = first_map(stats, n_shards, n_slots)
        version = 1
    else:
        placed = rebalanced(placed, stats, n_shards)
        version += 1
    store_map(spark, map_path or f"{shared_dir(spark)}/slot-map-{uuid.uuid4().hex}", version, placed)
    return place(slotted, placed, stats, version)


def op6_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir), 16)
