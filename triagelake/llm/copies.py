"""One text of each group of near copies, by fingerprint balls, an exact check and an exact join for the rest.

Two texts are linked when the Jaccard similarity of their sets of five-word
shingles is at least ``SIMILARITY``; groups are the connected components.
First texts meet by their SimHash fingerprints, as in ``simhash``: those of one
fingerprint its first, distinct fingerprints their neighbours in a half ball;
these pairs are compared exactly.  An appended or replaced passage may differ
in more bits, so a prefix join then looks for the links that balls miss, among
texts that no ball has joined.

All shingles have one order (rare ones first), and of a set of n the first
``n - ceil(SIMILARITY * n) + 1`` are its prefix: two sets as similar as asked
share a shingle of both prefixes, whatever the kind of edit.  Rarity is read
from a table of counts by hash; any table gives the same result, a good one
keeps common passages out of the prefixes.

Holders of one prefix shingle are a bucket.  In a star round after the balls each meets one
member of it (first the one whose prefix is shared most, so a template of many
copies; then by chance), pairs are compared exactly, and buckets inside one
component are done.  After a round without links, or ``ROUNDS``, all pairs of
a bucket that lie in different components and weren't compared are, so no
pair that could join two components is left unread.

Defined cases: equal texts are one node, and null and empty texts are equal; a
text of fewer words than a shingle is one shingle; of a group the row with
the smallest id stays (null ids last, then the first row); repeated rows are
copies; an empty table gives an empty one.  All columns are kept as they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import forget, small_batches, spool
from .components import components
from .longmatch import _unpack, chunked
from .simhash import ball_links, fingerprint

SIMILARITY, SHINGLE = 0.8, 5
ROUNDS = 3  # the balls and star rounds before all pairs that are left
COUNT_BITS = 18  # of a shingle's hash, to count it by
ROW_BITS = 15  # of a row's number in its chunk, which has one row for each 64 bytes at most


def _shingles(words: list[bytes], size: int) -> list[bytes]:
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    return [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)]


def shingle_set(text: bytes, size: int = SHINGLE) -> np.ndarray:
    return np.unique(np.array([xxhash.xxh3_64_intdigest(g) for g in _shingles(text.lower().split(), size)], np.uint64))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(len(a) + len(b) - both, 1)


def prefix(shingles: np.ndarray, counts: np.ndarray, least: float = SIMILARITY) -> np.ndarray:
    """The rarest shingles of a set, enough to meet every set as similar as asked."""
    n = len(shingles)
    order = np.lexsort((shingles, counts[shingles >> np.uint64(64 - COUNT_BITS)]))
    return shingles[order[: n - math.ceil(least * n - 1e-9) + 1]] if n else shingles


def _texts(row: dict, text_at: int) -> tuple[pa.Table, list[bytes]]:
    table, data, edges = _unpack(row["data"], text_at)
    raw = data.tobytes()
    return table, [raw[i:j] for i, j in zip(edges, edges[1:], strict=False)]


def _counts(chunks: DataFrame, text_at: int, size: int) -> np.ndarray:
    """Texts with a shingle of each hash prefix, over all rows; tasks' tables are added up by a few tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNT_BITS, np.uint32)
        for b in batches:
            for row in b.to_pylist():
                sets = [shingle_set(t, size) for t in _texts(row, text_at)[1]]
                at = (np.concatenate(sets) >> np.uint64(64 - COUNT_BITS)).astype(np.int64)
                total += np.bincount(at, minlength=len(total)).astype(np.uint32)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNT_BITS, np.uint32)
        for b in batches:
            for x in b.column(0):
                total += np.frombuffer(x.as_buffer(), np.uint32)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])

    small_batches(chunks.sparkSession, 8192, 4 << 20)
    parts = chunks.mapInArrow(run, "counts binary").repartition(4).mapInArrow(add, "counts binary").collect()
    return reduce(np.add, [np.frombuffer(bytes(r["counts"]), np.uint32) for r in parts], np.zeros(1 << COUNT_BITS, np.uint32))


def _marks(chunks: DataFrame, id_at: int, text_at: int, counts: np.ndarray, least: float, size: int) -> DataFrame:
    """Of each row its id, the text's hash and fingerprint, the number of its shingles, its prefix and how widely that is shared."""
    shared = chunks.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                table, texts = _texts(row, text_at)
                sets = [shingle_set(t, size) for t in texts]
                first = [prefix(s, shared.value, least) for s in sets]
                nodes = np.array([xxhash.xxh3_64_intdigest(t) for t in texts], np.uint64).view(np.int64)
                wide = [int(np.log2(1.0 + shared.value[p >> np.uint64(64 - COUNT_BITS)]).mean() * (1 << 24)) if len(p) else 0 for p in first]
                fps = pa.array([fingerprint(t) for t in texts], pa.int64())
                rid = np.arange(len(texts), dtype=np.int64) + (row["chunk"] << ROW_BITS)
                ids = table.column(id_at).combine_chunks().cast(pa.int64())
                edges = np.cumsum([0, *map(len, first)]).astype(np.int32)
                tokens = pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate(first).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(rid), ids, pa.array(nodes), fps, pa.array([len(s) for s in sets], pa.int32()), pa.array(wide, pa.int64()), tokens], ["rid", "doc_id", "hash", "fp", "n", "wide", "tokens"])

    small_batches(chunks.sparkSession, 8192, 4 << 20)
    return chunks.mapInArrow(run, "rid long, doc_id long, hash long, fp long, n int, wide long, tokens array<long>")


def _may_reach(n: Column, pos: Column, m: Column, other: Column, least: float) -> Column:
    """Whether sets of n and m can be similar if their first shared shingle stands at these places of the order."""
    needed = F.lit(least / (1 + least)) * (n + m) - 1e-6
    return (F.least(n, m) >= F.lit(least) * F.greatest(n, m) - 1e-6) & (F.least(n - pos, m - other) >= needed)


def _by_chunk(rids: DataFrame, name: str) -> DataFrame:
    return rids.groupBy(F.shiftright("rid", ROW_BITS).alias("chunk")).agg(F.collect_list("rid").alias(name))


def _sets(chunks: DataFrame, pairs: DataFrame, text_at: int, size: int) -> DataFrame:
    """Shingle sets of the texts in ``pairs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                _, data, edges = _unpack(row["data"], text_at)
                for r in row["wanted"]:
                    i = r - (row["chunk"] << ROW_BITS)
                    yield pa.RecordBatch.from_arrays([pa.array([r], pa.int64()), pa.array([shingle_set(data[edges[i] : edges[i + 1]].tobytes(), size).tobytes()], pa.binary())], ["rid", "s"])

    wanted = pairs.select(F.col("a").alias("rid")).unionAll(pairs.select(F.col("b").alias("rid"))).distinct()
    small_batches(chunks.sparkSession, 8192, 4 << 20)
    return chunks.join(_by_chunk(wanted, "wanted").hint("shuffle_hash"), "chunk").mapInArrow(run, "rid long, s binary")


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links ``(u, v)``: pairs whose shingle sets are as similar as asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = ([np.frombuffer(s, np.uint64) for s in b.column(i).to_pylist()] for i in (2, 3))
            close = pa.array([similarity(s, t) >= least for s, t in zip(x, y, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(close), b.column(1).filter(close)], ["u", "v"])

    both = pairs.join(sets.select(F.col("rid").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("rid").alias("b"), F.col("s").alias("y")), "b")
    small_batches(pairs.sparkSession, 8192, 4 << 20)
    return both.select("a", "b", "x", "y").mapInArrow(run, "u long, v long")


def _ball_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` that connect all nodes whose fingerprints are linked."""
    first = spool(nodes.groupBy("fp").agg(F.min("node").alias("node")), "fp")
    same = nodes.select("fp", F.col("node").alias("b")).join(first.withColumnRenamed("node", "a"), "fp").filter("a <> b").select("a", "b")
    near = ball_links(first)
    return same.unionAll(near.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct())


def _groups(chunks: DataFrame, nodes: DataFrame, text_at: int, least: float, size: int) -> DataFrame:
    """node and component of all nodes that have a near copy."""
    columns = ["node", "n", "wide", "pos", "token", "component"]
    rest, links, tried, found, spent = None, None, None, None, []
    for turn in range(ROUNDS + 1):
        last = turn == ROUNDS or (turn > 1 and not more)
        if not turn:
            pairs = spool(_ball_pairs(nodes), "pairs")
        else:
            now = (nodes if rest is None else rest.drop("component")).join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
            if rest is None:
                now = now.select("node", "n", "wide", F.posexplode("tokens").alias("pos", "token"), "component")
            open_ = now.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("token")
            before, rest = rest, spool(now.join(open_, "token").select(columns), "met")
            if before is not None:
                forget(before)
            other = rest.select("token", *(F.col(c).alias(f"r_{c}") for c in ("node", "n", "pos", "component")))
            if last:
                apart = F.col("node") < F.col("r_node")
            else:
                key = F.xxhash64("node", "token", F.lit(turn)) if turn > 1 else F.col("wide")
                other = rest.withColumn("key", key).groupBy("token").agg(*(F.max_by(c, "key").alias(f"r_{c}") for c in ("node", "n", "pos", "component")))
                apart = F.col("node") != F.col("r_node")
            left = rest.withColumnRenamed("token", "l_token")
            near = _may_reach(F.col("n"), F.col("pos"), F.col("r_n"), F.col("r_pos"), least)
            met = left.join(other, (F.col("l_token") == F.col("token")) & apart & (F.col("component") != F.col("r_component")) & near)
            pairs = met.select(F.least("node", "r_node").alias("a"), F.greatest("node", "r_node").alias("b")).distinct()
            pairs = spool(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        tried = pairs if tried is None else tried.unionAll(pairs)
        sets = spool(_sets(chunks, pairs, text_at, size), "sets")
        close = spool(_verified(pairs, sets, least), "near")
        forget(sets)
        spent += [pairs, close]
        more = not close.isEmpty()
        links = close if links is None else links.unionAll(close)
        if more or found is None:
            found = components(links)
        if last:
            forget(*spent, *(() if rest is None else (rest,)))
            return found
    raise AssertionError


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY, size: int = SHINGLE) -> DataFrame:
    """Rows of ``docs`` that stay."""
    id_at, text_at = docs.columns.index(id_col), docs.columns.index(text_col)
    chunks = chunked(docs, text_col)
    marked = spool(_marks(chunks, id_at, text_at, _counts(chunks, text_at, size), least, size), "marks")
    nodes = spool(marked.groupBy("hash").agg(F.min("rid").alias("node")), "nodes")
    found = _groups(chunks, marked.select(F.col("rid").alias("node"), "fp", "n", "wide", "tokens").join(nodes.select("node"), "node", "left_semi"), text_at, least, size)
    group = F.coalesce("component", "node")
    rows = marked.select("rid", "doc_id", "hash").join(nodes.select("hash", "node"), "hash").join(found, "node", "left").select("rid", "doc_id", group.alias("grp"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid"))
    kept = rows.groupBy("grp").agg(first.alias("first")).select(F.col("first.rid").alias("rid"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                table = pa.ipc.open_stream(row["data"]).read_all()
                some = np.sort(np.array(row["kept"], np.int64)) - (row["chunk"] << ROW_BITS)
                yield from table.take(pa.array(some)).combine_chunks().to_batches()

    small_batches(docs.sparkSession, 8192, 4 << 20)
    return chunks.join(_by_chunk(kept, "kept").hint("shuffle_hash"), "chunk").mapInArrow(keep, docs.schema)
