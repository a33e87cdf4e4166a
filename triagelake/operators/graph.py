"""Breadth-first traversal of many graphs at once.

``strategy="project"`` walks each project's graph inside one group (a project
fits a task, there is one stage for all).  ``"frontier"`` advances one level of
all graphs by joins, for single graphs too large for a task.  ``"auto"`` counts
each project's rows and deals the project to one or the other.  All give the
same distances and, on ties, the same predecessor: the least
``(speculative, fqn)`` among those one hop nearer.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GROUP_ROWS = 2_000_000  # of a project that one task may walk
LEVELS = 8  # tables of levels before they become one

OUT = "project_id long, node string, dist int, pred string, via_speculative boolean"


KINDS = {"edge": 0, "start": 1, "caller": 2, "holder": 3}


class _Links:
    """Pairs of numbers, to be looked up by the first."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, spec: np.ndarray | None = None) -> None:
        order = np.argsort(src, kind="stable")
        self.src, self.dst = src[order], dst[order]
        self.spec = spec[order] if spec is not None else None

    def of(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the pairs of ``some``, and how many each has."""
        low = np.searchsorted(self.src, some, "left")
        n = np.searchsorted(self.src, some, "right") - low
        return np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum()), n


def _walk(table: pa.Table) -> pa.Table:
    """One project's walk over numbers that stand for its names in their order."""
    coded = pa.chunked_array(table["src"].chunks + table["dst"].chunks, table["src"].type).dictionary_encode(null_encoding="encode").combine_chunks()
    names, at = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
    order = pc.sort_indices(names).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    src, dst = rank[at[: len(table)]], rank[at[len(table) :]]
    kind, spec, n = table["kind"].to_numpy(), table["spec"].combine_chunks().fill_null(False).to_numpy(zero_copy_only=False), len(names)
    links = _Links(*(x[kind == KINDS["edge"]] for x in (src, dst, spec)))
    callers, holders = (_Links(src[kind == KINDS[k]], dst[kind == KINDS[k]]) for k in ("caller", "holder"))
    dist, best, met = np.full(n, -1, np.int32), np.full(n, -1, np.int64), np.zeros(n, bool)
    level = np.unique(src[kind == KINDS["start"]])
    dist[level], far = 0, 0
    while len(level):
        far += 1
        i, k = links.of(level)
        to, by = links.dst[i], links.spec[i] * n + np.repeat(level, k)  # a guess counts after all sure ones
        if len(callers.src):
            i, k = callers.of(level)
            tails, first = np.unique(callers.dst[i], return_index=True)  # the level is in order: the first caller is the least
            led = np.repeat(level, k)[first][~met[tails]]
            tails = tails[~met[tails]]
            met[tails] = True
            i, k = holders.of(tails)
            to, by = np.concatenate([to, holders.dst[i]]), np.concatenate([by, n + np.repeat(led, k)])
        to, by = to[dist[to] < 0], by[dist[to] < 0]
        o = np.lexsort((by, to))
        level, first = np.unique(to[o], return_index=True)
        dist[level], best[level] = far, by[o][first]
    seen = np.flatnonzero(dist >= 0)
    back, text = best[seen], names.take(pa.array(order))
    pred = text.take(pa.array(np.where(back < 0, 0, back % n), mask=back < 0))
    project = pa.repeat(table["project_id"][0], len(seen))
    return pa.Table.from_arrays([project, text.take(pa.array(seen)).cast(pa.string()), pa.array(dist[seen]), pred.cast(pa.string()), pa.array(back >= n)], ["project_id", "node", "dist", "pred", "via_speculative"])


def shared_folder(spark: SparkSession) -> str:
    """Folder that all executors see: ``spark.checkpoint.dir``, or one of our own on a local master."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors see")
    if not found:
        spark.sparkContext.setCheckpointDir(os.path.join(tempfile.gettempdir(), f"triagelake-{uuid.uuid4().hex[:8]}"))
        found = spark.sparkContext.getCheckpointDir()
    return found


_owners: list[str] = []


@contextmanager
def workspace(spark: SparkSession) -> Iterator[str]:
    """Owner of the tables that plans write while it is open; they are deleted when it closes.

    Results are lazy, so write or collect them inside::

        with workspace(spark):
            found, state = scan_findings(...)
            found.write.parquet(path)

    Without an owner tables stay in the shared folder, for whoever cleans it.
    """
    folder = f"{shared_folder(spark)}/work-{uuid.uuid4().hex}"
    _owners.append(folder)
    try:
        yield folder
    finally:
        _owners.remove(folder)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table_path(spark: SparkSession, tag: str = "table") -> str:
    """A new folder for a table: the open owner's, or in the shared one."""
    return f"{_owners[-1] if _owners else shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"


GUESSED_BYTES = 256 << 10  # of a join's side by its files, to be broadcast before a run has measured it


@contextmanager
def measured_joins(spark: SparkSession) -> Iterator[None]:
    """Inside, joins broadcast a side by its measured size.

    Files say little about rows: columns compress fiftyfold and lists explode,
    so a side of 10 MB by its files may come to 500 MB in the driver.  Sides
    over ``GUESSED_BYTES`` are shuffled first, and broadcast if what was
    shuffled is under the session's own threshold.
    """
    guess, known = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    before = {k: spark.conf.get(k, None) for k in (guess, known)}
    if before[known] is None and before[guess] is not None:
        spark.conf.set(known, before[guess])
    bound = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    spark.conf.set(guess, str(min(bound, GUESSED_BYTES)))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` over as many tasks as a shuffle has, for costly work on rows of small files."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder and read back.

    Lineage ends here, so a lost executor costs no recomputation; unlike an RDD
    checkpoint the table is columnar, later readers prune its columns, and its
    size is known to the joins that read it.
    """
    path = table_path(df.sparkSession)
    with measured_joins(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _dealt(sized: DataFrame, *tables: DataFrame, group_rows: int) -> tuple[list[DataFrame], list[DataFrame] | None]:
    """``tables`` of the projects that a task can hold, and of the others if there are any."""
    counts = sized.groupBy("project_id").agg(F.count(F.lit(1)).alias("n"))
    large = checkpointed(counts.filter(F.col("n") > group_rows).select("project_id"))
    if large.isEmpty():
        return list(tables), None
    return [t.join(large, "project_id", "left_anti") for t in tables], [t.join(large, "project_id", "left_semi") for t in tables]


Fans = tuple[DataFrame, DataFrame]


def bfs(edges: DataFrame, starts: DataFrame, strategy: str = "project", group_rows: int = GROUP_ROWS, fans: Fans | None = None) -> DataFrame:
    """``project_id, node, dist, pred, via_speculative`` of every node in reach.

    ``edges(project_id, src, dst[, speculative])``, ``starts(project_id, node)``.
    ``fans``: callers (project_id, src, tail) and holders (project_id, tail,
    dst) stand for a guessed edge from each caller of a tail to each holder.
    They are walked as one hop and never multiplied out: the first level that
    meets a tail reaches all its holders, from its least caller there.
    """
    if strategy == "auto":
        sized = edges.select("project_id")
        for f in fans or ():
            sized = sized.unionAll(f.select("project_id"))
        small, large = _dealt(sized, edges, starts, *(fans or ()), group_rows=group_rows)
        walk = lambda t, how: bfs(t[0], t[1], how, fans=(t[2], t[3]) if fans else None)
        walked = walk(small, "project")
        return walked if large is None else walked.unionByName(walk(large, "frontier"))
    spec = F.col("speculative") if "speculative" in edges.columns else F.lit(False)
    links = edges.select("project_id", "src", "dst", spec.alias("spec"))
    if strategy == "project":
        row = lambda df, src, dst, kind: df.select(F.col("project_id").cast("long"), F.col(src), dst, F.lit(False), F.lit(KINDS[kind]).cast("byte"))
        rows = links.select(F.col("project_id").cast("long"), "src", "dst", "spec", F.lit(KINDS["edge"]).cast("byte").alias("kind")).unionAll(row(starts, "node", F.lit(None).cast("string"), "start"))
        if fans:
            rows = rows.unionAll(row(fans[0], "src", F.col("tail"), "caller")).unionAll(row(fans[1], "tail", F.col("dst"), "holder"))
        return spread(rows, "project_id").groupBy("project_id").applyInArrow(_walk, OUT)  # small tables of many projects are much work
    if strategy != "frontier":
        raise ValueError(strategy)
    links = checkpointed(links.groupBy("project_id", "src", "dst").agg(F.bool_and("spec").alias("spec")))
    callers, holders = (f.distinct() for f in fans) if fans else (None, None)
    front = starts.select(F.col("project_id").cast("long").alias("project_id"), "node").distinct()
    front = checkpointed(front.select("project_id", "node", F.lit(0).alias("dist"), F.lit(None).cast("string").alias("pred"), F.lit(False).alias("via_speculative")))
    levels, met, dist = [front], [], 0
    while not front.isEmpty():
        dist += 1
        here = front.select("project_id", F.col("node").alias("src"))
        step = here.join(links, ["project_id", "src"]).select("project_id", "dst", "spec", "src")
        if fans:
            led = here.join(callers, ["project_id", "src"]).groupBy("project_id", "tail").agg(F.min("src").alias("src"))
            if met:
                led = led.join(reduce(DataFrame.unionAll, met), ["project_id", "tail"], "left_anti")
            led = checkpointed(led)
            met = [checkpointed(reduce(DataFrame.unionAll, [*met, led.select("project_id", "tail")]))] if len(met) > LEVELS else [*met, led.select("project_id", "tail")]
            step = step.unionAll(led.join(holders, ["project_id", "tail"]).select("project_id", "dst", F.lit(True), "src"))
        best = step.groupBy("project_id", F.col("dst").alias("node")).agg(F.min(F.struct("spec", "src")).alias("b"))
        fresh = best.join(reduce(DataFrame.unionByName, levels).select("project_id", "node"), ["project_id", "node"], "left_anti")
        front = checkpointed(fresh.select("project_id", "node", F.lit(dist).alias("dist"), F.col("b.src").alias("pred"), F.col("b.spec").alias("via_speculative")))
        levels.append(front)
        if len(levels) > LEVELS:
            levels = [checkpointed(reduce(DataFrame.unionByName, levels))]
    return reduce(DataFrame.unionByName, levels)


def _traced(targets: DataFrame, reach: DataFrame) -> DataFrame:
    """Paths by pointers that double their reach, for graphs too large for a task.

    After round k every node points 2^k predecessors back, and each target
    holds its nearest 2^k ancestors; a path of n hops takes log2(n) + 1 rounds
    of joins on scalars.  A node's distance is its place on the path.
    """
    rows = checkpointed(reach.select("project_id", "node", "dist", "pred", F.coalesce("via_speculative", F.lit(False)).alias("guess")))
    back = rows.filter("pred is not null").select("project_id", "node", F.col("pred").alias("far"))
    held = targets.distinct().join(rows.select("project_id", "node"), ["project_id", "node"], "left_semi").select("project_id", "node", F.col("node").alias("at"))
    while True:
        ahead = held.join(back.withColumnRenamed("node", "at"), ["project_id", "at"]).select("project_id", "node", F.col("far").alias("at"))
        ahead = checkpointed(ahead)
        if ahead.isEmpty():
            break
        held = checkpointed(held.unionAll(ahead))
        back = checkpointed(back.join(back.select("project_id", F.col("node").alias("far"), F.col("far").alias("further")), ["project_id", "far"]).select("project_id", "node", F.col("further").alias("far")))
    full = held.join(rows.select("project_id", F.col("node").alias("at"), "dist", "guess"), ["project_id", "at"])
    out = full.groupBy("project_id", "node").agg(F.array_sort(F.collect_list(F.struct("dist", "at"))).alias("p"), F.bool_or("guess").alias("speculative"))
    return out.select("project_id", "node", F.transform("p", lambda x: x["at"]).alias("path"), "speculative")


def evidence(reach: DataFrame, targets: DataFrame, strategy: str = "project", group_rows: int = GROUP_ROWS) -> DataFrame:
    """Path from a start to each target, nodes in order; whether a guessed hop is on it.

    ``targets(project_id, node)``.  The predecessor chain is followed inside
    each project, for the targets only; ``strategy`` as for ``bfs``.
    """
    if strategy == "auto":
        small, large = _dealt(reach, reach, targets, group_rows=group_rows)
        paths = evidence(*small)
        return paths if large is None else paths.unionByName(evidence(*large, "frontier"))

    def chain(left: pa.Table, right: pa.Table) -> pa.Table:
        back = dict(zip(right["node"].to_pylist(), zip(right["pred"].to_pylist(), right["via_speculative"].to_pylist(), strict=True), strict=True))
        nodes, paths, guesses = [], [], []
        for node in dict.fromkeys(left["node"].to_pylist()):
            if node not in back:
                continue
            path, guessed, at = [], False, node
            while at is not None:
                path.append(at)
                guessed |= bool(back[at][1])
                at = back[at][0]
            nodes.append(node), paths.append(path[::-1]), guesses.append(guessed)
        project = left["project_id"][0] if nodes else pa.scalar(None, pa.int64())
        return pa.Table.from_arrays([pa.repeat(project, len(nodes)), pa.array(nodes, pa.string()), pa.array(paths, pa.list_(pa.string())), pa.array(guesses, pa.bool_())], ["project_id", "node", "path", "speculative"])

    schema = "project_id long, node string, path array<string>, speculative boolean"
    wanted = targets.select(F.col("project_id").cast("long").alias("project_id"), F.col("node").alias("node"))
    steps = reach.select(F.col("project_id").cast("long").alias("project_id"), F.col("node").alias("node"), F.col("dist").alias("dist"), F.col("pred").alias("pred"), F.col("via_speculative").alias("via_speculative"))
    if strategy == "frontier":
        return _traced(wanted, steps)
    return spread(wanted, "project_id").groupBy("project_id").cogroup(spread(steps, "project_id").groupBy("project_id")).applyInArrow(chain, schema)


def evidence_marks(reach: DataFrame, targets: DataFrame, strategy: str = "auto", group_rows: int = GROUP_ROWS) -> DataFrame:
    """``project_id, node, hops, speculative``: nodes on each target's path, and whether a guessed hop is on it.

    As ``evidence`` without the paths: rows and memory are linear in the graph
    where the paths of all nodes of a chain are quadratic.
    """
    if strategy == "auto":
        small, large = _dealt(reach, reach, targets, group_rows=group_rows)
        marks = evidence_marks(*small, "project")
        return marks if large is None else marks.unionByName(evidence_marks(*large, "frontier"))
    if strategy not in ("project", "frontier"):
        raise ValueError(strategy)
    wanted = targets.select(F.col("project_id").cast("long").alias("project_id"), F.col("node").alias("node"))
    steps = reach.select(F.col("project_id").cast("long").alias("project_id"), F.col("node").alias("node"), F.col("dist").alias("dist"), F.col("pred").alias("pred"), F.coalesce("via_speculative", F.lit(False)).alias("guess"))

    def chain(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("dist")
        marks: dict[str, tuple[int, bool]] = {}
        for node, dist, pred, guess in zip(*(right[c].to_pylist() for c in ("node", "dist", "pred", "guess")), strict=True):
            marks[node] = dist + 1, guess or (pred in marks and marks[pred][1])
        nodes = [n for n in dict.fromkeys(left["node"].to_pylist()) if n in marks]
        project = left["project_id"][0] if nodes else pa.scalar(None, pa.int64())
        return pa.Table.from_arrays([pa.repeat(project, len(nodes)), pa.array(nodes, pa.string()), pa.array([marks[n][0] for n in nodes], pa.int32()), pa.array([marks[n][1] for n in nodes], pa.bool_())], ["project_id", "node", "hops", "speculative"])

    if strategy == "project":
        return spread(wanted, "project_id").groupBy("project_id").cogroup(spread(steps, "project_id").groupBy("project_id")).applyInArrow(chain, "project_id long, node string, hops int, speculative boolean")
    back = checkpointed(steps.select("project_id", "node", F.col("pred").alias("far"), "guess"))
    while not back.filter("far is not null").isEmpty():
        further = back.select("project_id", F.col("node").alias("far"), F.col("far").alias("next"), F.col("guess").alias("g"))
        back = checkpointed(back.join(further, ["project_id", "far"], "left").select("project_id", "node", F.col("next").alias("far"), (F.col("guess") | F.coalesce("g", F.lit(False))).alias("guess")))
    rows = steps.select("project_id", "node", (F.col("dist") + 1).cast("int").alias("hops")).join(back.select("project_id", "node", F.col("guess").alias("speculative")), ["project_id", "node"])
    return checkpointed(rows.join(wanted.distinct(), ["project_id", "node"], "left_semi"))
