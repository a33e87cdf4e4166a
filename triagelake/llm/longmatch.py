"""Long repeated substrings through logarithmic families of sampled suffix arrays.

A string of ``LENGTH`` bytes (a window) is removed wherever it also starts
anywhere else.  Suffixes are sampled by content: of a window's ``k``-byte
strings the one with the least fingerprint (the last on ties) is its anchor,
so equal windows have equal anchors at equal offsets.  The suffix space is
split by anchor fingerprint; every shard keeps an index family: each new batch
of suffixes is sorted into a suffix array (in the order of fingerprints), is
merge-scanned against the shard's levels, and becomes a level; neighbouring
levels of like size merge, so a suffix moves a logarithmic number of times.

An anchor that occurs once has only unique windows.  If all its occurrences
stand in one and the same span (the union of the windows that chose it), all
these windows repeat.  Else its windows stay active for a finer round with a
longer ``k``; the last round has ``k = LENGTH``, one window an anchor.

Two strings count as equal if two fingerprints of 62 bits agree: an anchor's and
its span's, and in the last round two of the window over independent tables.  At
10^14 windows that makes a wrong match unlikely (about 10^28 pairs of windows
against 2^124); only inside a chunk do answers meet windows by one of the two.

Texts travel in chunks of about ``CHUNK`` bytes.  In a chunk equal anchors are
one row before the shuffle, so a passage that a third of all rows share costs
a shard one row a chunk.  The chunks are a table bucketed by chunk number and
written once; answers meet it without moving the texts again.

Defined cases: a null text is empty and nothing is removed from it; texts
under ``LENGTH`` bytes keep everything; repeated rows are copies like any; an
empty table gives no row; other columns are carried along untouched.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import documents, id_text, shared_dir, small_batches, spool

LENGTH = 200
ROUNDS = (64, 176, 200)
CHUNK = 1 << 20
BATCH = 1 << 16  # suffixes of a new batch
SHARD = 64 << 20  # bytes of text for each shard of the suffix space, at most
POS_BITS = 30
NUMBER_BITS = 24  # of a chunk's number in its task
VARIED = np.uint64(1)  # more than one span stands around the anchor
AGAIN = np.uint64(2)  # more than one occurrence
FLAGS = np.uint64(3)

_M = np.uint64(0x9E3779B97F4A7C15)
_ODD = (0xD1342543DE82EF95, 0xAF251AF3B0F025B5)
_rng = np.random.default_rng(200)
_BYTE = [_rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in _ODD]
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(n: int, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a multiplier and of its inverse, kept for the longest text so far."""
    if kind not in _powers or len(_powers[kind][0]) < n:
        made = []
        for base in (_ODD[kind], pow(_ODD[kind], -1, 1 << 64)):
            steps = np.full(max(n, 1 << 21), np.uint64(base), np.uint64)
            steps[0] = 1
            made.append(np.multiply.accumulate(steps))
        _powers[kind] = (made[0], made[1])
    up, down = _powers[kind]
    return up[:n], down[:n]


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M
    return x ^ (x >> np.uint64(29))


class Prints:
    """Fingerprints of any substring of a byte array, of one of two independent kinds."""

    def __init__(self, data: np.ndarray, kind: int = 0):
        self.kind = kind
        up, self.down = _power(len(data) + 1, kind)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[kind][data] * up[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def all(self, k: int) -> np.ndarray:
        """Of the k bytes from each position that has as many."""
        return (self.sums[k:] - self.sums[:-k]) * self.down[: len(self.sums) - k]


def _sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours, by running minima inside blocks of w."""
    n = len(x)
    pad = np.full(-n % w, np.iinfo(np.uint64).max, np.uint64)
    blocks = np.concatenate([x, pad]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


class Items:
    """Anchors of the active windows for one k: fingerprint h, span s, first and last window."""

    def __init__(self, prints: Prints, active: np.ndarray, k: int, length: int):
        at = np.flatnonzero(active)
        if k == length:
            self.lo = self.hi = at
            self.h = _stir(prints.of(at, at + length)) & ~FLAGS
            self.s = np.zeros(len(at), np.uint64)
            return
        if len(prints.sums) >> POS_BITS:
            raise OverflowError("a chunk of over 2^30 bytes")
        low = np.uint64((1 << POS_BITS) - 1)
        gram = _stir(prints.all(k))
        place = low - np.arange(len(gram), dtype=np.uint64)
        least = _sliding_least((gram & ~low) | place, length - k + 1)
        anchor = (low - (least[at] & low)).astype(np.int64)
        first = np.ones(len(at), bool)
        first[1:] = (np.diff(anchor) != 0) | (np.diff(at) != 1)
        begin = np.flatnonzero(first)
        self.lo = at[begin]
        self.hi = at[np.append(begin[1:], len(at))[: len(begin)] - 1] if len(begin) else at
        a = anchor[begin]
        self.h = _stir(gram[a] + np.uint64(k)) & ~FLAGS
        span = prints.of(self.lo, self.hi + length) + (a - self.lo).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D) + (self.hi - self.lo).astype(np.uint64) * np.uint64(0x5851F42D4C957F2D)
        self.s = _stir(span) & ~FLAGS


def window_checks(data: np.ndarray, items: Items, length: int) -> np.ndarray:
    """A second fingerprint of each window, for the last round."""
    return _stir(Prints(data, 1).of(items.lo, items.lo + length)) & ~FLAGS


def combine(h: np.ndarray, s: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct h, each with one s and the flags that its rows add up to.

    With ``pairs`` rows are one only if s agrees too, and the order is by (h, s).
    """
    if not len(h):
        return h, s
    order = np.argsort(h, kind="stable")
    h, s = h[order], s[order]
    span = s & ~FLAGS
    new, other = np.append(True, h[1:] != h[:-1]), np.append(True, span[1:] != span[:-1])
    if pairs and (other & ~new).any():  # two fingerprints differ where one agrees
        order = np.lexsort((span, h))
        h, s, span = h[order], s[order], span[order]
        new = np.append(True, (h[1:] != h[:-1]) | (span[1:] != span[:-1]))
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(h)))
    flags = np.bitwise_or.reduceat(s & FLAGS, begin)
    varied = np.maximum.reduceat(span, begin) != np.minimum.reduceat(span, begin)
    flags |= np.where(size > 1, AGAIN, np.uint64(0)) | np.where(varied, VARIED, np.uint64(0))
    return h[begin], span[begin] | flags


class Family:
    """Sorted levels of distinct anchors; batches come in, like-sized neighbours merge."""

    def __init__(self, pairs: bool = False) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.pairs = pairs

    def add(self, h: np.ndarray, s: np.ndarray) -> None:
        h, s = combine(h, s, self.pairs)  # the batch's suffix array
        for old_h, old_s in self.levels:  # merge-scan: long matches mark both sides
            at, met = self._find(old_h, old_s, h, s)
            other = at[met]
            both = (old_s[other] | s[met]) & FLAGS | AGAIN
            both |= np.where((old_s[other] ^ s[met]) & ~FLAGS != 0, VARIED, np.uint64(0))
            old_s[other] |= both
            s[met] |= both
        if len(h):
            self.levels.append((h, s))
        while len(self.levels) > 1 and len(self.levels[-2][0]) <= 2 * len(self.levels[-1][0]):
            self._merge()

    def _find(self, old_h: np.ndarray, old_s: np.ndarray, h: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each anchor stands in a level, and whether it does."""
        end = max(len(old_h) - 1, 0)
        at = np.minimum(np.searchsorted(old_h, h), end)
        met = old_h[at] == h
        while self.pairs and (later := met & (old_s[at] & ~FLAGS < s & ~FLAGS) & (at < end)).any():
            at = at + later
            met = old_h[at] == h
        return at, met & (old_s[at] & ~FLAGS == s & ~FLAGS) if self.pairs else met

    def _merge(self) -> None:
        (a, x), (b, y) = self.levels[-2:]
        self.levels[-2:] = [combine(np.concatenate([a, b]), np.concatenate([x, y]), self.pairs)]

    def flags(self, h: np.ndarray, s: np.ndarray) -> np.ndarray:
        """Of anchors that have all been added before."""
        while len(self.levels) > 1:
            self._merge()
        if not self.levels:
            return np.zeros(len(h), np.uint64)
        all_h, all_s = self.levels[0]
        return all_s[self._find(all_h, all_s, h, s)[0]] & FLAGS


def _bucket_of(chunk: int, buckets: int) -> int:
    """The bucket Spark gives a long: Murmur3 with seed 42, its remainder not negative."""
    m = 0xFFFFFFFF
    h = 42
    for word in (chunk & m, chunk >> 32 & m):
        k = word * 0xCC9E2D51 & m
        k = (k << 15 | k >> 17) & m
        h ^= k * 0x1B873593 & m
        h = ((h << 13 | h >> 19) * 5 + 0xE6546B64) & m
    h ^= 8
    h = (h ^ h >> 16) * 0x85EBCA6B & m
    h = (h ^ h >> 13) * 0xC2B2AE35 & m
    h ^= h >> 16
    return (h - (1 << 32) if h >> 31 else h) % buckets


def chunked(docs: DataFrame, text_col: str, size: int = CHUNK) -> DataFrame:
    """A table of chunks (whole rows of ``docs`` in Arrow's format), bucketed by chunk number.

    A task numbers its chunks so that all fall into one bucket and so into one
    file; the numbers depend on the partition only and repeat in a new attempt.
    """
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        number, held, total = 0, [], 0

        def out() -> pa.RecordBatch:
            nonlocal number
            while _bucket_of(pid << NUMBER_BITS | number, buckets) != pid % buckets:
                number += 1
            if number >> NUMBER_BITS:
                raise OverflowError("too many chunks in a partition: read the table in more partitions")
            table = pa.Table.from_batches(held).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as writer:
                writer.write_table(table)
            row = pa.RecordBatch.from_arrays([pa.array([pid << NUMBER_BITS | number], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["chunk", "data"])
            number += 1
            return row

        for b in batches:
            begin = 0
            sizes = [len(x.as_buffer()) if x.is_valid else 0 for x in b.column(at).cast(pa.binary())]
            for i, n in enumerate(sizes):
                total += n + 64
                if total >= size:
                    held.append(b.slice(begin, i + 1 - begin))
                    yield out()
                    begin, held, total = i + 1, [], 0
            if begin < len(b):
                held.append(b.slice(begin))
        if held:
            yield out()

    small_batches(spark)
    name, path = f"chunks_{uuid.uuid4().hex}", f"{shared_dir(spark)}/chunks-{uuid.uuid4().hex}"
    rows = docs.mapInArrow(run, "chunk long, data binary")
    rows.write.bucketBy(buckets, "chunk").options(path=path, compression="zstd", **{"parquet.page.size.row.check.min": "4", "parquet.page.size.row.check.max": "4", "parquet.block.size.row.check.min": "4"}).saveAsTable(name)
    return spark.table(name)


def _unpack(blob: bytes, at: int) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """A chunk's rows, its texts' bytes end to end, and where each begins (and the last ends)."""
    table = pa.ipc.open_stream(blob).read_all()
    texts = [x or b"" for x in table.column(at).cast(pa.binary()).to_pylist()]
    return table, np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])


def _windows(size: int, edges: np.ndarray, length: int) -> np.ndarray:
    """Which positions start a window inside one text."""
    inside = np.zeros(max(size - length + 1, 0), bool)
    for a, b in zip(edges, edges[1:], strict=False):
        if b - a >= length:
            inside[a : b - length + 1] = True
    return inside


def replay(data: np.ndarray, edges: np.ndarray, answers: list[np.ndarray], rounds: tuple[int, ...], length: int) -> tuple[Prints, np.ndarray, np.ndarray]:
    """Windows known to repeat and windows still active after the answered rounds."""
    active = _windows(len(data), edges, length)
    repeats = np.zeros(len(active), bool)
    prints = Prints(data)
    for k, known in zip(rounds, answers, strict=False):
        if not active.any():
            break
        items = Items(prints, active, k, length)
        h = np.sort(known)
        base = h & ~FLAGS
        at = np.minimum(np.searchsorted(base, items.h), max(len(h) - 1, 0))
        flags = np.where(base[at] == items.h, h[at] & FLAGS, np.uint64(0)) if len(h) else np.zeros(len(items.h), np.uint64)
        more = np.zeros((2, len(active) + 1), np.int32)
        for row, some in enumerate((flags == AGAIN, flags & VARIED != 0)):
            more[row, items.lo[some]] += 1  # first windows are distinct, and so are last ones
            more[row, items.hi[some] + 1] -= 1
        found = np.cumsum(more, axis=1)[:, :-1] > 0
        repeats |= found[0]
        active = found[1]
    return prints, repeats, active


def _answers(row: dict, n: int) -> list[np.ndarray]:
    return [np.array(row[f"a{i}"] or (), np.int64).view(np.uint64) for i in range(n)]


def _round(chunks: DataFrame, at: int, done: int, rounds: tuple[int, ...], length: int, shards: int) -> DataFrame:
    """Index one round; per chunk its anchors that repeat, flags in the low bits."""
    k = rounds[done]
    pairs = k == length

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                _, data, edges = _unpack(row["data"], at)
                prints, _, active = replay(data, edges, _answers(row, done), rounds, length)
                if active.any():
                    items = Items(prints, active, k, length)
                    if pairs:
                        items.s = window_checks(data, items, length)
                    h, s = combine(items.h, items.s, pairs)
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(s.view(np.int64)), pa.array(np.full(len(h), row["chunk"], np.int64))], ["h", "s", "chunk"])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, kept, fresh, size = Family(pairs), [], [], 0
        for b in batches:
            h, s = (np.array(b.column(i), np.int64).view(np.uint64) for i in (0, 1))
            fresh.append((h, s))
            size += len(h)
            kept.append((h, s & ~FLAGS if pairs else h, b.column(2)))
            if size >= BATCH:
                family.add(*map(np.concatenate, zip(*fresh, strict=True)))
                fresh, size = [], 0
        if fresh:
            family.add(*map(np.concatenate, zip(*fresh, strict=True)))
        for h, s, chunk in kept:
            flags = family.flags(h, s)
            some = flags != 0
            yield pa.RecordBatch.from_arrays([chunk.filter(pa.array(some)), pa.array((h | flags)[some].view(np.int64))], ["chunk", "h"])

    spark = chunks.sparkSession
    small_batches(spark, 8192, 4 << 20)
    rows = chunks.mapInArrow(anchors, "h long, s long, chunk long").repartition(shards, "h")
    return rows.mapInArrow(index, "chunk long, h long").groupBy("chunk").agg(F.collect_list("h").alias(f"a{done}"))


def cut_repeats(docs: DataFrame, finish, schema: T.StructType | str, text_col: str = "text", length: int = LENGTH, rounds: tuple[int, ...] = ROUNDS, size: int = CHUNK) -> DataFrame:
    """Run all rounds and hand each chunk to ``finish(table, texts, removed)``.

    ``texts`` are the rows' bytes and ``removed`` a boolean array for each.
    """
    if rounds[-1] != length:
        raise ValueError("the last round must compare whole windows")
    at = docs.columns.index(text_col)
    known = chunks = chunked(docs, text_col, size)
    spark = docs.sparkSession
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), chunks.count() * size // SHARD)
    for done in range(len(rounds)):
        found = spool(_round(known, at, done, rounds, length, shards), f"anchors{done}")
        known = known.join(found.hint("shuffle_hash"), "chunk", "left")

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                table, data, edges = _unpack(row["data"], at)
                _, repeats, _ = replay(data, edges, _answers(row, len(rounds)), rounds, length)
                cover = np.zeros(len(data) + 1, np.int32)
                start = np.flatnonzero(repeats)
                cover[start] += 1
                cover[start + length] -= 1
                gone = np.cumsum(cover[:-1]) > 0
                spans = list(zip(edges[:-1], edges[1:], strict=True))
                yield from finish(table, [data[a:b] for a, b in spans], [gone[a:b] for a, b in spans])

    del chunks
    small_batches(spark, 8192, 4 << 20)
    return known.mapInArrow(last, schema)


def runs(mask: np.ndarray) -> int:
    return int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum())


def repeat_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""

    def finish(table: pa.Table, texts: list[np.ndarray], removed: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        rows = [(len(t), int(r.sum()), runs(r), hashlib.sha256(t[~r].tobytes()).hexdigest()) for t, r in zip(texts, removed, strict=True)]
        cols = list(zip(*rows, strict=True))
        ids = table.column(0).combine_chunks()
        arrays = [ids, *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return cut_repeats(id_text(docs), finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, text_col: str = "text", count_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with repeated passages cut from the text.

    A cut may fall inside a character; its left-over bytes go too.  ``count_col``
    is the text's length in characters and follows it.  Nulls stay null.
    """
    at = docs.columns.index(text_col)
    count_at = docs.columns.index(count_col) if count_col in docs.columns else None

    def finish(table: pa.Table, texts: list[np.ndarray], removed: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        valid = table.column(at).is_valid().to_pylist()
        kept = [t[~r].tobytes().decode("utf-8", "ignore") if v else None for t, r, v in zip(texts, removed, valid, strict=True)]
        out = table.set_column(at, text_col, pa.array(kept, pa.string()))
        if count_at is not None:
            was = table.column(count_at).to_pylist()
            now = [len(k) if k is not None and r.any() else w for k, r, w in zip(kept, removed, was, strict=True)]
            out = out.set_column(count_at, count_col, pa.array(now, table.schema.field(count_at).type))
        yield from out.combine_chunks().to_batches()

    return cut_repeats(docs, finish, docs.schema, text_col)


def op7_suffix_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_digest(documents(spark, sf_dir))
