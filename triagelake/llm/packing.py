"""Variable-capacity best-fit packing of texts into training sequences.

A sequence of length c costs ``c + charge + c * c / quadratic``: its tokens
(padding too), a fixed charge, and attention, which grows with the square.
Texts are cut into pieces of at most the largest permitted length.  Inside a
group, longest first, a piece goes to the open bin that it fills best; if none
has room, a bin opens, of the permitted length with the least cost for each
token that the piece and the group's remaining pieces put into it (longest
first).  At the end each bin shrinks to the smallest permitted length that
still holds its contents.  A group is packed so for every lower limit of the
lengths that may open, and the cheapest of these packings is taken.

Groups come from a hash of the row and its number and hold about
``GROUP_PIECES`` pieces each however many rows there are, repeated rows too.
A task reads its pieces sorted by group, one group at a time, so its memory
has a bound; each group can leave only its last bins less than full.

Defined cases: a null or empty text is its end token alone, one piece; a text
of any length is packed whole, in pieces; repeated rows are packed once each;
an empty table gives no row.  Pieces of equal length go by id, then by number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents, small_batches, spool

CAPACITIES = (256, 512, 1024, 2048, 4096)
CHARGE = 64
QUADRATIC = 16_384
GROUP_PIECES = 20_000


def word_tokens(text: str = "text") -> Column:
    """Tokens of a text: its words and one end token."""
    return (F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")) + 1).cast("long")


def cost_of(length: int, charge: float = CHARGE, quadratic: float = QUADRATIC) -> float:
    return length + charge + length * length / quadratic


class _Rest:
    """How many pieces of each length are left; a bit set of the lengths finds the longest that fits."""

    def __init__(self, lengths: np.ndarray):
        self.count = np.bincount(lengths).tolist()
        self.bits = sum(1 << n for n in np.unique(lengths).tolist())

    def take(self, n: int) -> None:
        self.count[n] -= 1
        if not self.count[n]:
            self.bits ^= 1 << n

    def fills(self, room: int) -> int:
        """Tokens that go into ``room``, longest pieces first."""
        got, under = 0, room
        while room and (fit := self.bits & ((1 << min(room, under) + 1) - 1)):
            n = fit.bit_length() - 1
            many = min(self.count[n], room // n)
            got, room, under = got + many * n, room - many * n, n - 1
        return got


def _packed(lengths: list[int], opens: list[int], sizes: list[int], cost: dict[int, float]) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each piece and final lengths, where only bins of ``opens`` may open.

    Open bins stand in stacks by room; a bit set of the rooms in use finds the
    least room that is enough.
    """
    rest = _Rest(np.array(lengths))
    rooms: list[list[int]] = [[] for _ in range(sizes[-1] + 1)]
    used, inside, bins, offsets = 0, [], [], []
    for n in lengths:
        rest.take(n)
        enough = used >> n
        if enough:
            room = n + (enough & -enough).bit_length() - 1
            at = rooms[room].pop()
            if not rooms[room]:
                used &= ~(1 << room)
        else:
            room = min((c for c in opens if c >= n), key=lambda c: (cost[c] / (n + rest.fills(c - n)), c))
            at = len(inside)
            inside.append(0)
        bins.append(at)
        offsets.append(inside[at])
        inside[at] += n
        if room > n:
            rooms[room - n].append(at)
            used |= 1 << (room - n)
    return bins, offsets, [next(c for c in sizes if c >= x) for x in inside]


def pack(lengths: np.ndarray, capacities: tuple[int, ...] = CAPACITIES, charge: float = CHARGE, quadratic: float = QUADRATIC) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Bin and offset of each piece (given longest first), and each bin's final length."""
    sizes, pieces_ = sorted(capacities), lengths.tolist()
    cost = {c: cost_of(c, charge, quadratic) for c in sizes}
    made = [_packed(pieces_, sizes[i:], sizes, cost) for i in range(len(sizes))]
    bins, offsets, final = min(made, key=lambda x: sum(cost[c] for c in x[2]))
    return np.array(bins, np.int64), np.array(offsets, np.int64), final


def pieces(docs: DataFrame, largest: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, first_token, n_tokens and a hash that spreads the rows, equal ones too."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), word_tokens(text_col).alias("n"), F.xxhash64(id_col, F.monotonically_increasing_id()).alias("spread"))
    parts = rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / largest))))
    return parts.select("doc_id", "piece", (F.col("piece") * largest).alias("first_token"), F.least(F.lit(largest).cast("long"), F.col("n") - F.col("piece") * largest).alias("n_tokens"), F.xxhash64("spread", "piece").alias("spread"))


PACKED = "doc_id long, piece long, first_token long, n_tokens long, bin long, bin_offset long, capacity long"


def _by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one group after the other, from batches sorted by ``grp``."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        edges = np.flatnonzero(np.diff(np.array(b["grp"]))) + 1
        for lo, hi in zip([0, *edges], [*edges, len(b)], strict=True):
            part = b.slice(lo, hi - lo)
            if held and len(part) and held[0]["grp"][0] != part["grp"][0]:
                yield pa.Table.from_batches(held)
                held = []
            if len(part):
                held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def pack_documents(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, charge: float = CHARGE, quadratic: float = QUADRATIC, group_pieces: int = GROUP_PIECES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Where each piece of each row stands: bin, offset, and the bin's final length."""
    made = spool(pieces(docs, max(capacities), id_col, text_col), "pieces")
    groups = made.count() // group_pieces + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_group(batches):
            bins, offsets, final = pack(np.array(table["n_tokens"]), capacities, charge, quadratic)
            columns = [*(table[c].combine_chunks() for c in ("doc_id", "piece", "first_token", "n_tokens")), pa.array(bins + (table["grp"][0].as_py() << 32)), pa.array(offsets), pa.array(np.array(final, np.int64)[bins])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "first_token", "n_tokens", "bin", "bin_offset", "capacity"])

    small_batches(docs.sparkSession, 8192)
    grouped = made.withColumn("grp", F.pmod("spread", F.lit(groups))).drop("spread")
    dealt = grouped.repartition(groups, "grp") if groups < int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) else grouped.repartition("grp")
    return dealt.sortWithinPartitions("grp", F.desc("n_tokens"), "doc_id", "piece").mapInArrow(run, PACKED)


def op8_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
