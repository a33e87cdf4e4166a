"""Quality classifier: Bradley-Terry scores learnt from preference pairs.

Each text becomes a fixed vector of shares (byte classes, repeated words and
lines, capitals, lengths), expanded by hinges at quantiles of the training
rows.  A labelled good row is preferred to a labelled bad one; the weights
minimise the logistic loss of the feature differences of such pairs, and a
row's score is its weighted sum.  The score quantile of the training rows at
which a cut errs least becomes 0.7 of the reported scale.

Labels come from a bounded sample: at most ``TRAIN_ROWS`` labelled rows of
each class, taken by a hash of the id, and ``PAIRS`` pairs between them.
Everything else reads all rows and whole texts.

Defined cases: a null text is empty, and an empty text has the vector of
zeros; a null id is never held out and never labelled; labels that are null
or repeated with both values teach nothing; with one class alone (or none)
every score is 0.5; equal texts have equal scores.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents, id_text, small_batches

TRAIN_ROWS = 12_000
PAIRS = 40_000
CUT = 0.7
KNOTS = (0.02, 0.1, 0.3, 0.5, 0.7, 0.9, 0.98)
SLOPE = 2.0

_GROUPS = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b".", b",", b"!", b"?", b"|", b"#&$%*", b"<>{}[]()=;:/\\_+-@~^`'\""]
_MASKS = np.zeros((len(_GROUPS) + 1, 256))
for _i, _g in enumerate(_GROUPS):
    _MASKS[_i, list(_g)] = 1
_MASKS[-1, 128:] = 1
WIDTH = len(_MASKS) + 9


def features(text: bytes | None) -> np.ndarray:
    """A fixed vector of a whole text, in one pass over its bytes, words and lines."""
    out = np.zeros(WIDTH, np.float32)
    if not text:
        return out
    n = len(_MASKS)
    out[:n] = _MASKS @ np.bincount(np.frombuffer(text, np.uint8), minlength=256) / len(text)
    words = text.split()
    if words:
        m = len(words)
        again = [a == b for a, b in zip(words, words[1:], strict=False)]
        lengths = np.fromiter(map(len, words), np.int64, m)
        out[n] = sum(again) / m
        out[n + 1] = len(set(words)) / m
        out[n + 2] = sum(map(bytes.isupper, words)) / m
        out[n + 3] = min(lengths.mean(), 50) / 10
        out[n + 4] = (lengths == 1).mean()
        out[n + 5] = math.log1p(m)
        out[n + 6] = sum(map(bytes.isalpha, words)) / m
    lines = text.split(b"\n")
    out[n + 7] = 1 - len(set(lines)) / len(lines)
    out[n + 8] = math.log1p(len(text) / len(lines))
    return out


class Ranker:
    """Hinge expansion, weights, and the cut with its slope."""

    def __init__(self, x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, seed: int = 11):
        self.knots = np.quantile(x, KNOTS, axis=0) if len(x) else np.zeros((len(KNOTS), WIDTH))
        self.scale = np.ones(WIDTH * (len(KNOTS) + 1))
        self.weights, self.cut = np.zeros(len(self.scale)), None
        good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        if not len(good) or not len(bad):
            return
        wide = self._widen(x)
        self.scale = np.maximum(wide.std(axis=0), 1e-6)
        wide /= self.scale
        rng = np.random.default_rng(seed)
        a, b = rng.choice(good, pairs), rng.choice(bad, pairs)
        self.weights = self._fit(wide[a] - wide[b])
        score = wide @ self.weights
        order = np.argsort(score, kind="stable")
        bad_below = np.concatenate([[0], np.cumsum(y[order] == 0)])
        right = bad_below + (len(good) - (np.arange(len(y) + 1) - bad_below))  # of a cut below each rank
        rank = int(np.median(np.flatnonzero(right == right.max())))
        low, high = max(rank - 1, 0), min(rank, len(y) - 1)
        self.quantile = rank / len(y)
        self.cut = float((score[order[low]] + score[order[high]]) / 2)

    def _widen(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x, *(np.maximum(x - k, 0) for k in self.knots)], axis=1).astype(np.float64)

    @staticmethod
    def _fit(diff: np.ndarray, ridge: float = 1e-3, steps: int = 12) -> np.ndarray:
        """Newton steps on the mean of log(1 + exp(-w d)) over the pairs' differences d."""
        w = np.zeros(diff.shape[1])
        for _ in range(steps):
            p = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))
            grad = -(diff * p[:, None]).mean(0) + ridge * w
            curve = (diff * (p * (1 - p))[:, None]).T @ diff / len(diff) + ridge * np.eye(len(w))
            step = np.linalg.solve(curve, grad)
            w -= step * min(1, 5 / max(np.abs(step).max(), 1e-9))
        return w

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.cut is None:
            return np.full(len(x), 0.5)
        raw = self._widen(x) / self.scale @ self.weights - self.cut
        return 1 / (1 + np.exp(-np.clip(SLOPE * raw / 2 + math.log(CUT / (1 - CUT)), -30, 30)))


def labelled_sample(labels: DataFrame, label: str, hold: Column, most: int) -> DataFrame:
    """doc_id and y of at most about ``most`` training rows of each class, chosen by a hash of the id."""
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .filter(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("z")).filter("y = z").select("doc_id", "y").filter(~hold)
    )
    sizes = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    unit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.when(F.col("y") == 1, F.lit(most / max(sizes.get(1, 0), 1))).otherwise(F.lit(most / max(sizes.get(0, 0), 1)))
    return known.filter(unit < share)


def hold_out(mod: int, rest: int) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod == rest, F.lit(False))


def train_ranker(docs: DataFrame, labels: DataFrame, hold: Column, most: int = TRAIN_ROWS) -> Ranker:
    """Fit on the bounded sample, the only rows whose features are computed for it."""
    sample = labelled_sample(labels, "quality", hold, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [features(t).tobytes() for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary()), b.column(2)], ["doc_id", "x", "y"])

    small_batches(docs.sparkSession)
    rows = id_text(docs).join(F.broadcast(sample), "doc_id")  # at most about 2 * most ids
    got = rows.select("doc_id", "text", "y").mapInArrow(run, "doc_id long, x binary, y int").toArrow()
    x = np.frombuffer(b"".join(got["x"].to_pylist()), np.float32).reshape(-1, WIDTH)
    ids, y = np.array(got["doc_id"].to_pylist(), np.int64), np.array(got["y"].to_pylist(), np.int64)
    order = np.lexsort((*x.T, y, ids))
    return Ranker(x[order], y[order])


def score_quality(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(train_ranker(docs, labels, hold_out(4, 2), most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t) for t in b.column(1).cast(pa.binary()).to_pylist()], np.float32).reshape(-1, WIDTH)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.scores(x), pa.float64())], ["doc_id", "score"])

    small_batches(docs.sparkSession)
    scored = id_text(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", hold_out(4, 2).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def quality_filter(docs: DataFrame, labels: DataFrame, text_col: str = "text", most: int = TRAIN_ROWS) -> DataFrame:
    """Rows of ``docs``, all columns as they are, whose text scores at least the cut.

    Null and empty texts have the score of an empty text; repeated rows stay or
    go together; without labels of both classes nothing is rejected.
    """
    ranker = train_ranker(docs, labels, hold_out(4, 2), most)
    if ranker.cut is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(ranker)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t) for t in b.column(at).cast(pa.binary()).to_pylist()], np.float32).reshape(-1, WIDTH)
            yield b.filter(pa.array(shared.value.scores(x) >= CUT))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def op5_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
