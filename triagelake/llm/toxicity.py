"""Toxicity by class-conditional Kneser-Ney models.

A toxic and an ordinary model give each word the probability of its letters
(up to ``ORDER - 1`` earlier bytes and the word's start as context).  Their
discounted counts are their own; what the discounts leave goes to one backoff
distribution of continuation counts shared by both, so an expression that
neither has seen often speaks for neither.  A text's log-likelihoods are
divided by its number of words; the difference, its strongest words and its
length enter a logistic curve that turns it into a probability.

A word of more than ``SEGMENT`` bytes is read in segments.  Each keeps the last
``ORDER - 1`` bytes of the one before as context, so every letter has the
probability it has in the whole word; each segment is a word in the evidence.

Counts come from a bounded sample: at most ``TRAIN_ROWS`` labelled rows of
each class, by a hash of the id; one row in ``HOLD`` of them sets the curve.
Executors sum letters in context; only distinct ones reach the driver, as
arrays, and one broadcast serves both the curve and the scores.
Scoring reads all rows and whole texts.

Defined cases: a null or empty text has no words and takes the curve's value
at zero evidence; repeated rows score alike; labels that are null, or both
values for one id, teach nothing; with one class alone every score is 0
(or 1, if that class is the toxic one); without labels 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents, id_text, small_batches, spool
from .quality import hold_out, labelled_sample

TRAIN_ROWS = 8_000
HOLD = 4
ORDER = 8
DISCOUNT = 0.75
SEGMENT = 64  # bytes of a word that are one piece of evidence; longer words are several
MORE = b"\n"  # where a segment's word goes on; no word holds it
CACHE = 400_000
FLUSH = 100_000  # distinct words that a task counts before it hands on sums
EDGE = b"#&$%*!|.,;:()[]{}<>\"'?-_/\\=+~^`@"
INPUTS = 8


def _mix(h: np.ndarray, byte: np.ndarray) -> np.ndarray:
    return (h ^ byte.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each letter (a word's end included): its word, hash of context, hash of context and letter, short code.

    The short code is two bytes of context and the letter.  A segment's
    context and marks are no letters.
    """
    size = np.fromiter((len(w) for w in words), np.int64, len(words)) + 1
    owner = np.repeat(np.arange(len(words)), size)
    flat = np.frombuffer(b"".join([w + b"\n" for w in words]), np.uint8)
    start = np.repeat(np.cumsum(size) - size, size)
    at = np.arange(len(flat))
    context = np.full(len(flat), np.uint64(0x51ED270B), np.uint64)
    for back in range(ORDER - 1, 0, -1):
        there = at - back
        byte = np.where(there >= start, flat[np.maximum(there, 0)], np.where(there == start - 1, 32, 0))
        context = _mix(context, byte)
    one = np.where(at - 1 >= start, flat[np.maximum(at - 1, 0)], 32).astype(np.int64)
    two = np.where(at - 2 >= start, flat[np.maximum(at - 2, 0)], 32).astype(np.int64)
    full, short = _mix(context, flat), (two << 16) | (one << 8) | flat
    skip = np.fromiter((ORDER if w.startswith(MORE) else 0 for w in words), np.int64, len(words))
    drop = np.fromiter((2 if w.endswith(MORE) else 0 for w in words), np.int64, len(words))
    if skip.any() or drop.any():
        inside = at - start
        keep = (inside >= skip[owner]) & (inside < (size - drop)[owner])
        return owner[keep], context[keep], full[keep], short[keep]
    return owner, context, full, short


class _Table:
    """Sorted keys with columns of values; absent keys have zeros."""

    def __init__(self, keys: np.ndarray, *columns: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.columns = keys[order], [c[order].astype(np.float32) for c in columns]

    def get(self, keys: np.ndarray) -> list[np.ndarray]:
        if not len(self.keys):
            return [np.zeros(len(keys), np.float32) for _ in self.columns]
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        met = self.keys[at] == keys
        return [np.where(met, c[at], np.float32(0)) for c in self.columns]


def gram_counts(words: list[bytes], toxic: np.ndarray, ordinary: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each distinct letter in its context: hash, hash of the context, short code, and its counts by class."""
    owner, context, full, short = grams(words)
    found, first, inverse = np.unique(full, return_index=True, return_inverse=True)
    n0, n1 = (np.bincount(inverse, n[owner], len(found)).astype(np.int64) for n in (ordinary, toxic))
    return found.view(np.int64), context[first].view(np.int64), short[first], n0, n1


class ClassModels:
    """Both Kneser-Ney models; ``ratio`` is log P(word | toxic) - log P(word | ordinary).

    Built from sums: ``own`` has a letter's hash and its count in either class,
    ``contexts`` a context's hash with the classes' totals and what their
    discounts free, ``short`` a short code and in how many longer contexts of
    either class it stands.
    """

    def __init__(self, own: tuple[np.ndarray, ...], contexts: tuple[np.ndarray, ...], short: tuple[np.ndarray, ...]):
        self.own = _Table(own[0], *(np.maximum(n - DISCOUNT, 0) for n in own[1:]))
        self.contexts = _Table(*contexts)
        keys, n = short
        first, at = np.unique(keys >> 8, return_inverse=True)
        total = np.bincount(at, n, len(first))
        self.letter = np.bincount(keys & 255, minlength=256) + 0.5
        self.letter = self.letter / self.letter.sum()
        self.free = _Table(first, np.bincount(at, np.minimum(n, DISCOUNT), len(first)) / np.maximum(total, 1))
        self.short = _Table(keys, np.maximum(n - DISCOUNT, 0) / np.maximum(total[at], 1))

    @staticmethod
    def of_words(words: list[bytes], toxic: np.ndarray, ordinary: np.ndarray) -> ClassModels:
        """From words and in how many texts of each class they stand."""
        full, context, short, n0, n1 = gram_counts(words, toxic, ordinary)
        keys, at = np.unique(context, return_inverse=True)
        sums = [np.bincount(at, x, len(keys)) for x in (n0, np.minimum(n0, DISCOUNT), n1, np.minimum(n1, DISCOUNT))]
        return ClassModels((full, n0, n1), (keys, *sums), np.unique(short, return_counts=True))

    def letters(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each letter its word and its log-probability under the ordinary and the toxic model."""
        owner, context, full, short = grams(words)
        (left,), (seen,) = self.free.get(short >> 8), self.short.get(short)
        shared = seen + np.where(left > 0, left, 1) * self.letter[short & 255]
        n0, n1 = self.own.get(full.view(np.int64))
        all0, free0, all1, free1 = self.contexts.get(context.view(np.int64))
        logs = [np.log(np.where(t > 0, (n + f * shared) / np.maximum(t, 1e-9), shared)) for n, t, f in ((n0, all0, free0), (n1, all1, free1))]
        return owner, logs[0], logs[1]

    def ratio(self, words: list[bytes]) -> np.ndarray:
        if not words:
            return np.zeros(0)
        owner, ordinary, toxic = self.letters(words)
        return np.bincount(owner, toxic - ordinary, len(words))


def core(token: bytes) -> bytes:
    """A word without signs at its edges."""
    return token.strip(EDGE)


def pieces(token: bytes) -> list[bytes]:
    """A word, or the segments of a long one: a mark and context first if it began before, a mark last if it goes on."""
    if len(token) <= SEGMENT:
        return [token]
    word = core(token)
    out = []
    for at in range(0, max(len(word), 1), SEGMENT):
        before = MORE + word[at - ORDER + 1 : at] if at else b""
        out.append(before + word[at : at + SEGMENT] + (MORE if at + SEGMENT < len(word) else b""))
    return out


def pieces_of(text: bytes | None) -> list[bytes]:
    return [p for w in (text or b"").lower().split() for p in pieces(w)]


def evidence(models: ClassModels, texts: list[bytes | None], cache: dict[bytes, float]) -> np.ndarray:
    """Inputs of the curve for each text: length-normalised difference, strongest words, length."""
    split = [pieces_of(t) for t in texts]
    if len(cache) > CACHE:
        cache.clear()
    fresh = list({w for ws in split for w in ws} - cache.keys())
    for at in range(0, len(fresh), 20_000):
        some = fresh[at : at + 20_000]
        cache.update(zip(some, models.ratio([core(w) for w in some]).tolist(), strict=True))
    out = np.zeros((len(texts), INPUTS))
    for i, words in enumerate(split):
        if not words:
            continue
        each = np.array([cache[w] for w in set(words)])
        top = np.sort(each)[-8:][::-1]
        top = np.clip(np.concatenate([top, np.zeros(8 - len(top))]), -2, 12)
        mean = sum(map(cache.__getitem__, words)) / len(words)
        out[i] = mean, top[0], top[1], top[2], top[3:5].mean(), top[5:].mean(), np.log1p((each > 4).sum()) - 0.5 * math.log1p(len(each)), math.log1p(len(each))
    return out


class Curve:
    """Logistic regression with a ridge, in standard units."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1e-3):
        self.mean, self.std = x.mean(0), np.maximum(x.std(0), 1e-6)
        z = self._units(x)
        self.w = np.zeros(z.shape[1])
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
            curve = (z * (p * (1 - p))[:, None]).T @ z / len(z) + ridge * np.eye(len(self.w))
            step = np.linalg.solve(curve, z.T @ (p - y) / len(z) + ridge * self.w)
            self.w -= step * min(1, 3 / max(np.abs(step).max(), 1e-9))

    def _units(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.std
        return np.concatenate([np.ones((len(z), 1)), z, np.clip(z, 0, None) ** 2 / 4], axis=1)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._units(x) @ self.w, -30, 30)))


COUNTED = "own long, context long, short long, n0 long, n1 long"


def _counted(rows: DataFrame) -> DataFrame:
    """Letters in context of the texts ``(text, y)`` with their counts by class (texts with the word), summed over all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            words, n = list(seen), np.array(list(seen.values()), np.int64).reshape(-1, 2)
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in gram_counts(words, n[:, 1], n[:, 0])], ["own", "context", "short", "n0", "n1"])

        seen: dict[bytes, list[int]] = {}
        for b in batches:
            for t, y in zip(b.column(0).cast(pa.binary()).to_pylist(), b.column(1).to_pylist(), strict=True):
                for w in {core(w) for w in pieces_of(t)}:
                    seen.setdefault(w, [0, 0])[y] += 1
            if len(seen) > FLUSH:
                yield out()
        if seen:
            yield out()

    small_batches(rows.sparkSession)
    letters = rows.select("text", "y").mapInArrow(run, COUNTED)
    return letters.groupBy("own").agg(F.min("context").alias("context"), F.min("short").alias("short"), F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _columns(df: DataFrame) -> tuple[np.ndarray, ...]:
    table = df.toArrow()
    return tuple(c.to_numpy() for c in table.columns)


def build_models(rows: DataFrame) -> ClassModels | None:
    """Models of the texts ``(text, y)``; sums are made on executors, and none with one class alone."""
    counted = spool(_counted(rows), "letters")
    totals = counted.agg(F.sum("n0"), F.sum("n1")).first()
    if not totals[0] or not totals[1]:
        return None
    sums = [f(c) for c in ("n0", "n1") for f in (F.sum, lambda c: F.sum(F.least(F.col(c).cast("double"), F.lit(DISCOUNT))))]
    contexts = _columns(counted.groupBy("context").agg(*(s.cast("double").alias(f"s{i}") for i, s in enumerate(sums))))
    short = _columns(counted.groupBy("short").agg(F.count(F.lit(1)).alias("n")))
    return ClassModels(_columns(counted.select("own", F.col("n0").cast("float").alias("n0"), F.col("n1").cast("float").alias("n1"))), contexts, short)


def train_models(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> tuple[Broadcast | None, Curve | float]:
    """Models from one part of the sample, already broadcast, and the curve from its other part."""
    sample = labelled_sample(labels, "toxic", hold_out(5, 0), most)
    part = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(5)), F.lit(HOLD)) == 0
    rows = id_text(docs).join(F.broadcast(sample), "doc_id")  # at most about 2 * most ids
    models = build_models(rows.filter(~part))
    if models is None:
        return None, float(bool(sample.filter(~part & (F.col("y") == 1)).head(1)) and not sample.filter(~part & (F.col("y") == 0)).head(1))
    shared = docs.sparkSession.sparkContext.broadcast(models)
    del models

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, float] = {}
        for b in batches:
            x = evidence(shared.value, b.column(1).cast(pa.binary()).to_pylist(), cache)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in x], pa.binary()), b.column(2)], ["doc_id", "x", "y"])

    small_batches(docs.sparkSession)
    got = rows.filter(part).select("doc_id", "text", "y").mapInArrow(measure, "doc_id long, x binary, y int").toArrow()
    x, y = np.frombuffer(b"".join(got["x"].to_pylist()), np.float64).reshape(-1, INPUTS), got["y"].to_numpy().astype(float)
    order = np.lexsort(x.T)
    if len(set(y.tolist())) < 2:
        return shared, float(np.mean(y)) if len(y) else 0.0
    return shared, Curve(x[order], y[order])


def score_toxicity(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    shared, curve = train_models(docs, labels, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, float] = {}
        for b in batches:
            if isinstance(curve, float):
                scores = np.full(len(b), curve)
            else:
                scores = curve(evidence(shared.value, b.column(1).cast(pa.binary()).to_pylist(), cache))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    small_batches(docs.sparkSession)
    scored = id_text(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", hold_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
