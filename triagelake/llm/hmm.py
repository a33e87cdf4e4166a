"""Hidden Markov language model trained by Baum-Welch over all partitions.

1. Word counts of all training texts are aggregated (in each task first, then
   by word).  The commonest words, at most ``HEAD`` of them, are the only part
   that is broadcast; counts of all other words stay in a distributed table
   and meet the texts by an equi-join on the word.
2. Each word emits through a class: the commonest ``SINGLES`` words are classes
   of their own, every other word falls into one of ``SUFFIXES`` classes by its
   last bytes, inside which it has its smoothed relative frequency.
3. States, transitions and class emissions come from Baum-Welch.  From
   random starting values, each of ``ROUNDS`` passes over all training rows and
   whole texts accumulates expected counts in every partition, sums them by
   class, and re-estimates on the driver (at most SINGLES + SUFFIXES rows).
   Texts go as spans of ``TRAIN_SPAN`` tokens, whose states are settled by
   ``LAG`` tokens on both sides, so a long text is one chain up to what a state
   still tells beyond ``LAG`` tokens.
4. A scaled forward recursion gives the exact likelihood.  Texts beyond
   ``SPAN`` tokens go as several spans: one vector for the first, one matrix
   (a lane for each starting state) for others, multiplied in order, which is
   the same recursion.

Defined cases: a null or empty text is the end token alone; repeated rows
count each time; an empty training set leaves uniform counts (N = 0, V = 0);
texts of any length are scored whole.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents, id_text, small_batches, spool

STATES = 8
ROUNDS = 14
HEAD = 1 << 17
SINGLES = 4096
SUFFIXES = 1024
SUFFIX_BYTES = 3
SPAN = 1024
TRAIN_SPAN, LAG = 512, 24
TOKENS_AT_ONCE = 800_000
FLUSH = 200_000
END = b""


def held_out(mod: int, rest: int, id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % mod == rest, F.lit(False))


def tokens_of(text: bytes | None) -> list[bytes]:
    words = (text or b"").lower().split()
    words.append(END)
    return words


def word_counts(docs: DataFrame) -> DataFrame:
    """word (binary) and its count c over all rows; the end token is the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "c"])
            seen.clear()
            return made

        seen: Counter[bytes] = Counter()
        for b in batches:
            for t in b.column(1).cast(pa.binary()).to_pylist():
                seen.update(tokens_of(t))
            if len(seen) > FLUSH:
                yield out()
        yield out()

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Vocabulary:
    """Totals, the head words and the class sums; of bounded size."""

    def __init__(self, n: int, v: int, head: list[tuple[bytes, int]], suffix: dict[int, tuple[int, int]]):
        self.n, self.v = n, v
        self.log_d = math.log10(n + 0.5 * (v + 1))
        self.words = [w for w, _ in head]
        self.counts = np.array([c for _, c in head], np.float64)
        singles = min(SINGLES, len(head))
        self.cls = np.array([i if i < singles else suffix_class(w) for i, (w, _) in enumerate(head)], np.int32)
        self.sums = np.zeros((SUFFIXES, 2))
        for k, (c, m) in suffix.items():
            self.sums[k] = c, m
        for w, c in head[:singles]:  # these have classes of their own
            self.sums[suffix_class(w) - SINGLES] -= c, 1
        self.class_log = np.log10(self.sums[:, 0] + 0.5 * (self.sums[:, 1] + 1))
        base = np.log10(self.counts + 0.5)
        self.base = base - self.log_d
        self.within = np.where(np.arange(len(head)) < singles, 0.0, base - self.class_log[np.maximum(self.cls - SINGLES, 0)])
        weight = np.zeros(SINGLES + SUFFIXES)
        weight[:singles] = self.counts[:singles]
        weight[SINGLES:] = self.sums[:, 0]
        self.unigram = (weight + 0.5) / (weight + 0.5).sum()

    def index(self) -> dict[bytes, int]:
        return {w: i for i, w in enumerate(self.words)}


def suffix_class(word: bytes) -> int:
    return SINGLES + zlib.crc32(word[-SUFFIX_BYTES:]) % SUFFIXES


def vocabulary(counts: DataFrame, head: int = HEAD) -> Vocabulary:
    level = F.floor(F.log2(F.col("c").cast("double")) * 16)
    hist = counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("m"), F.sum("c").alias("n")).collect()
    total, kept, cut = 0, 0, None
    for r in sorted(hist, key=lambda r: -r["level"]):
        total += r["m"]
        if total > head:
            break
        kept, cut = total, r["level"]
    rows = counts.filter(level >= cut).collect() if kept else []
    rows = sorted(((bytes(r["word"]), r["c"]) for r in rows), key=lambda x: (-x[1], x[0]))
    suffix = F.expr(f"crc32(CASE WHEN octet_length(word) > {SUFFIX_BYTES} THEN substring(word, -{SUFFIX_BYTES}, {SUFFIX_BYTES}) ELSE word END)") % SUFFIXES
    sums = counts.groupBy(suffix.cast("int").alias("k")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("m")).collect()
    return Vocabulary(sum(r["n"] for r in hist), sum(r["m"] for r in hist), rows, {r["k"]: (r["c"], r["m"]) for r in sums})


CODED = (
    "uid long, doc_id long, held_out boolean, n_tokens long, known long, base double, within double,"
    " codes binary, tail_words array<binary>, tail_counts array<long>"
)


def encode(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Class codes of each text, its sums over head words, and its other words with their numbers."""
    shared = docs.sparkSession.sparkContext.broadcast(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = shared.value
        find = voc.index().get
        uid = TaskContext.get().partitionId() << 33  # the same in a repeated task
        for b in batches:
            out: list[tuple] = []
            for t in b.column(1).cast(pa.binary()).to_pylist():
                words = tokens_of(t)
                at = np.array([find(w, -1) for w in words], np.int64)
                rare = np.flatnonzero(at < 0)
                in_head = at[at >= 0] if len(rare) else at
                codes = voc.cls[at].astype(np.uint16) if len(voc.cls) else np.zeros(len(at), np.uint16)
                tail: dict[bytes, int] = {}
                for i in rare.tolist():
                    w = words[i]
                    codes[i] = suffix_class(w)
                    tail[w] = tail.get(w, 0) + 1
                out.append((uid, len(words), len(in_head), float(voc.base[in_head].sum()), float(voc.within[in_head].sum()), codes.tobytes(), list(tail), list(tail.values())))
                uid += 1
            cols = list(zip(*out, strict=True)) or [()] * 8
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64())]
            arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([arrays[0], b.column(0), b.column(2), *arrays[1:]], ["uid", "doc_id", "held_out", "n_tokens", "known", "base", "within", "codes", "tail_words", "tail_counts"])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text", "held_out").mapInArrow(run, CODED)


class Model:
    """start (K), move (K x K) and emit (classes x K); rows of move and columns of emit sum to 1."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @staticmethod
    def first(unigram: np.ndarray, states: int = STATES, seed: int = 7) -> Model:
        rng = np.random.default_rng(seed)
        emit = unigram[:, None] * (0.2 + rng.random((len(unigram), states)) ** 2)
        move = np.full((states, states), 0.2 / states) + np.eye(states) * 0.8
        return Model(np.full(states, 1 / states), move, emit / emit.sum(0))

    def refit(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray, unigram: np.ndarray) -> Model:
        """Maximisation, with a little of the unigram model in every state."""
        start, move = start + 0.1, move + 0.1
        emit = emit + unigram[:, None] * (1 + 0.001 * emit.sum(0))
        return Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def _lanes(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Time-major codes of sequences by falling length, lanes alive at each step, and the order."""
    size = np.array([len(s) for s in seqs])
    order = np.argsort(-size, kind="stable")
    codes = np.zeros((int(size.max()), len(seqs)), np.int32)
    for lane, i in enumerate(order):
        codes[: size[i], lane] = seqs[i]
    alive = np.searchsorted(-size[order], -np.arange(codes.shape[0]), side="left")
    return codes, alive, order


def _stationary(move: np.ndarray) -> np.ndarray:
    at = np.full(len(move), 1 / len(move))
    for _ in range(64):
        at = at @ move
    return at / at.sum()


def expected(model: Model, texts: list[np.ndarray], span: int = TRAIN_SPAN, lag: int = LAG) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts of starts, moves and emissions by a scaled forward-backward pass.

    Texts go side by side as spans.  A span also reads the ``lag`` tokens
    before and after it, which settle its states but count only in their own
    spans; so each token, move and start of a text counts once.
    """
    k, flat = len(model.start), np.concatenate(texts).astype(np.int64)
    ends = np.cumsum([len(t) for t in texts])
    low, high, lo, hi = (np.array(x) for x in zip(*((max(a - lag, e - len(t)), min(a + span + lag, e), a, min(a + span, e)) for t, e in zip(texts, ends, strict=True) for a in range(e - len(t), e, span)), strict=True))
    order = np.argsort(low - high, kind="stable")
    low, lo, hi, size = low[order], lo[order], hi[order], (high - low)[order]
    alive = np.searchsorted(-size, -np.arange(size[0]), side="left")
    at = np.concatenate([[0], np.cumsum(alive)])
    move, back = model.move.T.astype(np.float32).copy(), model.move.astype(np.float32)
    step = np.repeat(np.arange(len(alive)), alive)
    lane = np.arange(at[-1]) - at[step]
    place = low[lane] + step
    counted = ((place >= lo[lane]) & (place < hi[lane])).astype(np.float32)
    codes = flat[place]
    ahead_of = np.ascontiguousarray(model.emit.astype(np.float32).take(codes, axis=0).T)
    alpha = np.empty_like(ahead_of)
    first = np.isin(low, np.concatenate([[0], ends[:-1]]))
    now = np.where(first, model.start[:, None], _stationary(model.move)[:, None]).astype(np.float32)
    for t, m in enumerate(alive):
        here = slice(at[t], at[t + 1])
        now = move @ now[:, :m] if t else now
        now *= ahead_of[:, here]
        now /= now.sum(0)
        alpha[:, here] = now
    beta, pairs = np.ones((k, len(size)), np.float32), np.zeros((k, k))
    for t in range(len(alive) - 2, -1, -1):
        m = alive[t + 1]
        here, after = slice(at[t], at[t] + m), slice(at[t + 1], at[t + 2])
        ahead = ahead_of[:, after]
        ahead *= beta[:, :m]
        new = back @ ahead
        was = alpha[:, here]
        both = was * new
        scale = 1 / both.sum(0)
        pairs += (was * (scale * counted[after])) @ ahead.T
        np.multiply(both, scale, out=was)
        np.multiply(new, scale, out=beta[:, :m])
    start = alpha[:, : len(size)][:, first & (lo == low)].sum(1, dtype=np.float64)
    alpha *= counted
    emit = np.stack([np.bincount(codes, a, len(model.emit)) for a in alpha], axis=1)
    return start, pairs * model.move, emit


def log10_likelihoods(model: Model, texts: list[np.ndarray], span: int = SPAN) -> np.ndarray:
    """Exact log10 likelihood of each code sequence."""
    k = len(model.start)
    seqs, begin, owner = [], [], []
    for i, codes in enumerate(texts):
        for at in range(0, len(codes), span):
            for j in range(k if at else 1):
                seqs.append(codes[at : at + span])
                begin.append(j if at else -1)
                owner.append(i)
    codes, alive, order = _lanes(seqs)
    now = np.stack([model.start if begin[i] < 0 else model.move[begin[i]] for i in order])
    logs, last = np.zeros(len(seqs)), np.zeros((len(seqs), k))
    for t in range(codes.shape[0]):
        m = alive[t]
        if m < len(now):
            last[m : len(now)] = now[m:]
            now = now[:m]
        now = (now @ model.move if t else now) * model.emit[codes[t, :m]]
        s = now.sum(1)
        now = now / s[:, None]
        logs[:m] += np.log(s)
    last[: len(now)] = now
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    out, total, state = np.zeros(len(texts)), None, None
    at = 0
    while at < len(seqs):
        lane = back[at]
        if begin[at] < 0:
            state, out[owner[at]] = last[lane], logs[lane]
            at += 1
            continue
        lanes = back[at : at + k]
        top = logs[lanes].max()
        state = (state * np.exp(logs[lanes] - top)) @ last[lanes]
        total = state.sum()
        state = state / total
        out[owner[at]] += top + math.log(total)
        at += k
    return out / math.log(10)


def _codes(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint16) for x in column.to_pylist()]


def _groups(seqs: Iterator[np.ndarray], most: int = TOKENS_AT_ONCE) -> Iterator[list[np.ndarray]]:
    held, size = [], 0
    for s in seqs:
        held.append(s)
        size += len(s)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for b in batches:
        yield from _codes(b.column(0))


def train_round(coded: DataFrame, model: Model, unigram: np.ndarray) -> Model:
    """One Baum-Welch pass over all training rows."""
    k, shared = len(model.start), coded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mod = shared.value
        start, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros_like(mod.emit)
        for group in _groups(_sequences(batches)):
            a, b, c = expected(mod, group)
            start += a
            move += b
            emit += c
        rows = np.concatenate([emit, move, start[None]])
        some = np.flatnonzero(rows.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *(pa.array(rows[some, j]) for j in range(k))], ["row", *(f"s{j}" for j in range(k))])

    small_batches(coded.sparkSession)
    parts = coded.filter(~F.col("held_out")).select("codes").mapInArrow(run, "row int, " + ", ".join(f"s{j} double" for j in range(k)))
    rows = np.zeros((len(unigram) + k + 1, k))
    for r in parts.groupBy("row").agg(*(F.sum(f"s{j}").alias(f"s{j}") for j in range(k))).collect():
        rows[r[0]] = r[1:]
    c = len(unigram)
    return model.refit(rows[-1], rows[c : c + k], rows[:c], unigram)


def train(coded: DataFrame, unigram: np.ndarray, states: int = STATES, rounds: int = ROUNDS) -> Model:
    model = Model.first(unigram, states)
    for _ in range(rounds):
        model = train_round(coded, model, unigram)
    return model


def forward_scores(coded: DataFrame, model: Model) -> DataFrame:
    """uid and the log10 likelihood of its class sequence."""
    shared = coded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mod = shared.value
        for b in batches:
            texts = _codes(b.column(1))
            scored = [x for group in _groups(iter(texts)) for x in log10_likelihoods(mod, group)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scored, pa.float64())], ["uid", "forward"])

    small_batches(coded.sparkSession)
    return coded.select("uid", "codes").mapInArrow(run, "uid long, forward double")


def score_documents(docs: DataFrame, hold: Column, states: int = STATES, rounds: int = ROUNDS, head: int = HEAD) -> DataFrame:
    """Base and model scores of every row, learnt from rows that ``hold`` doesn't hold out."""
    rows = id_text(docs).withColumn("held_out", hold)
    counts = spool(word_counts(rows.filter(~F.col("held_out"))), "counts")
    vocab = vocabulary(counts, head)
    coded = spool(encode(rows, vocab), "coded")
    model = train(coded, vocab.unigram, states, rounds)
    forward = forward_scores(coded, model)
    # words beyond the head meet their counts by a join; classes by the same rule as in encode()
    suffix = F.expr(f"crc32(CASE WHEN octet_length(word) > {SUFFIX_BYTES} THEN substring(word, -{SUFFIX_BYTES}, {SUFFIX_BYTES}) ELSE word END)") % SUFFIXES
    tail = coded.select("uid", F.explode(F.arrays_zip("tail_words", "tail_counts")).alias("x")).select("uid", F.col("x.tail_words").alias("word"), F.col("x.tail_counts").alias("m"))
    logs = F.array(*[F.lit(float(x)) for x in vocab.class_log])
    c = F.coalesce("c", F.lit(0))
    met = (
        tail.join(counts, "word", "left")
        .select("uid", "m", c.alias("c"), (F.log10(c + 0.5) * F.col("m")).alias("x"), (F.element_at(logs, suffix.cast("int") + 1) * F.col("m")).alias("y"))
        .groupBy("uid")
        .agg(F.sum(F.when(F.col("c") > 0, F.col("m")).otherwise(0)).alias("t_known"), F.sum(F.col("x") - F.col("m") * vocab.log_d).alias("t_base"), F.sum(F.col("x") - F.col("y")).alias("t_within"))
    )
    zero = lambda name: F.coalesce(name, F.lit(0))
    return (
        coded.select("uid", "doc_id", "held_out", "n_tokens", "known", "base", "within")
        .join(forward, "uid")
        .join(met, "uid", "left")
        .select(
            "doc_id", "held_out", "n_tokens", (F.col("known") + zero("t_known")).cast("long").alias("n_known"), F.lit(vocab.n).cast("long").alias("train_tokens"),
            (F.col("base") + zero("t_base")).alias("base_score"), (F.col("forward") + F.col("within") + zero("t_within")).alias("score"),
        )
    )


def op10_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir), held_out(5, 1))
