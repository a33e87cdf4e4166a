"""Scores of the learners against plain second versions, written from their descriptions with loops and dictionaries."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from triagelake.llm import quality, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def learnt(tables, label, mod, rest):
    """Texts by id, and labels by id of the rows that may teach."""
    docs, labels = tables
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    return texts, {r.doc_id: r[label] for r in labels.collect() if r.doc_id in texts and zlib.crc32(str(r.doc_id).encode()) % mod != rest}


def logistic(z):
    return 1 / (1 + math.exp(-max(min(z, 30), -30)))


# op5

LETTERS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", ".", ",", "!", "?", "|", "#&$%*", "<>{}[]()=;:/\\_+-@~^`'\""]


def plain_features(text):
    if not text:
        return [0.0] * (len(LETTERS) + 10)
    out = [sum(chr(b) in group for b in text) / len(text) for group in LETTERS] + [sum(b > 127 for b in text) / len(text)]
    words = text.split()
    if words:
        m, size = len(words), [len(w) for w in words]
        out += [sum(words[i] == words[i - 1] for i in range(1, m)) / m, len(set(words)) / m, sum(w.isupper() for w in words) / m]
        out += [min(sum(size) / m, 50) / 10, size.count(1) / m, math.log(1 + m), sum(w.isalpha() for w in words) / m]
    else:
        out += [0.0] * 7
    lines = text.split(b"\n")
    return out + [1 - len(set(lines)) / len(lines), math.log(1 + len(text) / len(lines))]


def test_quality_scores_equal_a_plain_version(spark, tables):
    texts, taught = learnt(tables, "quality", 4, 2)
    ids = sorted(taught)
    assert {0, 1} == set(taught.values()) and len(ids) > 50
    x = np.array([plain_features(texts[i]) for i in ids], np.float32)
    y = np.array([taught[i] for i in ids])
    got = quality.train_ranker(*tables, quality.hold_out(4, 2))
    assert np.allclose(got.knots, [[sorted_quantile(col, q) for col in x.T.tolist()] for q in quality.KNOTS], atol=1e-5)

    def raw(row):
        wide = list(row) + [max(v - k[j], 0.0) for k in got.knots for j, v in enumerate(row)]
        return sum(w * v / s for w, v, s in zip(got.weights, wide, got.scale, strict=True))

    ranks = [raw(row) for row in x.astype(float).tolist()]
    wide = np.array([list(row) + [max(v - k[j], 0.0) for k in got.knots for j, v in enumerate(row)] for row in x.astype(float).tolist()]) / got.scale
    rng = np.random.default_rng(11)  # the pairs that the operator draws, of rows in order of their ids
    a, b = rng.choice(np.flatnonzero(y == 1), quality.PAIRS), rng.choice(np.flatnonzero(y == 0), quality.PAIRS)
    diff = wide[a] - wide[b]
    slope = -(diff / (1 + np.exp(np.clip(diff @ got.weights, -30, 30)))[:, None]).mean(0) + 1e-3 * got.weights
    assert np.abs(slope).max() < 1e-4  # no step from these weights lessens the pairs' logistic loss
    errors = lambda cut: sum((r >= cut) != bool(t) for r, t in zip(ranks, y, strict=True))
    assert errors(got.cut) == min(errors(cut) for cut in [*ranks, math.inf])
    scores = {r.doc_id: r for r in quality.score_quality(*tables).collect()}
    assert scores.keys() == texts.keys()
    for i, text in texts.items():
        want = logistic(quality.SLOPE * (raw(plain_features(text)) - got.cut) / 2 + math.log(0.7 / 0.3))
        assert abs(scores[i].score - want) < 1e-3 and scores[i].predicted == (scores[i].score >= 0.7)


def sorted_quantile(values, q):
    values = sorted(values)
    at = q * (len(values) - 1)
    low = int(at)
    return values[low] + (values[min(low + 1, len(values) - 1)] - values[low]) * (at - low)


# op9

EDGES = "#&$%*!|.,;:()[]{}<>\"'?-_/\\=+~^`@"


class PlainModels:
    """Kneser-Ney by dictionaries: seven bytes of context, then two shared by the classes, then the letter alone."""

    def __init__(self, texts, classes):
        self.count = [defaultdict(Counter), defaultdict(Counter)]
        kinds = defaultdict(set)
        for text, y in zip(texts, classes, strict=True):
            for word in {w.strip(EDGES.encode()) for w in text.lower().split()}:
                for context, letter in self.steps(word):
                    self.count[y][context][letter] += 1
                    kinds[context[-2:]].add((context, letter))
        self.short = {two: Counter(letter for _, letter in some) for two, some in kinds.items()}
        last = Counter(letter for some in self.short.values() for letter in some)
        self.letter = {b: (last[b] + 0.5) / (sum(last.values()) + 128) for b in range(256)}

    @staticmethod
    def steps(word):
        """A word's start counts as a space, and what lies before as nothing."""
        whole = [0] * 6 + [32] + list(word) + [10]
        for at in range(7, len(whole)):
            two = [whole[at - 2] or 32, whole[at - 1]]
            yield (*whole[at - 7 : at - 2], whole[at - 2], two[1]), whole[at]

    def back(self, context, letter):
        seen = self.short.get(context[-2:])
        if not seen:
            return self.letter[letter]
        total = sum(seen.values())
        return max(seen[letter] - 0.75, 0) / total + sum(min(n, 0.75) for n in seen.values()) / total * self.letter[letter]

    def log(self, y, word):
        out = 0.0
        for context, letter in self.steps(word):
            seen, shared = self.count[y].get(context), self.back(context, letter)
            if seen:
                total = sum(seen.values())
                shared = (max(seen[letter] - 0.75, 0) + sum(min(n, 0.75) for n in seen.values()) * shared) / total
            out += math.log(shared)
        return out


def plain_evidence(models, text, known):
    words = text.lower().split()
    if not words:
        return [0.0] * 8
    for w in set(words) - known.keys():
        core = w.strip(EDGES.encode())
        known[w] = models.log(1, core) - models.log(0, core)
    each = sorted((known[w] for w in set(words)), reverse=True)
    top = [min(max(v, -2), 12) for v in each[:8]] + [0.0] * max(8 - len(each), 0)
    strong = math.log(1 + sum(v > 4 for v in each)) - 0.5 * math.log(1 + len(each))
    return [sum(known[w] for w in words) / len(words), top[0], top[1], top[2], sum(top[3:5]) / 2, sum(top[5:]) / 3, strong, math.log(1 + len(each))]


def test_toxicity_scores_equal_a_plain_version(spark, tables):
    texts, taught = learnt(tables, "toxic", 5, 0)
    assert max(len(w) for t in texts.values() for w in t.split()) <= toxicity.SEGMENT
    curve_part = {r.doc_id for r in tables[1].filter(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(5)), F.lit(toxicity.HOLD)) == 0).collect()}
    counted = [i for i in sorted(taught) if i not in curve_part]
    models, known = PlainModels([texts[i] for i in counted], [taught[i] for i in counted]), {}
    shared, curve = toxicity.train_models(*tables)
    some = sorted({w.strip(EDGES.encode()) for i in list(texts)[:20] for w in texts[i].lower().split()})
    ratio = [models.log(1, w) - models.log(0, w) for w in some]
    assert np.allclose(shared.value.ratio(some), ratio, atol=1e-3)
    held = sorted(i for i in taught if i in curve_part)
    x, y = np.array([plain_evidence(models, texts[i], known) for i in held]), np.array([taught[i] for i in held], float)
    mean, std = x.mean(0), np.maximum(x.std(0), 1e-6)
    assert np.allclose(curve.mean, mean, atol=1e-3) and np.allclose(curve.std, std, atol=1e-3)

    def inputs(row):
        z = [(v - m) / s for v, m, s in zip(row, curve.mean, curve.std, strict=True)]
        return [1.0, *z, *(max(v, 0) ** 2 / 4 for v in z)]

    p = np.array([logistic(float(np.dot(inputs(r), curve.w))) for r in x])
    slope = np.array([inputs(r) for r in x]).T @ (p - y) / len(y) + 1e-3 * curve.w
    assert np.abs(slope).max() < 1e-3
    scores = {r.doc_id: r for r in toxicity.score_toxicity(*tables).collect()}
    assert scores.keys() == texts.keys()
    for i, text in texts.items():
        want = logistic(float(np.dot(inputs(plain_evidence(models, text, known)), curve.w)))
        assert abs(scores[i].score - want) < 5e-3 and scores[i].predicted == (scores[i].score >= 0.5)
