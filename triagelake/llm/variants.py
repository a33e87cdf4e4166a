"""Spellings that stand for the same word: all neighbours of a vocabulary at one edit.

Every word makes its whole neighbourhood: all distinct deletions, replacements
and insertions over the letters that the vocabulary holds.  A neighbour that is
a word by a hash join is near, and no distance is computed.  The neighbourhood
is made as hashes first (numpy, a rolling hash of the unchanged head and tail);
only what a bit table of the vocabulary may hold is written out as a string
and travels to the join.  The table takes ``BITS_PER_WORD`` bits a word and is
broadcast in parts of at most ``TABLE_BITS`` bits: a vocabulary beyond one part
is searched in several passes, each with the words of its share of the hashes.

Defined cases: a null or empty text has no words; a null doc_id is the empty
text in the hash that decides on a deletion; words of any length are searched
in blocks; repeated rows count each; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents, id_text, spool

RUN = "[A-Za-zÀ-ÿ]+"
LEAST_LETTERS, LEAST_COUNT, LEAST_RATIO = 5, 3, 2
BITS_PER_WORD, PROBES = 16, 3
TABLE_BITS = 1 << 29  # 64 MB at most in each pass
BLOCK = 1 << 20  # hashes of neighbours that are held at once
TASK_WORDS = 40_000  # words whose neighbourhoods one task makes
CHUNK = 32_768  # bits of one row of bitmap_construct_agg

_rng = np.random.default_rng(20)
LETTER = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)


def word_counts(docs: DataFrame, least_letters: int = LEAST_LETTERS) -> DataFrame:
    """``word, n``: runs of letters, A-Z in lower case, with planted slips of the pen.

    Where 97 divides the crc32 of ``<doc_id>:<run>`` one letter is missing.
    Counts are summed in each task before they travel.
    """
    upper = "".join(map(chr, range(65, 91)))
    rows = id_text(docs).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.translate("text", upper, upper.lower()), F.lit(RUN), F.lit(0))).alias("run"))
    h = F.crc32(F.encode(F.concat("id", F.lit(":"), "run"), "UTF-8"))
    place = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % 97 == 0, F.concat(F.substring("run", F.lit(1), place), F.substring("run", place + 2, F.length("run")))).otherwise(F.col("run"))
    return rows.withColumn("h", h).select(word.alias("word")).filter(F.length("word") >= least_letters).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _by_length(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of words and their letters, for each length (a block at a time)."""
    size = np.array([len(w) for w in words], np.int64)
    for n in np.unique(size):
        of = np.flatnonzero(size == n)
        step = max(1, BLOCK // int(n + 1))
        for k in range(0, len(of), step):
            part = of[k : k + step]
            yield part, np.frombuffer(b"".join([words[i] for i in part]), np.uint8).reshape(len(part), n)


def _heads_and_tails(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of what stands before and after each place, and the powers of the base."""
    rows, n = letters.shape
    power = np.full(n + 2, BASE)
    power[0] = 1
    power = np.multiply.accumulate(power)
    head, tail = np.zeros((rows, n + 1), np.uint64), np.zeros((rows, n + 1), np.uint64)
    for k in range(n):
        head[:, k + 1] = head[:, k] * BASE + LETTER[letters[:, k]]
    tail[:, :n] = np.cumsum((LETTER[letters] * power[n - 1 :: -1][:n])[:, ::-1], axis=1, dtype=np.uint64)[:, ::-1]
    return head, tail, power


def word_hashes(words: list[bytes]) -> np.ndarray:
    out = np.zeros(len(words), np.uint64)
    for of, letters in _by_length(words):
        out[of] = _heads_and_tails(letters)[0][:, -1]
    return _mixed(out)


def _edits(letters: np.ndarray) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Kind, word, place, and ``base + factor * letter`` as the hash of what an edit there gives.

    ``barred`` is the letter that would give a word that another edit gives (or the word itself).
    """
    head, tail, power = _heads_and_tails(letters)
    rows, n = letters.shape
    word, place = np.divmod(np.arange(rows * n), n)
    down = power[n - 1 - place]
    fresh = (place == 0) | (letters[word, place] != letters[word, place - 1])
    yield "cut", word[fresh], place[fresh], (head[word, place] * down + tail[word, place + 1])[fresh], np.zeros(int(fresh.sum()), np.uint64), np.zeros(int(fresh.sum()), np.int16)
    yield "swap", word, place, head[word, place] * power[n - place] + tail[word, place + 1], down, letters[word, place].astype(np.int16)
    word, place = np.divmod(np.arange(rows * (n + 1)), n + 1)
    barred = np.where(place > 0, letters[word, np.maximum(place - 1, 0)].astype(np.int16), np.int16(-1)) if n else np.full(rows, -1, np.int16)
    yield "add", word, place, head[word, place] * power[n + 1 - place] + tail[word, place], power[n - place], barred


def neighbours(words: list[bytes], alphabet: np.ndarray, found) -> Iterator[tuple[int, bytes]]:
    """Pairs of a word's place and a neighbour of it that ``found(hashes)`` lets pass.

    Of all distinct neighbours none is left out; each word's come once.
    """
    none = np.zeros(1, np.uint8)
    for of, letters in _by_length(words):
        for kind, word, place, base, factor, barred in _edits(letters):
            over = none if kind == "cut" else alphabet
            step = max(1, BLOCK // max(len(over), 1))
            for k in range(0, len(word), step):
                part = slice(k, k + step)
                hashes = base[part, None] + factor[part, None] * LETTER[over][None, :]
                fits = found(_mixed(hashes))
                if kind != "cut":
                    fits &= over[None, :] != barred[part, None]
                for r, a in zip(*np.nonzero(fits), strict=True):
                    i, at = of[word[k + r]], place[k + r]
                    w = words[i]
                    yield i, w[:at] + (b"" if kind == "cut" else over[a : a + 1].tobytes()) + w[at + (kind != "add") :]


def _probe(h: np.ndarray, k: int, bits: int) -> np.ndarray:
    """The ``k``-th bit of each hash in a table of ``bits`` bits (a power of two)."""
    return (h + np.uint64(k) * ((h >> np.uint64(32)) | np.uint64(1))) & np.uint64(bits - 1)


def _share(h: np.ndarray, passes: int) -> np.ndarray:
    return (h >> np.uint64(40)) % np.uint64(passes)


def bit_tables(vocabulary: DataFrame, most_bits: int = TABLE_BITS) -> tuple[int, int, list[DataFrame]]:
    """Number of bits of a table, number of passes, and the set bits of each as rows of a bitmap."""
    n = max(vocabulary.count(), 1)
    wanted = 1 << max(16, (n * BITS_PER_WORD - 1).bit_length())
    passes = max(1, wanted // most_bits)
    bits = wanted // passes

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            h = word_hashes([w.encode("latin-1") for w in pdf["word"]])
            for k in range(PROBES):
                yield pd.DataFrame({"share": _share(h, passes).astype(np.int32), "bit": _probe(h, k, bits).astype(np.int64)})

    rows = vocabulary.select("word").mapInPandas(run, "share int, bit long")
    maps = spool(rows.groupBy("share", F.floor(F.col("bit") / CHUNK).alias("chunk")).agg(F.bitmap_construct_agg(F.col("bit") % CHUNK).alias("bitmap")), "bits")
    return bits, passes, [maps.filter(F.col("share") == k).select("chunk", "bitmap") for k in range(passes)]


def near_words(vocabulary: DataFrame, most_bits: int = TABLE_BITS) -> DataFrame:
    """``word, near, n``: all pairs of words at one edit, both ways, with the second one's count."""
    spark = vocabulary.sparkSession
    letters = vocabulary.select(F.explode(F.split("word", "")).alias("letter")).filter("letter <> ''").distinct()
    alphabet = np.array(sorted(ord(r[0]) for r in letters.collect()), np.uint8)  # at most the 90 letters of RUN
    bits, passes, maps = bit_tables(vocabulary, most_bits)
    dealt = vocabulary.select("word").repartition(1 + vocabulary.count() // TASK_WORDS, "word")
    out = None
    for share, rows in enumerate(maps):
        table = np.zeros(bits // 8, np.uint8)
        for r in rows.toLocalIterator():
            chunk = np.frombuffer(bytes(r["bitmap"]), np.uint8)
            at = r["chunk"] * (CHUNK // 8)
            table[at : at + CHUNK // 8] = chunk[: len(table) - at]
        sent = spark.sparkContext.broadcast(table)  # at most most_bits / 8 bytes

        def run(batches: Iterator[pd.DataFrame], share: int = share, sent=sent) -> Iterator[pd.DataFrame]:
            held = sent.value

            def found(h: np.ndarray) -> np.ndarray:
                flat = h.ravel()
                left = np.flatnonzero(_share(flat, passes) == share) if passes > 1 else np.arange(len(flat))
                for k in range(PROBES):
                    bit = _probe(flat[left], k, bits)
                    left = left[held[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1 > 0]
                fits = np.zeros(len(flat), bool)
                fits[left] = True
                return fits.reshape(h.shape)

            for pdf in batches:
                words = [w.encode("latin-1") for w in pdf["word"]]
                pairs = [(i, near.decode("latin-1")) for i, near in neighbours(words, alphabet, found)]
                yield pd.DataFrame({"word": [pdf["word"].iloc[i] for i, _ in pairs], "near": [near for _, near in pairs]})

        made = dealt.mapInPandas(run, "word string, near string")
        out = made if out is None else out.unionAll(made)
    return out.join(vocabulary.select(F.col("word").alias("near"), "n"), "near").select("word", "near", "n")


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for ``forms(word, form)``: the last of each chain, by pointers that double their reach.

    A form occurs at least twice as often as its word, so chains have no cycle
    and at most log2 of the largest count links; rounds are the log2 of that.
    """
    now = spool(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        ahead = spool(now.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        now = ahead.select("word", "root")
        if ahead.filter("moved").isEmpty():
            return now


def spelling_variants(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, ratio: int = LEAST_RATIO) -> DataFrame:
    """Every word with its count, near words, form and root."""
    vocabulary = spool(word_counts(docs, least_letters).filter(F.col("n") >= least_count), "vocabulary")
    met = near_words(vocabulary)
    best = met.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n")).alias("m"), F.col("near"))).alias("b"))
    rows = spool(vocabulary.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), *(F.when(-F.col("b.m") >= F.col("n") * ratio, x).alias(name) for x, name in ((F.col("b.near"), "form"), (-F.col("b.m"), "form_n")))), "forms")
    ends = roots(rows.filter("form is not null"))
    return rows.join(ends, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op11_full_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(documents(spark, sf_dir))
