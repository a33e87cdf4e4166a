"""Encoding by a public byte-pair vocabulary, and decoding.

The words that a batch of rows holds for the first time are laid out in one
row of symbols.  An index maps each pair that may be merged to all its
positions there; active ranks are applied in ascending order, and each merge
adds the two pairs that it makes to their lists.  Normalisation and the cut
into words are those of the tokenizer file, by the library that reads it; no
merge is asked of the library.

Defined cases: a null or empty text has no ids and decodes to the empty text;
texts that contain a special token's string yield its id there; a long text is
read in pieces that end at white space; ids outside the vocabulary decode to
nothing.
"""

from __future__ import annotations

import functools
import heapq
import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents, id_text, small_batches

TOKENIZER = "word_bpe_49k.json"
PIECE = 4 << 20  # bytes of a text that are split at once
KEPT = 160 << 20  # bytes of encoded stretches that a worker remembers; forgetting changes no result
ENTRY = 170  # bytes of a remembered stretch beside its own text and ids
SPACE = re.compile(rb"[ \t\n\r\x0b\x0c]")
#: How the tokenizer file normalises and cuts text.  Printed ASCII and the letters of Latin-1
#: follow from it without the library, everything else is cut by the library itself.
CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
STEPS = ["NFC", "Replace", "Lowercase"]
LATIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
STOP, MERGED, UNKNOWN = -1, -2, -3


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def byte_names() -> list[str]:
    """The letter that stands for each byte: printed ones for themselves, the others from 256 on."""
    printed = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printed]
    return [chr(b) if b in printed else chr(256 + others.index(b)) for b in range(256)]


class Vocabulary:
    """Ids, merge rules and special strings of a tokenizer file."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model, added = data["model"], data["added_tokens"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or odd or any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError(f"{path}: only plain byte-pair files with literal special tokens are read ({odd})")
        self.ids, self.suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rules = [(self.ids[a], self.ids[b], self.ids[a + b]) for a, b in pairs]
        self.rank = {a << 32 | b: r for r, (a, b, _) in enumerate(self.rules)}
        self.pair_keys = np.array(sorted(self.rank) or [-1], np.int64)
        self.pair_ranks = np.array([self.rank.get(k, -1) for k in self.pair_keys.tolist()], np.int64)
        self.special = {t["content"].encode(): t["id"] for t in added}
        self.names = dict(zip(self.ids.values(), self.ids, strict=True)) | {t["id"]: t["content"] for t in added}
        self.cut = re.compile(b"(" + b"|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + b")") if self.special else None
        tokenizer = Tokenizer.from_file(path)
        self.normalise, self.words = tokenizer.normalizer.normalize_str, tokenizer.pre_tokenizer.pre_tokenize_str
        cuts = (data.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        steps = [n["type"] for n in (data.get("normalizer") or {}).get("normalizers", [])]
        self.latin = steps == STEPS and [c.get("type") for c in cuts] == ["Split", "ByteLevel"] and cuts[0]["pattern"] == {"Regex": CUT}
        names = byte_names()
        self.inner = np.array([self.ids.get(n, UNKNOWN) for n in names])
        self.last = np.array([self.ids.get(n + self.suffix, UNKNOWN) for n in names])
        self.known: dict[bytes | str, bytes] = {}  # stretches and words; a word in the vocabulary's letters is a str
        self.kept = 0
        self.by_id = [self.names.get(i, "") for i in range(max(self.names) + 1)]

    def cut_words(self, part: bytes) -> list[bytes | str]:
        """Words of a stretch without white space: bytes, or strings of the vocabulary's letters."""
        if self.latin:
            if part.isalpha():
                return [part.lower()]
            text = part.decode()
            if LATIN.fullmatch(text):
                return [w.encode() for w in WORDS.findall(text.lower())]
        return [w for w, _ in self.words(self.normalise(part.decode()))]

    def symbols(self, word: str) -> list[int]:
        return [self.ids.get(ch, UNKNOWN) for ch in word[:-1]] + [self.ids.get(word[-1] + self.suffix, UNKNOWN)]

    def laid_out(self, words: list[bytes | str]) -> tuple[np.ndarray, list[bytes | str]]:
        """Ids of all words' letters in a row with a stop before and after each, and the words in that order.

        Letters outside the vocabulary have none.
        """
        plain, other = [w for w in words if isinstance(w, bytes)], [w for w in words if isinstance(w, str)]
        raw = np.frombuffer(b"".join([b"\0", *(w + b"\0" for w in plain)]), np.uint8)
        ends = np.append(raw[1:] == 0, False)
        at = np.where(raw == 0, STOP, np.where(ends, self.last[raw], self.inner[raw]))
        if other:
            at = np.concatenate([at, np.fromiter((i for w in other for i in (*self.symbols(w), STOP)), np.int64)])
        return at[at != UNKNOWN], plain + other


def merged(row: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """The row of ``laid_out`` after all merges, lowest rank first and from left to right.

    Places that a merge has made stale stay in the lists and are passed over.
    Should a merge make a pair of a lower rank, that rank comes before the
    places that are left.
    """
    pairs = row[:-1] << 32 | row[1:]
    slot = np.minimum(np.searchsorted(vocab.pair_keys, pairs), len(vocab.pair_keys) - 1)
    first = np.flatnonzero((vocab.pair_keys[slot] == pairs) & (row[:-1] >= 0) & (row[1:] >= 0))
    ranks = vocab.pair_ranks[slot[first]]
    order = np.argsort(ranks, kind="stable")
    ranks, first = ranks[order], first[order]
    cuts = np.flatnonzero(np.diff(ranks)) + 1
    active: list[int] = ranks[np.append(0, cuts)].tolist() if len(ranks) else []  # ascending, so a heap
    places: dict[int, list[int]] = dict(zip(active, (x.tolist() for x in np.split(first, cuts)), strict=False))
    at, after, before = row.tolist(), list(range(1, len(row) + 1)), list(range(-1, len(row) - 1))
    rank, rules, push = vocab.rank.get, vocab.rules, heapq.heappush
    while active:
        r = heapq.heappop(active)
        here = places.pop(r)
        left, right, made = rules[r]
        here.sort()
        for k, i in enumerate(here):
            if at[i] != left:
                continue
            j = after[i]
            if at[j] != right:
                continue
            p, n = before[i], after[j]
            at[i], at[j], after[i], before[n] = made, MERGED, n, i
            woken = False
            a, b = at[p], at[n]
            if a >= 0:
                q = rank(a << 32 | made)
                if q is not None:
                    if q in places:
                        places[q].append(p)
                    else:
                        places[q] = [p]
                        push(active, q)
                    woken = q < r
            if b >= 0:
                q = rank(made << 32 | b)
                if q is not None:
                    if q in places:
                        places[q].append(i)
                    else:
                        places[q] = [i]
                        push(active, q)
                    woken |= q < r
            if woken and k + 1 < len(here):
                if r not in places:
                    push(active, r)
                places[r] = here[k + 1 :] + places.get(r, [])
                break
    out = np.array(at, np.int64)
    return out[out != MERGED]


def encode_words(words: list[bytes | str], vocab: Vocabulary) -> dict[bytes | str, bytes]:
    """Ids (32-bit integers) of each distinct word, given as its bytes or in the vocabulary's letters."""
    row, named = vocab.laid_out(words)
    done = merged(row, vocab)
    stops = np.flatnonzero(done == STOP)
    ids = done[done != STOP].astype(np.int32).tobytes()
    ends = (4 * (stops - np.arange(len(stops)))).tolist()
    return {w: ids[a:b] for w, a, b in zip(named, ends[:-1], ends[1:], strict=True)}


def _learn(parts: set[bytes], vocab: Vocabulary) -> None:
    """Encode stretches without white space that were not met before."""
    known = vocab.known
    cut = {p: vocab.cut_words(p) for p in parts}
    new = [w for w in {w for ws in cut.values() for w in ws} if w not in known]
    known.update(encode_words(new, vocab))
    for p, ws in cut.items():
        known[p] = known[ws[0]] if len(ws) == 1 else b"".join([known[w] for w in ws])
    vocab.kept += sum(ENTRY + 2 * len(w) for w in new) + sum(ENTRY + 2 * len(p) for p in cut)


def _pieces(raw: bytes):
    """A text in parts of bounded size, cut at white space."""
    start = 0
    while len(raw) - start > PIECE:
        space = SPACE.search(raw, start + PIECE)
        if space is None:
            break
        yield raw[start : space.start()]
        start = space.end()
    yield raw[start:]


def _split(raw: bytes, vocab: Vocabulary) -> list[bytes]:
    """Stretches without white space, special strings by themselves."""
    if vocab.cut is None or not vocab.cut.search(raw):
        return raw.split()
    return [p for k, part in enumerate(vocab.cut.split(raw)) for p in ((part,) if k % 2 else part.split())]


def encode_batch(texts: list[bytes | None], vocab: Vocabulary) -> list[bytes]:
    """Ids of each text as little-endian 32-bit integers."""
    out: list[list[bytes]] = [[] for _ in texts]
    waiting: list[tuple[int, list[bytes]]] = []
    size = 0
    special = {s: np.array([i], np.int32).tobytes() for s, i in vocab.special.items()}  # no stretch holds one inside
    vocab.known.update(special)

    def settle() -> None:
        if vocab.kept > KEPT:
            vocab.known, vocab.kept = {}, 0
            vocab.known.update(special)
        table = vocab.known
        _learn({p for _, parts in waiting for p in parts}.difference(table), vocab)
        for k, parts in waiting:
            out[k].append(b"".join([table[p] for p in parts]))
        waiting.clear()

    for k, raw in enumerate(texts):
        for piece in _pieces(raw or b""):
            waiting.append((k, _split(piece, vocab)))
            size += len(piece)
            if size > PIECE:
                settle()
                size = 0
    settle()
    return [b"".join(x) for x in out]


@functools.lru_cache(maxsize=2)
def _vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)  # once a worker


def encode(text: Column, path: str | None = None) -> Column:
    """``array<int>``: ids of a text, as the library gives them without added special tokens."""

    @F.arrow_udf("array<int>")
    def run(texts: pa.Array) -> pa.Array:
        vocab = _vocabulary(path or default_path())
        ids = encode_batch(texts.cast(pa.large_binary()).to_pylist(), vocab)
        ends = np.cumsum([0, *(len(b) // 4 for b in ids)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), np.int32)))

    return run(text)


def decode(ids: Column, path: str | None = None) -> Column:
    """Text of an array of ids: the vocabulary's strings, special ones too, joined by a space."""

    @F.arrow_udf("string")
    def run(lists: pa.Array) -> pa.Array:
        names = _vocabulary(path or default_path()).by_id
        ids, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *(n or 0 for n in pc.list_value_length(lists).to_pylist())])
        known = len(ids) == 0 or (0 <= ids.min() and ids.max() < len(names) and "" not in names)
        out = []
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            mine = ids[a:b].tolist()
            out.append(" ".join([names[i] for i in mine] if known else [names[i] for i in mine if 0 <= i < len(names) and names[i]]))
        return pa.array(out, pa.string())

    return run(ids)


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, ids, decoded`` of every row."""
    small_batches(docs.sparkSession)
    return id_text(docs).select("doc_id", encode(F.col("text"), path).alias("ids")).withColumn("decoded", decode(F.col("ids"), path))


def op12_pair_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = encode_documents(documents(spark, sf_dir))
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
