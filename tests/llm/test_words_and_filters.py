"""Spelling variants, byte pairs and the filter audit against plain versions."""

import hashlib
import itertools
import json
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from triagelake.llm import bpe, filter_audit, variants

LOWER = {c: c + 32 for c in range(65, 91)}
WHITE = r"[^\x20\x09-\x0D]+"


# spelling variants


def edits(w, letters):
    near = {w[:i] + w[i + 1 :] for i in range(len(w))}
    near |= {w[:i] + x + w[i + 1 :] for i in range(len(w)) for x in letters} | {w[:i] + x + w[i:] for i in range(len(w) + 1) for x in letters}
    return near - {w}


def plain_variants(rows):
    n = Counter()
    for ident, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if ident is None else ident}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                n[run] += 1
    n = {w: k for w, k in n.items() if k >= 3}
    letters = {x for w in n for x in w}
    form, count = {}, {}
    for w in n:
        near = [x for x in edits(w, letters) if x in n]
        count[w] = len(near)
        best = min(near, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, n[w], count[w], form[w], n.get(form[w]), root(w)) for w in n}


def as_rows(df):
    return {(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()}


def test_variants_equal_a_plain_search(spark, odd_docs, no_docs):
    rng = random.Random(1)
    words = ["Straße", "station", "stations", "statiin", "aaaaa", "aaaaaa", "aaaaaaa", "ÀÉÎÕÜ", "àéîõü", "over×under", "x" * 300, "x" * 299 + "y", "abcde", "abcdf", "abxde"]
    rows = [(i, " ".join(rng.choices(words, weights=[2 ** (k % 7) for k in range(len(words))], k=60))) for i in range(40)] + [(None, "station " * 9), (50, None), (51, "")]
    docs = odd_docs.select("doc_id", "text", "slot").unionAll(spark.createDataFrame(rows, "doc_id long, text string").withColumn("slot", F.lit(1)))
    got = variants.spelling_variants(docs.withColumn("word", F.lit("clash")).withColumn("n", F.lit(0)))
    want = plain_variants([(r.doc_id, r.text) for r in docs.collect()])
    assert as_rows(got) == want and len(want) == got.count() and any(w[3] and w[3] != w[5] for w in want)
    assert variants.spelling_variants(no_docs).count() == 0


def test_many_passes_and_small_blocks_change_nothing(spark, monkeypatch):
    rng = random.Random(2)
    words = sorted({"".join(rng.choices("abc", k=rng.randint(5, 7))) for _ in range(400)})
    vocabulary = spark.createDataFrame([(w, 3 + i % 50) for i, w in enumerate(words)], "word string, n long")
    want = {(w, x) for w in words for x in edits(w, "abc") if x in set(words)}
    for most, block in ((1 << 29, 1 << 20), (1 << 14, 7)):
        monkeypatch.setattr(variants, "BLOCK", block)
        got = [(r.word, r.near) for r in variants.near_words(vocabulary, most).collect()]
        assert len(got) == len(want) and set(got) == want


def test_a_neighbourhood_is_whole_and_without_repeats():
    letters = np.frombuffer("abé".encode("latin-1"), np.uint8)
    words = ["aabba", "a", "éé", "baaab", "abéab"]
    got = Counter((i, w.decode("latin-1")) for i, w in variants.neighbours([w.encode("latin-1") for w in words], letters, lambda h: np.ones(h.shape, bool)))
    assert got == Counter({(i, x): 1 for i, w in enumerate(words) for x in edits(w, "abé")})


def test_equal_strings_have_equal_hashes():
    letters = np.frombuffer(b"abc", np.uint8)
    for w in (b"abcab", b"aaaaa", b"c"):
        seen = []
        list(variants.neighbours([w], letters, lambda h: [seen.append(h.copy()), np.ones(h.shape, bool)][1]))
        mine = [x for _, x in variants.neighbours([w], letters, lambda h: np.ones(h.shape, bool))]
        assert set(variants.word_hashes(mine)) <= set(np.concatenate([s.ravel() for s in seen]))


def test_roots_of_long_chains(spark):
    chain = [(f"w{i:03d}", f"w{i + 1:03d}") for i in range(37)] + [("side", "w010")]
    got = {r.word: r.root for r in variants.roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert set(got.values()) == {"w037"} and len(got) == 38


# byte pairs


def test_ids_and_text_are_those_of_the_library(spark, odd_docs, no_docs):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(bpe.default_path())
    more = ["<|endoftext|>", "a<|startoftext|>B <|endoftext|><|ENDOFTEXT|>", "It's we'll I'D 12x3 --'s", "\x00\x1c\x1f\x85\xa0 é é ſ İ Σας ﬁ", "漢字かな 한글 مرحبا", "a　b c", "<|endoftext|" * 3, "🙂🙂‍↔️ ȩ́", "w" * 3000]
    docs = odd_docs.select("doc_id", "text", F.lit("x").alias("ids"), F.lit("y").alias("decoded")).unionAll(spark.createDataFrame([(100 + i, t, "", "") for i, t in enumerate(more)], "doc_id long, text string, ids string, decoded string"))
    texts = [(r.doc_id, r.text or "") for r in docs.collect()]
    want = Counter()
    for i, t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        want[i, tuple(ids), library.decode(ids, skip_special_tokens=False)] += 1
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in bpe.encode_documents(docs).collect()) == want
    assert bpe.encode_documents(no_docs).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=4))
def test_any_text_is_encoded_as_the_library_does(texts):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(bpe.default_path())
    got = bpe.encode_batch([t.encode() for t in texts], bpe._vocabulary(bpe.default_path()))
    assert [np.frombuffer(g, np.int32).tolist() for g in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]


LATIN = st.text(alphabet=st.characters(min_codepoint=1, max_codepoint=0x180), max_size=60)


@settings(max_examples=400, deadline=None)
@given(st.lists(LATIN, max_size=4))
def test_latin_text_is_encoded_as_the_library_does(texts):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(bpe.default_path())
    every = [*texts, "".join(map(chr, range(1, 0x250))), " ".join(map(chr, range(1, 0x250)))]
    got = bpe.encode_batch([t.encode() for t in every], bpe._vocabulary(bpe.default_path()))
    assert [np.frombuffer(g, np.int32).tolist() for g in got] == [library.encode(t, add_special_tokens=False).ids for t in every]


def tiny_file(folder, merges):
    letters = "abcd"
    vocab = {}
    for x in [*letters, *(x + "</w>" for x in letters), *("".join(m) for m in merges)]:
        vocab.setdefault(x, len(vocab))
    path = folder / "tiny.json"
    model = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "fuse_unk": False, "byte_fallback": False, "ignore_merges": False, "vocab": vocab, "merges": [list(m) for m in merges]}
    path.write_text(json.dumps({"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": {"type": "Lowercase"}, "pre_tokenizer": {"type": "Whitespace"}, "post_processor": None, "decoder": None, "model": model}))
    return str(path)


def test_merges_that_wake_lower_ranks_keep_the_librarys_order(tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    rng = random.Random(3)
    woken = [("b", "c"), ("a", "b"), ("ab", "c"), ("abc", "a"), ("a", "bc"), ("b", "c</w>"), ("a", "bc</w>"), ("abc", "abc</w>")]
    for turn in range(60):
        merges = list(woken) if turn == 0 else []
        known = [*"abcd", *(x + "</w>" for x in "abcd"), *("".join(m) for m in merges)]
        while len(merges) < 25:
            pair = (rng.choice([k for k in known if not k.endswith("</w>")]), rng.choice(known))
            if pair not in merges:
                merges.append(pair)
                known.append("".join(pair))
        rng.shuffle(merges)
        path = tiny_file(tmp_path, merges)
        library, vocab = tokenizers.Tokenizer.from_file(path), bpe.Vocabulary(path)
        words = ["".join(rng.choices("abcd", k=rng.randint(1, 14))) for _ in range(60)]
        got = bpe.encode_words([*(w.encode() for w in set(words)), *set(words)], vocab)
        for w in words:
            ids = library.encode(w, add_special_tokens=False).ids
            assert np.frombuffer(got[w.encode()], np.int32).tolist() == np.frombuffer(got[w], np.int32).tolist() == ids


def test_forgetting_and_pieces_change_nothing(monkeypatch):
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choices("abcdeé,'", k=rng.randint(1, 9))) for _ in range(400)).encode() for _ in range(6)]
    vocab = bpe.Vocabulary(bpe.default_path())
    want = bpe.encode_batch(texts, vocab)
    monkeypatch.setattr(bpe, "PIECE", 50)
    monkeypatch.setattr(bpe, "KEPT", 1000)
    assert bpe.encode_batch(texts, bpe.Vocabulary(bpe.default_path())) == want


def test_unknown_ids_decode_to_nothing(spark):
    rows = spark.createDataFrame([(1, [0, 1, 10**9, -5]), (2, []), (3, None), (4, [49407, 256])], "k int, ids array<int>")
    got = {r.k: r.t for r in rows.select("k", bpe.decode(F.col("ids")).alias("t")).collect()}
    assert got[1] == "! \"" and got[2] == "" and got[3] == "" and got[4].startswith("<|endoftext|> ")


def test_other_kinds_of_files_are_refused(tmp_path):
    path = tiny_file(tmp_path, [])
    data = json.loads(open(path).read())
    data["model"]["byte_fallback"] = True
    (tmp_path / "odd.json").write_text(json.dumps(data))
    with pytest.raises(ValueError):
        bpe.Vocabulary(str(tmp_path / "odd.json"))


# filters


def plain_audit(rows, labels):
    texts = [(i, s or "", t or "") for i, s, t in rows]
    fails = []
    for i, s, t in texts:
        words = re.findall(WHITE, t)
        a, b = len(words) < 50, 100 * len(set(words)) < 65 * len(words)
        c, d = 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search("[#$%&*|]", t))
        e = i is not None and any(j is not None and j < i and u == t for j, _, u in texts)
        fails.append((s, {f for f, x in zip("ABCDE", (a, b, c, d, e), strict=True) if x}, i is not None and any(k == i and q == 1 for k, q, _ in labels), i is not None and any(k == i and x == 1 for k, _, x in labels)))
    out = {}
    for part in {f[0] for f in fails}:
        mine = [f for f in fails if f[0] == part]
        shapley = Counter()
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                redundant = sum(f in x[1] for x in mine) - len(gone)
                left = [x for x in left if f not in x[1]]
                out[part, "".join(order), step] = [len(left), len(gone), redundant, sum(x[1] == {f} for x in mine), sum(x[2] for x in gone), sum(x[3] for x in gone)]
                shapley[f] += len(gone)
        for key, v in out.items():
            if key[0] == part:
                v.append(shapley[key[1][key[2] - 1]])
    return out


def test_audit_equals_a_plain_one(spark, odd_docs, no_docs):
    rng = random.Random(5)
    pool = ["x" * 5, "AB " * 60, " ".join(f"w{i}" for i in range(80)), " ".join(f"w{i % 9}" for i in range(80)), "#tag " + " ".join(f"v{i}" for i in range(60)), "", None, "É" * 300]
    rows = [(rng.randint(0, 30), rng.choice(["a", "b", "", None]), rng.choice(pool)) for _ in range(120)] + [(None, "a", pool[2]), (None, "c", pool[0])]
    docs = odd_docs.select("doc_id", F.lit("odd").alias("source"), "text", F.lit(0).alias("n"), F.lit("z").alias("key"), F.lit(3).alias("mask"), F.lit("p").alias("part")).unionAll(
        spark.createDataFrame([(*r, 0, "", 0, "") for r in rows], "doc_id long, source string, text string, n int, key string, mask int, part string")
    )
    labels = [(rng.randint(0, 30), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(25)] + [(None, 1, 1), (3, 1, 1)]
    given_labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("good", F.lit(9)).withColumn("part", F.lit("q"))
    got = {(r.part, r.filter_order, r.step): [r[c] for c in filter_audit.COUNTS] for r in filter_audit.audit_filters(docs, given_labels).collect()}
    assert got == plain_audit([(r.doc_id, r.source, r.text) for r in docs.collect()], labels)
    assert filter_audit.audit_filters(no_docs.withColumn("source", F.lit("s")), given_labels).count() == 0
    bare = filter_audit.audit_filters(docs, given_labels.limit(0))
    assert bare.agg(F.sum("good_lost"), F.sum("toxic_lost")).first() == (0, 0)


def test_every_order_is_visited_once_by_single_swaps():
    for n in range(1, 6):
        order, seen = list(range(n)), [tuple(range(n))]
        for at in filter_audit.plain_changes(n):
            order[at], order[at + 1] = order[at + 1], order[at]
            seen.append(tuple(order))
        assert sorted(seen) == sorted(itertools.permutations(range(n)))


def test_digest_columns_of_op12(spark):
    row = bpe.op12_pair_index(spark, "/root/testdata/sf0.001").orderBy("doc_id").first()
    text = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter(F.col("doc_id") == row.doc_id).first().text or ""
    ids = np.frombuffer(bpe.encode_batch([text.encode()], bpe._vocabulary(bpe.default_path()))[0], np.int32)
    assert (row.n_tokens, row.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
