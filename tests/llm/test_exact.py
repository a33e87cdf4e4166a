"""Operators with exact results, against brute force."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from triagelake.llm import contamination, copies, hmm, longmatch, media, packing, simhash, slots
from triagelake.llm.components import components

WORDS = [f"{a}{b}{c}" for a in ("ba", "ke", "li", "mo", "nu") for b in ("ra", "se", "ti") for c in ("", "n", "st", "ly")]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def key(x):
    return tuple((v is None, v) for v in x)


# media


@pytest.mark.parametrize("kind", range(5))
@pytest.mark.parametrize("size", [64, 128, 64 * 33])
def test_png_round_trip_under_every_filter(kind, size):
    raw = np.random.default_rng(size).integers(0, 256, size, dtype=np.uint8).tobytes()
    assert media.decode_gray(media.encode_gray(raw, filter_kind=kind)).tobytes() == raw


def test_png_mixed_filters_and_damage():
    image = np.random.default_rng(1).integers(0, 256, (5, 64), dtype=np.uint8)
    lines = np.stack([media.filter_rows(image, k)[k] for k in range(5)])
    assert (media.unfilter(lines) == image).all()
    good = media.encode_gray(image.tobytes())
    for at in (3, 20, 50, len(good) - 6):
        bad = bytearray(good)
        bad[at] ^= 1
        with pytest.raises(media.MediaError):
            media.decode_gray(bytes(bad))
    for cut in (0, 10, 40, len(good) - 1):
        with pytest.raises(media.MediaError):
            media.decode_gray(good[:cut])
    with pytest.raises(media.MediaError):
        media.encode_gray(b"")


def test_media_digest(spark, odd_docs, no_docs):
    out = media.read_back(media.store(odd_docs)).collect()
    assert len(out) == odd_docs.count() and media.read_back(media.store(no_docs)).count() == 0
    want = []
    for i, t in texts_of(odd_docs):
        raw = (t or "").encode()
        pad = raw + bytes(-len(raw) % 64 if raw else 64)
        want.append((i, len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:])))
    assert sorted(want, key=key) == sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in out), key=key)
    assert len({r.feature for r in out if r.doc_id in (7, 8)}) == 1 and len({r.feature for r in out}) > 3


def test_stored_lines_are_filtered(spark, odd_docs):
    kinds = set()
    for r in media.store(odd_docs).collect():
        at = r.media.index(b"IDAT")
        lines = zlib.decompress(r.media[at + 4 : at + 4 + int.from_bytes(r.media[at - 4 : at], "big")])
        kinds |= set(lines[:: media.WIDTH + 1])
    assert kinds == set(media.SUMS)


def plain_unfilter(lines):
    """Sample by sample, as the format's text says."""
    out = []
    for kind, *row in lines.tolist():
        above, line = out[-1] if out else [0] * len(row), []
        for i, v in enumerate(row):
            a, b, c = line[i - 1] if i else 0, above[i], above[i - 1] if i else 0
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            line.append((v + [0, a, b, (a + b) // 2, paeth][kind]) % 256)
        out.append(line)
    return out


@pytest.mark.parametrize("kinds", [3, 5])
@pytest.mark.parametrize("height", [1, 2, 64, 150])
def test_unfilter_against_plain_loops(kinds, height):
    rng = np.random.default_rng(height)
    lines = rng.integers(0, 256, (height, 65), dtype=np.uint8)
    lines[:, 0] = rng.integers(0, kinds, height)
    assert media.unfilter(lines).tolist() == plain_unfilter(lines)
    lines[:, 0] = kinds - 1
    assert media.unfilter(lines).tolist() == plain_unfilter(lines)


def plain_cosine_hash(image):
    """Area means and the cosine transform by their defining sums."""
    h, w = image.shape
    share = lambda n: np.array([[max(0.0, min((i + 1) * n / 32, y + 1) - max(i * n / 32, y)) * 32 / n for y in range(n)] for i in range(32)])
    grid = share(h) @ image.astype(float) @ share(w).T
    cos = np.array([[np.cos(np.pi * (2 * x + 1) * k / 64) for x in range(32)] for k in range(8)])
    low = [round(sum(grid[y, x] * cos[j, y] * cos[k, x] for y in range(32) for x in range(32)), 6) for j in range(8) for k in range(8)]
    middle = np.median(low[1:])
    return np.packbits([0] + [v > middle for v in low[1:]]).tobytes()


@pytest.mark.parametrize("height", [1, 7, 50])
def test_cosine_hash_against_sums(height):
    image = np.random.default_rng(height).integers(0, 256, (height, 64), dtype=np.uint8)
    assert media.cosine_hash(image) == plain_cosine_hash(image)


# near copies


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    ones = [sum(xxhash.xxh64_intdigest(g, 42) >> b & 1 for g in grams) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))


def test_fingerprints_and_components(spark, odd_docs, no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0
    out = simhash.near_duplicates(odd_docs).collect()
    fps = [(i, plain_fingerprint(t)) for i, t in texts_of(odd_docs)]
    assert sorted(((i, f) for i, f in fps), key=key) == sorted(((r.doc_id, r.fp % (1 << 64)) for r in out), key=key)
    group = {}
    for r in out:
        group.setdefault(r.fp, set()).add(r.component_id)
    assert all(len(g) == 1 for g in group.values())
    assert {r.component_id for r in out if r.doc_id in (1, 2, 3)} == {1} and {r.component_id for r in out if r.doc_id in (7, 8)} == {7}


@pytest.mark.parametrize("radius", [2, 4])
def test_ball_links_connect_exactly_the_close(spark, radius):
    rng = random.Random(radius)
    base = [rng.getrandbits(64) for _ in range(6)]
    fps = set(base)
    for b in base:
        for _ in range(12):
            x = b
            for _ in range(rng.randint(1, 5)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    rows = [(n, f - (1 << 64) if f >> 63 else f) for n, f in enumerate(sorted(fps))]
    links = simhash.ball_links(spark.createDataFrame(rows, "node long, fp long"), radius)
    got = {r.node: r.component for r in components(links).collect()}
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, f in rows:
        for j, g in rows:
            if i < j and ((f ^ g) & (1 << 64) - 1).bit_count() <= radius:
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
    assert {i: got.get(i, i) for i, _ in rows} == {i: top(i) for i, _ in rows}
    with pytest.raises(ValueError, match="even"):
        simhash.half_ball(3)


def test_components_of_chains_loops_and_hubs(spark):
    edges = [(i, i + 1) for i in range(30)] + [(5, 5), (40, 41), (41, 40), (100, 99)] + [(200, 200 + i) for i in range(1, 40)]
    out = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert out == {**dict.fromkeys(range(31), 0), 40: 40, 41: 40, 99: 99, 100: 99, **dict.fromkeys(range(200, 240), 200)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_one_of_each_group(spark, odd_docs, no_docs):
    rng = random.Random(8)
    base = sentence(rng, 400).split()
    near = [base[:], base[:], base[:]]
    near[1][200] = "changed"
    near[2][10] = "else"
    far = [w if i % 3 else "no" for i, w in enumerate(base)]
    rows = [(i, " ".join(w), f"x{i}") for i, w in enumerate([*near, far, base])]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string")
    assert sorted((r.doc_id, r.node) for r in copies.one_of_each(df).collect()) == [(0, "x0"), (3, "x3")]
    assert copies.one_of_each(no_docs).count() == 0
    kept = copies.one_of_each(odd_docs)
    assert kept.schema == odd_docs.schema
    ids = sorted(str(r.doc_id) for r in kept.collect())
    assert ids.count("7") == 1 and "8" not in ids and "9" not in ids and "None" in ids and sum(i in ids for i in ("1", "2")) == 1


def test_copies_over_many_partitions(spark):
    rng = random.Random(21)
    texts = [sentence(rng, 40) for _ in range(300)]
    rows = [(i, texts[i % 300]) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(220)
    assert sorted(r.doc_id for r in copies.one_of_each(df).collect()) == plain_groups(texts)
    assert longmatch.repeat_digest(df).filter("n_removed = n_bytes").count() == sum(2 for t in texts if len(t) >= 200)


def plain_groups(texts):
    """The first row of each group of near copies, by all pairs."""
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)})
    parent = list(range(len(sets)))

    def top(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for j, t in enumerate(sets):
        for i in range(j):
            both = len(sets[i] & t)
            if both / (len(sets[i]) + len(t) - both) >= 0.8:
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
    return sorted({top(i) for i in range(len(sets))})


def test_copies_of_one_template_that_differ_from_each_other(spark):
    rng = random.Random(11)
    template = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    texts = []
    for _ in range(1000):
        w = template[:]
        for at in rng.sample(range(300), 5):
            w[at] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    texts.insert(500, " ".join(template))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in copies.one_of_each(df).collect()) == plain_groups(texts)


def test_near_copies_under_every_kind_of_edit(spark):
    rng = random.Random(12)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    texts = []
    for size in (60, 300):
        for k in range(30):
            base, n = fresh(size), size // 5 - 4 + k % 4  # about the similarity, on both sides of it
            at = rng.randrange(size - n)
            texts += [" ".join(base), " ".join([base + fresh(n), base[:-n], base[: at + n // 2] + fresh(n // 2) + base[at + n // 2 + n // 2 :], base + base[:size // 2] * 3, base[:at] + base[at : at + n] * 2 + base[at + n :]][k % 5])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = plain_groups(texts)
    assert len(want) < 0.8 * len(texts)
    assert sorted(r.doc_id for r in copies.one_of_each(df).collect()) == want


def test_near_copies_meet_by_their_fingerprints_first(spark, monkeypatch):
    """Balls link what they can, an exact check follows, and the prefix join is left with the rest."""
    rng = random.Random(31)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    bits = lambda a, b: ((copies.fingerprint(a.encode()) ^ copies.fingerprint(b.encode())) & (1 << 64) - 1).bit_count()
    edits = (" ".join([*base[:i], "else", *base[i + 1 :]]) for i in range(400))
    close = next(t for t in edits if 0 < bits(" ".join(base), t) <= 2)
    dull = [" ".join(["a"] * 100 + [f"w{rng.randrange(10**6)}" for _ in range(20)]) for _ in range(2)]
    assert bits(*dull) == 0  # one fingerprint, other texts
    texts = [" ".join(base), close, " ".join(base[60:]), *dull]
    seen, real = [], copies._verified
    monkeypatch.setattr(copies, "_verified", lambda pairs, *a: seen.append(sorted((r.a & 7, r.b & 7) for r in pairs.collect())) or real(pairs, *a))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    assert sorted(r.doc_id for r in copies.one_of_each(df).collect()) == plain_groups(texts) == [0, 3, 4]
    assert seen[0] == [(0, 1), (3, 4)] and not any((0, 1) in s for s in seen[1:])


# long repeats


def plain_removal(texts, length):
    seen = Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = True
        out.append((len(t), int(gone.sum()), longmatch.runs(gone), hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return out


def test_long_repeats(spark, odd_docs, no_docs):
    rng = random.Random(2)
    shared = [sentence(rng, 60)[:n] for n in (199, 200, 201, 260)]
    rows = []
    for i in range(40):
        own = sentence(rng, rng.randint(1, 40))
        rows.append((i, own + shared[i % 4] + sentence(rng, 5) + (shared[(i + 1) % 4] if i % 3 else "")))
    rows += [(50, "ab" * 300), (51, "a" * 250), (52, "é" * 150), (53, None), (54, "")]
    for docs in (spark.createDataFrame(rows, "doc_id long, text string"), odd_docs):
        texts = [((t or "").encode(), i) for i, t in texts_of(docs)]
        want = sorted(((i, *x) for (t, i), x in zip(texts, plain_removal([t for t, _ in texts], 200))), key=key)
        assert want == sorted((tuple(r) for r in longmatch.repeat_digest(docs).collect()), key=key)
    assert longmatch.repeat_digest(no_docs).count() == 0
    kept = longmatch.without_repeats(odd_docs)
    assert kept.schema == odd_docs.schema and kept.count() == odd_docs.count()


@pytest.mark.parametrize("pairs", [False, True])
def test_family_marks_all_meetings_whatever_the_batches(pairs):
    rng = np.random.default_rng(5)
    h = (rng.integers(0, 200, 900).astype(np.uint64) << np.uint64(2)) * np.uint64(4)
    s = rng.integers(0, 3, 900).astype(np.uint64) * np.uint64(4)
    for size in (1, 7, 100, 900):
        family = longmatch.Family(pairs)
        for at in range(0, 900, size):
            family.add(h[at : at + size].copy(), s[at : at + size].copy())
        assert len(family.levels) <= 11
        flags = family.flags(h, s)
        for i in range(900):
            same = s[(h == h[i]) & (s == s[i])] if pairs else s[h == h[i]]
            assert bool(flags[i] & longmatch.AGAIN) == (len(same) > 1) and bool(flags[i] & longmatch.VARIED) == (len(set(same.tolist())) > 1)


def test_windows_that_share_one_fingerprint_are_told_apart(monkeypatch):
    """The first fingerprint of windows is made to collide for all texts; the second one decides."""
    real = longmatch.Prints.of

    def of(self, start, end):
        made = real(self, start, end)
        return made if self.kind else made & np.uint64(1)

    monkeypatch.setattr(longmatch.Prints, "of", of)
    texts = [bytes([65 + i]) * 3 + bytes(range(40, 120)) * 3 for i in range(4)]
    h = [longmatch.Items(longmatch.Prints(np.frombuffer(t, np.uint8)), np.ones(44, bool), 200, 200) for t in texts]
    assert len(np.unique(np.concatenate([x.h for x in h]))) <= 2
    family = longmatch.Family(True)
    rows = []
    for t, x in zip(texts, h, strict=True):
        rows.append(longmatch.combine(x.h, longmatch.window_checks(np.frombuffer(t, np.uint8), x, 200), True))
        family.add(*(y.copy() for y in rows[-1]))
    alone = sum(int((family.flags(a, b & ~longmatch.FLAGS) == 0).sum()) for a, b in rows)
    assert alone == 4 * 3


def test_bucket_numbers_match_spark(spark):
    ids = [0, 1, 7 << 32 | 3, (1 << 45) + 12345, 99 << 24]
    got = spark.createDataFrame([(i,) for i in ids], "c long").select(F.pmod(F.hash("c"), F.lit(13))).collect()
    assert [r[0] for r in got] == [longmatch._bucket_of(i, 13) for i in ids]


# benchmark passages


def plain_overlaps(docs, items):
    out = {}
    for i, t in docs:
        w = (t or "").lower().split()
        for j, u in items:
            v = (u or "").lower().split()
            if len(v) < contamination.SHORTEST:
                continue
            need = contamination.NEED if len(v) >= contamination.WINDOW else len(v)
            for diag in range(-len(v), len(w)):
                same = [0 <= diag + p < len(w) and w[diag + p] == v[p] for p in range(len(v))]
                best = max(sum(same[p : p + contamination.WINDOW]) for p in range(len(v)))
                if best >= need:
                    out[i, j] = max(best, out.get((i, j), 0))
    return out


def test_contamination(spark, odd_docs, no_docs):
    rng = random.Random(6)
    items = [(k, sentence(rng, n)) for k, n in enumerate((5, 7, 12, 13, 30, 60))] + [(90, None), (91, "")]
    docs = [(100, None), (101, ""), (102, " ".join(t or "" for _, t in items))]
    for n in range(40):
        w = items[rng.randrange(1, 6)][1].split()
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = "changed"
        docs.append((n, sentence(rng, rng.randint(0, 30)) + " " + " ".join(w[rng.randint(0, 3) :]).upper() + "\n" + sentence(rng, rng.randint(0, 5))))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = plain_overlaps(docs, items)
    assert len(want) > 20
    assert {(r.doc_id, r.item_id): r.n_matched for r in contamination.contaminated(d, b).collect()} == want
    kept = {r.doc_id for r in contamination.without_contaminated(d, b).collect()}
    assert kept == {i for i, _ in docs} - {i for i, _ in want}
    assert contamination.without_contaminated(odd_docs, b).count() == odd_docs.count()
    assert contamination.contaminated(no_docs, b).count() == 0 and contamination.contaminated(d, b.limit(0)).count() == 0


# shards


def test_slots(spark, odd_docs, no_docs, tmp_path):
    out = slots.shard_documents(odd_docs, 4, 64).collect()
    want = sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts_of(odd_docs)), key=key)
    assert want == sorted(((r.doc_id, r["size"], r.text_crc32) for r in out), key=key)
    for s in {r.shard for r in out}:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    assert slots.shard_documents(no_docs, 4, 64).count() == 0
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 90).cast("int")).alias("text"))
    path = str(tmp_path / "map")
    first = slots.shard_documents(docs, 4, 512, path)
    load = [r["b"] for r in first.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert max(load) < 1.01 * min(load)
    second = slots.shard_documents(docs, 5, 512, path)
    load = [r["b"] for r in second.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(load) == 5 and max(load) < 1.1 * min(load)
    (v1, old), (v2, new) = slots.load_map(spark, path, 1), slots.load_map(spark, path)
    assert (v1, v2) == (1, 2) and sum(old[k] != new[k] for k in old) < 0.3 * len(old)
    gone = slots.rebalanced(new, {k: (1, 1) for k in new}, 3)
    assert set(gone.values()) == {0, 1, 2}
    with pytest.raises(AnalysisException):
        slots.store_map(spark, path, 2, new)  # another writer's version stays


def test_equal_rows_spread_over_shards(spark):
    docs = spark.range(3000).select((F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id"))).alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    out = slots.shard_documents(docs, 16)
    load = [r["b"] for r in out.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert out.count() == 3000 and len(load) == 16 and max(load) < 1.02 * min(load)
    assert out.groupBy("vslot").count().agg(F.max("count")).first()[0] < 20
    numbers = out.groupBy("shard").agg(F.countDistinct("slot").alias("n"), F.max("slot").alias("m")).collect()
    assert all(r.n == r.m + 1 for r in numbers) and sum(r.n for r in numbers) == 3000


# packing


def test_packing(spark, odd_docs, no_docs):
    caps = (16, 64, 256)
    out = packing.pack_documents(odd_docs, caps, 4, 512, 10).collect()
    want = Counter((i, len((t or "").encode().split()) + 1) for i, t in texts_of(odd_docs))
    total = Counter()
    for r in out:
        total[r.doc_id] += r.n_tokens
        assert r.first_token == r.piece * 256 and 1 <= r.n_tokens <= 256
    assert total == Counter({i: 0 for i, _ in want}) + Counter({i: sum(n * m for (j, n), m in want.items() if j == i) for i, _ in want})
    bins = {}
    for r in out:
        bins.setdefault((r.bin, r.capacity), []).append((r.bin_offset, r.n_tokens))
    for (_, cap), parts in bins.items():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= cap and cap == min(c for c in caps if c >= at)
    assert packing.pack_documents(no_docs).count() == 0


def test_best_fit_takes_the_tightest_bin():
    bins, offsets, final = packing.pack(np.array([60, 50, 14, 4, 4]), (64,), 0)
    assert bins.tolist() == [0, 1, 1, 0, 2] and offsets.tolist() == [0, 0, 50, 60, 0] and final == [64, 64, 64]
    assert packing.pack(np.array([5]), (8, 64), 0)[2] == [8]


def least_cost(lengths, sizes, cost):
    """The least cost of all ways to part the pieces into bins, each of the smallest length that holds it."""
    best = [float("inf")]

    def go(i, inside):
        if i == len(lengths):
            best[0] = min(best[0], sum(cost(next(c for c in sizes if c >= x)) for x in inside))
            return
        for j in range(len(inside)):
            if inside[j] + lengths[i] <= sizes[-1]:
                go(i + 1, [*inside[:j], inside[j] + lengths[i], *inside[j + 1 :]])
        go(i + 1, [*inside, lengths[i]])

    go(0, [])
    return best[0]


def test_packing_cost_is_near_that_of_an_exhaustive_search():
    rng, sizes, ratio = random.Random(3), (8, 16, 32), []
    cost = lambda c: packing.cost_of(c, 2, 64)
    for _ in range(60):
        lengths = sorted((rng.randint(1, rng.choice([6, 20, 32])) for _ in range(rng.randint(1, 8))), reverse=True)
        got = sum(map(cost, packing.pack(np.array(lengths), sizes, 2, 64)[2]))
        ratio.append(got / least_cost(lengths, sizes, cost))
    assert min(ratio) > 1 - 1e-9 and max(ratio) < 1.25 and np.mean(ratio) < 1.02


def test_lengths_compete_and_beat_each_single_one():
    lengths = np.sort(np.minimum(np.random.default_rng(1).lognormal(5.5, 1, 5000).astype(int) + 1, 4096))[::-1]
    final = packing.pack(lengths)[2]
    total = sum(map(packing.cost_of, final))
    assert len(set(final)) >= 3 and sum(final) < 1.02 * lengths.sum()
    assert total <= sum(map(packing.cost_of, packing.pack(lengths, (4096,))[2]))


def test_equal_rows_spread_over_groups(spark):
    docs = spark.range(4000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("a b c").alias("text"))
    out = packing.pack_documents(docs, group_pieces=500).withColumn("grp", F.shiftright("bin", 32)).groupBy("grp").count().collect()
    assert len(out) == 9 and max(r["count"] for r in out) < 700 and sum(r["count"] for r in out) == 4000


# language model


def plain_forward(m, codes):
    a, total = m.start * m.emit[codes[0]], 0.0
    for x in codes[1:]:
        z = a.sum()
        total += np.log10(z)
        a = (a / z @ m.move) * m.emit[x]
    return total + np.log10(a.sum())


def test_forward_is_exact_across_spans():
    rng = np.random.default_rng(0)
    m = hmm.Model.first(np.full(40, 1 / 40), 4)
    seqs = [rng.integers(0, 40, n) for n in (1, 8, 9, 16, 17, 63, 200)]
    assert np.allclose(hmm.log10_likelihoods(m, seqs, span=8), [plain_forward(m, s) for s in seqs], atol=1e-9)


def test_baum_welch_never_loses_likelihood():
    rng = np.random.default_rng(1)
    seqs = [np.repeat(rng.integers(0, 2, 8), 5) * 10 + rng.integers(0, 10, 40) for _ in range(30)]
    m, last = hmm.Model.first(np.full(20, 1 / 20), 2), -np.inf
    for _ in range(8):
        now = hmm.log10_likelihoods(m, seqs).sum()
        assert now > last - 1.0
        last = now
        start, move, emit = hmm.expected(m, seqs)
        assert np.isclose(start.sum(), 30) and np.isclose(emit.sum(), 30 * 40) and np.isclose(move.sum(), 30 * 39)
        m = m.refit(start, move, emit, np.full(20, 1 / 20))


def plain_expected(m, seq):
    """Starts, moves and emissions of one sequence, token by token."""
    k, n = len(m.start), len(seq)
    a, b = np.zeros((n, k)), np.ones((n, k))
    for t in range(n):
        a[t] = (a[t - 1] @ m.move if t else m.start) * m.emit[seq[t]]
        a[t] /= a[t].sum()
    for t in range(n - 2, -1, -1):
        b[t] = m.move @ (m.emit[seq[t + 1]] * b[t + 1])
        b[t] /= b[t].sum()
    g = a * b / (a * b).sum(1, keepdims=True)
    move, emit = np.zeros((k, k)), np.zeros_like(m.emit)
    for t in range(n - 1):
        x = a[t][:, None] * m.move * (m.emit[seq[t + 1]] * b[t + 1])
        move += x / x.sum()
    np.add.at(emit, seq, g)
    return g[0], move, emit


def test_every_round_reads_all_rows_and_whole_texts(spark):
    rng = np.random.default_rng(3)
    seqs = [rng.integers(0, 40, n).astype(np.uint16) for n in [1, 5, 256, 257, 1500, 2500] + [30] * 100]
    coded = spark.createDataFrame([(i, False, bytearray(s.tobytes())) for i, s in enumerate(seqs)], "uid long, held_out boolean, codes binary").repartition(3)
    unigram = np.full(40, 1 / 40)
    got, want = hmm.train(coded, unigram, 3, 2), hmm.Model.first(unigram, 3)
    for _ in range(2):
        want = want.refit(*(sum(x) for x in zip(*(plain_expected(want, s) for s in seqs), strict=True)), unigram)
    assert np.allclose(got.emit, want.emit, rtol=1e-3) and np.allclose(got.move, want.move, rtol=1e-3) and np.allclose(got.start, want.start, rtol=1e-3)


def test_scores_do_not_depend_on_partitions_and_equal_a_plain_forward(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("doc_id < 200")
    one, two = ({r.doc_id: r for r in hmm.score_documents(docs.repartition(n), hmm.held_out(5, 1), 3, 4, head=500).collect()} for n in (2, 7))
    assert all(abs(two[i].score - r.score) < 1e-6 * abs(r.score) and two[i].base_score == pytest.approx(r.base_score) for i, r in one.items())
    rows = docs.select("doc_id", "text").withColumn("held_out", hmm.held_out(5, 1))
    counts = hmm.word_counts(rows.filter("not held_out")).persist()
    voc = hmm.vocabulary(counts, 500)
    model = hmm.train(hmm.encode(rows, voc), voc.unigram, 3, 4)
    known = {bytes(r.word): r.c for r in counts.collect()}
    find, single = voc.index(), min(hmm.SINGLES, 500)
    for i, t in texts_of(docs.limit(30)):
        words = hmm.tokens_of((t or "").encode())
        codes = [find[w] if find.get(w, single) < single else hmm.suffix_class(w) for w in words]
        inside = sum(np.log10(known.get(w, 0) + 0.5) - voc.class_log[c - hmm.SINGLES] for w, c in zip(words, codes) if c >= hmm.SINGLES)
        assert one[i].score == pytest.approx(plain_forward(model, codes) + inside, rel=1e-6)


@pytest.mark.parametrize("head", [0, 20, 5000])
def test_language_model_scores(spark, odd_docs, no_docs, head):
    out = hmm.score_documents(odd_docs, hmm.held_out(5, 1), 3, 1, head).collect()
    docs = [(i, (t or "").encode().lower().split() + [b""]) for i, t in texts_of(odd_docs)]
    hold = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    counts = Counter(w for i, ws in docs if not hold(i) for w in ws)
    n, d = sum(counts.values()), sum(counts.values()) + 0.5 * (len(counts) + 1)
    want = sorted(((i, hold(i), len(ws), sum(w in counts for w in ws), n, round(sum(np.log10((counts[w] + 0.5) / d) for w in ws), 6)) for i, ws in docs), key=key)
    assert want == sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out), key=key)
    assert all(r.score < 0 for r in out)
    assert hmm.score_documents(no_docs, hmm.held_out(5, 1), 3, 1).count() == 0
