"""Main text of web pages by a recurrent block labeller.

A page is read into leaf blocks: runs of text between block-level tags, each
with the path of open elements above it.  A bidirectional LSTM in numpy reads
the sequence of blocks (hashed vectors of the tag path and its class names, of
the words, and a few shares) and labels each with the whole page as context.
The text is what blocks labelled main say.

The model is trained where it is used, on at most ``TRAIN_PAGES`` distinct
pages of the table, chosen by a hash of the whole row, and on variants of them
with renamed containers, lists and tables, and inserted side matter.  Of each a stretch of
``TRAIN_BLOCKS`` blocks at a place chosen by the hash is used, so pages of all
lengths take part.  Their labels come from the markup (``teacher``), so no
marked pages are needed.

Memory: an open element is one node that points to the one above it and holds
the sum of the vectors down to it, so depth costs a node an element; the net
reads at most ``CELLS`` blocks at once, side by side (a longer page alone), and
keeps no trace.

Defined cases: a null or empty page has an empty text; broken markup is read
as far as it goes (an unclosed comment or script runs to the end); repeated
rows give repeated results; pages and blocks of any length are read whole; an
empty table gives no row; where no page has a block to learn from, the labels
are those of ``teacher``.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import small_batches

TRAIN_PAGES, TRAIN_BLOCKS, VARIANTS, EPOCHS = 160, 256, 5, 14
PATH_DIM, WORD_DIM, SHARES, HIDDEN = 24, 8, 6, 12
CUT = 0.5
CELLS = 40_000  # blocks and padding that the net reads at once

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][\w:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][\w:-]*)([^>]*)>""", re.S)
OPEN = re.compile(r"<(?:!--|[!?/]?[a-zA-Z])")
ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style template noscript iframe svg textarea object title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
#: Opening one of the first closes an open one of the second.
CLOSES = {"li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
SCOPE = frozenset("table ul ol dl select article section div main body".split())

#: Names that mark side matter and names that mark an article, in tags, classes and ids.
SIDE = frozenset("nav menu header footer aside sidebar form button select ad ads advert advertisement sponsor banner promo cookie cookies consent notice alert comment comments reply respond share social related breadcrumb breadcrumbs subscribe newsletter login search modal popup widget copyright pagination".split())
MAIN = frozenset("article main content post entry story".split())


def _vectors(size: int, dim: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).normal(0, 1 / math.sqrt(dim), (size, dim)).astype(np.float32)


PATHS, WORDS = _vectors(4096, PATH_DIM, 1), _vectors(4096, WORD_DIM, 2)
WIDTH = 2 * PATH_DIM + WORD_DIM + SHARES


def _hash(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "replace")) & 4095


class Node:
    """An open element: its names, the one it stands in, and what the path down to it sums up to."""

    __slots__ = ("linked", "main", "names", "side", "total", "up")

    def __init__(self, up: Node | None, names: tuple[str, ...]):
        plain = {n.lstrip(".#") for n in names}
        self.up, self.names = up, names
        self.total = PATHS[[_hash(n) for n in names]].sum(0) + (up.total if up else 0)
        self.main = bool(plain & MAIN) or (up is not None and up.main)
        self.side = bool(plain & SIDE) or (up is not None and up.side)
        self.linked = names[0] == "a" or (up is not None and up.linked)

    def last(self, n: int = 2) -> list[str]:
        """The n innermost names, the outer first."""
        out, at = [], self
        while at and len(out) < n:
            out = [*at.names[-(n - len(out)) :], *out]
            at = at.up
        return out


def node(*elements: tuple[str, ...]) -> Node | None:
    """The innermost node of a path of elements' names."""
    at = None
    for names in elements:
        at = Node(at, names)
    return at


Block = tuple[str, Node | None, float]  # text, innermost open element, share of link text


def read_blocks(html: str | None) -> list[Block]:
    """Leaf blocks of a page in order."""
    out: list[Block] = []
    stack: list[tuple[str, Node]] = []
    opened: Counter[str] = Counter()
    text: list[str] = []
    path: Node | None = None
    linked = 0

    def close() -> None:
        nonlocal linked
        words = "".join(text).split()
        if words:
            joined = " ".join(words)
            out.append((joined, path, min(1.0, linked / len(joined))))
        text.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal path, linked
        if not raw:
            return
        raw = entities.unescape(raw)
        top = stack[-1][1] if stack else None
        if not text and raw.strip():
            path = top
        if text or raw.strip():
            text.append(raw)
            if top and top.linked:
                linked += len(raw.strip())

    def cut(i: int) -> None:
        for tag, _ in stack[i:]:
            opened[tag] -= 1
        del stack[i:]

    html = html or ""
    at = 0
    while True:
        m = TAG.search(html, at) if html.find(">", at) >= 0 else None  # without an end no tag can follow
        if m is None:
            broken = OPEN.search(html, at)  # a tag or comment that is cut off is no text
            say(html[at : broken.start()] if broken else html[at:])
            break
        say(html[at : m.start()])
        at = m.end()
        ends, tag, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag not in INLINE:
            close()
        if ends:
            for i in range(len(stack) - 1, -1, -1) if opened[tag] > 0 else ():
                if stack[i][0] == tag:
                    cut(i)
                    break
                if tag in INLINE and stack[i][0] not in INLINE:
                    break
            continue
        if tag in SILENT:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        if tag not in INLINE:
            shut = CLOSES.get(tag, set()) | {"p"}
            for i in range(len(stack) - 1, -1, -1) if any(opened[x] > 0 for x in shut) else ():
                if stack[i][0] in shut:
                    cut(i)
                    break
                if stack[i][0] in SCOPE:
                    break
        if tag in VOID or rest.endswith("/"):
            continue
        names = [tag]
        for kind, *values in ATTRIBUTE.findall(rest):
            for value in re.split(r"[\s_-]+", next((v for v in values if v), "").lower()):
                if value:
                    names.append(f"{'#' if kind.lower() == 'id' else '.'}{value}")
        stack.append((tag, Node(stack[-1][1] if stack else None, tuple(names))))
        opened[tag] += 1
    close()
    return out


def teacher(blocks: list[Block]) -> list[int]:
    """Labels from the markup: inside an article and outside of side matter."""
    labels = [int(at is not None and at.main and not at.side) for _, at, _ in blocks]
    if any(labels):
        return labels
    return [int(not (at and at.side) and len(t.split()) >= 8 and link < 0.3) for t, at, link in blocks]


def block_inputs(blocks: list[Block]) -> np.ndarray:
    """A row of inputs for each block."""
    x = np.zeros((len(blocks), WIDTH), np.float32)
    for i, (text, path, link) in enumerate(blocks):
        if path:
            x[i, :PATH_DIM] = path.total
            x[i, PATH_DIM : 2 * PATH_DIM] = PATHS[[_hash(n) for n in path.last()]].sum(0)
        words = text.lower().split()
        at = 2 * PATH_DIM
        x[i, at : at + WORD_DIM] = WORDS[[_hash(w) for w in words]].mean(0)
        marks = sum(text.count(c) for c in ".,;!?")
        x[i, at + WORD_DIM :] = math.log1p(len(words)) / 3, link, min(1.0, marks / len(words)), i / len(blocks), math.log1p(len(blocks)) / 4, text[0].isupper()
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Bidirectional LSTM with a logistic output for each block."""

    def __init__(self, seed: int = 3, hidden: int = HIDDEN):
        rng, h = np.random.default_rng(seed), hidden
        self.p = {}
        for side in "fb":
            self.p[f"w{side}"] = rng.normal(0, 0.1, (WIDTH + h, 4 * h))
            self.p[f"c{side}"] = np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)])  # remember at first
        self.p["out"], self.p["bias"] = rng.normal(0, 0.1, 2 * h), np.zeros(1)

    def _run(self, x: np.ndarray, keep: np.ndarray, side: str) -> tuple[np.ndarray, list]:
        """Hidden states along time (rows past a lane's end hold still) and what the way back needs."""
        w, c0 = self.p[f"w{side}"], self.p[f"c{side}"]
        steps, lanes, h = x.shape[0], x.shape[1], len(c0) // 4
        hid, cell, states, trace = np.zeros((lanes, h)), np.zeros((lanes, h)), np.zeros((steps, lanes, h)), []
        drive = x @ w[:WIDTH] + c0
        for t in range(steps):
            z = drive[t] + hid @ w[WIDTH:]
            i, f, o, g = _sigmoid(z[:, :h]), _sigmoid(z[:, h : 2 * h]), _sigmoid(z[:, 2 * h : 3 * h]), np.tanh(z[:, 3 * h :])
            new = f * cell + i * g
            k = keep[t][:, None]
            trace.append((hid, cell, i, f, o, g, np.tanh(new)))
            cell = np.where(k, new, cell)
            hid = np.where(k, o * np.tanh(new), hid)
            states[t] = hid
        return states, trace

    def logits(self, x: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, tuple]:
        ahead, ta = self._run(x, keep, "f")
        back, tb = self._run(x[::-1], keep[::-1], "b")
        both = np.concatenate([ahead, back[::-1]], axis=2)
        return both @ self.p["out"] + self.p["bias"], (both, ta, tb)

    def gradients(self, x: np.ndarray, keep: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        z, (both, ta, tb) = self.logits(x, keep)
        p, n = _sigmoid(z), max(keep.sum(), 1)
        loss = -(np.log(np.where(y > 0, p, 1 - p) + 1e-12) * keep).sum() / n
        d = (p - y) * keep / n
        grads = {"out": np.einsum("tl,tlh->h", d, both), "bias": np.array([d.sum()])}
        h = both.shape[2] // 2
        grads["wf"], grads["cf"] = self._back(x, keep, d[..., None] * self.p["out"][:h], ta, "f")
        grads["wb"], grads["cb"] = self._back(x[::-1], keep[::-1], (d[..., None] * self.p["out"][h:])[::-1], tb, "b")
        return float(loss), grads

    def _back(self, x: np.ndarray, keep: np.ndarray, d_states: np.ndarray, trace: list, side: str) -> tuple[np.ndarray, np.ndarray]:
        w = self.p[f"w{side}"]
        gw, gc = np.zeros_like(w), np.zeros(w.shape[1])
        dh, dc = np.zeros_like(trace[0][0]), np.zeros_like(trace[0][1])
        for t in range(len(trace) - 1, -1, -1):
            hid, cell, i, f, o, g, tc = trace[t]
            k = keep[t][:, None]
            dh = dh + d_states[t]
            d_new = np.where(k, dc + dh * o * (1 - tc * tc), 0)
            dz = np.concatenate([d_new * g * i * (1 - i), d_new * cell * f * (1 - f), np.where(k, dh * tc, 0) * o * (1 - o), d_new * i * (1 - g * g)], axis=1)
            gw[:WIDTH] += x[t].T @ dz
            gw[WIDTH:] += hid.T @ dz
            gc += dz.sum(0)
            dc = np.where(k, d_new * f, dc)
            dh = np.where(k, dz @ w[WIDTH:].T, dh)
        return gw, gc

    def fit(self, pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = EPOCHS, lanes: int = 32, rate: float = 0.02, seed: int = 5) -> float:
        """Adam over padded batches of pages of like length; the last epoch's mean loss."""
        rng, mean, var, step, loss = np.random.default_rng(seed), {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0, 0.0
        order = sorted(range(len(pages)), key=lambda i: len(pages[i]))
        groups = [order[i : i + lanes] for i in range(0, len(order), lanes)]
        for epoch in range(epochs):
            losses = []
            for g in rng.permutation(len(groups)):
                x, keep = _padded([pages[i] for i in groups[g]])
                y = np.zeros(keep.shape)
                for lane, i in enumerate(groups[g]):
                    y[: len(labels[i]), lane] = labels[i]
                loss, grads = self.gradients(x, keep, y)
                losses.append(loss)
                step += 1
                for k, v in grads.items():
                    v = np.clip(v, -1, 1)
                    mean[k] = 0.9 * mean[k] + 0.1 * v
                    var[k] = 0.99 * var[k] + 0.01 * v * v
                    self.p[k] = self.p[k] - rate * (1 - 0.9 * epoch / epochs) * (mean[k] / (1 - 0.9**step)) / (np.sqrt(var[k] / (1 - 0.99**step)) + 1e-8)
            loss = float(np.mean(losses)) if losses else 0.0
        return loss

    def _states(self, x: np.ndarray, keep: np.ndarray, side: str) -> np.ndarray:
        """Hidden states as ``_run`` gives them, without a trace."""
        w, c0 = self.p[f"w{side}"].astype(np.float32), self.p[f"c{side}"].astype(np.float32)
        steps, lanes, h = x.shape[0], x.shape[1], len(c0) // 4
        hid, cell, states = np.zeros((lanes, h), np.float32), np.zeros((lanes, h), np.float32), np.zeros((steps, lanes, h), np.float32)
        for t in range(steps):
            z = x[t] @ w[:WIDTH] + c0 + hid @ w[WIDTH:]
            gates, k = _sigmoid(z[:, : 3 * h]), keep[t][:, None]
            new = gates[:, h : 2 * h] * cell + gates[:, :h] * np.tanh(z[:, 3 * h :])
            cell = np.where(k, new, cell)
            hid = np.where(k, gates[:, 2 * h :] * np.tanh(new), hid)
            states[t] = hid
        return states

    def chances(self, x: np.ndarray, keep: np.ndarray) -> np.ndarray:
        """How likely each block is main text, by time and lane."""
        h = len(self.p["out"]) // 2
        out = self._states(x, keep, "f") @ self.p["out"][:h]
        out += self._states(x[::-1], keep[::-1], "b")[::-1] @ self.p["out"][h:]
        return _sigmoid(out + self.p["bias"])

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Whether each block is main text."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        while order:
            some = [order.pop(0)]
            while order and len(pages[order[0]]) * (len(some) + 1) <= CELLS:
                some.append(order.pop(0))
            p = self.chances(*_padded([pages[i] for i in some]))
            for lane, i in enumerate(some):
                out[i] = p[: len(pages[i]), lane] >= CUT
        return out


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(p) for p in pages)
    x, keep = np.zeros((steps, len(pages), WIDTH), np.float32), np.zeros((steps, len(pages)), bool)
    for lane, p in enumerate(pages):
        x[: len(p), lane], keep[: len(p), lane] = p, True
    return x, keep


Row = tuple[str, tuple[tuple[str, ...], ...], float]  # text, names of each open element, share of link text


def _opened_up(blocks: list[Block]) -> list[Row]:
    out = []
    for t, at, link in blocks:
        path = []
        while at:
            path.append(at.names)
            at = at.up
        out.append((t, tuple(path[::-1]), link))
    return out


def _nested(rows: list[Row]) -> list[Block]:
    seen: dict[tuple[tuple[str, ...], ...], Node | None] = {(): None}
    for _, path, _ in rows:
        for i in range(len(path)):
            if path[: i + 1] not in seen:
                seen[path[: i + 1]] = Node(seen[path[:i]], path[i])
    return [(t, seen[path], link) for t, path, link in rows]


def variant(rows: list[Row], labels: list[int], rng: random.Random) -> tuple[list[Block], list[int]]:
    """The page with other container names and with side matter put in."""
    new = rng.choice([(("main",),), (("div", ".content"),), (("div", "#main"),), (("section", ".post"),), (("main",), ("article",)), (("div", ".entry", ".content"),), (("article",),)])
    kept = []
    for (t, path, link), y in zip(rows, labels, strict=True):
        path = tuple(p for names in path for p in (new if names[0] == "article" else (names,)))
        if y and rng.random() < 0.4:  # an article has lists, tables and quotations too, and short lines in them
            path = path[: len(path) - (path[-1:] == (("p",),))] + rng.choice([(("ul",), ("li",)), (("ol",), ("li",)), (("blockquote",), ("p",)), (("table",), ("tr",), ("td",)), (("h2",),), (("figure",), ("figcaption",)), (("pre",),)])
            t = " ".join(t.split()[: rng.choice([1, 2, 4, 9, 40])])
        kept.append(((t, path, link), y))
    inner = next((p for (_, p, _), y in kept if y), (("html",), ("body",)))[:-1]
    for _ in range(rng.randint(2, 6)):
        where = rng.choice([("nav",), ("aside",), ("aside", ".sidebar"), ("footer",), ("header",), ("form",), ("div", ".ad"), ("div", ".advert"), ("div", ".cookie", ".notice"), ("section", ".comments"), ("div", ".comment"), ("div", "#comments"), ("ol", ".comment", ".list"), ("div", ".related"), ("div", ".share"), ("div", ".promo"), ("div", "#sidebar")])
        path = (inner if where[0] not in ("header", "footer", "nav") and rng.random() < 0.65 else (("html",), ("body",))) + (where,)
        path += rng.choice([(), (("p",),), (("p",),), (("ul",), ("li",)), (("div",), ("p",)), (("h3",),), (("button",),), (("label",),)])
        at = rng.randint(0, len(kept))
        for _ in range(rng.choice([1, 1, 2, 4])):
            text = " ".join(rng.choice(rows)[0].split()[: rng.choice([1, 2, 5, 12, 40])])  # it reads like the page
            kept.insert(at, ((text, path, float(path[-1][0] == "li" and rng.random() < 0.7)), 0))
    return _nested([b for b, _ in kept]), [y for _, y in kept]


def lessons(html: str | None, seed: int) -> list[tuple[np.ndarray, list[int]]]:
    """Inputs and labels of a stretch of a page and of its variants."""
    blocks = read_blocks(html)
    if not blocks:
        return []
    rng, labels = random.Random(seed), teacher(blocks)
    at = rng.randint(0, max(0, len(blocks) - TRAIN_BLOCKS))
    blocks, labels = blocks[at : at + TRAIN_BLOCKS], labels[at : at + TRAIN_BLOCKS]
    rows = [(t, path[:8] + path[8:][-8:], link) for t, path, link in _opened_up(blocks)]
    return [(block_inputs(x), y) for x, y in [(blocks, labels), *(variant(rows, labels, rng) for _ in range(VARIANTS))]]


def train_labeller(pages: DataFrame, most: int = TRAIN_PAGES) -> Labeller | None:
    """Fit on a bounded sample of the table and its variants, made on executors; none without a block to learn from."""
    h = F.xxhash64("page_id", "url", "html")
    total = max(pages.select(h.alias("h")).distinct().count(), 1)  # repeated rows are one page here too
    near = F.pmod(h, F.lit(1 << 30)) / F.lit(float(1 << 30)) < 4 * most / total
    sample = pages.filter(near).select(h.alias("h"), "html").groupBy("h").agg(F.min("html").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [(seed, k, x.tobytes(), bytes(y)) for seed, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for k, (x, y) in enumerate(lessons(page, seed))]
            cols = list(zip(*made, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["h", "k", "x", "y"])

    small_batches(pages.sparkSession)
    rows = sample.mapInArrow(run, "h long, k int, x binary, y binary").orderBy("h", "k").limit(most * (1 + VARIANTS)).collect()
    if not rows:
        return None
    model = Labeller()
    model.fit([np.frombuffer(bytes(r["x"]), np.float32).reshape(-1, WIDTH) for r in rows], [np.frombuffer(bytes(r["y"]), np.uint8).astype(float) for r in rows])
    return model


def extract(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """page_id, url, text, n_chars and the numbers of blocks and of main blocks."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    shared = pages.sparkSession.sparkContext.broadcast(model or train_labeller(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            read = [read_blocks(h) for h in b.column(2).to_pylist()]
            net = shared.value
            marks = net.label([block_inputs(x) for x in read]) if net else [np.array(teacher(x), bool) for x in read]
            texts = [" ".join(t for (t, _, _), main in zip(x, m, strict=True) if main) for x, m in zip(read, marks, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([len(x) for x in read], pa.int32()), pa.array([int(m.sum()) for m in marks], pa.int32())],
                ["page_id", "url", "text", "n_chars", "n_blocks", "n_main"],
            )

    small_batches(pages.sparkSession)
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long, n_blocks int, n_main int")


def op3_block_labeller(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
