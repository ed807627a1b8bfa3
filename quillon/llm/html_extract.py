"""Main text of web pages by a recurrent block labeller.

A page is a sequence of text blocks, the leaves between block-level tags. Each
is a vector of its hashed tag path, its hashed words and a few statistics; a
bidirectional LSTM in numpy reads the whole sequence both ways and labels each
block as content or not. It is trained on pages whose own structure says what
is content (article and main against nav, footer, aside and ads), with those
tags hidden from most of the training pages, so that it learns from the rest.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PATH, WORD, STAT = 48, 48, 6
INPUT = PATH + WORD + STAT
HIDDEN = 20
MAX_PAGES = 600
EPOCHS, BATCH, RATE = 6, 32, 0.01
#: Few pages are gone through more often, until so many batches were learnt from.
LEAST_STEPS = 120
HIDE = 0.7
#: Names of the path weigh this much less with each step up from the block.
FADE = 0.8
#: Pages longer than this are not trained on; all are labelled.
MAX_TRAIN_CHARS = 1_000_000
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9]*)([^>]*)>|<[!?][^>]*>", re.S | re.I)
#: What hides the rest of a page that has no further ">".
HIDING = re.compile(r"<!--|<(?:script|style|noscript|template)\b", re.I)
CLASS = re.compile(r"""\b(?:class|id|role)\s*=\s*["']?([\w -]+)""", re.I)
INLINE = frozenset("a b i u em strong span small sub sup code mark q s abbr cite font time br img wbr".split())
VOID = frozenset("br img hr meta link input wbr area base col embed source track".split())
#: Ends of these are often left out; a new one, or the end of what holds it, ends the last.
LOOSE = frozenset("p li td th tr dt dd option b i".split())
CONTENT = frozenset(["article", "main"])
OTHER = frozenset(["nav", "footer", "aside", "header", "ad", "ads", "head", "sidebar", "menu"])


class Buckets(dict):
    """Bucket of each name or word, hashed once while the table of them is small."""

    def __init__(self, size: int):
        super().__init__()
        self.size = size

    def __missing__(self, name: str) -> int:
        if len(self) > 200_000:
            self.clear()
        self[name] = out = zlib.crc32(name.lower().encode("utf-8", "surrogatepass")) % self.size
        return out


path_bucket, word_bucket = Buckets(PATH), Buckets(WORD)


@dataclass
class Block:
    """Text, characters of it in links, hashed tag path with and without telling names, and 1 for content by the page's own structure."""

    text: str
    links: int
    path: np.ndarray
    blind: np.ndarray
    label: int


@dataclass
class Frame:
    """An open element; ``path``, ``blind`` and ``label`` are those of blocks directly in it."""

    tag: str
    path: np.ndarray
    blind: np.ndarray
    label: int


class Stack:
    """The open elements. Looking one up takes no time that grows with the depth, unless elements are closed by it."""

    def __init__(self) -> None:
        none = np.zeros(PATH, dtype=np.float32)
        self.frames = [Frame("", none, none, 0)]
        self.open: Counter[str] = Counter()
        #: Open elements since each that only its own end closes.
        self.within: list[Counter[str]] = [Counter()]

    def push(self, tag: str, names: list[str]) -> None:
        top = self.frames[-1]
        path, blind, label = FADE * top.path, FADE * top.blind, top.label
        for name in names:
            path[path_bucket[name]] += 1
            if name in CONTENT or name in OTHER:
                label = int(name in CONTENT)
            else:
                blind[path_bucket[name]] += 1
        self.frames.append(Frame(tag, path, blind, label))
        self.open[tag] += 1
        if tag in LOOSE or tag in INLINE:
            self.within[-1][tag] += 1
        else:
            self.within.append(Counter())

    def close(self, tag: str, loosely: bool) -> None:
        """End the innermost element of that tag and what is in it; loosely: only if nothing firm is in between."""
        if not (self.within[-1][tag] if loosely else self.open[tag]):
            return
        while True:
            ended = self.frames.pop().tag
            self.open[ended] -= 1
            if ended in LOOSE or ended in INLINE:
                self.within[-1][ended] -= 1
            else:
                self.within.pop()
            if ended == tag:
                return


def blocks(page: str | None) -> list[Block]:
    """The text blocks of a page in order; scripts, styles and comments are skipped. Linear in the page's length."""
    out: list[Block] = []
    stack = Stack()
    held: list[str] = []
    links = at = 0
    page = page or ""

    def flush() -> None:
        nonlocal links
        text = " ".join(html.unescape("".join(held)).split())
        if text:
            top = stack.frames[-1]
            out.append(Block(text, links, top.path, top.blind, top.label))
        held.clear()
        links = 0

    end = page.rfind(">") + 1
    hidden = False
    for m in TOKEN.finditer(page, 0, end):
        if m.start() > at:
            piece = page[at : m.start()]
            held.append(piece)
            if any(frame.tag == "a" for frame in stack.frames[-3:]):
                links += len(piece)
        at = m.end()
        name = m.group(3)
        if name is None:
            whole = m.group(0)
            hidden = at == end and (whole.startswith("<!--") and not whole.endswith("-->") or bool(m.group(1)) and not re.search(rf"</{m.group(1)}\s*>\Z", whole, re.I))
            continue
        tag = name.lower()
        if tag not in INLINE:
            flush()
        elif tag == "br":
            held.append(" ")
        if m.group(2):
            stack.close(tag, tag in LOOSE and tag not in INLINE)
        elif tag not in VOID:
            if tag in LOOSE:
                stack.close(tag, True)
            marks = CLASS.findall(m.group(4)) if m.group(4) else []
            stack.push(tag, [tag, *(w.lower() for x in marks for w in x.split())])
    if not hidden:
        rest = HIDING.search(page, max(at, end))
        held.append(page[at : rest.start() if rest else len(page)])
    flush()
    return out


def vectors(page: list[Block], blind: bool = False) -> np.ndarray:
    """(blocks, INPUT): tag path, words, statistics; ``blind`` leaves telling names out of tag paths."""
    out = np.zeros((len(page), INPUT), dtype=np.float32)
    for i, b in enumerate(page):
        row = out[i]
        row[:PATH] = b.blind if blind else b.path
        words = b.text.split()
        at = np.fromiter(map(word_bucket.__getitem__, words), dtype=np.int64, count=len(words))
        row[PATH : PATH + WORD] = np.bincount(at, minlength=WORD) / np.sqrt(len(words))
        n = len(b.text)
        row[-STAT:] = (np.log1p(len(words)) / 6, min(1.0, b.links / n), sum(map(b.text.count, ".,;:!?")) / n * 5, n / len(words) / 12, (i + 1) / len(page), i == 0)
    return out


class Labeller:
    """Weights of two LSTMs and a logistic output. Gates in the order input, forget, cell, output."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.w = {}
        for d in "fb":
            self.w[f"x{d}"] = rng.normal(0, INPUT**-0.5, (INPUT, 4 * HIDDEN)).astype(np.float32)
            self.w[f"h{d}"] = rng.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
            self.w[f"c{d}"] = np.zeros(4 * HIDDEN, dtype=np.float32)
            self.w[f"c{d}"][HIDDEN : 2 * HIDDEN] = 1
        self.w["o"] = rng.normal(0, (2 * HIDDEN) ** -0.5, 2 * HIDDEN).astype(np.float32)
        self.w["b"] = np.zeros(1, dtype=np.float32)

    @staticmethod
    def _sigmoid(z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-z))

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """Hidden states (time, batch, HIDDEN) in time order, and what gradients need if it is to be kept; masked steps keep the state."""
        steps = range(len(x)) if d == "f" else range(len(x) - 1, -1, -1)
        h = c = np.zeros((x.shape[1], HIDDEN), dtype=np.float32)
        out, tape = np.zeros((*x.shape[:2], HIDDEN), dtype=np.float32), []
        pre = x @ self.w[f"x{d}"] + self.w[f"c{d}"]
        for t in steps:
            z = pre[t] + h @ self.w[f"h{d}"]
            i, f, o = self._sigmoid(z[:, :HIDDEN]), self._sigmoid(z[:, HIDDEN : 2 * HIDDEN]), self._sigmoid(z[:, 3 * HIDDEN :])
            g = np.tanh(z[:, 2 * HIDDEN : 3 * HIDDEN])
            c2 = f * c + i * g
            th = np.tanh(c2)
            m = mask[t][:, None]
            if keep:
                tape.append((t, h, c, i, f, g, o, th, m))
            h, c = np.where(m, o * th, h), np.where(m, c2, c)
            out[t] = h
        return out, tape

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
        (hf, tf), (hb, tb) = self._run(x, mask, "f", keep), self._run(x, mask, "b", keep)
        both = np.concatenate([hf, hb], axis=2)
        return self._sigmoid(both @ self.w["o"] + self.w["b"][0]), (both, tf, tb)

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy over unmasked steps, by backpropagation through time."""
        p, (both, tf, tb) = self.forward(x, mask, keep=True)
        e = np.where(mask, p - y, 0).astype(np.float32) / max(1, mask.sum())
        grads = {"o": np.einsum("tb,tbh->h", e, both), "b": np.array([e.sum()], dtype=np.float32)}
        back = e[:, :, None] * self.w["o"]
        for d, tape, part in (("f", tf, back[:, :, :HIDDEN]), ("b", tb, back[:, :, HIDDEN:])):
            wh = self.w[f"h{d}"]
            gx, gh, gc = np.zeros_like(self.w[f"x{d}"]), np.zeros_like(wh), np.zeros_like(self.w[f"c{d}"])
            dh = dc = np.zeros((x.shape[1], HIDDEN), dtype=np.float32)
            for t, h, c, i, f, g, o, th, m in reversed(tape):
                dh = dh + part[t]
                live_h, live_c = np.where(m, dh, 0), np.where(m, dc, 0)
                dc2 = live_c + live_h * o * (1 - th * th)
                dz = np.concatenate([dc2 * g * i * (1 - i), dc2 * c * f * (1 - f), dc2 * i * (1 - g * g), live_h * th * o * (1 - o)], axis=1)
                gx += x[t].T @ dz
                gh += h.T @ dz
                gc += dz.sum(axis=0)
                dh = dz @ wh.T + np.where(m, 0, dh)
                dc = dc2 * f + np.where(m, 0, dc)
            grads |= {f"x{d}": gx, f"h{d}": gh, f"c{d}": gc}
        return grads


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    top = max(1, max(len(p) for p in pages))
    x, mask = np.zeros((top, len(pages), INPUT), dtype=np.float32), np.zeros((top, len(pages)), dtype=bool)
    for i, p in enumerate(pages):
        x[: len(p), i], mask[: len(p), i] = p, True
    return x, mask


def train(pages: list[str], seed: int = 5) -> Labeller:
    """Adam over pages that have both content and other blocks."""
    rng = np.random.default_rng(seed)
    held = [b for b in map(blocks, pages) if b]
    targets = [np.array([x.label for x in b], dtype=np.float32) for b in held]
    model = Labeller(seed)
    first, second = ({k: np.zeros_like(v) for k, v in model.w.items()} for _ in range(2))
    shown = [vectors(b) for b in held]
    blind = [vectors(b, blind=True) for b in held]
    step = 0
    for _ in range(max(EPOCHS, -(-LEAST_STEPS * BATCH // max(1, len(held)))) if held else 0):
        order = rng.permutation(len(held))
        for at in range(0, len(order), BATCH):
            own = sorted(order[at : at + BATCH], key=lambda i: len(held[i]))
            x, mask = padded([(blind if rng.random() < HIDE else shown)[i] for i in own])
            y = np.zeros(mask.shape, dtype=np.float32)
            for j, i in enumerate(own):
                y[: len(targets[i]), j] = targets[i]
            step += 1
            for k, g in model.gradients(x, mask, y).items():
                g = np.clip(g, -1, 1)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                model.w[k] -= RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def label(model: Labeller, pages: list[list[Block]], size: int = 128) -> list[np.ndarray]:
    """Probabilities of content for the blocks of each page. Pages of like length run together."""
    out: list[np.ndarray] = [np.empty(0, dtype=np.float32)] * len(pages)
    order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
    at = 0
    while at < len(order):
        # A batch holds as many padded blocks as 128 pages of 64, or one page.
        end = at + 1
        while end < len(order) and end - at < size and len(pages[order[end]]) * (end + 1 - at) <= 64 * size:
            end += 1
        own = order[at:end]
        p, _ = model.forward(*padded([vectors(pages[i]) for i in own]))
        for j, i in enumerate(own):
            out[i] = p[: len(pages[i]), j]
        at = end
    return out


def fit(pages: DataFrame, limit: int = MAX_PAGES, ident: str = "page_id", column: str = "html") -> Labeller:
    """A labeller from at most ``limit`` pages that have an article or main element, chosen by a hash of the id.

    Ids are chosen first, so that the driver gets no other pages. Pages without
    an id or longer than MAX_TRAIN_CHARS aren't trained on.
    """
    usable = pages.select(F.col(ident).alias("i"), F.col(column).alias("t")).where(F.col("i").isNotNull() & (F.length("t") <= MAX_TRAIN_CHARS) & F.col("t").rlike("(?i)<(article|main)[ >]"))
    chosen = usable.select("i").distinct().orderBy(F.xxhash64("i"), "i").limit(limit)
    rows = usable.join(F.broadcast(chosen), "i", "left_semi").groupBy("i").agg(F.min("t").alias("t")).collect()
    return train([r["t"] for r in sorted(rows, key=lambda r: zlib.crc32(repr(r["i"]).encode()))])


def extract(pages: DataFrame, model: Labeller, ident: str = "page_id", column: str = "html") -> DataFrame:
    """(page_id, text, n_blocks, n_content): the content blocks of each page, a line each.

    A page that is NULL, empty or without text has an empty text and no blocks.
    Pages of any length are read whole, unclosed tags and comments included, in
    time and memory linear in their length.
    Repeated rows give repeated results; extra columns don't matter; an empty
    table gives an empty one.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<text: string, n_blocks: int, n_content: int>")
    def read(column: pa.Array) -> pa.Array:
        texts, totals, kept = [], [], []
        for a in range(0, len(column), 512):
            held = [blocks(p) for p in column[a : a + 512].to_pylist()]
            for page, p in zip(held, label(shared.value, held)):
                own = [b.text for b, x in zip(page, p) if x >= 0.5]
                texts.append("\n".join(own))
                totals.append(len(page))
                kept.append(len(own))
        return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(totals, pa.int32()), pa.array(kept, pa.int32())], names=["text", "n_blocks", "n_content"])

    return pages.select(F.col(ident).alias("page_id"), read(F.col(column)).alias("_r")).select("page_id", "_r.text", "_r.n_blocks", "_r.n_content")


def html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages, fit(pages))
