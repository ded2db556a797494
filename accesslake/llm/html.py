"""Main-text extraction from HTML by a recurrent block labeller.

A page is a sequence of leaf blocks: runs of text that no block-level tag interrupts. Each block is a vector of its tag path (tags,
classes and ids, hashed), its hashed words and a few numbers. A bidirectional LSTM in numpy reads the whole sequence and says for
each block whether it belongs to the article, so that what stands before and after a block counts as much as its own look.

Nothing is labelled in raw pages. The labeller learns from a bounded sample of them, in which blocks with telling paths (semantic
tags, common class names) are labelled, and from variants of these pages with other containers and more kinds of clutter.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from .common import refuse_clash
from .shingles import word_hashes

#: Pages that the labeller learns from, on average, and the characters from which a page is not learned from, only labelled.
SAMPLE, SAMPLE_CHARS = 600, 200_000
PATH_SIZE, WORD_SIZE, NUMBERS, HIDDEN = 160, 16, 7, 24
INPUT = PATH_SIZE + WORD_SIZE + NUMBERS
STEPS, BATCH, RATE = 320, 24, 0.01
#: Blocks of a training sequence; longer pages are learned from in pieces. Extraction always reads whole pages.
PIECE = 120
#: Characters of HTML, and pages, that are labelled at once.
CHARS, PAGES = 2_000_000, 256

# Names of HTML elements.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
                   "span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|template|svg|math|iframe|object"
#: Which open elements an opening tag closes, up to the nearest list or table.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "option": {"option"}, "body": {"head"}}
ENDS_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre "
                   "section table ul".split())

#: Words of tags, classes and ids that tell clutter, and those that tell an article; the labeller's first teachers.
CLUTTER = frozenset("nav navbar navigation menu breadcrumb breadcrumbs pagination pager footer sidebar aside ad ads advert adverts "
                    "advertisement banner promo sponsor sponsored cookie cookies consent gdpr notice alert popup modal overlay form "
                    "button input select option textarea fieldset comment comments reply replies respond discussion related recommended "
                    "share sharing social subscribe newsletter signup login search copyright widget toolbar masthead topbar head title "
                    "skip tags meta byline author".split())
ARTICLE = frozenset("article main".split())

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>"
    # a quote opens a value right after = only, and closes it only where an attribute can end; others are characters like any
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>=]|=\s*\"[^\"]*\"(?=[\s/>]|\Z)|=\s*'[^']*'(?=[\s/>]|\Z)|=)*)(?:>|\Z)|([^<]+|<)", re.S | re.I)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+")


@dataclass
class Block:
    text: str
    path: tuple[str, ...]  # tags and the words of their classes and ids, from the root down
    linked: int  # characters within links


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in order; comments, scripts, styles and the like have none. Broken markup is read as browsers do."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    links = linked = 0
    open_tags: Counter[str] = Counter()

    def close(k: int) -> None:
        for tag, _ in stack[k:]:
            open_tags[tag] -= 1
        del stack[k:]

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, tuple(n for _, names in stack for n in names), min(linked, len(text))))
            parts.clear()
        linked = 0

    for raw, closing, name, attributes, text in _TOKEN.findall(page):
        if text:
            parts.append(text)
            if links:
                linked += len(text)
        elif name:
            tag = name.lower()
            if tag in INLINE:
                if tag == "a":
                    links = 0 if closing else 1
                elif tag in ("br", "img"):
                    parts.append(" ")
                continue
            flush()
            if closing:
                links = 0
                if open_tags[tag]:
                    close(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag))
                continue
            if tag in ENDS_P and any(t == "p" for t, _ in stack[-3:]):
                close(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == "p"))
            elif tag in CLOSES:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in CLOSES[tag]:
                        close(k)
                        break
                    if stack[k][0] in ("ul", "ol", "dl", "table", "select"):
                        break
            if tag not in VOID:
                names = [tag]
                for a in _NAMES.findall(attributes) if "=" in attributes else ():
                    names += _WORD.findall("".join(a).lower())
                stack.append((tag, tuple(names)))
                open_tags[tag] += 1
    flush()
    return out


def _cell(name: str, size: int, salt: int) -> int:
    h = salt
    for c in name.encode():
        h = (h * 1000003 ^ c) & 0xFFFFFFFF
    return ((h ^ h >> 15) * 0x2C1B3C6D >> 8) % size


_CELLS: dict[str, tuple[int, int]] = {}


def vectors(page: list[Block]) -> np.ndarray:
    """One row of INPUT numbers for each block."""
    x = np.zeros((len(page), INPUT), np.float32)
    if not page:
        return x
    h, counts = word_hashes([b.text.encode("utf-8", "surrogatepass") for b in page])
    row = np.repeat(np.arange(len(page)), counts)
    bag = np.bincount(row * WORD_SIZE + (h % np.uint64(WORD_SIZE)).astype(np.int64), minlength=len(page) * WORD_SIZE)
    x[:, PATH_SIZE:PATH_SIZE + WORD_SIZE] = np.sqrt(bag.reshape(len(page), WORD_SIZE) / np.maximum(1, counts)[:, None])
    for i, b in enumerate(page):
        for name in b.path:
            if name not in _CELLS:
                if len(_CELLS) > 100_000:
                    _CELLS.clear()
                _CELLS[name] = _cell(name, PATH_SIZE, 7), _cell(name, PATH_SIZE, 11)
            first, second = _CELLS[name]
            x[i, first] = x[i, second] = 1
        n, size = int(counts[i]), len(b.text)
        x[i, -NUMBERS:] = (np.log1p(n) / 4, b.linked / size, sum(map(b.text.count, ".!?")) / max(1, n) * 4, len(b.path) / 8,
                           i / len(page), n > 12, b.text[-1] in ".!?:\"'")
    return x


def teacher(b: Block) -> float | None:
    """1 for blocks that are surely of an article, 0 for those that surely are not, else None."""
    inside = max((k for k, n in enumerate(b.path) if n in ARTICLE), default=-1)
    if CLUTTER.intersection(b.path[inside + 1:]) or CLUTTER.intersection(b.path[:max(inside, 0)]) - {"title"}:
        return 0.0
    if inside >= 0:
        return 1.0
    if "header" in b.path or b.linked > 0.5 * len(b.text):
        return 0.0
    return None


_SHELLS = ["article", "main", "main article", "div content", "div main", "div post body", "section entry content", "div article body",
           "div story", "div page article", "div wrapper div text", "div container div post"]
_INNER = ["p", "p", "p", "p", "p", "h 2", "h 3", "ul li", "blockquote p", "pre", "table tr td", "div", "figure figcaption", "section p"]
_JUNK = [("nav ul li", "short"), ("ul menu li", "short"), ("header div logo", "short"), ("header p tagline", "short"), ("div ad", "long"),
         ("div advert", "long"), ("div banner", "long"), ("div sponsored p", "long"), ("aside sidebar p", "long"), ("aside ul li", "short"),
         ("div sidebar div widget", "long"), ("form label", "short"), ("form p", "short"), ("div newsletter form", "short"),
         ("div cookie notice p", "long"), ("div notice", "long"), ("div alert", "long"), ("section comments div comment p", "long"),
         ("div comments p", "long"), ("ol comment list li p", "long"), ("footer p", "long"), ("footer", "long"), ("div footer", "long"),
         ("div related ul li", "short"), ("div share", "short"), ("div breadcrumb", "short"), ("div popup p", "long"), ("button", "short"),
         ("div subscribe", "short"), ("div consent p", "long"), ("div promo p", "long"), ("div login form p", "short")]

_NAMED = sorted(CLUTTER - {"head", "title", "meta", "tags", "byline", "author"})


def _variant(page: list[tuple[Block, float]], others: list[str], rnd: random.Random) -> list[tuple[Block, float]]:
    """A page with the same article in another container, among other clutter."""
    shell = ("html", "body", *rnd.choice(_SHELLS).split())
    article = [b for b, y in page if y == 1]
    out = [(Block(b.text, (*shell, *(("h", "1") if k == 0 and rnd.random() < 0.5 else rnd.choice(_INNER).split())), b.linked), 1.0)
           for k, b in enumerate(article)]
    for _ in range(rnd.randint(2, 7)):
        path, length = rnd.choice(_JUNK)
        if rnd.random() < 0.5:
            path, length = f"{rnd.choice(('div', 'div', 'p', 'section', 'ul li', 'aside'))} {rnd.choice(_NAMED)}", rnd.choice(("short", "long"))
        inside = rnd.random() < 0.3
        where = (*shell, *path.split()) if inside else ("html", "body", *path.split())
        run = []
        for _ in range(rnd.randint(1, 6)):
            words = rnd.choice(others).split()
            text = " ".join(words[: rnd.randint(1, 4)] if length == "short" else words[: rnd.randint(4, 60)])
            if text:
                run.append((Block(text, where, len(text) if length == "short" and rnd.random() < 0.7 else 0), 0.0))
        at = rnd.randint(0, len(out)) if inside else rnd.choice((0, len(out)))
        out[at:at] = run
    return out


class Labeller:
    """A bidirectional LSTM over block vectors with a logistic output for each block."""

    def __init__(self, seed: int = 1):
        r = np.random.default_rng(seed)
        self.p = {}
        for side in "fb":
            self.p[f"w{side}"] = (r.normal(size=(INPUT, 4 * HIDDEN)) / np.sqrt(INPUT / 4)).astype(np.float32)
            self.p[f"u{side}"] = (r.normal(size=(HIDDEN, 4 * HIDDEN)) / np.sqrt(HIDDEN)).astype(np.float32)
            bias = np.zeros(4 * HIDDEN, np.float32)
            bias[HIDDEN:2 * HIDDEN] = 1  # remember at first
            self.p[f"b{side}"] = bias
        self.p["out"] = (r.normal(size=(2 * HIDDEN + INPUT,)) / np.sqrt(INPUT)).astype(np.float32)
        self.p["bias"] = np.zeros(1, np.float32)

    def _run(self, x: np.ndarray, mask: np.ndarray, side: str) -> tuple[np.ndarray, list]:
        """Hidden states of one direction over padded sequences (pages x blocks x INPUT)."""
        pages, length, _ = x.shape
        z = x @ self.p[f"w{side}"] + self.p[f"b{side}"]
        h, c = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
        out, trace = np.zeros((pages, length, HIDDEN), np.float32), []
        for t in range(length) if side == "f" else range(length - 1, -1, -1):
            a = z[:, t] + h @ self.p[f"u{side}"]
            gates = 1 / (1 + np.exp(-a[:, : 3 * HIDDEN]))
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN:2 * HIDDEN], gates[:, 2 * HIDDEN:]
            g = np.tanh(a[:, 3 * HIDDEN:])
            m = mask[:, t, None]
            c_new = m * (f * c + i * g) + (1 - m) * c
            tc = np.tanh(c_new)
            h_new = m * (o * tc) + (1 - m) * h
            trace.append((t, h, c, i, f, o, g, tc, m))
            h, c = h_new, c_new
            out[:, t] = h
        return out, trace

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(x, mask, "f")[0], self._run(x, mask, "b")[0], x], axis=2)
        return both @ self.p["out"] + self.p["bias"]

    def step(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean logistic loss over labelled blocks, back through time."""
        hf, tf = self._run(x, mask, "f")
        hb, tb = self._run(x, mask, "b")
        both = np.concatenate([hf, hb, x], axis=2)
        z = both @ self.p["out"] + self.p["bias"]
        dz = (1 / (1 + np.exp(-z)) - y) * weight / max(1.0, weight.sum())
        grads = {"out": np.tensordot(dz, both, axes=([0, 1], [0, 1])), "bias": dz.sum(keepdims=True).reshape(1)}
        for side, trace, part in (("f", tf, slice(0, HIDDEN)), ("b", tb, slice(HIDDEN, 2 * HIDDEN))):
            above = dz[:, :, None] * self.p["out"][part]
            dh, dc = np.zeros((len(x), HIDDEN), np.float32), np.zeros((len(x), HIDDEN), np.float32)
            da_all = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            du = np.zeros_like(self.p[f"u{side}"])
            for t, h, c, i, f, o, g, tc, m in reversed(trace):
                dh = dh + above[:, t]
                dcc = (dc + dh * o * (1 - tc * tc)) * m
                da = np.concatenate([dcc * g * i * (1 - i), dcc * c * f * (1 - f), dh * m * tc * o * (1 - o), dcc * i * (1 - g * g)], axis=1)
                da_all[:, t] = da
                du += h.T @ da
                dh = dh * (1 - m) + da @ self.p[f"u{side}"].T
                dc = dc * (1 - m) + dcc * f
            grads[f"u{side}"] = du
            grads[f"w{side}"] = np.tensordot(x, da_all, axes=([0, 1], [0, 1]))
            grads[f"b{side}"] = da_all.sum(axis=(0, 1))
        return grads

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Whether each block of each page belongs to the article; pages of like length go together."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
        while order:
            longest = len(pages[order[-1]])
            some = order[-max(1, min(len(order), 20_000 // longest)):]
            del order[-len(some):]
            x, mask = _padded([pages[k] for k in some])
            z = self.logits(x, mask)
            for j, k in enumerate(some):
                out[k] = z[j, : len(pages[k])] >= 0
        return out


def _padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(map(len, rows))
    x, mask = np.zeros((len(rows), longest, rows[0].shape[1]), np.float32), np.zeros((len(rows), longest), np.float32)
    for k, r in enumerate(rows):
        x[k, : len(r)], mask[k, : len(r)] = r, 1
    return x, mask


def fit(pages: DataFrame, html: str = "html", id_col: str = "page_id", sample: int = SAMPLE, seed: int = 1) -> Labeller:
    """A labeller learned from about ``sample`` pages of less than SAMPLE_CHARS characters, drawn by a hash of their ids.

    Both bound what the driver gets. Extraction reads every page, of any length, whole.
    """
    rows = pages.filter(F.col(html).isNotNull() & F.col(id_col).isNotNull())
    total = max(1, rows.count())
    draw = F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.lit(13)), 11) / F.lit(float(1 << 53))
    got = rows.filter((draw * total < sample) & (F.length(html) < SAMPLE_CHARS)).select(F.col(id_col).alias("id"), F.col(html).alias("html"))
    texts = [r.html for r in sorted(got.collect(), key=lambda r: str(r.id))]
    model, rnd = Labeller(seed), random.Random(seed)
    base = []
    for t in texts:
        known = [(b, teacher(b)) for b in blocks(t)]
        for s in range(0, len(known), PIECE):
            base.append(known[s:s + PIECE])
    base = [p for p in base if p]
    if not base:
        return model
    others = [b.text for p in base for b, _ in p]
    first = {k: np.zeros_like(v) for k, v in model.p.items()}
    second = {k: np.zeros_like(v) for k, v in model.p.items()}
    for step in range(1, STEPS + 1):
        some = []
        for _ in range(BATCH):
            page = rnd.choice(base)
            some.append(_variant(page, others, rnd)[:PIECE] if rnd.random() < 0.6 else page)
        some = [p for p in some if p]
        x, mask = _padded([vectors([b for b, _ in p]) for p in some])
        y, weight = np.zeros(mask.shape, np.float32), np.zeros(mask.shape, np.float32)
        for k, p in enumerate(some):
            for j, (_, label) in enumerate(p):
                if label is not None:
                    y[k, j], weight[k, j] = label, 1
        for name, g in model.step(x, mask, y, weight).items():
            g = np.clip(g, -1, 1)
            first[name] = 0.9 * first[name] + 0.1 * g
            second[name] = 0.99 * second[name] + 0.01 * g * g
            slower = RATE * min(1.0, 2 * (1 - step / (STEPS + 1)))
            model.p[name] = (model.p[name] - slower * (first[name] / (1 - 0.9 ** step)) / (
                np.sqrt(second[name] / (1 - 0.99 ** step)) + 1e-6)).astype(np.float32)
    return model


def extract(pages: DataFrame, model: Labeller, html: str = "html", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """``pages`` with the main text of each, blocks joined by two line feeds, and its length in code points.

    Null pages count as empty and, like pages without an article, have an empty text. Whole pages are read, however long; repeated
    rows each come out; character references are decoded and white space within a block is one space. All other columns stay, a
    clash of names is an error. Pages are mapped in place without a shuffle; the model's size does not depend on the data.
    """
    refuse_clash(pages, text, n_chars)
    sent = pages.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*pages.schema.fields, T.StructField(text, T.StringType()), T.StructField(n_chars, T.LongType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = np.array([len(t) if isinstance(t, str) else 0 for t in batch[html]])
            part = (np.cumsum(sizes) // CHARS) * (len(batch) // PAGES + 1) + np.arange(len(batch)) // PAGES
            for _, rows in batch.groupby(part, sort=False):
                found = [blocks(t) if isinstance(t, str) else [] for t in rows[html]]
                labels = sent.value.label([vectors(p) for p in found])
                texts = ["\n\n".join([b.text for b, keep in zip(p, own) if keep]) for p, own in zip(found, labels)]
                yield rows.assign(**{text: texts, n_chars: [len(t) for t in texts]})

    return pages.mapInPandas(run, schema)
