"""Personal data: patterns, and a skip-chain conditional random field over the words that can hold it.

Patterns find emails, IP addresses, card and phone numbers of the plain forms. A conditional random field adds what they miss: forms that
were altered, and parts of an entity that stand again elsewhere. Its variables are the words with a digit or ``@``; any other word carries
no label, so chains end there. Neighbouring words share a potential, and so do distant words that are repeated or alike (equal last seven
digits, local parts of addresses, or equal words): the skip edges that keep the labels of one entity the same across its document. Loopy
message passing gives each word's posterior; words of pattern matches are observed.

Weights are learned by pseudo-likelihood from the patterns' own matches in a bounded sample of documents, together with altered forms of
them, repeated parts, and near misses that are no personal data.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import refuse_clash, text_batches

#: Kinds of spans in the order of their listing, after the label for none.
KINDS = ("email", "ip", "card", "phone")
#: Documents learned from, and the characters of one that may be: longer lists of words with digits are not learned from.
SAMPLE, SAMPLE_CHARS = 2000, 1000
#: Altered copies that are learned from besides, spread over the documents with matches.
ALTERED = 6000
#: Posterior from which a word that no pattern covers gets a label.
CERTAIN = 0.9
#: Message passing: rounds, share of the old message that stays, and the change at which it ends.
ROUNDS, DAMPING, SETTLED = 30, 0.3, 1e-4
#: Digits of the longest card and phone numbers, by label.
LONGEST = {3: 19, 4: 15}
#: Hashed features of a word's shape.
SHAPES = 256
SPACE = " \t\n\x0b\f\r"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ACTIVE = re.compile(r"[0-9@][^ \t\n\x0b\f\r]*")
_NO_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches, by start and kind; each kind leftmost and non-overlapping, in linear time."""
    found = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((start, 0, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    for chain in _DOTTED.finditer(text):
        if "." in chain.group():
            parts, start = chain.group().split("."), chain.start()
            for k in range(0, len(parts) - 3, 4):
                end = start + sum(map(len, parts[k:k + 4])) + 3
                if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or "0") <= 255 for p in parts[k:k + 4]):
                    found.append((start, 1, end))
                start = end + 1
    for m in _DIGITS.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= len(_NO_DIGIT.sub("", m.group())) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


@dataclass
class Words:
    """The words of a text that can hold personal data: their places, whether each follows the one before it directly, and skip edges."""

    spans: list[tuple[int, int]]
    follows: list[bool]
    skips: list[tuple[int, int]]
    cores: list[str]


def words_of(text: str) -> Words:
    spans: list[tuple[int, int]] = []
    follows, cores, skips, last_end = [], [], [], -1
    seen: dict[tuple, int] = {}
    for m in _ACTIVE.finditer(text):
        start = m.start()
        while start > last_end and start > 0 and text[start - 1] not in SPACE:
            start -= 1
        between = text[last_end:start] if last_end >= 0 and start - last_end <= 8 else "x"
        follows.append(not between.strip(SPACE))
        last_end = m.end()
        a, b = start, m.end()
        while a < b and not (text[a].isalnum() or text[a] in "@(+["):
            a += 1
        while b > a and not (text[b - 1].isalnum() or text[b - 1] in ")]@"):
            b -= 1
        if a == b:
            a, b = start, m.end()
        spans.append((a, b))
        core = text[a:b]
        cores.append(core)
        digits = _NO_DIGIT.sub("", core)
        local, _, domain = core.partition("@")
        if domain:
            key = ("@", local.lower(), domain.split(".")[0].lower())
        else:
            key = ("#", digits[-7:]) if len(digits) >= 7 else ("w", core.lower())
        if key in seen:
            skips.append((seen[key], len(spans) - 1))
        seen[key] = len(spans) - 1  # each is linked to the last one of its key: as many edges as words
    return Words(spans, follows, skips, cores)


def _bucket(n: int, *ends: int) -> int:
    return sum(n >= e for e in ends)


def _features(core: str) -> list[int]:
    """Numbers of the features that a word has."""
    digits = _NO_DIGIT.sub("", core)
    letters = sum(c.isalpha() for c in core)
    local, at, domain = core.partition("@")
    quad = core.replace("[.]", ".").replace("(.)", ".").split(".")
    is_quad = len(quad) == 4 and all(q.isdigit() and len(q) <= 3 and int(q) <= 255 for q in quad if q.isascii()) and all(quad)
    runs = [str(len(r)) if r[0].isdigit() else r[:1] for r in re.findall(r"[0-9]+|[^0-9]+", core[:40])]
    shape = ["".join("a" if c.isalpha() else c for c in r) for r in runs]
    out = [0, 1 + _bucket(len(digits), 1, 3, 4, 5, 7, 10, 11, 14, 17, 20), 12 + _bucket(letters, 1, 4, 12),
           16 + _bucket(core.count("."), 1, 2, 3, 4), 21 + _bucket(core.count("-"), 1, 2, 3), 25 + _bucket(len(core), 3, 8, 16, 24, 48)]
    flags = [bool(at), bool(at and local), bool(at and domain), "." in domain, core.count("@") > 1, core[:1] == "+", "(" in core, ")" in core, is_quad,
             14 <= len(digits) <= 19, 14 <= len(digits) <= 19 and luhn(digits), 14 <= len(digits) <= 19 and luhn(digits) and not letters,
             core.isalnum() and letters > 0 and len(digits) > 0, core.isdigit(), "[" in core, "/" in core, "_" in core]
    out += [32 + k for k, f in enumerate(flags) if f]
    return [*out, PLAIN + crc32(" ".join(shape).encode("utf-8", "surrogatepass")) % SHAPES]


PLAIN = 52
N_FEATURES = PLAIN + SHAPES


@dataclass
class Field:
    """Weights of a skip-chain field: of features, of neighbours (left, right), and of skip edges; labels are none and KINDS."""

    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def posteriors(self, graph: Graph) -> np.ndarray:
        """Posterior of each label for every word, by loopy message passing until it settles."""
        node = np.add.reduceat(self.unary[graph.features], graph.first, axis=0)
        seen = graph.observed >= 0
        node[seen] = -40.0
        node[seen, graph.observed[seen]] = 0.0
        pairs = np.concatenate([graph.chain, graph.skip])
        # each edge both ways: from a to b with the table [a, b], and back with its transpose
        source, target = np.r_[pairs[:, 0], pairs[:, 1]], np.r_[pairs[:, 1], pairs[:, 0]]
        tables = np.concatenate([np.broadcast_to(t, (len(e), *t.shape)) for t, e in (
            (self.chain, graph.chain), (self.skip, graph.skip), (self.chain.T, graph.chain), (self.skip.T, graph.skip))])
        back = np.r_[np.arange(len(pairs)) + len(pairs), np.arange(len(pairs))]
        sent = np.zeros((len(source), node.shape[1]))
        for _ in range(ROUNDS if len(pairs) else 0):
            total = node.copy()
            np.add.at(total, target, sent)
            rest = total[source] - sent[back]
            fresh = _log_sum(rest[:, :, None] + tables, 1)
            fresh -= _log_sum(fresh, 1)[:, None]
            change = np.abs(fresh - sent).max()
            sent = DAMPING * sent + (1 - DAMPING) * fresh
            if change < SETTLED:
                break
        np.add.at(node, target, sent)
        return np.exp(node - _log_sum(node, 1)[:, None])


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


@dataclass
class Graph:
    """The words of several documents: their features one after the other, chain and skip edges, and observed labels (-1: none)."""

    features: np.ndarray
    first: np.ndarray
    chain: np.ndarray
    skip: np.ndarray
    observed: np.ndarray


def graph_of(docs: list[Words], observed: list[list[int]]) -> Graph:
    rows = [_features(c) for w in docs for c in w.cores]
    chain, skip, first = [], [], 0
    for w in docs:
        chain += [(first + k - 1, first + k) for k, f in enumerate(w.follows) if f]
        direct = {(k - 1, k) for k, f in enumerate(w.follows) if f}
        skip += [(first + a, first + b) for a, b in w.skips if (a, b) not in direct]
        first += len(w.cores)
    pairs = lambda e: np.array(e, np.int64).reshape(-1, 2)
    starts = np.cumsum([0, *map(len, rows)], dtype=np.int64)[:-1]
    return Graph(np.array([f for r in rows for f in r], np.int64), starts, pairs(chain), pairs(skip),
                 np.array([o for d in observed for o in d], np.int64))


def covered(words: Words, spans: list[tuple[int, int, int]]) -> list[int]:
    """For every word the label (1 + kind) of the first span that overlaps it, or -1."""
    out, s = [-1] * len(words.spans), 0
    spans = sorted(spans)
    for k, (a, b) in enumerate(words.spans):
        while s < len(spans) and spans[s][2] <= a:
            s += 1
        for start, kind, end in spans[s:]:
            if start >= b:
                break
            if end > a:
                out[k] = 1 + kind
                break
    return out


def compact(text: str) -> str:
    """The words that can hold personal data with what stands between neighbours, and ``x`` for all other words between."""
    w = words_of(text)
    parts, last = [], 0
    for (a, b), core, follows in zip(w.spans, w.cores, w.follows):
        parts.append((text[last:a] if follows else " x ") + core)
        last = b
    return "".join(parts)


def _altered(kind: int, found: str, rnd: random.Random) -> tuple[str, int]:
    """Another way to write a match, or a near miss, with its label."""
    digits = _NO_DIGIT.sub("", found)
    if kind == 0:
        local, domain = found.split("@")
        return rnd.choice([(f"{local}@{domain.split('.')[0]}", 1), (f"{local}@{domain.replace('.', ',')}", 1),
                           (f"{local}@{domain.replace('.', '[.]')}", 1), (f"{local}[@]{domain}", 1), (domain, 0), (f"{rnd.randrange(99)}@", 0)])
    if kind == 1:
        return rnd.choice([(found.replace(".", "[.]"), 2), (found.replace(".", "(.)"), 2), (".".join(found.split(".")[:3]), 0),
                           (".".join(found.split(".")[:2]), 0), (f"{rnd.randrange(256, 999)}.{found.split('.', 1)[1]}", 0)])
    if kind == 2:
        fours = [digits[k:k + 4] for k in range(0, len(digits), 4)]
        miss = digits[:-1] + str((int(digits[-1]) + rnd.randrange(1, 10)) % 10)
        return rnd.choice([("_".join(fours), 3), ("/".join(fours), 3), ("--".join(fours), 3), (miss, 0), (miss, 0), (miss, 0), (digits[:13], 0),
                           (digits[:8], 0), (f"{miss[:4]}-{miss[4:8]}-{miss[8:12]}-{miss[12:]}", 0)])
    a, b, c = digits[-10:-7], digits[-7:-4], digits[-4:]
    return rnd.choice([(f"({a}) {b}-{c}", 4), (f"{a}-{b}-{c}", 4), (f"+{a}/{b}/{c}", 4), (f"{b}-{c}", 0), (f"({a})", 0), (digits[-7:], 0), (c, 0),
                       (f"{b} {c}", 0)])


def _training(texts: list[str], seed: int) -> tuple[list[Words], list[list[int]]]:
    """The sampled texts with the labels of the patterns, and copies with altered matches, repeated parts and near misses."""
    rnd = random.Random(seed)
    docs, labels = [], []

    def add(text: str, extra: list[tuple[int, int, int]]) -> None:
        w = words_of(text)
        docs.append(w)
        labels.append([max(0, c) for c in covered(w, base_spans(text) + extra)])

    matched = [(t, spans) for t in texts if (spans := base_spans(t))]
    for text in texts:
        add(text, [])
    for text, spans in matched:
        for _ in range(-(-ALTERED // len(matched))):
            start, kind, end = rnd.choice(spans)
            form, label = _altered(kind, text[start:end], rnd)
            if rnd.random() < 0.5:  # in its place
                new = f"{text[:start]} x {form} x {text[end:]}"
                add(new, [(start + 3, label - 1, start + 3 + len(form))] if label else [])
            else:  # once more, at the end: what stands again is of the same kind
                part = text[start:end].split(" ")[-1] if kind == 3 else text[start:end].split(".")[0] if kind == 0 else form
                again = label - 1 if kind in (1, 2) else kind if kind == 3 or "@" in part else -1
                new = f"{text} x {part}"
                add(new, [(len(new) - len(part), again, len(new))] if again >= 0 else [])
    return docs, labels


def learn(texts: list[str], seed: int = 0, steps: int = 300, decay: float = 1e-4, rate: float = 0.1) -> Field:
    """The field that fits the texts' matches best by pseudo-likelihood: each word's label given those of its neighbours."""
    docs, labels = _training(texts, seed)
    graph = graph_of(docs, labels)
    n, k = len(graph.observed), len(KINDS) + 1
    y = np.eye(k)[graph.observed] if n else np.zeros((0, k))
    left, right, joined = (np.zeros((n, k)) for _ in range(3))  # labels of the word before, the word after, and over skip edges
    np.add.at(left, graph.chain[:, 1], y[graph.chain[:, 0]])
    np.add.at(right, graph.chain[:, 0], y[graph.chain[:, 1]])
    np.add.at(joined, graph.skip[:, 1], y[graph.skip[:, 0]])
    np.add.at(joined, graph.skip[:, 0], y[graph.skip[:, 1]])
    # equal words among equal labels count once
    ends = np.r_[graph.first[1:], len(graph.features)]
    times: dict[bytes, int] = {}
    seen: list[int] = []
    around = np.concatenate([left, right, joined, y], axis=1)
    for i in range(n):
        key = graph.features[graph.first[i]:ends[i]].tobytes() + around[i].tobytes()
        if key not in times:
            seen.append(i)
        times[key] = times.get(key, 0) + 1
    x = np.zeros((len(seen), N_FEATURES))
    for row, i in enumerate(seen):
        x[row, graph.features[graph.first[i]:ends[i]]] = 1
    left, right, joined, y = left[seen], right[seen], joined[seen], y[seen]
    share = np.array([*times.values()], np.float64)[:, None] / max(1, n)
    params = [np.zeros((N_FEATURES, k)), np.zeros((k, k)), np.zeros((k, k))]
    params[0][0, 0] = 4.0  # without evidence, none
    mean, spread = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, steps + 1 if n else 0):
        unary, chain, skip = params
        z = x @ unary + left @ chain + right @ chain.T + joined @ skip
        p = np.exp(z - _log_sum(z, 1)[:, None])
        g = (p - y) * share
        chain_slope = left.T @ g + (right.T @ g).T
        skip_slope = joined.T @ g
        slopes = [x.T @ g, chain_slope, (skip_slope + skip_slope.T) / 2]
        for i, s in enumerate(slopes):
            s = s + decay * params[i]
            mean[i] = 0.9 * mean[i] + 0.1 * s
            spread[i] = 0.999 * spread[i] + 0.001 * s * s
            params[i] = params[i] - rate * (mean[i] / (1 - 0.9 ** t)) / (np.sqrt(spread[i] / (1 - 0.999 ** t)) + 1e-8)
    return Field(*params)


def fit(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> Field:
    """A field learned from at most ``sample`` documents with digits or ``@``, drawn by a hash of their text.

    They are counted first, so that no more than about twice the sample are looked at. Only the words that can hold personal data are brought to the driver, at most SAMPLE_CHARS characters of a document; documents with
    more are not learned from. Null texts and empty tables teach nothing: what is left finds the patterns only.
    """
    text_batches(docs.sparkSession)

    def shorten(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            short = batch.text.map(compact)
            digest = batch.text.map(lambda t: hashlib.md5(t.encode("utf-8", "surrogatepass")).hexdigest())
            yield pd.DataFrame({"digest": digest, "words": short})[short.str.len() <= SAMPLE_CHARS]

    active = docs.select(F.col(text_col).alias("text")).filter(F.col("text").rlike("[0-9@]"))
    total = active.count()
    draw = F.shiftrightunsigned(F.xxhash64(F.col("text"), F.lit(17)), 11) / F.lit(float(1 << 53))
    rows = active.filter(draw * F.lit(float(max(1, total))) < 2 * sample).mapInPandas(shorten, "digest string, words string")
    return learn([r.words for r in rows.orderBy("digest", "words").limit(sample).collect()])


def added_spans(words: Words, observed: list[int], posterior: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the field adds: words of one label that follow each other, none of them in a pattern's match."""
    best = posterior.argmax(axis=1)
    label = np.where((posterior.max(axis=1) >= CERTAIN) & (np.array(observed) < 0), best, 0)
    out: list[tuple[int, int, int]] = []
    digits = 0
    for k, kind in enumerate(label.tolist()):
        if not kind:
            continue
        start, end = words.spans[k]
        size = len(_NO_DIGIT.sub("", words.cores[k]))
        if kind in LONGEST and k and words.follows[k] and label[k - 1] == kind and digits + size <= LONGEST[kind]:
            out[-1] = (out[-1][0], kind - 1, end)  # numbers may go on after a space
            digits += size
        else:
            out.append((start, kind - 1, end))
            digits = size
    return out


COLUMNS = ("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def find_pii(docs: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """``docs`` with the numbers of pattern matches by kind, the digest of their list, the list of all spans, and the number added.

    A list names ``kind:start:end`` by start, then kind in the order of KINDS, joined by commas; places are code points, ends exclusive.
    Patterns: email, IP address (parts to 255), card (14 to 19 digits that pass Luhn's test), phone (``+``, 10 to 15 digits), each leftmost
    and non-overlapping for itself; matches that fail the tests are dropped without another try. The field adds spans where no pattern's
    match stands, never changes those, and never labels words without a digit or ``@``.

    Null texts are empty texts: no spans, the digest of nothing. Repeated rows are rows each; an empty table stays empty. Texts are read
    whole, in time linear in their length. An input column named like an added one is an error; all others are kept.
    """
    added = [c.split()[0] for c in COLUMNS.split(", ")]
    refuse_clash(docs, *added)
    text_batches(docs.sparkSession)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    sent = docs.sparkSession.sparkContext.broadcast(field)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = describe([t or "" for t in batch[text_col]], sent.value)
            for k, name in enumerate(added):
                batch[name] = [r[k] for r in rows]
            yield batch

    return docs.mapInPandas(search, f"{kinds}, {COLUMNS}")


_NOTHING = ([0] * len(KINDS), hashlib.sha256(b"").hexdigest(), "")


def describe(texts: list[str], field: Field) -> list[list]:
    out, words, observed, places, bases = [], [], [], [], []
    for t in texts:
        if not _ACTIVE.search(t):
            out.append([*_NOTHING[0], *_NOTHING[1:], 0])
            continue
        base = base_spans(t)
        w = words_of(t)
        words.append(w)
        observed.append(covered(w, base))
        places.append(len(out))
        bases.append(base)
        out.append([])
    for s, e in _groups(words):
        posterior = field.posteriors(graph_of(words[s:e], observed[s:e]))
        first = 0
        for k in range(s, e):
            extra = added_spans(words[k], observed[k], posterior[first:first + len(words[k].cores)])
            first += len(words[k].cores)
            counts = [sum(b[1] == kind for b in bases[k]) for kind in range(len(KINDS))]
            digest = hashlib.sha256(_listed(bases[k]).encode()).hexdigest()
            out[places[k]] = [*counts, digest, _listed(sorted(bases[k] + extra)), len(extra)]
    return out


def _groups(words: list[Words], size: int = 4096) -> Iterator[tuple[int, int]]:
    """Documents whose graphs are passed over together: some thousand words, or one document."""
    start, count = 0, 0
    for k, w in enumerate(words):
        if count and count + len(w.cores) > size:
            yield start, k
            start, count = k, 0
        count += len(w.cores)
    if count:
        yield start, len(words)


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)
