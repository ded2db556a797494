"""Periodic runs of words by longest common extensions in suffix trees.

For a sequence of words, Ukkonen's suffix trees of it and of its reversal are walked once each (Euler tours), so that the longest common
extension of two positions, to the right or to the left, is the depth of a lowest common ancestor: a range minimum over the tour, in
constant time. The longest Lyndon word that starts at a position, in the order of words and in the reverse order, is a candidate for the
root of a run; it is extended both ways by its period. Every run has a Lyndon root in one of the two orders, so none is missed.

Trees are built only over stretches that can hold a run that counts, of ``least`` words and ``times`` periods: there, every five words come
again at most a ``times``-th of the stretch away. What is left out provably holds no such run.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import refuse_clash, text_batches

#: Words of the grams that must come again in a run; ``least`` and ``times`` have to be large enough for it.
GRAM = 5
#: Steps of an Euler tour for each entry of the table of range minima.
BLOCK = 16

COLUMNS = ("n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, "
           "collapsed_sha256 string")


class SuffixTree:
    """Ukkonen's suffix tree of a sequence of numbers from 0 on, ended by a letter of its own that is less than all others.

    Afterwards ``rank`` orders the suffixes and ``back_rank`` orders them with the letters (not the end) reversed; ``extension`` gives the
    length of the longest common prefixes of pairs of suffixes.
    """

    def __init__(self, letters: list[int]):
        self.n = n = len(letters)
        text = [*letters, -1]
        size = 2 * (n + 2)
        start, end, link = [0] * size, [0] * size, [0] * size
        edges: list[dict[int, int] | None] = [None] * size
        edges[0] = {}
        nodes, leaf_end = 1, n + 1
        node = length = waiting = 0  # the active point: a node, and ``length`` letters from text[at] on
        at = 0
        for i, letter in enumerate(text):
            waiting += 1
            last = 0
            while waiting:
                if not length:
                    at = i
                branch = edges[node]
                child = branch.get(text[at])
                if child is None:
                    start[nodes], end[nodes] = i, leaf_end
                    branch[text[at]] = nodes
                    nodes += 1
                    if last:
                        link[last] = node
                        last = 0
                else:
                    span = min(end[child], i + 1) - start[child]
                    if length >= span:  # walk down
                        at += span
                        length -= span
                        node = child
                        continue
                    middle = start[child] + length
                    if text[middle] == letter:
                        length += 1
                        if last:
                            link[last] = node
                        break
                    split, leaf = nodes, nodes + 1
                    nodes += 2
                    start[split], end[split] = start[child], middle
                    start[leaf], end[leaf] = i, leaf_end
                    edges[split] = {letter: leaf, text[middle]: child}
                    start[child] = middle
                    branch[text[at]] = split
                    if last:
                        link[last] = split
                    last = split
                waiting -= 1
                if node == 0 and length:
                    length -= 1
                    at = i - waiting + 1
                else:
                    node = link[node]
        self._tour(edges, start, end)

    def _tour(self, edges: list, start: list[int], end: list[int]) -> None:
        """Depths along the Euler tour, where suffixes stand in it, and the two orders of suffixes."""
        n = self.n
        depths, position, order, back_order = [], [0] * (n + 1), [], []
        # a node comes again after each of its children: (node, depth) to enter, (-1, depth) to return to
        stack = [(0, 0)]
        while stack:
            node, depth = stack.pop()
            depths.append(depth)
            if node < 0:
                continue
            branch = edges[node]
            if branch is None:
                suffix = n + 1 - depth
                position[suffix] = len(depths) - 1
                order.append(suffix)
                continue
            for key in sorted(branch, reverse=True):
                child = branch[key]
                stack.append((-1, depth))
                stack.append((child, depth + end[child] - start[child]))
        stack = [(0, 0)]
        while stack:
            node, depth = stack.pop()
            branch = edges[node]
            if branch is None:
                back_order.append(n + 1 - depth)
                continue
            for key in sorted(branch):
                if key >= 0:
                    child = branch[key]
                    stack.append((child, depth + end[child] - start[child]))
            if -1 in branch:
                child = branch[-1]
                stack.append((child, depth + end[child] - start[child]))
        self.position = np.array(position)
        self.rank, self.back_rank = (self._inverse(o) for o in (order, back_order))
        self._minima(np.array(depths, np.int32))

    @staticmethod
    def _inverse(order: list[int]) -> np.ndarray:
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        return rank

    def _minima(self, depths: np.ndarray) -> None:
        """Range minima: a table of powers of two over blocks, and running minima from both ends of each block."""
        whole = np.full(-(-len(depths) // BLOCK) * BLOCK, np.iinfo(np.int32).max, np.int32)
        whole[:len(depths)] = depths
        blocks = whole.reshape(-1, BLOCK)
        self.depths = whole
        self.from_start = np.minimum.accumulate(blocks, axis=1).ravel()
        self.to_end = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        self.table = [blocks.min(axis=1)]
        while 1 << len(self.table) <= len(blocks):
            half = 1 << (len(self.table) - 1)
            self.table.append(np.minimum(self.table[-1][:-half], self.table[-1][half:]))

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Lengths of the longest common prefixes of the suffixes at i and j; none of them equal, n stands for the empty suffix."""
        a, b = np.minimum(self.position[i], self.position[j]), np.maximum(self.position[i], self.position[j])
        x, y = a // BLOCK, b // BLOCK
        out = np.empty(len(a), np.int64)
        near = x == y
        if near.any():
            steps = np.minimum(a[near, None] + np.arange(BLOCK), b[near, None])
            out[near] = self.depths[steps].min(axis=1)
        far = ~near
        out[far] = np.minimum(self.to_end[a[far]], self.from_start[b[far]])
        gap = y - x - 1
        level = np.where(gap > 0, np.frexp(np.maximum(gap, 1))[1] - 1, -1)
        for k in np.unique(level[level >= 0]):
            at = level == k
            t = self.table[k]
            out[at] = np.minimum(out[at], np.minimum(t[x[at] + 1], t[y[at] - (1 << k)]))
        return out


def _next_smaller(rank: list[int]) -> list[int]:
    """For each suffix, the next one that is smaller: the longest Lyndon word at a position ends there."""
    n = len(rank) - 1  # the empty suffix, at n, is the smallest
    following = [n] * n
    for i in range(n - 2, -1, -1):
        j = i + 1
        while rank[j] > rank[i]:
            j = following[j]
        following[i] = j
    return following


def runs_of(letters: list[int]) -> np.ndarray:
    """(start, length, period) of all runs, of two periods at least, by start and period."""
    n = len(letters)
    if n < 2:
        return np.zeros((0, 3), np.int64)
    forward, backward = SuffixTree(letters), SuffixTree(letters[::-1])
    found = []
    for rank in (forward.rank, forward.back_rank):
        i, j = np.arange(n), np.array(_next_smaller(rank.tolist()))
        period = j - i
        right = forward.extension(i, j)
        left = np.zeros(n, np.int64)
        inner = np.nonzero(i > 0)[0]
        left[inner] = backward.extension(n - i[inner], n - j[inner])
        keep = left + right >= period
        found.append(np.stack([i - left, left + period + right, period], axis=1)[keep])
    return np.unique(np.concatenate(found)[:, [0, 2, 1]], axis=0)[:, [0, 2, 1]]


def _stretches(codes: np.ndarray, least: int, times: int) -> Iterator[tuple[int, int]]:
    """(start, end) of the stretches that can hold a run of ``least`` words and ``times`` periods.

    In such a run of length L and period q, L >= 2q + GRAM - 1, so that every gram inside comes again q words before or after, within the
    run, and q <= L / times. Starts of grams that have no equal one so near are left out, then what is left is shorter, and so on.
    """
    n = len(codes) - GRAM + 1
    if n < 2:
        return
    mix = np.zeros(n, np.uint64)
    for k in range(GRAM):
        mix = mix * np.uint64(0x9E3779B97F4A7C15) + codes[k:k + n]
    order = np.argsort(mix, kind="stable")
    gap = np.where(mix[order][1:] == mix[order][:-1], np.diff(order), n + 1)
    if gap.min() > n:
        return
    near = np.empty(n, np.int64)
    near[order] = np.minimum(np.r_[gap, n + 1], np.r_[n + 1, gap])
    todo = [(0, n)]
    while todo:
        s, e = todo.pop()
        length = e - s + GRAM - 1
        if length < least:
            continue
        kept = near[s:e] * times <= length
        if kept.all():
            yield s, s + length
            continue
        edges = np.nonzero(np.diff(np.r_[False, kept, False]))[0]
        todo += [(s + int(a), s + int(b)) for a, b in zip(edges[::2], edges[1::2])]


def find_runs(words: list[bytes], least: int = 6, times: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of ``least`` words and ``times`` periods at least, by start and period."""
    if len(words) < least:
        return []
    codes = np.fromiter(map(hash, words), np.int64, len(words)).astype(np.uint64)
    found = []
    for s, e in _stretches(codes, least, times):
        known: dict[bytes, int] = {}
        runs = runs_of([known.setdefault(w, len(known)) for w in words[s:e]])
        runs = runs[runs[:, 1] >= np.maximum(least, times * runs[:, 2])]
        found += [(s + a, b, c) for a, b, c in runs.tolist()]
    return sorted(found, key=lambda r: (r[0], r[2]))


def periodic_runs(docs: DataFrame, text_col: str = "text", least: int = 6, times: int = 4, collapsed: str | None = None) -> DataFrame:
    """``docs`` with ``n_words``, ``n_runs``, the run of the greatest exponent, and digests of all runs and of the text without repeats.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0. A run is a stretch with a smallest period q, of ``least`` words and ``times`` periods
    at least, that no neighbouring word extends. ``start, length, period, exponent_milli`` tell of the run with the greatest exact
    length / period (ties: smallest start, then period), null without a run; ``runs_sha256`` is the digest of the lines
    ``start,length,period`` of all runs. Words that a run holds after its first period are dropped; ``collapsed_sha256`` is the digest of
    the rest, joined by one space, which ``collapsed`` names a column for.

    Null and empty texts, and those of white space, have no words, no runs and the digests of nothing. Repeated rows are rows each; an
    empty table stays empty. An input column named like an added one is an error; all others are kept. Texts are read whole; a task's
    memory follows its longest periodic stretch. ``least`` and ``times`` must be 6 and 4 or more (see ``_stretches``).
    """
    if least < GRAM + 1 or times < 4:
        raise ValueError("runs need 6 words and 4 periods at least")
    added = [c.split()[0] for c in COLUMNS.split(", ")] + ([collapsed] if collapsed else [])
    refuse_clash(docs, *added)
    text_batches(docs.sparkSession)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    kinds = f"{kinds}, {COLUMNS}" + (f", `{collapsed}` string" if collapsed else "")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [_describe(t, least, times, bool(collapsed)) for t in batch[text_col]]
            for k, name in enumerate(added):
                column = [r[k] for r in rows]
                batch[name] = pd.Series(column, batch.index, "Int64" if name in ("start", "length", "period", "exponent_milli") else None)
            yield batch

    return docs.mapInPandas(walk, kinds)


def _describe(text: str | None, least: int, times: int, keep_text: bool) -> list:
    words = (text or "").encode("utf-8", "surrogatepass").split()  # of bytes: at ASCII white space only
    runs = find_runs(words, least, times)
    digest = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
    best: list = [None] * 4
    if runs:
        s, n, q = runs[0]
        for run in runs[1:]:
            if run[1] * q > n * run[2]:  # by start and period already
                s, n, q = run
        best = [s, n, q, 1000 * n // q]
        kept = np.ones(len(words), bool)
        for a, b, c in runs:
            kept[a + c:a + b] = False
        words_left = [words[i] for i in np.nonzero(kept)[0]]
    else:
        words_left = words
    left = b" ".join(words_left)
    out = [len(words), len(runs), *best, digest, hashlib.sha256(left).hexdigest()]
    return [*out, left.decode("utf-8", "surrogatepass")] if keep_text else out
