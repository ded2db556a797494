"""Forests and boosted trees fitted over bins, by the rules of Spark ML and into its models.

Spark ML's fits take hundreds of nanoseconds for each row and level. Here every value becomes one of 32 bins once, two bins share a number of
16 bits, and blocks of rows are kept as arrays: a level of a tree costs a few array operations for each block, counting two features at a time.
Rows never leave their task, only histograms do; several trees (those of a forest, those of all folds) are grown in one pass over the blocks.

The rules are those of Spark ML: at most 32 bins, split points midway between values or at even ranks, every node's features drawn anew, gini or
variance, a forest's rows drawn with replacement and a boosted tree's without, the first boosted tree fitted to the labels (-1 and 1) and
the others to the gradient of the log loss, stopped when the held-out rows no longer gain. Ranks come from summaries of all rows, where Spark ML
reads some 10,000.
"""

from __future__ import annotations

import json
import math
import pickle
import time
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.classification import (
    GBTClassificationModel, GBTClassifier, RandomForestClassificationModel, RandomForestClassifier)
from pyspark.sql import DataFrame, SparkSession, functions as F

from .ensembles import Trees, leaf_sums
from ..session import Scratch

#: Bins of a feature, and the bits that tell them.
BINS, BITS = 32, 5
#: Rows that are handled at once, and rows that are dealt out together.
ROWS, DEALT = 1 << 17, 1 << 14
#: Values that a summary of a feature keeps; up to so many different ones it is exact.
SUMMARY = 4096
#: Trees of a forest that grow in one pass.
TOGETHER = 20
#: Tasks whose histograms are summed on the driver; those of more are summed by tasks first.
DIRECT = 64
EPSILON = 2.0 ** -52
#: Blocks are kept as they are sent: stored in the usual way they would be compressed, and unpacked in every pass.
KEPT = StorageLevel(True, True, False, True)


# -- from rows to blocks ----------------------------------------------------------------------------

Summary = tuple[np.ndarray, np.ndarray]  # values in order, and how many rows each stands for


def _shortened(values: np.ndarray, counts: np.ndarray) -> Summary:
    if len(values) <= SUMMARY:
        return values, counts
    middle = np.cumsum(counts) - counts / 2
    starts = np.flatnonzero(np.diff((middle * (SUMMARY / counts.sum())).astype(np.int64), prepend=-1))
    return values[np.append(starts[1:], len(values)) - 1], np.add.reduceat(counts, starts)


def _joined(a: Summary, b: Summary) -> Summary:
    values, place = np.unique(np.concatenate([a[0], b[0]]), return_inverse=True)
    return _shortened(values, np.bincount(place, np.concatenate([a[1], b[1]]), len(values)).astype(np.int64))


def _thresholds(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Split points: midway between all values or, if they are too many, where the rows are cut most evenly."""
    between = values[:-1] / 2 + values[1:] / 2
    if len(between) >= BINS:
        stride, chosen = counts.sum() / BINS, []
        target, below = stride, np.cumsum(counts)
        for k in range(1, len(values)):
            if abs(below[k - 1] - target) < abs(below[k] - target):
                chosen.append(k - 1)
                target += stride
        between = between[chosen]
    return np.unique(between[~np.isnan(between)])


def _columns(batch: pa.RecordBatch, count: int) -> list[np.ndarray]:
    """The first ``count`` columns as numbers; null is not a number."""
    return [batch.column(i).to_numpy(zero_copy_only=False).astype(np.float64, copy=False) for i in range(count)]


@dataclass
class Blocks:
    """Rows as blocks ``(place, pairs, label, fold)`` dealt out over tasks: two bins of each row in a number, the label, the fold."""

    blocks: RDD
    thresholds: list[np.ndarray]
    rows: int
    ones: int

    def release(self) -> None:
        self.blocks.unpersist()

    @property
    def values(self) -> list[np.ndarray]:
        """A value of each bin, on the same side of all split points as the bin's rows."""
        return [np.append(t, np.inf) for t in self.thresholds]


def to_blocks(df: DataFrame, features: Sequence[str], medians: Sequence[float], label: str, spread, fold: str | None = None) -> Blocks:
    """Rows of numbers and labels (0 or 1) as blocks; what is missing takes the medians. ``spread`` deals rows out evenly."""
    count, medians = len(features), np.array(medians, np.float64)
    chosen = df.select(*[F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(features)], F.col(label).cast("double").alias("label"),
                       (F.col(fold) if fold else F.lit(0)).cast("int").alias("fold"))

    def filled(columns: list[np.ndarray]) -> list[np.ndarray]:
        return [np.where(np.isnan(x), m, x) for x, m in zip(columns, medians)]

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, rows, ones, others = [(np.zeros(0), np.zeros(0, np.int64))] * count, [], 0, 0, 0

        def fold_in():
            return [_joined(k, _shortened(*np.unique(np.concatenate(c), return_counts=True))) for k, c in zip(known, zip(*held))]

        for batch in batches:
            *x, y = _columns(batch, count + 1)
            rows, ones, others = rows + len(y), ones + int((y == 1).sum()), others + int(((y != 0) & (y != 1)).sum())
            held.append(filled(x))
            if sum(len(h[0]) for h in held) >= ROWS:
                known, held = fold_in(), []
        known = fold_in() if held else known
        yield pa.RecordBatch.from_pydict({"summary": [pickle.dumps((rows, ones, others, known))]})

    def add(a, b):
        return a[0] + b[0], a[1] + b[1], a[2] + b[2], [_joined(s, t) for s, t in zip(a[3], b[3])]

    rows, ones, others, known = chosen.drop("fold").mapInArrow(summaries, "summary binary").rdd.map(lambda r: pickle.loads(r[0])).treeReduce(add)
    if not rows:
        raise ValueError("no rows to fit on")
    if others:
        raise ValueError(f"{others} labels are neither 0 nor 1")
    thresholds = [_thresholds(*k) for k in known]

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []

        def block():
            x, y, g = (np.concatenate(parts, axis=-1) for parts in zip(*held))
            return pa.RecordBatch.from_pydict({"pairs": [x.tobytes()], "label": [y.tobytes()], "fold": [g.tobytes()]})

        for batch in batches:
            *x, y = _columns(batch, count + 1)
            b = [np.searchsorted(t, v).astype(np.uint16) for t, v in zip(thresholds, filled(x))] + [np.zeros(len(y), np.uint16)] * (count % 2)
            held.append((np.stack([(p << BITS) | q for p, q in zip(b[::2], b[1::2])]), y.astype(np.uint8),
                         batch.column(count + 1).to_numpy(zero_copy_only=False).astype(np.uint16)))
            if sum(len(h[1]) for h in held) >= DEALT:
                yield block()
                held = []
        if held:
            yield block()

    def merged(part: int, dealt: Iterator) -> Iterator[tuple]:
        held, place = [], 0
        for r in dealt:
            y = np.frombuffer(r[1], np.uint8)
            if held and sum(len(h[1]) for h in held) + len(y) > ROWS:
                yield ((part, place), *(np.concatenate(parts, axis=-1) for parts in zip(*held)))
                held, place = [], place + 1
            held.append((np.frombuffer(r[0], np.uint16).reshape(-1, len(y)), y, np.frombuffer(r[2], np.uint16)))
        if held:
            yield ((part, place), *(np.concatenate(parts, axis=-1) for parts in zip(*held)))

    dealt = spread(chosen.mapInArrow(bins, "pairs binary, label binary, fold binary"), rows)
    return Blocks(dealt.rdd.mapPartitionsWithIndex(merged).persist(KEPT), thresholds, rows, ones)


# -- growing trees ----------------------------------------------------------------------------------

@dataclass
class Growing:
    """A tree as complete levels: the children of node k are 2k + 1 and 2k + 2; below a leaf all rows keep to the left."""

    depth: int
    feature: np.ndarray = field(init=False)
    bin: np.ndarray = field(init=False)
    gain: np.ndarray = field(init=False)
    stats: list = field(init=False)

    def __post_init__(self):
        inner = 2 ** self.depth - 1
        self.feature, self.bin, self.gain = np.full(inner, -1), np.full(inner, BINS), np.zeros(inner)
        self.stats = [None] * (2 * inner + 1)

    def reached(self, level: int, pairs: np.ndarray) -> np.ndarray:
        """The node of each row, counted within the level."""
        at = np.zeros(pairs.shape[1], np.int64)
        if level == 0:
            return at
        inner = 2 ** level - 1
        feature, cut = self.feature[:inner], self.bin[:inner]
        both = np.arange(1 << 2 * BITS)
        own = np.where((feature % 2 == 0)[:, None], both >> BITS, both & (BINS - 1))
        right = ((own > cut[:, None]) & (feature >= 0)[:, None]).ravel()
        n, flat, row = pairs.shape[1], pairs.ravel(), np.arange(pairs.shape[1])
        column = np.where(feature >= 0, feature // 2, 0) * n
        for step in range(level):
            first = 2 ** step - 1
            pair = flat.take(row + column[first]) if step == 0 else flat.take(column.take(at + first) + row)
            at = 2 * at + right.take(((at + first) << 2 * BITS) + pair)
        return at

    def leaf_values(self, value) -> np.ndarray:
        """``value`` of the statistics of the leaf above each place of the lowest level."""
        out = np.zeros(2 ** self.depth)
        for k in range(len(out)):
            path = [2 ** self.depth - 1 + k]
            while path[-1]:
                path.append((path[-1] - 1) // 2)
            at = 0
            for below in reversed(path[:-1]):
                if self.feature[at] < 0:
                    break
                at = below
            out[k] = value(self.stats[at])
        return out


def _histogram(pairs: np.ndarray, group: np.ndarray, groups: int, count: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Rows, or their weights, by group, feature and bin."""
    out = np.empty((groups, count, BINS))
    n = pairs.shape[1]
    if n >= 2 * groups << 2 * BITS:  # both features of a pair are counted at once
        base = group << 2 * BITS
        for j, pair in enumerate(pairs):
            both = np.bincount(base + pair, weights, groups << 2 * BITS).reshape(groups, BINS, BINS)
            out[:, 2 * j] = both.sum(axis=2)
            if 2 * j + 1 < count:
                out[:, 2 * j + 1] = both.sum(axis=1)
        return out
    base = group << BITS
    for f in range(count):
        own = pairs[f // 2] >> BITS if f % 2 == 0 else pairs[f // 2] & (BINS - 1)
        out[:, f] = np.bincount(base + own, weights, groups << BITS).reshape(groups, BINS)
    return out


def _added(a, b):
    if isinstance(a, (list, tuple)):
        return [_added(x, y) for x, y in zip(a, b)]
    return a if b is None else b if a is None else a + b


def _total(found: RDD):
    """The sum over all tasks of what each found."""
    return found.treeReduce(_added, 2) if found.getNumPartitions() > DIRECT else found.reduce(_added)


def _drawn(seed: Sequence[int], n: int) -> np.ndarray:
    """The same even numbers of 16 bits whenever they are drawn for the same seed."""
    return np.frombuffer(np.random.Generator(np.random.SFC64(list(seed))).bytes(2 * n), np.uint16)


def _poisson() -> np.ndarray:
    """How often a row is drawn, for each number of 16 bits."""
    share = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
    return np.searchsorted(share, (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)


def _subset(seed: Sequence[int], nodes: int, count: int, chosen: int) -> np.ndarray:
    """For each node, which features it may split on."""
    order = np.random.Generator(np.random.SFC64(list(seed))).random((nodes, count)).argsort(axis=1)
    return order.argsort(axis=1) < chosen


def _split(tree: Growing, level: int, gains: np.ndarray, sound: np.ndarray, allowed: np.ndarray, impurity: np.ndarray) -> np.ndarray:
    """Splits each node of the level where that gains most, if anything; tells which nodes are split."""
    first, nodes = 2 ** level - 1, 2 ** level
    gains = np.where(sound & allowed[:, :, None], gains, -np.inf).reshape(nodes, -1)
    best = gains.argmax(axis=1)
    gain = gains[np.arange(nodes), best]
    alive = np.array([level == 0 or tree.feature[(k - 1) // 2] >= 0 for k in range(first, first + nodes)])
    done = alive & (gain > 0) & (impurity > EPSILON)
    tree.feature[first:first + nodes] = np.where(done, best // (BINS - 1), -1)
    tree.bin[first:first + nodes] = np.where(done, best % (BINS - 1), BINS)
    tree.gain[first:first + nodes] = np.where(done, gain, 0.0)
    return done


def _sides(counted: np.ndarray, tree: Growing, level: int, done: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each node split at the level, the statistics of both children out of (statistic, node, feature, bin)."""
    first = 2 ** level - 1
    for k in np.flatnonzero(done):
        f, b = tree.feature[first + k], tree.bin[first + k]
        yield first + k, counted[:, k, f, :b + 1].sum(axis=1), counted[:, k, f, b + 1:].sum(axis=1)


def _gini(stats: np.ndarray) -> np.ndarray:
    """Gini impurity by class weights along the first axis."""
    total = stats.sum(axis=0)
    return 1 - ((stats / np.where(total > 0, total, 1)) ** 2).sum(axis=0)


def fit_forest(data: Blocks, estimator: RandomForestClassifier, class_weights: tuple[float, float], seed: int = 42) -> RandomForestClassificationModel:
    """A forest of the estimator's trees and depth; rows weigh what their class does, nodes draw the root of the number of features."""
    count, depth, trees = len(data.thresholds), estimator.getMaxDepth(), estimator.getNumTrees()
    cuts = np.array([[b < len(t) for b in range(BINS - 1)] for t in data.thresholds])
    weight = np.array(class_weights, np.float64)[:, None, None, None]
    grown = [Growing(depth) for _ in range(trees)]

    def counted(level: int, some: range, known: list[Growing]):
        def run(blocks: Iterator[tuple]) -> Iterator[list]:
            times, found = _poisson(), [np.zeros((2 << level, count, BINS)) for _ in some]
            for place, pairs, label, _ in blocks:
                for i, t in enumerate(some):
                    drawn = times[_drawn((seed, 1, t, *place), len(label))]
                    rows = np.flatnonzero(drawn)
                    own = pairs.take(rows, axis=1)
                    group = 2 * known[i].reached(level, own) + label[rows]
                    found[i] += _histogram(own, group, 2 << level, count, drawn[rows].astype(np.float64))
            yield found
        return run

    for start in range(0, trees, TOGETHER):
        some = range(start, min(trees, start + TOGETHER))
        for level in range(depth):
            known = [grown[t] for t in some]
            if level and not any((tree.feature[2 ** (level - 1) - 1:2 ** level - 1] >= 0).any() for tree in known):
                break
            for t, found in zip(some, _total(data.blocks.mapPartitions(counted(level, some, known)))):
                tree = grown[t]
                drawn = found.reshape(1 << level, 2, count, BINS).transpose(1, 0, 2, 3)  # class, node, feature, bin
                heavy = drawn * weight
                if level == 0:
                    tree.stats[0] = (heavy[:, 0, 0].sum(axis=1), drawn[:, 0, 0].sum())
                left, all_of = heavy.cumsum(axis=3)[..., :-1], heavy.sum(axis=3, keepdims=True)
                right, impurity = all_of - left, _gini(all_of)
                many = drawn.sum(axis=0).cumsum(axis=2)
                sound = (many[..., :-1] > 0) & (many[..., :-1] < many[..., -1:]) & cuts
                whole = all_of.sum(axis=0)
                gains = impurity - (left.sum(axis=0) * _gini(left) + right.sum(axis=0) * _gini(right)) / np.where(whole > 0, whole, 1)
                allowed = _subset((seed, 2, t, level), 1 << level, count, math.ceil(math.sqrt(count)))
                done = _split(tree, level, gains, sound, allowed, impurity[:, 0, 0])
                both = np.concatenate([heavy, drawn])
                for node, *sides in _sides(both, tree, level, done):
                    for k, side in enumerate(sides):
                        tree.stats[2 * node + 1 + k] = (side[:2], side[2:].sum())

    def node_of(stats):
        by_class, drawn = stats
        return float(by_class.argmax()), float(_gini(by_class)), [float(v) for v in by_class], int(drawn)

    stored = [_nodes(tree, data.thresholds, node_of) for tree in grown]
    return _model(RandomForestClassificationModel, estimator, stored, [1.0] * trees, count, {"numClasses": 2})


def _residuals(label: np.ndarray, margin: np.ndarray | None) -> np.ndarray:
    """What a boosted tree is fitted to: the labels as -1 and 1, or the gradient of the log loss at the margins so far."""
    sign = label.astype(np.float32) * 2 - 1
    if margin is None:
        return sign.astype(np.float64)
    with np.errstate(over="ignore"):
        return (4 * sign / (1 + np.exp(2 * sign * margin))).astype(np.float64)


def fit_boosted(data: Blocks, estimator: GBTClassifier, folds: int = 0, share: float = 1.0, subset: float = 1.0, seed: int = 42) -> list[GBTClassificationModel]:
    """Boosted trees over all rows or, for each of the folds, over the rows of the others until those of the fold no longer gain.

    The models of the folds grow side by side: a pass over the blocks is a level of a tree of each. ``share`` of the rows are drawn for a
    tree, and ``subset`` of the features for a node.
    """
    count, depth, rounds, models = len(data.thresholds), estimator.getMaxDepth(), estimator.getMaxIter(), max(1, folds)
    step, tolerance = estimator.getStepSize(), estimator.getValidationTol()
    cuts = np.array([[b < len(t) for b in range(BINS - 1)] for t in data.thresholds])
    below = min(1 << 16, round(share * (1 << 16)))
    grown: list[list[Growing]] = [[] for _ in range(models)]
    best, errors, active = [rounds] * models, [math.inf] * models, list(range(models))

    def rows_of(m: int, k: int, place: tuple, fold: np.ndarray) -> np.ndarray | None:
        chosen = fold != k if folds else None
        if below < 1 << 16:
            drawn = _drawn((seed, 3, m, k, *place), len(fold)) < below
            chosen = drawn if chosen is None else chosen & drawn
        return None if chosen is None else np.flatnonzero(chosen)

    def counted(m: int, level: int, some: list[int], known: list[Growing]):
        last = level == depth - 1

        def run(blocks: Iterator[tuple]) -> Iterator[list]:
            found = [[np.zeros((3 if last else 2, 1 << level, count, BINS)), np.zeros(1 << level), np.zeros(2)] for _ in some]
            for place, pairs, label, fold, margins in blocks:
                for i, k in enumerate(some):
                    rows = rows_of(m, k, place, fold)
                    own = pairs if rows is None else pairs.take(rows, axis=1)
                    y = label if rows is None else label[rows]
                    margin = None if m == 0 else margins[k] if rows is None else margins[k][rows]
                    r, at = _residuals(y, margin), known[i].reached(level, own)
                    found[i][0][0] += _histogram(own, at, 1 << level, count)
                    found[i][0][1] += _histogram(own, at, 1 << level, count, r)
                    if last:
                        found[i][0][2] += _histogram(own, at, 1 << level, count, r * r)
                    else:
                        found[i][1] += np.bincount(at, r * r, 1 << level)
                    if folds and m and level == 0:
                        found[i][2] += held_out_error(k, label, fold, margins)
            yield found
        return run

    def held_out_error(k: int, label: np.ndarray, fold: np.ndarray, margins: np.ndarray) -> np.ndarray:
        held = fold == k
        lost = -2.0 * (label[held].astype(np.float64) * 2 - 1) * margins[k][held]
        return np.array([2 * np.logaddexp(0, lost).sum(), held.sum()])

    def update(values: dict[int, tuple[Growing, np.ndarray]]):
        def run(blocks: Iterator[tuple]) -> Iterator[tuple]:
            for place, pairs, label, fold, margins in blocks:
                margins = np.zeros((models, len(label)), np.float32) if margins is None else margins.copy()
                for k, (tree, value) in values.items():
                    margins[k] += value.take(tree.reached(depth, pairs)).astype(np.float32)
                yield place, pairs, label, fold, margins
        return run

    def judge(m: int, sums: dict[int, np.ndarray]) -> None:
        """After ``m`` trees: which models still gain on their held-out rows, by Spark ML's rule."""
        for k, (lost, rows) in sums.items():
            error = lost / rows if rows else 0.0
            if m == 1:
                errors[k], best[k] = error, 1
            elif errors[k] - error < tolerance * max(error, 0.01):
                active.remove(k)
            elif error < errors[k]:
                errors[k], best[k] = error, m

    state = data.blocks.map(lambda b: (*b, None))
    kept: RDD | None = None
    for m in range(rounds):
        if m:
            values = {k: (grown[k][-1], grown[k][-1].leaf_values(lambda s: s[1] / s[0] if s[0] else 0.0) * (1.0 if m == 1 else step)) for k in active}
            state = state.mapPartitions(update(values)).persist(KEPT)
        some, known = list(active), [Growing(depth) for _ in active]
        for level in range(depth):
            if level and not any((tree.feature[2 ** (level - 1) - 1:2 ** level - 1] >= 0).any() for tree in known):
                break
            total = _total(state.mapPartitions(counted(m, level, some, known)))
            if level == 0 and m:
                if kept is not None:
                    kept.unpersist()
                kept = state
                if folds:
                    judge(m, {k: total[i][2] for i, k in enumerate(some)})
                    still = [i for i, k in enumerate(some) if k in active]
                    some, known, total = [some[i] for i in still], [known[i] for i in still], [total[i] for i in still]
            for i, (k, tree) in enumerate(zip(some, known)):
                found, squares, _ = total[i]
                n, s = found[0], found[1]
                squares = found[2, :, 0].sum(axis=1) if level == depth - 1 else squares
                nodes = [n[:, 0].sum(axis=1), s[:, 0].sum(axis=1), squares]
                for node in range(1 << level):
                    tree.stats[(1 << level) - 1 + node] = tuple(float(v[node]) for v in nodes)
                left_n, left_s = n.cumsum(axis=2)[..., :-1], s.cumsum(axis=2)[..., :-1]
                all_n, all_s = nodes[0][:, None, None], nodes[1][:, None, None]
                right_n, right_s = all_n - left_n, all_s - left_s
                sound = (left_n > 0) & (right_n > 0) & cuts
                one = lambda v: np.where(v > 0, v, 1)
                gains = (left_s ** 2 / one(left_n) + right_s ** 2 / one(right_n) - all_s ** 2 / one(all_n)) / one(all_n)
                impurity = nodes[2] / one(nodes[0]) - (nodes[1] / one(nodes[0])) ** 2
                allowed = _subset((seed, 4, m, k, level), 1 << level, count, math.ceil(subset * count))
                done = _split(tree, level, gains, sound, allowed, impurity)
                if level == depth - 1:
                    for node, *sides in _sides(found, tree, level, done):
                        for c, side in enumerate(sides):
                            tree.stats[2 * node + 1 + c] = tuple(map(float, side))
            if not some:
                break
        for k, tree in zip(some, known):
            grown[k].append(tree)
        if not active:
            break
    if folds and active:  # the last round's gain
        values = {k: (grown[k][-1], grown[k][-1].leaf_values(lambda s: s[1] / s[0] if s[0] else 0.0) * (1.0 if rounds == 1 else step)) for k in active}

        def errors_of(blocks: Iterator[tuple]) -> Iterator[list]:
            found = [np.zeros(2) for _ in active]
            for _, _, label, fold, margins in update(values)(blocks):
                for i, k in enumerate(active):
                    found[i] += held_out_error(k, label, fold, margins)
            yield found

        total = _total(state.mapPartitions(errors_of))
        judge(rounds, dict(zip(list(active), total)))
    if kept is not None:
        kept.unpersist()

    def node_of(stats):
        n, s, q = stats
        mean = s / n if n else 0.0
        return mean, max(0.0, q / n - mean ** 2) if n else 0.0, [n, s, q], int(n)

    out = []
    for k in range(models):
        stored = [_nodes(tree, data.thresholds, node_of) for tree in grown[k][:best[k]]]
        weights = [1.0] + [step] * (len(stored) - 1)
        out.append(_model(GBTClassificationModel, estimator, stored, weights, count, {}))
    return out


# -- fitted trees as Spark ML's models --------------------------------------------------------------

def _nodes(tree: Growing, thresholds: list[np.ndarray], node_of) -> list[tuple]:
    """The nodes from the root on, left sides first, as Spark ML stores them; two leaves that predict the same become one."""
    out: list[list] = []

    def visit(k: int) -> None:
        own, (prediction, impurity, stats, rows) = len(out), node_of(tree.stats[k])
        node = [own, prediction, impurity, stats, rows, -1.0, -1, -1, (-1, [], -1)]
        out.append(node)
        if k < len(tree.feature) and tree.feature[k] >= 0:
            f = int(tree.feature[k])
            left = len(out)
            visit(2 * k + 1)
            right = len(out)
            visit(2 * k + 2)
            if out[left][6] < 0 and out[right][6] < 0 and out[left][1] == out[right][1]:
                del out[left:]
                return
            node[5:] = float(tree.gain[k]), left, right, (f, [float(thresholds[f][tree.bin[k]])], -1)

    visit(0)
    return [tuple(n) for n in out]


_NODE = ("treeID int, nodeData struct<id: int, prediction: double, impurity: double, impurityStats: array<double>, rawCount: bigint, gain: double, "
         "leftChild: int, rightChild: int, split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>>")


def _model(kind, estimator, stored: list[list[tuple]], weights: list[float], count: int, more: dict):
    """A model of Spark ML out of its stored form, with the estimator's parameters."""
    spark = SparkSession.getActiveSession()
    scratch = Scratch(spark, "fitted")
    base = {"timestamp": int(time.time() * 1000), "sparkVersion": spark.version}
    single = "regression.DecisionTreeRegressionModel" if kind is GBTClassificationModel else "classification.DecisionTreeClassificationModel"
    chosen, usual = ({p.name: v for p, v in m.items()} for m in (estimator._paramMap, estimator._defaultParamMap))
    about = {"class": f"org.apache.spark.ml.classification.{kind.__name__}", **base, "uid": estimator.uid, "paramMap": chosen,
             "defaultParamMap": usual, "numFeatures": count, **more, "numTrees": len(stored)}
    of_tree = {"class": f"org.apache.spark.ml.{single}", **base, "paramMap": {"maxDepth": estimator.getMaxDepth()}, "defaultParamMap": {}}
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{scratch.folder}/metadata")
    nodes = [(t, n) for t, tree in enumerate(stored) for n in tree]
    spark.createDataFrame(nodes, _NODE).coalesce(1).write.parquet(f"{scratch.folder}/data")
    trees = [(t, json.dumps({**of_tree, "uid": f"{estimator.uid}_{t}"}), float(w)) for t, w in enumerate(weights)]
    spark.createDataFrame(trees, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{scratch.folder}/treesMetadata")
    model = kind.load(scratch.folder)
    scratch.release()
    return model


# -- what fitted trees say of the blocks ------------------------------------------------------------

def scored(data: Blocks, trees: Sequence[Trees], say, columns: str) -> DataFrame:
    """Rows of the named columns (numbers): those that ``say`` makes of a block's labels, folds and sums of leaf values for each of ``trees``.

    A bin has one value on the same side of all split points as its rows, so that trees score blocks as they score the rows.
    """
    values, names = data.values, [c.split()[0] for c in columns.split(", ")]
    sent = data.blocks.ctx.broadcast(list(trees))

    def run(blocks: Iterator[tuple]) -> Iterator[tuple]:
        for _, pairs, label, fold, *_ in blocks:
            x = np.stack([v[pairs[f // 2] >> BITS if f % 2 == 0 else pairs[f // 2] & (BINS - 1)] for f, v in enumerate(values)], axis=1)
            yield tuple(np.asarray(c, np.float64).tobytes() for c in say(label, fold, [leaf_sums(t, x) for t in sent.value]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.to_pylist():
                yield pa.RecordBatch.from_pydict({c: np.frombuffer(block[c], np.float64) for c in names})

    spark = SparkSession.getActiveSession()
    return spark.createDataFrame(data.blocks.mapPartitions(run), ", ".join(f"{c} binary" for c in names)).mapInArrow(rows, columns)
