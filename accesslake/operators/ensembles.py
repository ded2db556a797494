"""Fitted tree ensembles as flat arrays, and all candidates of a row scored within the row.

A pipeline of Spark ML trees scores one row at a time, so candidates had to become rows. Here the trees travel once to every worker as
arrays of nodes, and a batch of rows is scored with all its candidates by numpy: nothing is multiplied, gathered or shuffled, and only the
model's features and the outcome pass between the engine and the worker.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, LogisticRegressionModel, RandomForestClassificationModel
from pyspark.ml.feature import ImputerModel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import Scratch

#: Rows times candidates whose leaves are looked up at once.
BLOCK = 1024
#: Leaves that fit into the bits of one number; trees with more are walked.
MOST_LEAVES = 64


@dataclass
class Trees:
    """Trees as arrays of nodes. A leaf is its own child, so that every path takes ``depth`` steps."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int

    def __post_init__(self):
        self.leaves = Leaves.of(self)

    def sums(self, x: np.ndarray) -> np.ndarray:
        """For each row of features, the sum over the trees of the values of the leaves it falls in."""
        if self.leaves is not None:
            return self.leaves.sums(self.leaves.reached(x))
        at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[row, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.value[at].sum(axis=1)

    def sums_with(self, x: np.ndarray, at: int, values: np.ndarray) -> Iterator[np.ndarray]:
        """``sums`` for each of the values that the feature ``at`` may take instead; what the other features say is looked up once."""
        if self.leaves is None:
            for v in values:
                x = x.copy()
                x[:, at] = v
                yield self.sums(x)
            return
        others = self.leaves.reached(x, at)
        for v in values:
            yield self.leaves.sums(others & self.leaves.allowed(at, np.array([v])))


@dataclass
class Leaves:
    """The leaves of each tree as bits, from left to right: the place of a feature's value among its thresholds tells which leaves it leaves
    open. What all features leave open begins with the leaf that the row falls in."""

    thresholds: list[np.ndarray]
    open: list[np.ndarray]
    value: np.ndarray

    @staticmethod
    def of(trees: Trees) -> Leaves | None:
        inner = trees.left != np.arange(len(trees.left))
        below: dict[int, int] = {}  # bits of the leaves under each node
        values, splits = np.zeros((len(trees.roots), MOST_LEAVES, trees.value.shape[1])), []
        for t, root in enumerate(trees.roots):
            stack, seen = [int(root)], 0
            while stack:
                k = stack[-1]
                sides = (int(trees.left[k]), int(trees.right[k])) if inner[k] else ()
                open_sides = [c for c in sides if c not in below]
                if open_sides:
                    stack.append(open_sides[0])
                    continue
                stack.pop()
                if not sides:
                    if seen == MOST_LEAVES:
                        return None
                    values[t, seen], below[k], seen = trees.value[k], 1 << seen, seen + 1
                else:
                    below[k] = below[sides[0]] | below[sides[1]]
                    splits.append((int(trees.feature[k]), float(trees.threshold[k]), t, below[sides[0]]))
        every = (1 << MOST_LEAVES) - 1
        width = max((f for f, *_ in splits), default=-1) + 1
        thresholds = [np.array(sorted({v for g, v, *_ in splits if g == f})) for f in range(width)]
        allowed = [np.full((len(v) + 1, len(trees.roots)), every, np.uint64) for v in thresholds]
        for f, v, t, left in splits:  # a value beyond the threshold closes the left side
            allowed[f][np.searchsorted(thresholds[f], v) + 1:, t] &= np.uint64(every ^ left)
        return Leaves(thresholds, allowed, values)

    def allowed(self, feature: int, x: np.ndarray) -> np.ndarray:
        """For each value and tree, the leaves that the feature leaves open."""
        if feature >= len(self.open):
            return np.full((len(x), len(self.value)), ~np.uint64(0))
        return self.open[feature][np.searchsorted(self.thresholds[feature], x)]

    def reached(self, x: np.ndarray, but: int = -1) -> np.ndarray:
        """For each row and tree, the leaves that all features, but one if named, leave open."""
        out = np.full((len(x), len(self.value)), ~np.uint64(0))
        for f, v in enumerate(self.thresholds):
            if f != but and len(v):
                out &= self.allowed(f, x[:, f])
        return out

    def sums(self, reached: np.ndarray) -> np.ndarray:
        """The sum over the trees of the values of the first leaves left open."""
        first = reached & (~reached + np.uint64(1))
        leaf = (first.astype(np.float64).view(np.int64) >> 52) - 1023  # the exponent of a power of two
        leaf += np.arange(len(self.value)) * MOST_LEAVES
        flat = self.value.reshape(-1, self.value.shape[2])
        return np.stack([flat[:, c].take(leaf).sum(axis=1) for c in range(flat.shape[1])], axis=1)


def leaf_sums(trees: Trees, x: np.ndarray) -> np.ndarray:
    """``trees.sums`` of any number of rows, some at a time."""
    return np.concatenate([trees.sums(x[s:s + BLOCK]) for s in range(0, max(1, len(x)), BLOCK)])


def boosted_probability(sums: np.ndarray) -> np.ndarray:
    """The probability of class 1 for sums of boosted trees."""
    return 1.0 / (1.0 + np.exp(-2.0 * sums[:, 0]))


def trees_of(model) -> Trees:
    """The nodes of a fitted forest (values: share of each class in the leaf) or of boosted trees (values: weighted predictions).

    The stored form of the model is a table of nodes, as many rows as the model has; it is read back from there.
    """
    spark = SparkSession.getActiveSession()
    scratch = Scratch(spark, "trees")
    model.write().overwrite().save(scratch.folder)
    node = F.col("nodeData")
    rows = spark.read.parquet(f"{scratch.folder}/data").select(
        "treeID", node["id"].alias("id"), node["prediction"].alias("prediction"), node["impurityStats"].alias("stats"),
        node["leftChild"].alias("left"), node["rightChild"].alias("right"), node["split"]["featureIndex"].alias("feature"),
        node["split"]["leftCategoriesOrThreshold"].alias("threshold"), node["split"]["numCategories"].alias("categories"),
    ).orderBy("treeID", "id").collect()
    weights = list(model.treeWeights)
    scratch.release()
    if any(r.left >= 0 and r.categories != -1 for r in rows):
        raise ValueError("only splits of continuous features can be scored")
    first: dict[int, int] = {}
    for k, r in enumerate(rows):
        first.setdefault(r.treeID, k)
    own = np.arange(len(rows))
    inner = np.array([r.left >= 0 for r in rows])
    base = np.array([first[r.treeID] for r in rows])
    left = np.where(inner, base + [r.left for r in rows], own)
    right = np.where(inner, base + [r.right for r in rows], own)
    if isinstance(model, RandomForestClassificationModel):
        stats = np.array([r.stats for r in rows], np.float64)
        total = stats.sum(axis=1, keepdims=True)
        value = np.divide(stats, total, out=np.zeros_like(stats), where=total != 0)
    else:
        value = np.array([[r.prediction * weights[r.treeID]] for r in rows], np.float64)
    roots, depth = np.array(sorted(first.values())), 0
    at = roots
    while inner[at].any():
        at = np.unique(np.concatenate([left[at], right[at]]))
        depth += 1
    return Trees(np.array([max(0, r.feature) for r in rows]), np.array([r.threshold[0] if r.left >= 0 else np.inf for r in rows]),
                 left, right, value, roots, depth)


@dataclass
class Scorer:
    """A fitted pipeline as arrays: medians for missing features, trees, and the weights that stack a forest with boosted trees."""

    features: list[str]
    medians: np.ndarray
    forest: Trees | None
    boosted: Trees
    weights: np.ndarray | None
    intercept: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1 for each row of features; what is missing takes the median of the training rows."""
        x = np.where(np.isnan(x), self.medians, x)
        out = np.empty(len(x))
        for s in range(0, len(x), BLOCK):
            part = x[s:s + BLOCK]
            out[s:s + BLOCK] = self._stacked(self.boosted.sums(part), self.forest.sums(part) if self.forest is not None else None)
        return out

    def probabilities(self, x: np.ndarray, at: int, values: np.ndarray) -> np.ndarray:
        """For each row the probabilities with each of the values in the feature ``at`` (none: -1)."""
        if at < 0:
            return np.repeat(self.probability(x)[:, None], len(values), axis=1)
        x = np.where(np.isnan(x), self.medians, x)
        values = np.where(np.isnan(values), self.medians[at], values)
        out = np.empty((len(x), len(values)))
        for s in range(0, len(x), BLOCK):
            part = x[s:s + BLOCK]
            votes = self.forest.sums_with(part, at, values) if self.forest is not None else itertools.repeat(None)
            for k, (b, v) in enumerate(zip(self.boosted.sums_with(part, at, values), votes)):
                out[s:s + BLOCK, k] = self._stacked(b, v)
        return out

    def _stacked(self, boosted: np.ndarray, votes: np.ndarray | None) -> np.ndarray:
        p = boosted_probability(boosted)
        if votes is None:
            return p
        stacked = np.stack([votes[:, 1] / votes.sum(axis=1), p], axis=1)
        return 1.0 / (1.0 + np.exp(-(stacked @ self.weights + self.intercept)))


def scorer_of(model: PipelineModel) -> Scorer:
    """A fitted stack (forest, boosted trees, logistic model) or boosted trees alone, as ``models`` fits them."""
    def stage(kind):
        return next((s for s in model.stages if isinstance(s, kind)), None)

    imputer, forest, boosted, meta = map(stage, (ImputerModel, RandomForestClassificationModel, GBTClassificationModel,
                                                 LogisticRegressionModel))
    if imputer is None or boosted is None or (forest is None) != (meta is None):
        raise ValueError("the pipeline is neither a stacked forest nor boosted trees")
    features = list(imputer.getInputCols())
    medians = imputer.surrogateDF.first().asDict()
    return Scorer(features, np.array([medians[c] for c in features], np.float64), trees_of(forest) if forest else None, trees_of(boosted),
                  meta.coefficients.toArray() if meta else None, float(meta.intercept) if meta else 0.0)


def _expanded(facts: pd.DataFrame, at: int, sizes: np.ndarray, chunks: np.ndarray) -> np.ndarray:
    """Features of every candidate: each row ``sizes`` times, the candidate in the feature ``at`` (none: -1)."""
    x = np.repeat(facts.to_numpy(np.float64, na_value=np.nan), sizes, axis=0)
    if at >= 0:
        x[:, at] = chunks
    return x


def with_candidate_scores(df: DataFrame, model: PipelineModel, candidates: Column, chunk: str, name: str) -> DataFrame:
    """``df`` with the array ``name`` of the probabilities of all its candidates, in their order.

    ``candidates`` is an array of numbers, of any length for each row; null and empty arrays give empty ones. Null candidates get none.
    """
    scorer = scorer_of(model)
    sent = df.sparkSession.sparkContext.broadcast(scorer)
    at = scorer.features.index(chunk) if chunk in scorer.features else -1

    @F.pandas_udf("array<double>")
    def score(batches: Iterator[tuple[pd.DataFrame, pd.Series]]) -> Iterator[pd.Series]:
        own = sent.value
        for facts, lists in batches:
            lists = [np.zeros(0) if c is None else np.asarray(c, np.float64) for c in lists]
            sizes = np.array([len(c) for c in lists], np.int64)
            chunks = np.concatenate(lists) if lists else np.zeros(0)
            p = np.where(np.isnan(chunks), np.nan, own.probability(_expanded(facts[own.features], at, sizes, chunks)))
            yield pd.Series(np.split(p, np.cumsum(sizes)[:-1]) if len(sizes) else [], dtype=object)

    facts = F.struct(*[F.col(c).cast("double").alias(c) for c in scorer.features])
    return df.withColumn(name, score(facts, candidates.cast("array<double>")))


def with_best_candidate(df: DataFrame, model: PipelineModel, candidates: Sequence[float], chunk: str, tie: float) -> DataFrame:
    """``df`` with ``_optimal``, the largest candidate whose probability is within ``tie`` of the best, and ``confidence``, the best."""
    scorer = scorer_of(model)
    sent = df.sparkSession.sparkContext.broadcast((scorer, np.array(sorted(candidates), np.float64)))
    at = scorer.features.index(chunk) if chunk in scorer.features else -1

    @F.pandas_udf("optimal double, confidence double")
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, chunks = sent.value
        for facts in batches:
            n, k = len(facts), len(chunks)
            if not n or not k:
                yield pd.DataFrame({"optimal": np.full(n, np.nan), "confidence": np.full(n, np.nan)})
                continue
            p = own.probabilities(facts[own.features].to_numpy(np.float64, na_value=np.nan), at, chunks)
            best = p.max(axis=1)
            last = k - 1 - np.argmax((best[:, None] - p < tie)[:, ::-1], axis=1)
            yield pd.DataFrame({"optimal": chunks[last], "confidence": best})

    facts = F.struct(*[F.col(c).cast("double").alias(c) for c in scorer.features])
    return df.withColumn("_s", score(facts)).withColumns({"_optimal": F.col("_s.optimal"), "confidence": F.col("_s.confidence")}).drop("_s")
