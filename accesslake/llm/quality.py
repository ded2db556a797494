"""Quality of documents by hierarchical empirical Bayes.

A logistic classifier turns the look of a text into evidence: the log-odds that it is good, whatever its site. How often documents
are good is estimated for all, for each host and for each path of a host; the rate of a host is shrunk towards the rate of all, that
of a path towards its host's, the more so the fewer documents there are. The strengths of both shrinkages are estimated from the
spread of the rates. A document's posterior joins its own evidence with the rate of its path.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from accesslake.session import Scratch

#: Labelled rows that a fit learns from, on average: the bound of what the driver gets.
SAMPLE = 20_000
RIDGE = 1e-3
#: What is measured of each text, in the order of its numbers.
FEATURES = ("log_words", "distinct_words", "same_as_before", "upper_words", "upper_letters", "signs", "sign_runs", "digits", "bars",
            "stops", "word_length", "line_words", "repeated_lines", "most_frequent_word")

_SIGN = np.zeros(256, bool)
_SIGN[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
_SIGN[[0x27, 0x2C, 0x2D, 0x2E]] = False  # apostrophes, commas, hyphens and stops belong to prose
_UPPER, _LOWER, _DIGIT = (np.isin(np.arange(256), np.arange(a, b)) for a, b in ((0x41, 0x5B), (0x61, 0x7B), (0x30, 0x3A)))


def measure(text: str) -> list[float]:
    """The numbers of FEATURES for one text; all 0 without words."""
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    n = len(words)
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    count = np.bincount(data, minlength=256)
    sign = _SIGN[data]
    lines = [x for x in text.split("\n") if x.strip()]
    distinct = set(words)
    upper, lower = count[_UPPER].sum(), count[_LOWER].sum()
    sample_max = _most(words)
    return [np.log1p(n), len(distinct) / n ** 0.8, sum(a == b for a, b in zip(words, words[1:])) / n,
            sum(w.isupper() and len(w) > 1 for w in words) / n, float(upper / max(1, upper + lower)), float(count[_SIGN].sum() / len(data)),
            float((sign[1:] & sign[:-1]).sum() / len(data)), float(count[_DIGIT].sum() / len(data)), float(count[0x7C] / n),
            float(count[0x2E] / n), np.log1p(len(text) / n), np.log1p(n / max(1, len(lines))),
            1 - len(set(lines)) / max(1, len(lines)), sample_max / n]


def _most(words: list[str]) -> int:
    count: dict[str, int] = {}
    for w in words:
        count[w] = count.get(w, 0) + 1
    return max(count.values())


def measured(docs: DataFrame, id_col: str, text: str, host: Column, path: Column, keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, host, path, x) and the columns ``keep`` of every row: x are the numbers of FEATURES, null texts count as empty."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[["doc_id", "host", "path", *keep]].assign(x=[measure(t) if isinstance(t, str) else [0.0] * len(FEATURES) for t in batch.text])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), host.cast("string").alias("host"), path.cast("string").alias("path"),
                       *keep, F.col(text).alias("text"))
    schema = rows.drop("text").withColumn("x", F.array(F.lit(0.0))).schema
    return rows.mapInPandas(run, schema)


@dataclass
class Classifier:
    """Standardised numbers, weights and intercept; ``base`` are the log-odds of good texts among those it learned from."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    intercept: float
    base: float

    def evidence(self, x: str = "x") -> Column:
        """The log-odds of a row less those of the training texts, within +-30."""
        w = self.weights / self.scale
        total = F.lit(float(self.intercept - (w * self.mean).sum() - self.base))
        for k, v in enumerate(w):
            total = total + F.col(x)[k] * float(v)
        return F.greatest(F.lit(-30.0), F.least(F.lit(30.0), total))


def fit(features: DataFrame, labels: DataFrame, id_col: str = "doc_id", label: str = "quality", sample: int = SAMPLE) -> Classifier:
    """Logistic regression on about ``sample`` labelled rows, drawn by a hash of their ids. Without both classes it knows nothing."""
    known = labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(
        F.min(label).cast("double").alias("y"))
    total = max(1, known.count())
    draw = F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.lit(5)), 11) / F.lit(float(1 << 53))
    rows = features.filter(draw * total < sample).join(known, "doc_id").select("doc_id", "x", "y").toPandas().sort_values("doc_id")
    n = len(FEATURES)
    y = rows.y.to_numpy(float) if len(rows) else np.zeros(0)
    if not 0 < y.sum() < len(y):
        return Classifier(np.zeros(n), np.ones(n), np.zeros(n), 0.0, 0.0)
    x = np.stack(rows.x.to_numpy())
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(n + 1)
    penalty = RIDGE * np.r_[np.ones(n), 0]
    for _ in range(60):  # Newton's method
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (p - y) / len(y) + penalty * w
        curve = (z * (p * (1 - p))[:, None]).T @ z / len(y) + np.diag(penalty + 1e-9)
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    share = y.mean()
    return Classifier(mean, scale, w[:n], float(w[n]), float(np.log(share / (1 - share))))


def _logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(p / (1 - p))


def _sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def _strength(groups: DataFrame, rate: str, parent: str) -> float:
    """How many documents a parent's rate is worth, from the spread of (rate, n, parent) around it: one aggregate.

    With weights n, the expected square of rate - parent is v / n + v / (strength + 1), where v = parent (1 - parent).
    """
    v = F.col(parent) * (1 - F.col(parent))
    got = groups.filter("n > 1").agg(
        F.sum(F.col("n") * F.pow(F.col(rate) - F.col(parent), 2) - v).alias("between"), F.sum(F.col("n") * v).alias("v")).first()
    if not got or not got.v:
        return 10.0
    return float(np.clip(got.v / max(got.between, 1e-9) - 1, 1.0, 1e4))


def site_rates(scored: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Shrunken rates: (host, host_rate) and (host, path, path_rate). Null hosts and paths are sites of their own.

    ``scored`` has (host, path, p). Sums are aggregated before any shuffle, so a host with a third of all rows costs one row a task.
    """
    paths = scratch.keep(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s")), "paths")
    whole = paths.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    base = float((whole.s or 0.0) / whole.n) if whole.n else 0.5
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).withColumn("parent", F.lit(base))
    hosts = hosts.withColumn("rate", F.col("s") / F.col("n"))
    k = _strength(hosts, "rate", "parent")
    hosts = scratch.keep(hosts.select("host", ((F.col("s") + k * F.lit(base)) / (F.col("n") + k)).alias("host_rate")), "hosts")
    below = paths.alias("p").join(hosts.alias("h"), F.col("p.host").eqNullSafe(F.col("h.host"))).select(
        "p.host", "p.path", "n", "s", "host_rate", (F.col("s") / F.col("n")).alias("rate"))
    k = _strength(below, "rate", "host_rate")
    return hosts, scratch.keep(below.select(
        "host", "path", "host_rate", ((F.col("s") + k * F.col("host_rate")) / (F.col("n") + k)).alias("path_rate")), "path_rates")


def score_quality(docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id", text: str = "text",
                  label: str = "quality", threshold: float = 0.25, keep: Sequence[str] = ()) -> DataFrame:
    """``doc_id, evidence, host_rate, path_rate, quality, kept`` of every row of ``docs``, after its columns ``keep``.

    ``evidence`` are the classifier's log-odds of a good text, ``quality`` the posterior with the rate of the row's path, ``kept``
    whether it is at least ``threshold``. Null and empty texts are measured as all zeros and judged like others; null hosts and paths
    are sites of their own; a null id is kept in the result. Repeated rows each come out. Without labels of both kinds the evidence
    is 0 and every rate one half. Empty tables give no rows.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    features = scratch.keep(measured(docs, id_col, text, host, path, keep), "features")
    model = fit(features, labels, id_col, label)
    evidence = model.evidence()
    scored = scratch.keep(features.select(*keep, "doc_id", "host", "path", evidence.alias("evidence"),
                                          _sigmoid(evidence + model.base).alias("p")), "scored")
    _, rates = site_rates(scored, scratch)
    same = F.col("d.host").eqNullSafe(F.col("r.host")) & F.col("d.path").eqNullSafe(F.col("r.path"))
    posterior = _sigmoid(F.col("evidence") + _logit(F.col("path_rate")))
    return scored.alias("d").join(rates.alias("r"), same).select(
        *keep, "doc_id", "evidence", "host_rate", "path_rate", posterior.alias("quality"), (posterior >= threshold).alias("kept"))
