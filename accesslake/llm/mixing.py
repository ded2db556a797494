"""Mixing documents to target weights of domains that are known for a labelled table only.

A sparse logistic classifier, learned from labelled rows, gives every document a posterior over the domains. Each document gets a
rate, the number of times that it is used on average; rates are found by projected gradient descent on the weighted squares of
(expected tokens of a domain - its target). The gradient of a document needs one number for each domain, and its scaling a matrix of
domains by domains, so an iteration is one aggregate over the stored posteriors, and rates are expressions of a document's own posterior.
All steps are DataFrame operations.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from accesslake.session import Scratch

#: Labelled rows learned from, on average, and words whose weights are kept (and broadcast).
SAMPLE, WORDS = 12_000, 1_000
#: Weight of the absolute penalty that keeps the classifier sparse, and its steps.
SPARSE, STEPS = 3e-4, 300
#: Least likelihood-ratio statistic of a word against the domains: far above what chance gives any of very many words.
EVIDENCE = 30.0
#: Steps at most, the share of a target by which it may be missed, and the share of the loss that a step has to gain.
ITERATIONS, REACHED, TOLERANCE = 40, 1e-4, 1e-5
#: How long the steps are that are tried.
LENGTHS = (1 / 64, 1 / 16, 1 / 4, 1 / 2, 1, 4, 16, 64, 256)
_SIGNS, _CAPITALS = "!#$%&*+<=>@^_|~", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _share_level(part: Column, whole: Column, name: str) -> Column:
    """A made-up word that says which of a few levels a share is on."""
    share = part / F.greatest(F.lit(1), whole)
    return F.concat(F.lit(f"#{name}"), F.floor(F.least(F.lit(9.0), F.sqrt(share) * 10)).cast("string"))


def _tokens(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with n_tokens and the array ``seen`` of distinct words and marks, in place of the text."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.withColumn("_words", F.split(F.trim(F.lower(body)), "[\\s,.;:?!()]+"))
    rows = rows.withColumn("_distinct", F.array_distinct("_words"))
    size, n = F.length(body), F.size("_words")
    looks = F.array(
        _share_level(size - F.length(F.translate(body, _SIGNS, "")), size, "signs"),
        _share_level(size - F.length(F.translate(body, _CAPITALS, "")), size, "capitals"),
        _share_level(n - F.size("_distinct"), n, "repeats"))
    return rows.withColumn("n_tokens", F.when(F.trim(body) == "", 0).otherwise(n).cast("long")).withColumn(
        "seen", F.concat(looks, F.col("_distinct"))).drop("_words", "_distinct", text)


def _softmax_fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights (columns of x by classes) and intercepts of a logistic regression with an absolute penalty on the weights."""
    n, size = x.shape[0], y.shape[1]
    w, b = np.zeros((x.shape[1], size)), np.log((y.sum(axis=0) + 1) / (n + size))
    ahead, ahead_b, t = w, b, 1.0
    rate = 2.0 / max(1.0, np.linalg.norm(x, 2) ** 2 / n + 1)  # the curvature of softmax is one half at most
    for _ in range(STEPS):
        z = x @ ahead + ahead_b
        q = np.exp(z - z.max(axis=1, keepdims=True))
        q = (q / q.sum(axis=1, keepdims=True) - y) / n
        moved, moved_b = ahead - rate * (x.T @ q), ahead_b - rate * q.sum(axis=0)
        moved = np.sign(moved) * np.maximum(np.abs(moved) - rate * SPARSE, 0)
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, ahead_b = moved + (t - 1) / t_next * (moved - w), moved_b + (t - 1) / t_next * (moved_b - b)
        w, b, t = moved, moved_b, t_next
    return w, b


def learn(docs: DataFrame, labelled: DataFrame, domains: list[str], id_col: str, text: str, scratch: Scratch) -> tuple[DataFrame, list[float]]:
    """(word, w) with one weight for each domain, and one intercept for each domain.

    Learned from about SAMPLE labelled rows, drawn by a hash of their ids, each text once, and the WORDS words at most that are
    spread over the domains least evenly: the driver gets their occurrences in those rows and no more.
    """
    spark = docs.sparkSession
    known = labelled.filter(F.col("domain").isin(domains) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    total = max(1, known.count())
    draw = F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.lit(9)), 11) / F.lit(float(1 << 53))
    drawn = scratch.keep(known.filter(draw * total < SAMPLE), "drawn")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(drawn), "doc_id")
    rows = rows.withColumn("digest", F.xxhash64("text"))
    once = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    seen = scratch.keep(_tokens(rows, "text").join(F.broadcast(once), ["digest", "doc_id"]).select("doc_id", "domain", "seen"), "seen")
    sizes = {r.domain: r["count"] for r in seen.groupBy("domain").count().collect()}
    whole = max(1, sum(sizes.values()))
    words = seen.select("doc_id", "domain", F.explode("seen").alias("word"))
    counts = words.groupBy("word").agg(*[F.count_if(F.col("domain") == d).alias(f"n{k}") for k, d in enumerate(domains)])
    n = [F.col(f"n{k}") for k in range(len(domains))]
    both = reduce(lambda a, b: a + b, n)
    # how far the documents with a word are from being spread over the domains as all are
    worth = reduce(lambda a, b: a + b, [
        F.when(c > 0, 2 * c * F.log(c * whole / (both * max(1, sizes.get(d, 0))))).otherwise(0.0) for c, d in zip(n, domains)])
    best = counts.withColumn("worth", worth).filter(F.col("worth") >= EVIDENCE).orderBy(F.desc("worth"), "word").limit(WORDS).select("word")
    chosen = [r.word for r in scratch.keep(best, "words").collect()]
    at = {w: k for k, w in enumerate(sorted(chosen))}
    found = words.join(F.broadcast(scratch.spark.createDataFrame([(w, k) for w, k in at.items()], "word string, k int")), "word", "left")
    found = found.groupBy("doc_id", "domain").agg(F.collect_list("k").alias("k")).collect()
    x, y = np.zeros((len(found), len(at))), np.zeros((len(found), len(domains)))
    for i, r in enumerate(found):
        x[i, r.k] = 1
        y[i, domains.index(r.domain)] = 1
    w, b = _softmax_fit(x, y) if len(found) and at else (np.zeros((len(at), len(domains))), np.log((y.sum(axis=0) + 1) / (len(y) + len(domains))))
    table = [(word, w[k].tolist()) for word, k in at.items() if w[k].any()]
    return scratch.keep(spark.createDataFrame(table, "word string, w array<double>"), "weights"), b.tolist()


def posteriors(docs: DataFrame, weights: DataFrame, priors: list[float], id_col: str, text: str, keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., row, doc_id, n_tokens, p): p is the posterior over the domains of every row of ``docs``."""
    size = len(priors)
    own = [*keep, "row", "doc_id", "n_tokens"]
    rows = _tokens(docs.select(*keep, F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"),
                               F.col(text).alias("text")), "text")
    # the empty mark keeps rows without any known word
    words = rows.select(*own, F.explode(F.concat(F.array(F.lit("#")), "seen")).alias("word"))
    always = weights.sparkSession.range(1).select(F.lit("#").alias("word"), F.array(*[F.lit(x) for x in priors]).alias("w"))
    table = weights.union(always)
    hits = words.join(F.broadcast(table), "word")
    sums = hits.groupBy(*own).agg(*[F.sum(F.col("w")[k]).alias(f"s{k}") for k in range(size)])
    logs = [F.col(f"s{k}") for k in range(size)]
    top = F.greatest(*logs) if size > 1 else logs[0]
    parts = [F.exp(x - top) for x in logs]
    whole = reduce(lambda a, b: a + b, parts)
    return sums.select(*own, F.array(*[x / whole for x in parts]).alias("p"))


def _descend(rows: DataFrame, p: list[Column], wanted: list[float], mass_of: list[float], max_rate: float | None,
             scratch: Scratch) -> tuple[DataFrame, Column]:
    """The rows and the rate of each, by projected gradient descent from rates of 1.

    Squares are weighed by 1 / a domain's tokens, and rates by a document's. A step moves each rate by its posteriors times one vector over
    the domains and cuts it off at its bounds. The vectors tried are the slope, shorter to much longer, and the slope scaled by the curvature
    of the rates that are free, a matrix of domains by domains, which meets the targets at once where no bound is; one aggregate gives the
    losses of all, and the lowest is taken. The slope alone always lowers the loss, for the curvature is 1 at most. It ends when the targets
    are met or no move lowers the loss by more than TOLERANCE of it; if neither comes in ITERATIONS steps, a warning says so.
    """
    size, n = len(p), F.col("n_tokens")
    top = None if max_rate is None else float(max_rate)

    def moved(rate: Column, by: np.ndarray) -> Column:
        to = rate - reduce(lambda a, b: a + b, [x * float(v) for x, v in zip(p, by)])
        return F.greatest(F.lit(0.0), to if top is None else F.least(F.lit(top), to))

    def tokens(rates: list[Column]) -> list[np.ndarray]:
        got = rows.agg(*[F.sum(r * n * x).alias(f"a{i}_{k}") for i, r in enumerate(rates) for k, x in enumerate(p)]).first()
        return [np.array([float(got[f"a{i}_{k}"] or 0.0) for k in range(size)]) for i in range(len(rates))]

    rate = F.lit(1.0) if top is None or top >= 1 else F.lit(top)
    gap = tokens([rate])[0] - wanted
    for step in range(ITERATIONS):
        if all(abs(g) <= REACHED * max(w, REACHED * sum(wanted)) for g, w in zip(gap, wanted)):
            return rows, rate
        rows = scratch.keep(rows.withColumn("rate", rate), f"rates{step}")
        rate = F.col("rate")
        free = (rate > 0) if top is None else (rate > 0) & (rate < top)
        found = rows.agg(*[F.sum(F.when(free, n * p[k] * p[j])).alias(f"h{k}_{j}") for k in range(size) for j in range(k + 1)]).first()
        curve = np.array([[float(found[f"h{max(k, j)}_{min(k, j)}"] or 0.0) for j in range(size)] for k in range(size)])
        slope, scaled = gap / mass_of, np.linalg.lstsq(curve, gap, rcond=1e-10)[0]
        moves = [slope * x for x in LENGTHS if x >= 1] + [scaled * x for x in LENGTHS if x <= 1]
        gaps = [a - wanted for a in tokens([moved(rate, m) for m in moves])]
        losses = [float(g @ (g / mass_of)) for g in gaps]
        best, loss = int(np.argmin(losses)), float(gap @ slope)
        if loss - losses[best] <= TOLERANCE * loss:
            return rows, rate
        rate, gap = moved(rate, moves[best]), gaps[best]
    warnings.warn(f"domain tokens have not settled in {ITERATIONS} steps: {(gap + wanted).tolist()} for {wanted}", stacklevel=3)
    return rows, rate


def mixing_rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text: str = "text",
                 max_rate: float | None = None, budget: float | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """``doc_id, n_tokens, domain, p, rate, copies`` of every row of ``docs``, after its columns ``keep``.

    ``labelled`` has (doc_id, domain). ``targets`` gives each domain's weight; targets are weights times ``budget`` tokens (default: the
    tokens that there are), and with ``max_rate`` no more than a domain's tokens at that rate: what no rates can reach would lift
    the rates of all that has a trace of the domain. ``p`` are the posteriors in the order of the targets' names, ``domain`` the likeliest (ties: first name).
    ``rate`` is nonnegative, ``max_rate`` at most; expected domain tokens, the sums of rate * n_tokens * p, meet the targets as
    closely as rates can. ``copies`` is the rate rounded up or down by a hash of the id, so that it is the rate on average.
    Null and empty texts have 0 tokens and the posterior of the prior and their looks. Repeated rows each get their rate. Null ids
    get one as well. Unlabelled domains and an empty ``labelled`` leave the priors. Empty tables give no rows; other columns are not read.
    """
    domains = sorted(targets)
    scratch = Scratch(docs.sparkSession, "mixing")
    weights, priors = learn(docs, labelled, domains, id_col, text, scratch)
    rows = scratch.keep(posteriors(docs, weights, priors, id_col, text, keep), "posteriors")
    size, p = len(domains), [F.col("p")[k] for k in range(len(domains))]
    mass = rows.agg(F.sum("n_tokens").alias("n"), *[F.sum(F.col("n_tokens") * x).alias(f"m{k}") for k, x in enumerate(p)]).first()
    mass_of = [max(float(mass[f"m{k}"] or 0.0), 1e-9) for k in range(size)]
    whole = sum(targets.values()) or 1.0
    wanted = [targets[d] / whole * float(budget if budget is not None else mass.n or 0) for d in domains]
    if max_rate is not None:
        wanted = [min(w, max_rate * m) for w, m in zip(wanted, mass_of)]

    rows, rate = _descend(rows, p, wanted, mass_of, max_rate, scratch)
    likeliest = F.element_at(F.array(*[F.lit(d) for d in domains]), F.array_position("p", F.array_max("p")).cast("int"))
    draw = F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.lit(21)), 11) / F.lit(float(1 << 53))
    out = rows.withColumn("rate", rate)
    return out.select(*keep, "doc_id", "n_tokens", likeliest.alias("domain"), "p", "rate",
                      (F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("int")).cast("int").alias("copies"))
