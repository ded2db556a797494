"""Hard negatives by threshold joins over inverted lists with norm bounds.

Dimensions are taken in one order, those of the largest values first. A task indexes its vectors for a threshold: a vector enters the
lists of its leading dimensions only, up to where the norm of what is left, times the norm of what is left of any query, stays below the
threshold. Queries add up partial scores over the lists, dimension by dimension; a pair is dropped once its partial score and the product
of the remaining norms stay below the query's threshold. What is left is scored exactly from the whole vectors.

Positives raise their threshold as better ones turn up. Windows of negatives start just below their upper end and lower their threshold,
round by round, until they are full or the lower end is reached.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from accesslake.session import Scratch

#: Anchors of one pass over the vectors; their vectors are broadcast (8 bytes for each component).
ANCHOR_BLOCK = 8192
#: Anchors and vectors whose partial scores are held at once by a task.
ANCHORS, ROWS = 512, 2048
#: Parts of the dimensions after which pairs are dropped.
SEGMENTS = 4
#: Shares of the way from a window's lower to its upper end at which its threshold stands, round by round.
STEPS = (0.75, 0.5, 0.25, 0.0)
#: Below this share of living pairs, they are scored one by one instead of by products of whole blocks.
SPARSE = 0.05
#: What tells the windows of negatives from each other.
WINDOW = ["anchor_id", "positive_id", "positive_score"]
#: Pairs scored one by one at once.
PAIRS = 1 << 15


def integer_vectors(vectors: DataFrame, id_col: str, vector: str, label: Column, scale: int) -> DataFrame:
    """(vec_id, label, v) with v = floor(scale * x), as double, of the rows that take part."""
    x = F.transform(vector, lambda e: F.floor(F.lit(float(scale)) * e.cast("double")).cast("double"))
    sound = F.col(vector).isNotNull() & F.forall(
        vector, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < F.lit(float("inf"))))
    rows = vectors.filter(sound & (F.size(vector) > 0) & F.col(id_col).isNotNull())
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("string").alias("label"), x.alias("v")).filter(
        "label IS NOT NULL")


def hard_negatives(vectors: DataFrame, anchor: Column, label: Column, n_positives: int = 5, n_negatives: int = 10, low: int = 30,
                   high: int = 90, id_col: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``anchor`` says which rows are anchors, ``label`` gives the class. Scores are inner products of floor(scale * x); higher scores come
    first, ties by the smaller id. The positives of an anchor are its first ``n_positives`` other rows of the same class (all, if fewer); for
    each, the first ``n_negatives`` rows of other classes come out whose score lies between ``low`` and ``high`` per cent of the
    positive's score, both ends included (all, if fewer). A window that ends below where it starts, as under a negative score, is empty.

    Rows with a null id, class or vector, an empty one, or with null or non-finite components take no part. Vectors of another length
    than the anchor's are not compared with it. A row is never compared with rows of its own id; repeated rows are rows each, but a
    repeated anchor is one: the first of its rows by class and components, and repeated positives of one score have one window. Empty
    tables give no rows; other columns are not read, so their names don't matter.

    Each pass scans stored vectors with a broadcast block of anchors and shuffles at most ``n_positives * n_negatives`` rows for each
    anchor and task. Scores are exact as long as they stay below 2^53.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "hardneg")
    kinds = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], kinds).write.parquet(f"{scratch.folder}/found")
    stored = scratch.keep(_packed(integer_vectors(vectors, id_col, vector, label, scale)), "vectors")
    once = Window.partitionBy("vec_id").orderBy("label", "v")
    anchors = integer_vectors(vectors.filter(anchor), id_col, vector, label, scale).withColumn("_n", F.row_number().over(once))
    anchors = scratch.keep(anchors.filter("_n = 1").select("vec_id", "label", "v", F.size("v").alias("dims")), "anchors")
    counts = {r.dims: r["count"] for r in anchors.groupBy("dims").count().collect()}
    for dims, count in sorted(counts.items()):
        rows, mine = stored.filter(F.col("dims") == dims), anchors.filter(F.col("dims") == dims).select("vec_id", "label", "v")
        blocks = 1 if count <= ANCHOR_BLOCK else -(-2 * count // ANCHOR_BLOCK)  # half full, so that uneven hashing stays in bounds
        for b in range(blocks):
            block = mine.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).toPandas()
            if len(block):
                _mine(rows, _Anchors(block), n_positives, n_negatives, low, high, scratch, f"{dims}_{b}")
    return spark.read.schema(kinds).parquet(f"{scratch.folder}/found")


def _packed(rows: DataFrame) -> DataFrame:
    """The vectors as bytes, which workers read without unpacking lists."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"vec_id": batch.vec_id, "label": batch.label, "dims": [len(v) for v in batch.v],
                                "x": [np.asarray(v, np.float64).tobytes() for v in batch.v]})

    return rows.mapInPandas(pack, "vec_id long, label string, dims int, x binary")


def _norms_left(x: np.ndarray, ends: list[int]) -> np.ndarray:
    """For each row, the norm of the components from each of the ends on."""
    return np.stack([np.sqrt(np.einsum("ij,ij->i", x[:, e:], x[:, e:])) for e in ends], axis=1)


class _Anchors:
    """A block of anchors: ids, classes, vectors with the dimensions of most energy first, and the norms of what is left of them."""

    def __init__(self, rows: pd.DataFrame):
        x = np.stack(rows.v.to_numpy()).astype(np.float64)
        self.ids, self.labels = rows.vec_id.to_numpy(np.int64), rows.label.to_numpy(object)
        self.order = np.argsort(-(x * x).sum(axis=0), kind="stable")
        self.x = x[:, self.order]
        size = -(-x.shape[1] // SEGMENTS)
        self.ends = list(range(0, x.shape[1], size)) + [x.shape[1]]
        self.left = _norms_left(self.x, self.ends)


def _matches(block: _Anchors, at: np.ndarray, x: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of all pairs of the anchors ``at`` and the vectors ``x`` with a score of ``limit`` (per anchor) or more."""
    ends, q, q_left = block.ends, block.x[at], block.left[at]
    last, left = len(ends) - 1, _norms_left(x, ends)
    # how many segments of a vector are indexed: what follows them cannot reach the threshold of any anchor on its own
    with np.errstate(divide="ignore"):
        reach = np.where(q_left > 0, limit[:, None] / q_left, np.where(limit[:, None] > 0, np.inf, -np.inf)).min(axis=0)
    depth = (left >= reach[None, :] * (1 - 1e-9)).cumprod(axis=1).sum(axis=1).clip(max=last)
    by_depth = np.argsort(-depth, kind="stable")
    x, left, depth = x[by_depth], left[by_depth], depth[by_depth]
    scores = np.zeros((len(q), len(x)))
    lowest = limit - 1e-9 * np.abs(limit) - 1e-6
    reached = last
    for s in range(last):
        rows = int((depth > s).sum())  # the lists of this segment hold the vectors indexed beyond it
        scores[:, :rows] += q[:, ends[s]:ends[s + 1]] @ x[:rows, ends[s]:ends[s + 1]].T
        if s + 1 < last and rows:
            bound = scores[:, :rows] + q_left[:, [s + 1]] * left[:rows, s + 1]
            if (bound >= lowest[:, None]).mean() <= SPARSE:
                reached = s + 1
                break
    depth = np.minimum(depth, reached)
    found = []
    for d in np.unique(depth):
        part = np.nonzero(depth == d)[0]
        part = slice(part[0], part[-1] + 1)
        a, r = np.nonzero(scores[:, part] + q_left[:, [d]] * left[part, d] >= lowest[:, None])
        if d == last:
            exact = scores[:, part][a, r]
        else:
            exact = np.concatenate([np.einsum("ij,ij->i", q[a[k:k + PAIRS]], x[part][r[k:k + PAIRS]]) for k in range(0, len(a), PAIRS)]
                                   or [np.zeros(0)])
        keep = exact >= limit[a]
        found.append((at[a[keep]], by_depth[part][r[keep]], exact[keep].astype(np.int64)))
    return tuple(np.concatenate(f) for f in zip(*found))


def _cut(groups: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the first k of every group, by falling score and rising id, groups together."""
    order = np.lexsort((ids, -scores, groups))
    g = groups[order]
    start = np.r_[0, np.nonzero(np.diff(g))[0] + 1] if len(g) else np.zeros(0, int)
    rank = np.arange(len(g)) - np.repeat(start, np.diff(np.r_[start, len(g)]))
    return order[rank < k]


class _Best:
    """The first k rows of each of a number of groups so far."""

    def __init__(self, groups: int, k: int):
        self.k, self.floor = k, np.full(groups, -np.inf)
        self.rows = [np.zeros(0, np.int64)] * 3  # group, score, id

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(group):
            return
        merged = [np.concatenate(p) for p in zip(self.rows, (group, score, ids))]
        kept = _cut(merged[0], merged[1], merged[2], self.k)
        self.rows = [m[kept] for m in merged]
        full, last = np.unique(self.rows[0], return_counts=True)
        ends = np.cumsum(last) - 1
        self.floor[full[last == self.k]] = self.rows[1][ends[last == self.k]]


def _blocks(batches: Iterator[pd.DataFrame], order: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for s in range(0, len(batch), ROWS):
            part = batch.iloc[s:s + ROWS]
            x = np.frombuffer(b"".join(part.x), np.float64).reshape(len(part), -1)[:, order]
            yield part.vec_id.to_numpy(np.int64), part.label.to_numpy(object), x


def _first(rows: DataFrame, keys: list[str], k: int, score: str, ids: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), ids))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k)


def _mine(rows: DataFrame, block: _Anchors, n_positives: int, n_negatives: int, low: int, high: int, scratch: Scratch,
          name: str) -> None:
    """Appends the hard negatives of a block of anchors to the table ``found``."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(block)

    def positives(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = sent.value
        best = _Best(len(own.ids), n_positives)
        for ids, labels, x in _blocks(batches, own.order):
            for label in pd.unique(labels):
                mine, theirs = np.nonzero(own.labels == label)[0], np.nonzero(labels == label)[0]
                for s in range(0, len(mine), ANCHORS):
                    at = mine[s:s + ANCHORS]
                    a, r, score = _matches(own, at, x[theirs], best.floor[at])
                    other = ids[theirs[r]] != own.ids[a]
                    best.add(a[other], score[other], ids[theirs[r[other]]])
        group, score, ids = best.rows
        yield pd.DataFrame({"anchor_id": own.ids[group], "positive_id": ids, "positive_score": score})

    found = _first(rows.mapInPandas(positives, "anchor_id long, positive_id long, positive_score long"), ["anchor_id"], n_positives,
                   "positive_score", "positive_id")
    # n_positives rows at most for each anchor of the block
    pairs = scratch.keep(found.filter("positive_score >= 0").drop("rank"), f"positives_{name}").toPandas().drop_duplicates()
    pairs["anchor"] = pd.Series(np.arange(len(block.ids)), index=block.ids).reindex(pairs.anchor_id).to_numpy()
    pairs["top"] = pairs.positive_score * high // 100
    pairs["bottom"] = -(-pairs.positive_score * low // 100)
    pairs = pairs[pairs.bottom <= pairs.top].reset_index(drop=True)
    for step, share in enumerate(STEPS):
        if not len(pairs):
            return
        reached = (pairs.bottom + np.floor((pairs.top - pairs.bottom) * share)).to_numpy(np.int64)
        found = scratch.keep(_round(rows, sent, spark.sparkContext.broadcast((pairs, reached)), n_negatives), f"negatives_{name}_{step}")
        counts = found.groupBy(WINDOW).count().toPandas()  # a row for each window of the block
        full = pairs.merge(counts, "left", WINDOW)["count"].fillna(0).to_numpy() >= n_negatives
        full |= reached <= pairs.bottom.to_numpy()
        if full.any():
            ready = spark.createDataFrame(pairs.loc[full, WINDOW])
            found.join(F.broadcast(ready), WINDOW).select(
                "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").write.mode(
                    "append").parquet(f"{scratch.folder}/found")
        pairs = pairs[~full].reset_index(drop=True)


def _round(rows: DataFrame, sent, windows, k: int) -> DataFrame:
    """The first k rows of every window that score its present threshold or more."""

    def negatives(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = sent.value
        pairs, reached = windows.value
        anchor, top = pairs.anchor.to_numpy(np.int64), pairs.top.to_numpy(np.int64)
        best = _Best(len(pairs), k)
        asked = np.unique(anchor)
        order = np.argsort(anchor, kind="stable")  # windows by anchor
        first, last = np.searchsorted(anchor[order], asked), np.searchsorted(anchor[order], asked, side="right")
        for ids, labels, x in _blocks(batches, own.order):
            # a full window needs nothing below its last row, an anchor nothing below what its windows need
            limit = np.minimum.reduceat(np.maximum(best.floor, reached)[order], first)
            for s in range(0, len(asked), ANCHORS):
                part = slice(s, s + ANCHORS)
                a, r, score = _matches(own, asked[part], x, limit[part])
                other = (labels[r] != own.labels[a]) & (ids[r] != own.ids[a])
                a, r, score = a[other], r[other], score[other]
                slot = np.searchsorted(asked, a)
                for w in range(int((last - first).max())):
                    has = first[slot] + w < last[slot]
                    window = order[np.where(has, first[slot] + w, 0)]
                    fits = has & (score <= top[window]) & (score >= np.maximum(best.floor, reached)[window])
                    best.add(window[fits], score[fits], ids[r[fits]])
        group, score, ids = best.rows
        yield pd.DataFrame({**{c: pairs[c].to_numpy()[group] for c in WINDOW}, "negative_id": ids, "negative_score": score})

    kinds = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    return _first(rows.mapInPandas(negatives, kinds), WINDOW, k, "negative_score", "negative_id")
