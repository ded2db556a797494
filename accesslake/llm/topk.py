"""Exact top-k by inner product with a vector-approximation file.

Every vector is stored twice: as one small cell for each dimension, and exactly. A scan of the cells bounds each score from both sides; the
k-th best lower bound, over all vectors, shuts out what cannot be a result. Of what is left, the exact vectors are read best upper bound
first: those of the first few, then only those whose upper bound still reaches the k-th score found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from accesslake.session import Scratch

#: Queries that are searched for in one pass over the vectors; their vectors are broadcast, so this bounds what is sent.
QUERY_BLOCK = 8192
#: Queries and vectors whose bounds are held at once by a task.
SCAN_QUERIES, SCAN_ROWS = 512, 2048
#: Parts of each dimension's range, so that a cell fits in a byte.
CELLS = 256
#: Exact vectors read first, for each result wanted.
FIRST = 2


def scaled(vectors: DataFrame, id_col: str, vector: str, scale: int = 64) -> DataFrame:
    """(vec_id, v) with v = floor(scale * x), as long; vectors that are null or hold null or non-finite components are left out."""
    x = F.transform(vector, lambda e: F.floor(F.lit(float(scale)) * e.cast("double")))
    sound = F.col(vector).isNotNull() & F.forall(
        vector, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < F.lit(float("inf"))))
    return vectors.filter(sound & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), x.alias("v"))


def approximated(exact: DataFrame, dims: int, scratch: Scratch) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """The vectors, numbered, with their cells and exactly, and each dimension's lowest value and cell width."""
    at = [F.get("v", F.lit(d)) for d in range(dims)]
    ends = exact.agg(F.array(*[F.min(c) for c in at]).alias("lo"), F.array(*[F.max(c) for c in at]).alias("hi")).first()
    lo, hi = (np.array([x or 0 for x in e], dtype=np.int64) for e in (ends.lo, ends.hi))  # null without vectors
    width = np.maximum(1, -(-(hi - lo + 1) // CELLS))

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                v = np.stack(batch.v.to_numpy()).astype(np.int64)
                yield pd.DataFrame({"vec_id": batch.vec_id, "cells": [c.tobytes() for c in ((v - lo) // width).astype(np.uint8)],
                                    "v": [x.tobytes() for x in v]})

    packed = exact.mapInPandas(cells, "vec_id long, cells binary, v binary")
    return scratch.keep(packed.select(F.monotonically_increasing_id().alias("row"), "*"), f"cells_{dims}"), lo, width


class _Queries:
    """A block of queries, and what turns products with cells into bounds.

    With low = lo + cells * width, a score lies between q.low + min(q, 0).(width - 1) and q.low + max(q, 0).(width - 1): one product with the
    cells, and two constants for each query.
    """

    def __init__(self, rows: pd.DataFrame, lo: np.ndarray, width: np.ndarray):
        self.ids = rows.vec_id.to_numpy(np.int64)
        self.q = np.stack(rows.v.to_numpy()).astype(np.int64)
        steps = self.q * width
        # sums of whole numbers below 2^24 are exact in single precision
        self.kind = np.float32 if (np.abs(steps) * (CELLS - 1)).sum(axis=1).max() < 1 << 24 else np.float64
        self.steps = steps.astype(self.kind)
        base = self.q.astype(np.float64) @ lo
        self.lower = base + (np.minimum(self.q, 0) * (width - 1)).sum(axis=1)
        self.upper = base + (np.maximum(self.q, 0) * (width - 1)).sum(axis=1)

    def products(self, batches: Iterator[pd.DataFrame]) -> Iterator[tuple[slice, pd.DataFrame, np.ndarray]]:
        """(queries, vectors, products): blocks of all pairs, a query's own id at minus infinity."""
        for batch in batches:
            for s in range(0, len(batch), SCAN_ROWS):
                part = batch.iloc[s:s + SCAN_ROWS]
                ids = part.vec_id.to_numpy(np.int64)
                cells = np.frombuffer(b"".join(part.cells), np.uint8).reshape(len(part), -1).astype(self.kind)
                for t in range(0, len(self.ids), SCAN_QUERIES):
                    some = slice(t, t + SCAN_QUERIES)
                    found = self.steps[some] @ cells.T
                    found[self.ids[some, None] == ids[None, :]] = -np.inf
                    yield some, part, found


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector: str = "embedding",
          scale: int = 64) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best candidates of every query by integer inner product, ties to the smaller id.

    ``queries`` and ``vectors`` have the same columns; a query is not its own candidate. Repeated rows of one id are candidates
    each, but not for themselves; as queries they are one, with the best of what their rows find. Vectors are scaled by ``scaled``;
    those that are null, empty or hold null or non-finite components take no part, nor do rows with a null id. Vectors of each length are
    searched by themselves. Queries with fewer candidates get all of them; empty tables give no rows. Other columns are not read.

    Queries go out in blocks of QUERY_BLOCK against all vectors. A block scans the stored cells twice and shuffles k rows for each query and
    task; exact vectors are joined to the pairs that the bounds leave. Scores and bounds are exact below 2^53.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    exact = scaled(vectors, id_col, vector, scale)
    asked = scratch.keep(scaled(queries, id_col, vector, scale).filter(F.size("v") > 0), "queries")
    counts = {r.dims: r["count"] for r in asked.groupBy(F.size("v").alias("dims")).count().collect()}
    spark.createDataFrame([], "query_id long, vec_id long, score long").write.parquet(f"{scratch.folder}/found")
    for dims, count in sorted(counts.items()):
        stored, lo, width = approximated(exact.filter(F.size("v") == dims), dims, scratch)
        blocks = 1 if count <= QUERY_BLOCK else -(-2 * count // QUERY_BLOCK)  # half full, so that uneven hashing stays in bounds
        part = asked.filter(F.size("v") == dims).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
        for b in range(blocks):
            rows = part.filter(F.col("block") == b).select("vec_id", "v").toPandas()
            if len(rows):
                near = _search(stored, _Queries(rows, lo, width), k, scratch, f"{dims}_{b}")
                near.write.mode("append").parquet(f"{scratch.folder}/found")
    found = spark.read.schema("query_id long, vec_id long, score long").parquet(f"{scratch.folder}/found")
    return _best(found, k)  # an id may have rows of several lengths


def _best(near: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(stored: DataFrame, block: _Queries, k: int, scratch: Scratch, name: str) -> DataFrame:
    """(query_id, vec_id, score): the k best of every query of the block, and maybe others."""
    context = stored.sparkSession.sparkContext
    sent = context.broadcast(block)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The k best products of every query in this part."""
        own = sent.value
        best = np.full((len(own.ids), k), -np.inf, own.kind)
        for some, part, found in own.products(batches):
            hit = np.nonzero((found > best[some].min(axis=1)[:, None]).any(axis=1))[0]
            if len(hit):
                both = np.concatenate([best[some][hit], found[hit]], axis=1)
                best[some.start + hit] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
        at, _ = np.nonzero(np.isfinite(best))
        yield pd.DataFrame({"query": at, "product": best[np.isfinite(best)].astype(np.float64)})

    products = stored.select("vec_id", "cells").mapInPandas(scan, "query long, product double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("product")))
    kth = products.withColumn("r", rank).filter(F.col("r") == k).select("query", "product").toPandas()  # a number for each query
    cut = np.full(len(block.ids), -np.inf)
    cut[kth["query"]] = kth["product"]
    least = context.broadcast(cut + block.lower - block.upper)  # products whose upper bound reaches the k-th lower bound

    def survive(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, limit = sent.value, least.value
        for some, part, found in own.products(batches):
            # a hair more covers rounding where numbers are too large to be exact
            q, r = np.nonzero((found >= (limit[some] - np.abs(limit[some]) * 1e-12)[:, None]) & (found > -np.inf))
            if len(q):
                yield pd.DataFrame({"query": some.start + q, "row": part["row"].to_numpy()[r], "vec_id": part.vec_id.to_numpy()[r],
                                    "upper": found[q, r] + own.upper[some.start + q]})

    left = stored.select("row", "vec_id", "cells").mapInPandas(survive, "query long, row long, vec_id long, upper double")
    left = scratch.keep(left.withColumn("first", F.row_number().over(
        Window.partitionBy("query").orderBy(F.desc("upper"), "vec_id", "row")) <= FIRST * k), f"left_{name}")

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = sent.value
        for batch in batches:
            if len(batch):
                v = np.frombuffer(b"".join(batch.v), np.int64).reshape(len(batch), -1)
                q = batch["query"].to_numpy()
                yield pd.DataFrame({"query": q, "query_id": own.ids[q], "vec_id": batch.vec_id, "score": np.einsum("ij,ij->i", own.q[q], v)})

    def read(pairs: DataFrame) -> DataFrame:
        whole = pairs.select("query", "row").join(stored.select("row", "vec_id", "v"), "row")
        return whole.select("query", "vec_id", "v").mapInPandas(score, "query long, query_id long, vec_id long, score long")

    first = scratch.keep(read(left.filter("first")), f"first_{name}")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    certain = first.withColumn("r", rank).filter(F.col("r") == k).select("query", F.col("score").alias("_s"), F.col("vec_id").alias("_v"))
    open_ = left.filter("NOT first").join(F.broadcast(certain), "query", "left").filter(  # a row for each query of the block
        "_s IS NULL OR upper > _s OR (upper = _s AND vec_id < _v)")
    return first.union(read(open_)).select("query_id", "vec_id", "score")
