"""Self-organising map: batch fit, nearest unit, unit maps.

A map has at most 30 x 30 units, so the codebook fits in one small array. Rows are matched against it
by numpy inside the tasks: no row is multiplied by the units.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .common import spread
from .scalers import VectorScalerModel, fit_vector_scaler
from ..functions.sizing import round_chunk

SMALLEST_SIDE, LARGEST_SIDE = 10, 30


def map_side(n: int) -> int:
    """Side of the square map for ``n`` rows."""
    return min(max(math.ceil(5 * math.sqrt(n)), SMALLEST_SIDE), LARGEST_SIDE)


def codebook_array(codebook: DataFrame) -> tuple[list, np.ndarray]:
    """Units (i, j) and their weights, in unit order; ``fit_som`` bounds how many there are."""
    rows = codebook.select("i", "j", "weights").orderBy("i", "j").collect()
    return [(r["i"], r["j"]) for r in rows], np.array([r["weights"] for r in rows], dtype="float64")


def _nearest():
    """A function of rows and units giving each row's nearest unit, the first among equals, and its Euclidean distance.

    It is made here, not imported, so that it travels to the tasks by value. One matrix product bounds all distances; those within its
    rounding of the least are then computed exactly. Rows are taken in blocks, so that memory does not grow with a batch.
    """
    def nearest(x, weights, block=1024):
        best, far = np.zeros(len(x), dtype="int64"), np.zeros(len(x))
        sizes = (weights ** 2).sum(axis=1)
        for at in range(0, len(x), block):
            part = x[at:at + block]
            own = (part ** 2).sum(axis=1)
            rough = own[:, None] + sizes - 2.0 * (part @ weights.T)
            slack = 1e-12 * (own + sizes.max())
            # where a bound is not a number every unit is looked at
            row, unit = np.nonzero(~(rough > (rough.min(axis=1) + slack)[:, None]))
            exact = np.empty(len(row))
            for k in range(0, len(row), 16 * block):
                pair = slice(k, k + 16 * block)
                exact[pair] = np.sqrt(((part[row[pair]] - weights[unit[pair]]) ** 2).sum(axis=1))
            # as argmin does: what is not a number comes first, then the least, then the first unit
            order = np.lexsort((unit, exact, ~np.isnan(exact), row))
            first = order[np.unique(row[order], return_index=True)[1]]
            best[at:at + block], far[at:at + block] = unit[first], exact[first]
        return best, far

    return nearest


def nearest_unit(df: DataFrame, codebook: DataFrame, vector: str = "vector") -> DataFrame:
    """Adds ``unit`` (i, j) and ``distance`` of the nearest unit, the first in order among equals."""
    units, weights = codebook_array(codebook)
    shared = df.sparkSession.sparkContext.broadcast((units, weights))
    nearest = _nearest()

    @F.pandas_udf("i int, j int, distance double")
    def match(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known, w = shared.value
        grid = np.array(known)
        for vectors in batches:
            best, far = nearest(np.stack(vectors.to_numpy()).astype("float64") if len(vectors) else w[:0], w)
            yield pd.DataFrame({"i": grid[best, 0], "j": grid[best, 1], "distance": far})

    return (df.withColumn("_m", match(F.col(vector)))
            .withColumn("unit", F.struct("_m.i", "_m.j")).withColumn("distance", F.col("_m.distance")).drop("_m"))


def hit_map(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("unit.i", "unit.j").agg(F.count(F.lit(1)).alias("hits"))


def quantization_error(assigned: DataFrame) -> DataFrame:
    return assigned.agg(F.avg("distance").alias("quantization_error"))


def unit_chunk_map(assigned: DataFrame, grid: DataFrame, chunk: str = "chunk_size_kb") -> DataFrame:
    """(i, j, chunk): mean chunk size per unit; an empty unit takes that of the nearest filled one.

    Nearest means by grid distance, then by (i, j). The window runs over the grid, at most 900 rows.
    """
    means = assigned.groupBy("unit.i", "unit.j").agg(F.avg(chunk).alias("_mean"))
    everywhere = Window.partitionBy(F.lit(0))
    filled = F.collect_list(F.when(F.col("_mean").isNotNull(), F.struct("i", "j", "_mean"))).over(everywhere)
    spread = grid.select("i", "j").join(means, ["i", "j"], "left").withColumn("_filled", filled)
    nearest = F.array_min(F.transform("_filled", lambda u: F.struct(
        (F.pow(u["i"] - F.col("i"), 2.0) + F.pow(u["j"] - F.col("j"), 2.0)).alias("d2"),
        u["i"].alias("i"), u["j"].alias("j"), u["_mean"].alias("chunk"))))
    return spread.select("i", "j", F.coalesce(F.col("_mean"), nearest["chunk"]).alias("chunk"))


def u_matrix(codebook: DataFrame) -> DataFrame:
    """Per unit the distances to its up to eight grid neighbours: sum, mean, and sum over the largest sum."""
    steps = F.array(*[F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj"))
                      for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)])
    looking = (codebook.select("i", "j", "weights", F.explode(steps).alias("s"))
               .select("i", "j", "weights", (F.col("i") + F.col("s.di")).alias("ni"), (F.col("j") + F.col("s.dj")).alias("nj")))
    other = codebook.select(F.col("i").alias("ni"), F.col("j").alias("nj"), F.col("weights").alias("nw"))
    squares = F.zip_with("weights", "nw", lambda a, b: F.pow(a.cast("double") - b.cast("double"), 2.0))
    d = F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, v: s + v))
    sums = (looking.join(other, ["ni", "nj"]).withColumn("d", d)
            .groupBy("i", "j").agg(F.sum("d").alias("sum_distance"), F.avg("d").alias("mean_distance")))
    largest = F.max("sum_distance").over(Window.partitionBy(F.lit(0)))
    return sums.withColumn("scaled", F.try_divide("sum_distance", largest))


def initial_codebook(df: DataFrame, side: int, vector: str = "vector", order: str = "_h") -> np.ndarray:
    """Weights picked from the rows by hash order: repeatable and independent of partitioning."""
    picked = (df.select(vector, F.md5(F.to_json(F.struct(vector))).alias(order))
              .orderBy(order).limit(side * side).collect())
    rows = np.array([r[vector] for r in picked], dtype="float64")
    return rows[np.arange(side * side) % len(rows)]


@dataclass
class FittedMap:
    """A map with what it needs to score other rows: the scaler of its input, and the error that each epoch started from, then the last."""

    codebook: DataFrame
    scaler: VectorScalerModel
    errors: list[float]
    chunk_map: DataFrame | None = None

    def assign(self, df: DataFrame, vector: str = "vector") -> DataFrame:
        """Adds each row's nearest unit and its distance, both in scaled space."""
        return nearest_unit(self._scaled(df, vector), self.codebook, vector)

    def predict(self, df: DataFrame, vector: str = "vector") -> DataFrame:
        """``predict_som`` on rows as they are."""
        if self.chunk_map is None:
            raise ValueError("the map has no chunk sizes")
        return predict_som(self._scaled(df, vector), self.codebook, self.chunk_map, vector)

    def _scaled(self, df: DataFrame, vector: str) -> DataFrame:
        return self.scaler.copy({self.scaler.inputCol: vector}).transform(df)


def fit_map(df: DataFrame, vector: str = "vector", epochs: int = 10, side: int | None = None, sigma: float = 1.0) -> FittedMap:
    """A map over rows whose positions are scaled to [0, 1] first, so that none outweighs the others.

    Its errors tell the descent: the units start as sampled rows, which the first epochs draw together; from there on the error falls.
    """
    scaler = fit_vector_scaler(df, vector)
    codebook, errors = _fit(scaler.transform(df.select(vector)), vector, epochs, side, sigma)
    return FittedMap(codebook, scaler, errors)


def fit_som(df: DataFrame, vector: str = "vector", epochs: int = 10, side: int | None = None,
            sigma: float = 1.0) -> DataFrame:
    """Codebook (i, j, weights) over the rows as they are; ``fit_map`` scales them, and measures the descent."""
    return _fit(df, vector, epochs, side, sigma)[0]


def _fit(df: DataFrame, vector: str, epochs: int, side: int | None, sigma: float) -> tuple[DataFrame, list[float]]:
    """Codebook (i, j, weights) fitted in batch epochs with a Gaussian neighbourhood, and the mean distance to the nearest unit.

    Each epoch sums rows, counts and distances per nearest unit inside the tasks, so a task returns at most one row
    per unit and the driver sees at most 900 sums.
    """
    spark = df.sparkSession
    data = spread(df.select(F.col(vector).cast("array<double>").alias(vector))).persist()
    errors = []
    try:
        side = min(side, LARGEST_SIDE) if side else map_side(data.count())
        grid = np.array([(i, j) for i in range(side) for j in range(side)])
        weights = initial_codebook(data, side, vector)
        gap2 = ((grid[:, None, :] - grid[None, :, :]) ** 2).sum(axis=2)
        for epoch in range(epochs):
            sums, hits, error = _unit_sums(data, vector, weights)
            errors.append(error)
            radius = sigma * (1 - epoch / epochs) + 0.1
            pull = np.exp(-gap2 / (2 * radius * radius))
            mass = pull @ hits
            weights = np.where(mass[:, None] > 1e-12, (pull @ sums) / np.maximum(mass, 1e-12)[:, None], weights)
        errors.append(_unit_sums(data, vector, weights)[2])
    finally:
        data.unpersist()
    return spark.createDataFrame(
        [(int(i), int(j), w.tolist()) for (i, j), w in zip(grid, weights)], "i int, j int, weights array<double>"), errors


def _unit_sums(data: DataFrame, vector: str, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Per unit the sum and the count of the rows nearest to it, and the mean distance of all rows to their units."""
    units, width = weights.shape
    shared = data.sparkSession.sparkContext.broadcast(weights)
    nearest = _nearest()

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = shared.value
        sums, hits, far = np.zeros((units, width)), np.zeros(units, dtype="int64"), np.zeros(units)
        for batch in batches:
            if not len(batch):
                continue
            x = np.stack(batch[vector].to_numpy()).astype("float64")
            best, d = nearest(x, w)
            np.add.at(sums, best, x)
            np.add.at(far, best, d)
            hits += np.bincount(best, minlength=units)
        used = np.flatnonzero(hits)
        if len(used):  # a task without rows has nothing to say
            yield pd.DataFrame({"unit": used, "hits": hits[used], "far": far[used], "sums": list(sums[used])})

    parts = data.mapInPandas(partial, "unit int, hits bigint, far double, sums array<double>")
    totals = parts.groupBy("unit").agg(
        F.sum("hits").alias("hits"), F.sum("far").alias("far"), *[F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(width)]).collect()
    sums, hits = np.zeros((units, width)), np.zeros(units)
    for r in totals:
        hits[r["unit"]] = r["hits"]
        sums[r["unit"]] = [r[f"s{k}"] for k in range(width)]
    shared.unpersist()
    return sums, hits, float(sum(r["far"] for r in totals) / max(1.0, hits.sum()))


def predict_som(df: DataFrame, codebook: DataFrame, chunk_map: DataFrame, vector: str = "vector") -> DataFrame:
    """Nearest unit, its chunk size rounded to 128 KB, and the ratio of the current size (bytes) to it."""
    mapped = chunk_map.select(F.struct("i", "j").alias("unit"), F.col("chunk").alias("_chunk"))
    found = nearest_unit(df, codebook, vector).join(mapped, "unit", "left")
    kb = round_chunk(F.col("_chunk"))
    return found.withColumn("predicted_chunk_size", kb).select(
        "file_path", "file_size", F.floor(F.col("chunk_size") / 1024).alias("current_chunk_size"),
        "predicted_chunk_size",
        F.try_divide(F.col("chunk_size"), F.col("predicted_chunk_size") * 1024).alias("current_to_predicted_ratio"),
        F.col("unit").alias("bmu"))
