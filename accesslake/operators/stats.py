"""Column statistics: outliers, correlation, selection scores, summaries."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import melt, with_row
from .quantiles import few_group_quantiles

OUTLIER_Z = 3.0
REDUNDANT_R = 0.85
KEPT_VARIANCE = 0.95
# Groups in which the moments of the tasks are merged before the last merge.
MERGE_GROUPS = 64


def dataset_summary(df: DataFrame, column: str = "chunk_size_kb") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count"), F.count_distinct(column).alias("distinct_chunks"),
                  F.min(column).alias("min_chunk"), F.max(column).alias("max_chunk"))


def quartiles(df: DataFrame, columns: Sequence[str], **options) -> DataFrame:
    """Five-number summary per column, one row each."""
    return few_group_quantiles(
        melt(df, columns), ["column_name"], "value",
        {"minimum": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "maximum": 1.0}, **options)


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """(bin, low, high, rows) over equal widths between minimum and maximum; the last bin is closed."""
    span = df.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi"))

    def width():
        return (F.col("_m.hi") - F.col("_m.lo")) / bins

    place = F.coalesce(F.floor(F.try_divide(F.col(column) - F.col("_m.lo"), width())), F.lit(0))
    counts = (with_row(df.where(F.col(column).isNotNull()), span)
              .groupBy(F.least(place, F.lit(bins - 1)).cast("int").alias("bin"))
              .agg(F.count(F.lit(1)).alias("row_count")))
    return with_row(counts, span).select("bin", (F.col("_m.lo") + width() * F.col("bin")).alias("low"),
                                         (F.col("_m.lo") + width() * (F.col("bin") + 1)).alias("high"), "row_count")


def mark_outliers(df: DataFrame, columns: Sequence[str], z: float = OUTLIER_Z) -> DataFrame:
    """Adds ``is_outlier``: some column lies more than ``z`` population deviations from its mean."""
    moments = df.agg(*[e for c in columns for e in (
        F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std"))])
    far = [F.coalesce(F.abs(F.try_divide(F.col(c) - F.col("_m")[f"{c}_mean"], F.col("_m")[f"{c}_std"])) > z, F.lit(False))
           for c in columns]
    return with_row(df, moments).withColumn("is_outlier", reduce(or_, far)).drop("_m")


def split_outliers(df: DataFrame, columns: Sequence[str], z: float = OUTLIER_Z) -> tuple[DataFrame, DataFrame]:
    """Rows without an outlier, and the others."""
    marked = mark_outliers(df, columns, z)
    return marked.where(~F.col("is_outlier")).drop("is_outlier"), marked.where("is_outlier").drop("is_outlier")


def moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: ``n``, and for the columns in their order the arrays ``mean``, ``lo``, ``hi`` and ``co``, the sums of products of deviations
    from the means, row by row of the matrix.

    The rows are read once. Each task folds its batches into one block of count, means and co-moments, and blocks are merged by the
    difference of their means, so nothing is lost where values are large and close. A task sends one row. Columns must be complete; an empty table has no moments.
    """
    columns = list(columns)
    d, merged = len(columns), _merged()

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            x = batch.to_numpy(np.float64)
            if len(x):
                mean = x.mean(axis=0)
                c = x - mean
                block = (len(x), mean, x.min(axis=0), x.max(axis=0), c.T @ c)
                total = block if total is None else merged(total, block)
        if total is not None:
            n, mean, lo, hi, co = total
            yield pd.DataFrame({"part": [0], "n": [n], "mean": [mean], "lo": [lo], "hi": [hi], "co": [co.ravel()]})

    def merge(blocks: pd.DataFrame) -> pd.DataFrame:
        total = None
        for r in blocks.itertuples():
            block = (r.n, np.asarray(r.mean), np.asarray(r.lo), np.asarray(r.hi), np.asarray(r.co).reshape(d, d))
            total = block if total is None else merged(total, block)
        n, mean, lo, hi, co = total
        return pd.DataFrame({"part": [0], "n": [n], "mean": [mean], "lo": [lo], "hi": [hi], "co": [co.ravel()]})

    kind = "part long, n long, mean array<double>, lo array<double>, hi array<double>, co array<double>"
    blocks = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).mapInPandas(fold, kind)
    # a row for each task; merged in groups first, so that no task gets very many
    grouped = blocks.withColumn("part", F.spark_partition_id().cast("bigint") % MERGE_GROUPS).groupBy("part").applyInPandas(merge, kind)
    return grouped.withColumn("part", F.lit(0).cast("bigint")).groupBy("part").applyInPandas(merge, kind).drop("part")


def _merged():
    """A function that merges two blocks of moments; made here, so that it travels to the tasks by value."""
    def merged(a, b):
        n = a[0] + b[0]
        gap = b[1] - a[1]
        return (n, a[1] + gap * (b[0] / n), np.minimum(a[2], b[2]), np.maximum(a[3], b[3]),
                a[4] + b[4] + np.outer(gap, gap) * (a[0] * b[0] / n))

    return merged


def _co(i: Column, j: Column, d: int) -> Column:
    """A sum of products out of ``moments``; 0 where a column is constant, whatever rounding has left there."""
    varies = [F.get("lo", k) < F.get("hi", k) for k in (i, j)]
    return F.when(varies[0] & varies[1], F.get("co", i * d + j)).otherwise(0.0)


def corr_matrix(df: DataFrame, columns: Sequence[str], known: DataFrame | None = None) -> DataFrame:
    """(feature_x, feature_y, r) for every ordered pair; null where a column is constant.

    Columns must be complete. The diagonal is 1, as is usual, unless the column is constant. ``known`` are their ``moments``, if at hand.
    """
    columns = list(columns)
    sums, d = moments(df, columns) if known is None else known, len(columns)
    names = F.array(*[F.lit(c) for c in columns])
    cells = sums.select("*", F.explode(F.sequence(F.lit(0), F.lit(d * d - 1))).alias("_at")).select(
        "*", F.expr(f"int(_at div {d})").alias("_i"), F.expr(f"int(_at % {d})").alias("_j"))
    i, j = F.col("_i"), F.col("_j")
    spread = F.sqrt(_co(i, i, d)) * F.sqrt(_co(j, j, d))
    r = F.try_divide(_co(F.least(i, j), F.greatest(i, j), d), spread)
    return cells.select(F.get(names, i).alias("feature_x"), F.get(names, j).alias("feature_y"),
                        F.when((i == j) & r.isNotNull(), F.lit(1.0)).otherwise(r).alias("r"))


def redundant_pairs(matrix: DataFrame, threshold: float = REDUNDANT_R) -> DataFrame:
    """Each unordered pair once whose correlation is strong but, at nine decimals, not one."""
    strength = F.round(F.abs("r"), 9)
    return matrix.where((F.col("feature_x") < F.col("feature_y")) & (strength > threshold) & (strength < 1.0))


def f_scores(df: DataFrame, columns: Sequence[str], target: str, known: DataFrame | None = None) -> DataFrame:
    """(feature, f_score) of the univariate regression of ``target`` on each column.

    ``known`` are the ``moments`` of the columns and the target, in this order, if at hand.
    """
    every = list(dict.fromkeys([*columns, target]))
    sums = moments(df, every) if known is None else known
    d, t = len(every), F.lit(every.index(target))
    asked = F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(every.index(c)).alias("at")) for c in columns])
    rows = sums.select("*", F.inline(asked))
    i = F.col("at")
    r2 = F.try_divide(F.pow(_co(i, t, d), 2.0), _co(i, i, d) * _co(t, t, d))
    return rows.select("feature", (F.try_divide(r2, 1 - r2) * (F.col("n") - 2)).alias("f_score"))


def select_by_corr(matrix: DataFrame, target: str, features: Sequence[str], k: int = 10) -> DataFrame:
    """Feature columns among the target and its ``k`` highest signed correlations."""
    ranked = (matrix.where((F.col("feature_x") == target) & F.col("r").isNotNull())
              .orderBy(F.desc(F.col("feature_y") == target), F.desc("r"), "feature_y").limit(k + 1))
    return ranked.where(F.col("feature_y").isin(*features)).select(F.col("feature_y").alias("feature"), "r")


def select_by_f(scores: DataFrame, k: int = 10) -> DataFrame:
    return scores.where(F.col("f_score").isNotNull()).orderBy(F.desc("f_score"), "feature").limit(k)


def pca_k(variances: DataFrame, kept: float = KEPT_VARIANCE) -> DataFrame:
    """Smallest number of components whose summed share of variance reaches ``kept``.

    ``variances`` has one row per component (component, variance): as many rows as feature columns.
    """
    running = Window.orderBy(F.desc("variance"), "component").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    total = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    share = variances.select(F.row_number().over(Window.orderBy(F.desc("variance"), "component")).alias("position"),
                             (F.sum("variance").over(running) / F.sum("variance").over(total)).alias("share"))
    return share.where(F.round("share", 12) >= kept).agg(F.min("position").alias("components"))
