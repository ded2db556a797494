"""Labelling runs as optimal by the throughput quantile of their group."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import join_on
from .quantiles import (
    HOT_VALUES, exact_quantiles, few_group_quantiles, global_quantile, quantiles_of_counts, stored_counts, values_at_ranks)
from ..functions.sizing import LARGE_FILE_KB, access_band, combination
from ..session import materialise

QUANTILE = 0.65
# Throughputs are compared at six decimals: interpolation noise must not flip a label.
DECIMALS = 6


def with_band(df: DataFrame, accesses: str = "access_count") -> DataFrame:
    return df.withColumn("access_count_label", access_band(F.col(accesses)))


def label_ot(df: DataFrame, q: float = QUANTILE, size: str = "file_size_kb", throughput: str = "throughput_kbps",
             min_rows: int = 1, label: str = "OT", hot_values: int = HOT_VALUES,
             keys: tuple[str, ...] | None = None) -> DataFrame:
    """``label`` = 1 where the throughput reaches the q-quantile of its (size, access band) group.

    Groups with fewer than ``min_rows`` values use the quantile of all rows. Adds the band, the
    combination text and the label; rows without throughput are the caller's to drop. Groups by other ``keys`` may be very many, such as
    files: their values are then counted once, instead of a histogram for each.
    """
    banded, many = with_band(df), keys is not None
    keys = list(keys or (size, "access_count_label"))
    narrow = banded.select(*keys, F.col(throughput).cast("double").alias(throughput))
    if many:
        counts = stored_counts(narrow, keys, throughput)
        limits = quantiles_of_counts(counts, keys, {"_limit": q}, "_rows", hot_values)
        if min_rows > 1:
            limits = limits.withColumn("_overall", quantiles_of_counts(counts, [], {"_overall": q}, hot_values=hot_values).scalar())
    else:
        limits = few_group_quantiles(narrow, keys, throughput, {"_limit": q}, "_rows", hot_values,
                                     overall={"_overall": q} if min_rows > 1 else None)
    if min_rows > 1:
        limits = limits.withColumn("_limit", F.when(F.col("_rows") >= min_rows, F.col("_limit")).otherwise(F.col("_overall")))
    # Stored, so that the join knows how small the thresholds are, and whatever reads the labels does not find them anew.
    limits = materialise(limits.select(*keys, "_limit"), "limits")
    reached = F.round(throughput, DECIMALS) >= F.round("_limit", DECIMALS)
    return (join_on(banded, limits, keys, "left")
            .withColumn(label, F.when(reached, 1).otherwise(0))
            .withColumn("combination", combination(F.col(size), F.col("access_count_label")))
            .drop("_limit"))


def prune_labels(df: DataFrame, label: str, path: str = "file_path", size: str = "file_size_kb",
                 chunk: str = "chunk_size_kb", hot_values: int = HOT_VALUES) -> DataFrame:
    """Of a file's optimal runs keep the larger chunks for large files, the smaller ones for small files.

    The cut is the median chunk of the file's optimal runs, and needs at least two of them. Runs are
    counted per (file, chunk) before the shuffle, so a file with very many runs stays small.
    """
    sized = df.withColumn("_large", F.col(size) > LARGE_FILE_KB)
    cuts = exact_quantiles(sized.where(F.col(label) == 1), [path, "_large"], chunk, {"_median": 0.5},
                           count_as="_optimal", hot_values=hot_values)
    joined = join_on(sized, cuts.where(F.col("_optimal") >= 2), [path, "_large"], "left")
    beyond = F.when(F.col("_large"), F.col(chunk) < F.col("_median")).otherwise(F.col(chunk) > F.col("_median"))
    loses = (F.col(label) == 1) & beyond
    return joined.withColumn(label, F.when(loses, 0).otherwise(F.col(label))).drop("_large", "_median", "_optimal")


def balance_labels(df: DataFrame, label: str, throughput: str, order: str) -> DataFrame:
    """Make sure both classes occur.

    Without positives the top quarter by throughput becomes 1, without negatives the bottom quarter
    becomes 0; among equals the lower ``order`` (unique) comes first. Only then is the table read again:
    the quarter's limits are found by rank selection, so no task holds the quarter itself.
    """
    totals = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(label), F.lit(0)).alias("positive")).first()
    n, positive = totals["n"], totals["positive"]
    quarter = n // 4
    if quarter == 0 or 0 < positive < n:
        return df
    top = positive == 0
    edge = _value_at(df, throughput, n - quarter if top else quarter - 1)
    v = F.col(throughput)
    beyond = v > edge if top else v < edge
    places = quarter - df.where(beyond).count()
    last = _value_at(df.where(v == edge), order, places - 1)
    chosen = beyond | ((v == edge) & (F.col(order) <= last))
    return df.withColumn(label, F.when(chosen, 1 if top else 0).otherwise(F.col(label)))


def _value_at(df: DataFrame, value: str, rank: int):
    """The value at one 0-based ascending rank over all rows."""
    counts = stored_counts(df, [], value)
    target = counts.agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi")).withColumn("_rank", F.lit(rank).cast("bigint"))
    return values_at_ranks(counts, [], target).first()["_v"]


def label_optimal(df: DataFrame, q: float = QUANTILE, order: str | None = None, min_rows: int = 3,
                  size: str = "file_size_kb", throughput: str = "throughput_kbps", chunk: str = "chunk_size_kb",
                  label: str = "is_optimal", hot_values: int = HOT_VALUES,
                  keys: tuple[str, ...] | None = None) -> DataFrame:
    """Quantile labels with the minimum group size, pruned per file and, given ``order``, balanced."""
    labelled = label_ot(df, q, size, throughput, min_rows, label, hot_values, keys)
    pruned = prune_labels(labelled, label, size=size, chunk=chunk, hot_values=hot_values)
    return balance_labels(pruned, label, throughput, order) if order else pruned


def label_stats(df: DataFrame, label: str = "is_optimal", size: str = "file_size_kb",
                throughput: str = "throughput_kbps", q: float = QUANTILE) -> DataFrame:
    """Combinations, positives, rows, share of positives and the overall threshold."""
    overall = global_quantile(df, throughput, q, "limit").scalar()
    return with_band(df).agg(
        F.count_distinct(F.col(size), F.col("access_count_label")).alias("combinations"),
        F.sum(label).alias("optimal"), F.count(F.lit(1)).alias("total"),
        F.try_divide(F.sum(label), F.count(F.lit(1))).alias("optimal_ratio"),
    ).withColumn("global_threshold", overall)
