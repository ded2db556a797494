"""Validation, missing values and unit clean-up."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Observation, functions as F

from .common import melt, with_row
from .quantiles import few_group_quantiles
from ..functions.measures import MIB


def validate_events(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows, and rejects with a ``reason``."""
    reason = (F.when(F.col("access_type").isNull() | ~F.col("access_type").isin("read", "write"), "access_type")
              .when(F.col("file_size") < 0, "file_size")
              .when(F.col("chunk_size") < 0, "chunk_size"))
    marked = df.withColumn("reason", reason)
    return marked.where(F.col("reason").isNull()).drop("reason"), marked.where(F.col("reason").isNotNull())


def lookup_file(df: DataFrame, path: str) -> DataFrame:
    return df.where(F.col("file_path") == path).select("file_path", "chunk_size")


def drop_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(columns))


def drop_missing_observed(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, Observation]:
    """As ``drop_missing``; the dropped row count arrives with the first action, without another pass."""
    seen = Observation()
    missing = reduce(or_, [F.col(c).isNull() for c in columns])
    return drop_missing(df.observe(seen, F.count_if(missing).alias("dropped")), columns), seen


def missing_count(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = reduce(or_, [F.col(c).isNull() for c in columns])
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(missing).alias("dropped"))


def clean_rows(df: DataFrame) -> DataFrame:
    """Complete rows, each once."""
    return df.na.drop().dropDuplicates()


def fill_zero(df: DataFrame) -> DataFrame:
    return df.na.fill(0)


def impute(df: DataFrame, columns: Sequence[str], how: str = "median") -> DataFrame:
    """Nulls become the column's exact median or its mean."""
    if how == "mean":
        filled = with_row(df, df.agg(*[F.avg(c).alias(c) for c in columns]))
        known = {c: F.col("_m")[c] for c in columns}
    else:
        medians = few_group_quantiles(melt(df, columns), ["column_name"], "value", {"median": 0.5})
        # One row per column of the table, so the map is small.
        by_name = F.map_from_entries(F.collect_list(F.struct("column_name", "median")))
        filled = with_row(df, medians.agg(by_name.alias("of")))
        known = {c: F.try_element_at(F.col("_m.of"), F.lit(c)) for c in columns}
    return filled.withColumns({c: F.coalesce(F.col(c).cast("double"), known[c]) for c in columns}).drop("_m")


def to_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Strings to doubles; rows with a value that is no number are dropped."""
    parsed = df.withColumns({c: F.col(c).try_cast("double") for c in columns})
    return parsed.na.drop(subset=list(columns))


def missing_report(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column_name, missing): nulls per column, counted in one pass."""
    columns = list(columns or df.columns)
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.unpivot([], columns, "column_name", "missing")


# Byte columns and the KB columns they become.
_SIZE_NAMES = {"avg_read_size": "avg_read_KB", "avg_write_size": "avg_write_KB",
               "max_read_size": "max_read_KB", "max_write_size": "max_write_KB"}
_COUNT_NAMES = {"read_count": "read_ops", "write_count": "write_ops"}
DEFAULT_CHUNK_KB = 512
DEFAULT_THROUGHPUT_KBPS = 100 * 1024


def normalise_units(df: DataFrame) -> DataFrame:
    """Bytes to KB and MB/s to KB/s under the model's column names, with defaults for what is absent.

    Spark matches column names without regard to case, so an input that already has the KB columns
    keeps them.
    """
    have = {c.lower() for c in df.columns}
    new = {}
    if "file_size_kb" not in have:
        new["file_size_KB"] = F.col("file_size") / 1024
    if "chunk_size_kb" not in have:
        new["chunk_size_KB"] = F.col("chunk_size") / 1024 if "chunk_size" in have else F.lit(float(DEFAULT_CHUNK_KB))
    if "throughput_mbps" in have:
        new["throughput_KBps"] = F.col("throughput_mbps") * 1024
    elif "throughput_kbps" not in have:
        new["throughput_KBps"] = F.lit(float(DEFAULT_THROUGHPUT_KBPS))
    new.update({kb: F.col(c) / 1024 for c, kb in _SIZE_NAMES.items() if c in have})
    new.update({ops: F.col(c) for c, ops in _COUNT_NAMES.items() if c in have})
    return df.withColumns(new)


# Features assumed for a file without any access, by file size.
_UNSEEN = {
    "avg_read_size": (4096, 65536, 1048576),
    "avg_write_size": (4096, 32768, 524288),
    "max_read_size": (8192, 131072, 4194304),
    "max_write_size": (8192, 65536, 1048576),
    "read_count": (10, 20, 50),
    "write_count": (5, 10, 20),
    "throughput_mbps": (50.0, 100.0, 150.0),
}


def with_default_features(profiles: DataFrame) -> DataFrame:
    """File profiles with every feature filled: by size tier where nothing was seen, else per column."""
    unseen = F.coalesce(F.col("access_count"), F.lit(0)) == 0

    def tier(name):
        small, middle, large = _UNSEEN[name]
        return (F.when(F.col("file_size") < MIB, small).when(F.col("file_size") < 100 * MIB, middle)
                .otherwise(large))

    def seen_or(name, fallback):
        return F.coalesce(F.nullif(F.col(name), F.lit(0)), fallback)

    avg_read = seen_or("avg_read_size", F.lit(4096.0))
    avg_write = seen_or("avg_write_size", F.lit(4096.0))
    seen = {
        "avg_read_size": avg_read,
        "avg_write_size": avg_write,
        "max_read_size": seen_or("max_read_size", avg_read * 2),
        "max_write_size": seen_or("max_write_size", avg_write * 2),
        "read_count": F.coalesce("read_count", F.lit(0)),
        "write_count": F.coalesce("write_count", F.lit(0)),
        "throughput_mbps": seen_or("throughput_mbps", F.lit(100.0)),
    }
    kinds = {"read_count": "bigint", "write_count": "bigint"}
    new = {n: F.when(unseen, tier(n)).otherwise(c).cast(kinds.get(n, "double")) for n, c in seen.items()}
    total = F.when(unseen, tier("read_count") + tier("write_count")).otherwise(F.col("access_count"))
    return profiles.withColumns({**new, "access_count": total.cast("bigint")})


def to_model_columns(features: DataFrame, chunk_kb: Column | float = 0.0, keep: Sequence[str] = ()) -> DataFrame:
    """The path and the ten model columns, in KB and KB/s, and the columns to ``keep``.

    ``chunk_kb`` is the current chunk size, where a decision is made against it; models fill in each candidate.
    """
    chunk_kb = chunk_kb if isinstance(chunk_kb, Column) else F.lit(chunk_kb)
    return features.select(
        "file_path",
        (F.col("file_size") / 1024).alias("file_size_KB"),
        (F.col("avg_read_size") / 1024).alias("avg_read_KB"),
        (F.col("avg_write_size") / 1024).alias("avg_write_KB"),
        (F.col("max_read_size") / 1024).alias("max_read_KB"),
        (F.col("max_write_size") / 1024).alias("max_write_KB"),
        F.col("read_count").alias("read_ops"),
        F.col("write_count").alias("write_ops"),
        "access_count",
        (F.col("throughput_mbps") * 1024).alias("throughput_KBps"),
        chunk_kb.cast("double").alias("chunk_size_KB"),
        *keep,
    )
