"""Per-file rollups, joins and the tables of the log store."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from .common import after, before, cutoff, lookback, not_before
from ..functions.measures import seconds_between, throughput_mbps
from ..functions.paths import extension, first_dot_ext
from ..session import materialise


def access_measures() -> list:
    """The count of a file's accesses, and what is known of them."""
    return [
        F.count(F.lit(1)).alias("access_count"),
        F.avg("read_size").alias("avg_read_size"),
        F.avg("write_size").alias("avg_write_size"),
        F.max("read_size").alias("max_read_size"),
        F.max("write_size").alias("max_write_size"),
        F.count_if(F.col("access_type") == "read").alias("read_count"),
        F.count_if(F.col("access_type") == "write").alias("write_count"),
    ]


def file_profiles(meta: DataFrame, access: DataFrame, throughput: DataFrame,
                  as_of: str | None = None, days: int = 30) -> DataFrame:
    """One row per file: its accesses and mean throughput in the window, nulls and zeros if none.

    Each fact table is aggregated before the join, so the joins are one row to one row and the
    shuffles carry partial aggregates. The time window filters the facts, never the files.
    """
    if as_of is not None:
        access = lookback(access, "access_time", days, as_of)
        throughput = lookback(throughput, "start_time", days, as_of)
    per_access = access.groupBy("file_path").agg(*access_measures())
    per_transfer = throughput.groupBy("file_path").agg(F.avg("throughput_mbps").alias("throughput_mbps"))
    joined = (meta.select("file_path", "file_size", "chunk_size")
              .join(per_access, "file_path", "left").join(per_transfer, "file_path", "left"))
    return joined.na.fill(0, ["access_count", "read_count", "write_count"])


def training_profiles(meta: DataFrame, access: DataFrame) -> DataFrame:
    """Profiles of the files that have accesses."""
    per_access = access.groupBy("file_path").agg(*access_measures())
    return meta.select("file_path", "file_size", "chunk_size").join(per_access, "file_path")


def accessed_paths(access: DataFrame) -> DataFrame:
    """Each accessed path once.

    Reduced on the map side first, so a file with a third of all accesses sends one row per task, and the
    result already has the partitioning the joins below need.
    """
    return access.select("file_path").distinct()


def active_files(meta: DataFrame, access: DataFrame) -> DataFrame:
    """Distinct paths of files with at least one access."""
    return meta.join(accessed_paths(access), "file_path", "left_semi").select("file_path").distinct()


def min_access_filter(meta: DataFrame, access: DataFrame, k: int) -> DataFrame:
    """Files with at least ``k`` accesses."""
    enough = access.groupBy("file_path").count().where(F.col("count") >= k)
    return meta.join(enough, "file_path", "left_semi")


def orphan_files(meta: DataFrame, access: DataFrame) -> DataFrame:
    """Files without any access row left."""
    return meta.join(accessed_paths(access), "file_path", "left_anti")


def select_files(meta: DataFrame, access: DataFrame, min_size: int | None = None, max_size: int | None = None,
                 min_access: int | None = None, extensions: Sequence[str] | None = None,
                 limit: int | None = None, loose_extension: bool = False) -> DataFrame:
    """Active files that meet every given condition; a limit takes the first paths in order."""
    files = matching_files(meta, min_size, max_size, extensions, loose_extension)
    # Having k >= 1 accesses implies being active, so one semi join does for both.
    files = min_access_filter(files, access, min_access) if min_access and min_access > 1 else files.join(
        accessed_paths(access), "file_path", "left_semi")
    paths = files.select("file_path").distinct()
    return paths.orderBy("file_path").limit(limit) if limit else paths


def matching_files(meta: DataFrame, min_size: int | None = None, max_size: int | None = None,
                   extensions: Sequence[str] | None = None, loose_extension: bool = False) -> DataFrame:
    """The files of ``meta`` that meet every given condition on themselves."""
    files = meta
    if min_size is not None:
        files = files.where(F.col("file_size") >= min_size)
    if max_size is not None:
        files = files.where(F.col("file_size") <= max_size)
    if extensions:
        suffix = first_dot_ext if loose_extension else extension
        files = files.where(suffix(F.col("file_path")).isin(*extensions))
    return files


def latest_metadata(events: DataFrame) -> DataFrame:
    """Per file: the first event's time, and size, chunk size and time of the latest event."""
    newest = F.max(F.struct("access_time", "id", "file_size", "chunk_size"))
    return (events.groupBy("file_path")
            .agg(F.min("access_time").alias("first_seen"), newest.alias("_new"))
            .select("file_path", "_new.file_size", "_new.chunk_size", "first_seen",
                    F.col("_new.access_time").alias("last_seen")))


def throughput_rows(transfers: DataFrame) -> DataFrame:
    """Rates of the transfers that took any time."""
    rate = throughput_mbps(F.col("bytes_transferred"), seconds_between(F.col("start_time"), F.col("end_time")))
    return transfers.withColumn("throughput_mbps", rate).where(F.col("throughput_mbps").isNotNull())


def dedup_throughput(throughput: DataFrame) -> DataFrame:
    """One row per file and start time: the one ingested first."""
    rest = [c for c in throughput.columns if c not in ("file_path", "start_time", "ingest_id")]
    first = F.min(F.struct("ingest_id", *rest)).alias("_first")
    return throughput.groupBy("file_path", "start_time").agg(first).select("file_path", "start_time", "_first.*")


def read_throughput(throughput: DataFrame) -> DataFrame:
    """Per file: bytes read over seconds spent reading, null without reading time."""
    reading = F.col("operation_type") == "read"
    seconds = seconds_between(F.col("start_time"), F.col("end_time"))
    return throughput.groupBy("file_path").agg(
        F.try_divide(F.sum(F.when(reading, F.col("bytes_transferred")).otherwise(0)),
                     F.sum(F.when(reading, seconds).otherwise(0.0))).alias("read_rate"))


def bench_rollup(operations: DataFrame) -> DataFrame:
    """One bench-log row per run out of its single operations.

    Mean sizes and the throughput are truncated to two decimals; a run without operations of a kind has
    a mean of 0. The throughput sample is at most 100 MB of the file.
    """
    def kind(name):
        return F.when(F.col("operation") == name, F.col("size_kb"))

    def truncated(c):
        return F.floor(c * 100) / 100

    def mean(name):
        return F.coalesce(truncated(F.try_divide(F.sum(kind(name)), F.count(kind(name)))), F.lit(0.0))

    runs = operations.groupBy("run_id", "file_path", "file_size_kb", "chunk_size_kb").agg(
        F.count(kind("read")).alias("read_ops"), F.count(kind("write")).alias("write_ops"),
        mean("read").alias("avg_read_kb"), mean("write").alias("avg_write_kb"),
        F.coalesce(F.max(kind("read")), F.lit(0)).alias("max_read_kb"),
        F.coalesce(F.max(kind("write")), F.lit(0)).alias("max_write_kb"),
        F.max("sample_seconds").alias("_seconds"))
    sample = F.least(F.col("file_size_kb"), F.lit(102400))
    return runs.select(
        "run_id", "file_path", "file_size_kb", "chunk_size_kb",
        (F.col("read_ops") + F.col("write_ops")).alias("access_count"),
        "avg_read_kb", "avg_write_kb", "max_read_kb", "max_write_kb", "read_ops", "write_ops",
        truncated(F.try_divide(sample, F.col("_seconds"))).alias("throughput_kbps"))


def monitor_stats(access: DataFrame, as_of: str, approximate: bool = False) -> DataFrame:
    """Events, files, reads, writes and last-day events in one pass."""
    files = F.approx_count_distinct("file_path") if approximate else F.count_distinct("file_path")
    return access.agg(
        F.count(F.lit(1)).alias("total_events"), files.alias("unique_files"),
        F.count_if(F.col("access_type") == "read").alias("read_events"),
        F.count_if(F.col("access_type") == "write").alias("write_events"),
        F.count_if(F.col("access_time") > cutoff(access, "access_time", 1, as_of)).alias("recent_events"))


def count_by_type(access: DataFrame) -> DataFrame:
    return access.groupBy("access_type").agg(F.count(F.lit(1)).alias("events"))


def top_files(access: DataFrame, n: int = 5) -> DataFrame:
    """Most accessed files, paths in order among equals."""
    counts = access.groupBy("file_path").agg(F.count(F.lit(1)).alias("events"))
    return counts.orderBy(F.desc("events"), "file_path").limit(n)


def history_stats(history: DataFrame, as_of: str) -> DataFrame:
    old, new = F.col("old_chunk_size"), F.col("new_chunk_size")
    return history.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("optimization_time") > cutoff(history, "optimization_time", 1, as_of)).alias("recent"),
        F.avg(old).alias("avg_old"), F.avg(new).alias("avg_new"), F.avg(new - old).alias("avg_change"),
        F.count_if(new > old).alias("increases"), F.count_if(new < old).alias("decreases"),
        F.count_if(new == old).alias("unchanged"))


def top_changes(history: DataFrame, n: int = 5) -> DataFrame:
    """History rows with the largest change either way."""
    signed = history.withColumn("change", F.col("new_chunk_size") - F.col("old_chunk_size"))
    order = [F.desc(F.abs("change")), *[F.col(c) for c in signed.columns if c != "change"]]
    return signed.orderBy(*order).limit(n)


def apply_retention(access: DataFrame, throughput: DataFrame, meta: DataFrame, days: int,
                    as_of: str) -> dict[str, DataFrame]:
    """The three tables without rows older than ``days``, and the rows each one loses.

    Rows exactly at the cut-off stay, and so do rows without a time; a file goes when no access of it stays. Accesses are read once and
    stored as two counts for each file: the report and the files to keep come from those. Runs a job when called.
    """
    access_end = cutoff(access, "access_time", days, as_of)
    transfer_end = cutoff(throughput, "start_time", days, as_of)
    old = F.coalesce(F.col("access_time") < access_end, F.lit(False))
    counts = materialise(access.groupBy("file_path").agg(
        F.count_if(old).alias("deleted"), F.count_if(~old).alias("kept")), "retention")
    files = meta.join(counts.where("kept > 0"), "file_path", "left_anti")
    deleted = (counts.agg(F.coalesce(F.sum("deleted"), F.lit(0)).alias("deleted")).select(F.lit("file_access").alias("table_name"), "deleted")
               .unionAll(throughput.where(before(throughput, "start_time", transfer_end)).agg(F.count(F.lit(1)).alias("deleted")).select(F.lit("throughput_metrics"), "deleted"))
               .unionAll(files.agg(F.count(F.lit(1)).alias("deleted")).select(F.lit("file_metadata"), "deleted")))
    return {"file_access": access.where(not_before(access, "access_time", access_end)),
            "throughput_metrics": throughput.where(not_before(throughput, "start_time", transfer_end)),
            "file_metadata": meta.join(counts.where("kept > 0"), "file_path", "left_semi"), "deleted": deleted}


def new_rows(df: DataFrame, ts: str, since: str) -> DataFrame:
    """How many rows arrived after ``since``."""
    later = after(df, ts, F.lit(since).cast(df.schema[ts].dataType))
    return df.where(later).agg(F.count(F.lit(1)).alias("new_rows"))
