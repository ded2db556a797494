"""Streams: notifications to events, kept metadata, transfer rates, live activity."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.sizing import parse_chunk_kb
from ..operators.clean import validate_events
from ..operators.profiles import access_measures, throughput_rows
from ..plans.recommend import Predictor, plan_of
from ..session import work_dir
from ..sources.versions import ChangeLog

# Bytes assumed per access, and the chunk size of a file without entry info.
ASSUMED_BYTES = 4096
DEFAULT_CHUNK_KB = 512
WRITES, READS = ("modified", "created"), ("opened", "accessed")


def ingest_events(notifications: DataFrame) -> DataFrame:
    """Access events of file notifications; directories and other kinds drop out."""
    kind = F.col("kind")
    access_type = F.when(kind.isin(*WRITES), "write").when(kind.isin(*READS), "read")
    events = (notifications.where((F.col("is_directory") == 0) & kind.isin(*WRITES, *READS))
              .select("file_path", "file_size", parse_chunk_kb(F.col("entry_info"), DEFAULT_CHUNK_KB).alias("chunk_size"),
                      access_type.alias("access_type"), F.col("seen_at").alias("access_time"))
              .withColumn("read_size", F.when(F.col("access_type") == "read", ASSUMED_BYTES).otherwise(0).cast("bigint"))
              .withColumn("write_size", F.when(F.col("access_type") == "write", ASSUMED_BYTES).otherwise(0).cast("bigint")))
    good, _ = validate_events(events)
    return good


def append_to(stream: DataFrame, path: str, checkpoint: str, trigger: dict) -> StreamingQuery:
    """Append a stream to a Parquet table; the file sink commits each batch once."""
    return (stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
            .trigger(**trigger).start(path))


def metadata_updates(events: DataFrame) -> DataFrame:
    """Running state per file: first time seen, and the facts of its latest event."""
    newest = F.max(F.struct("access_time", "id", "file_size", "chunk_size")).alias("latest")
    return events.groupBy("file_path").agg(F.min("access_time").alias("first_seen"), newest)


def kept_metadata(spark: SparkSession, path: str, every: int = 16) -> ChangeLog:
    """The stored metadata of the files, by path."""
    latest = "latest struct<access_time: timestamp, id: bigint, file_size: bigint, chunk_size: bigint>"
    return ChangeLog(spark, path, f"file_path string, first_seen timestamp, {latest}", ["file_path"], every)


def upsert_metadata(events: DataFrame, path: str, checkpoint: str, trigger: dict, every: int = 16) -> StreamingQuery:
    """Keep file metadata current: each batch stores the files it changed; every so many batches are merged into a snapshot."""
    log = kept_metadata(events.sparkSession, path, every)
    return (metadata_updates(events).writeStream.outputMode("update").foreachBatch(log.store)
            .option("checkpointLocation", checkpoint).trigger(**trigger).start())


def current_metadata(spark: SparkSession, path: str) -> DataFrame:
    """The metadata table as of the last stored batch."""
    return kept_metadata(spark, path).rows().select(
        "file_path", "latest.file_size", "latest.chunk_size", "first_seen", F.col("latest.access_time").alias("last_seen"))


def record_throughput(transfers: DataFrame, delay: str) -> DataFrame:
    """One rate per file and start time, the first to arrive; later copies within ``delay`` drop out.

    ``delay`` bounds the state: copies, and rows, later than that are not seen. The caller knows how late rows can be.
    """
    rated = throughput_rows(transfers).withWatermark("start_time", delay)
    return rated.dropDuplicatesWithinWatermark(["file_path", "start_time"])


_FIRST = "ingest_id: bigint, end_time: timestamp, bytes_transferred: bigint, operation_type: string, throughput_mbps: double"


def kept_throughput(spark: SparkSession, path: str, every: int = 16) -> ChangeLog:
    """The stored rates, by file and start time."""
    return ChangeLog(spark, path, f"file_path string, start_time timestamp, first struct<{_FIRST}>", ["file_path", "start_time"], every)


def publish_throughput(transfers: DataFrame, path: str, checkpoint: str, trigger: dict, delay: str, every: int = 16) -> StreamingQuery:
    """Keep one rate per file and start time: the copy ingested first, whichever order the copies arrive in.

    ``delay`` bounds the state: transfers that start so much before the latest one of earlier batches are not seen, and what is older is
    forgotten by the state, not by the table. Each batch stores the rates it changed; every so many batches are merged into a snapshot.
    """
    rated = throughput_rows(transfers).withWatermark("start_time", delay)
    first = F.min(F.struct(*[c.split(":")[0] for c in _FIRST.split(", ")])).alias("first")
    log = kept_throughput(transfers.sparkSession, path, every)
    return (rated.groupBy("file_path", "start_time").agg(first).writeStream.outputMode("update").foreachBatch(log.store)
            .option("checkpointLocation", checkpoint).trigger(**trigger).start())


def current_throughput(spark: SparkSession, path: str) -> DataFrame:
    """The rates as of the last stored batch."""
    return kept_throughput(spark, path).rows().select("file_path", "start_time", "first.*")


_ACTIVITY = ("events", "read_events", "write_events")


def kept_activity(spark: SparkSession, path: str, every: int = 16) -> ChangeLog:
    """The stored counts of the windows, by their bounds."""
    counts = ", ".join(f"{c} bigint" for c in _ACTIVITY)
    return ChangeLog(spark, path, f"window_start timestamp, window_end timestamp, {counts}", ["window_start", "window_end"], every)


def publish_activity(events: DataFrame, path: str, checkpoint: str, trigger: dict, length: str = "24 hours", step: str = "1 hour",
                     delay: str | None = None, every: int = 16) -> StreamingQuery:
    """Keep the accesses per sliding window current, open windows included.

    Each batch stores the windows it changed; every so many batches are merged into a snapshot. Without ``delay`` no row is ever too late
    and the state keeps all windows; with it, windows that old are closed and forgotten by the state, not by the table.
    """
    late = events.withWatermark("access_time", delay) if delay else events
    counted = late.groupBy(F.window("access_time", length, step).alias("w")).agg(
        F.count(F.lit(1)).alias("events"), F.count_if(F.col("access_type") == "read").alias("read_events"),
        F.count_if(F.col("access_type") == "write").alias("write_events"))
    rows = counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *_ACTIVITY)
    log = kept_activity(events.sparkSession, path, every)
    return (rows.writeStream.outputMode("update").foreachBatch(log.store).option("checkpointLocation", checkpoint)
            .trigger(**trigger).start())


def current_activity(spark: SparkSession, path: str) -> DataFrame:
    """The counts of every window as of the last stored batch."""
    return kept_activity(spark, path).rows()


def live_activity(events: DataFrame, length: str = "24 hours", step: str = "1 hour", delay: str | None = None) -> DataFrame:
    """Accesses per sliding window, by type, of a table, or of a stream of which only closed windows are wanted.

    A stream needs ``delay``: its windows come out once they are that old. ``publish_activity`` has the open ones as well.
    """
    if events.isStreaming:
        if delay is None:
            raise ValueError("a stream of closed windows needs a delay")
        events = events.withWatermark("access_time", delay)
    # Rows are counted per step first, so only the counts are repeated for every window they fall in.
    per_step = events.groupBy(F.window("access_time", step).alias("s")).agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(F.col("access_type") == "read").alias("read_events"),
        F.count_if(F.col("access_type") == "write").alias("write_events"))
    counted = per_step.groupBy(F.window(F.window_time("s"), length, step).alias("w")).agg(
        *[F.sum(c).alias(c) for c in _ACTIVITY])
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                          "events", "read_events", "write_events")


def count_stream(rows: DataFrame, ts: str, since: str) -> DataFrame:
    """Rows newer than ``since``, counted as they arrive."""
    return rows.where(F.col(ts) > F.lit(since).cast(rows.schema[ts].dataType)).groupBy().agg(
        F.count(F.lit(1)).alias("new_rows"))


def profile_updates(accesses: DataFrame, transfers: DataFrame) -> DataFrame:
    """The running profile of every file that a batch of accesses or transfers touches.

    Both streams feed one aggregation: its state holds sums, counts and maxima for each file, so a batch reads its own rows and the state
    of the files they touch, whatever the history. The measures are those of ``file_profiles``.
    """
    rows = (accesses.select("file_path", "access_type", "read_size", "write_size", F.lit(1).alias("_access"))
            .unionByName(transfers.select("file_path", "throughput_mbps"), allowMissingColumns=True))
    count = F.count("_access").alias("access_count")
    return rows.groupBy("file_path").agg(count, *access_measures()[1:], F.avg("throughput_mbps").alias("throughput_mbps"))


PLAN = "file_path string, old_chunk_size bigint, new_chunk_size bigint, confidence double, wanted boolean"


def kept_plan(spark: SparkSession, path: str, every: int = 16) -> ChangeLog:
    """The stored plan, by path; rows that are no longer wanted are kept as such."""
    return ChangeLog(spark, path, PLAN, ["file_path"], every)


def scan_loop(accesses: DataFrame, transfers: DataFrame, meta: Callable[[], DataFrame], predict: Predictor, path: str, checkpoint: str,
              min_access: int = 5, force: bool = False, trigger: dict | None = None, every: int = 16) -> StreamingQuery:
    """Keep the change plan current, every five minutes for the files that were touched since.

    ``meta`` gives the files' metadata as of the batch. A batch plans anew the files it touches, from their running profiles; the others'
    rows stand. ``current_plan`` equals ``change_plan`` over all rows so far.
    """
    log = kept_plan(accesses.sparkSession, path, every)

    def plan(batch: DataFrame, number: int) -> None:
        profiles = meta().select("file_path", "file_size", "chunk_size").join(batch, "file_path")
        rows = plan_of(profiles, predict, True, min_access)
        log.store(rows.withColumn("wanted", F.lit(force) | (F.col("old_chunk_size") != F.col("new_chunk_size"))), number)

    return (profile_updates(accesses, transfers).writeStream.outputMode("update").foreachBatch(plan)
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "300 seconds"})).start())


def current_plan(spark: SparkSession, path: str) -> DataFrame:
    """The planned changes as of the last stored batch."""
    return kept_plan(spark, path).rows().where("wanted").drop("wanted")


def drain(spark: SparkSession, start: Callable[[str, str], StreamingQuery], name: str) -> str:
    """Run a stream over all that is there now; returns the folder it wrote."""
    base = work_dir(spark, name)
    start(f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return f"{base}/out"
