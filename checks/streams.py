"""Streaming jobs, run over all rows that are there (``availableNow``), and retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from accesslake.operators import profiles
from accesslake.sources import logs
from accesslake.streaming import ingest
from .learning import BEST_OF_FILES, closed_form
from .registry import Tables, query, rounded
from .relational import AS_OF, ENTRY_TEXT, stored_tables

NOW = {"availableNow": True}


def stream_of(t: Tables, table: str, derive) -> DataFrame:
    """A given table as a file stream, in the columns the Tables view of it has."""
    schema = t.spark.read.parquet(f"{t.sf_dir}/{table}.parquet").schema
    stream = t.spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(t.sf_dir)
    live = Tables(t.spark, t.sf_dir)
    live.__dict__[table] = stream
    return derive(live)


def live_accesses(t: Tables) -> DataFrame:
    return stream_of(t, "events", lambda live: live.accesses.withColumn("access_time", F.col("access_time").cast("timestamp")))


def timed_transfers(t: Tables) -> DataFrame:
    return stream_of(t, "orders", lambda live: live.transfer_rows.withColumns(
        {c: F.col(c).cast("timestamp") for c in ("start_time", "end_time")}))


def live_transfers(t: Tables) -> DataFrame:
    return profiles.throughput_rows(timed_transfers(t))


KIND = "CASE WHEN access_type = 'write' THEN CASE id % 2 WHEN 0 THEN 'modified' ELSE 'created' END ELSE CASE id % 3 WHEN 0 THEN 'opened' WHEN 1 THEN 'accessed' ELSE 'moved' END END"


@query("st_ingest", f"""
SELECT file_path, size AS file_size, chunk_kb AS chunk_size, access_type, access_time, CAST(CASE WHEN access_type = 'read' THEN 4096 ELSE 0 END AS BIGINT) AS read_size,
  CAST(CASE WHEN access_type = 'write' THEN 4096 ELSE 0 END AS BIGINT) AS write_size
FROM (SELECT *, read_size + write_size AS size, {KIND} AS kind, id % 10 AS d,
  CAST(CASE id % 5 WHEN 0 THEN 512 WHEN 1 THEN 2048 WHEN 2 THEN id // 1024 WHEN 3 THEN 1048576 ELSE 512 END AS BIGINT) AS chunk_kb FROM accesses)
WHERE d <> 0 AND kind <> 'moved'""")
def _(t: Tables):
    notes = live_accesses(t).select(
        F.expr(KIND).alias("kind"), (F.col("id") % 10 == 0).cast("int").alias("is_directory"), "file_path",
        (F.col("read_size") + F.col("write_size")).alias("file_size"), F.expr(ENTRY_TEXT).alias("entry_info"),
        F.col("access_time").alias("seen_at"))
    events = ingest.ingest_events(notes)
    path = ingest.drain(t.spark, lambda out, ckpt: ingest.append_to(events, out, ckpt, NOW), "ingest")
    return t.spark.read.schema(events.schema).parquet(path).withColumn("access_time", F.col("access_time").cast("timestamp_ntz"))


@query("st_metadata", """
SELECT file_path, min(access_time) AS first_seen, max(access_time) AS last_seen,
  arg_max(size, (access_time, id)) AS file_size, arg_max(chunk, (access_time, id)) AS chunk_size
FROM (SELECT *, read_size + write_size AS size, 64 * (1 + id % 8) AS chunk FROM accesses) GROUP BY 1""")
def _(t: Tables):
    events = live_accesses(t).withColumns({"file_size": F.col("read_size") + F.col("write_size"), "chunk_size": 64 * (1 + F.col("id") % 8)})
    path = ingest.drain(t.spark, lambda out, ckpt: ingest.upsert_metadata(events, out, ckpt, NOW), "metadata")
    naive = {c: F.col(c).cast("timestamp_ntz") for c in ("first_seen", "last_seen")}
    return ingest.current_metadata(t.spark, path).withColumns(naive)


@query("st_throughput", """
SELECT file_path, start_time, min(ingest_id) AS ingest_id, arg_min(operation_type, ingest_id) AS operation_type,
  arg_min(bytes_transferred, ingest_id) AS bytes_transferred, round(arg_min(throughput_mbps, ingest_id), 6) AS throughput_mbps
FROM tput GROUP BY 1, 2""")
def _(t: Tables):
    """The first copy of every transfer and its rate. The whole table is one batch, so a day's delay loses nothing of it."""
    path = ingest.drain(t.spark, lambda out, ckpt: ingest.publish_throughput(timed_transfers(t), out, ckpt, NOW, delay="1 day"), "throughput")
    stored = ingest.current_throughput(t.spark, path).drop("end_time")
    return rounded(stored.withColumn("start_time", F.col("start_time").cast("timestamp_ntz")))


@query("st_throughput_append", """
SELECT file_path, start_time, count(*) AS row_count FROM (SELECT DISTINCT file_path, start_time FROM tput) GROUP BY 1, 2""")
def _(t: Tables):
    """The same as an append-only stream that drops later copies."""
    rates = ingest.record_throughput(timed_transfers(t), delay="1 day")
    path = ingest.drain(t.spark, lambda out, ckpt: ingest.append_to(rates, out, ckpt, NOW), "throughput")
    stored = t.spark.read.schema(rates.schema).parquet(path).withColumn("start_time", F.col("start_time").cast("timestamp_ntz"))
    return stored.groupBy("file_path", "start_time").agg(F.count(F.lit(1)).alias("row_count"))


@query("st_retention", """
SELECT 'file_access' AS table_name, count(*) AS deleted FROM accesses WHERE access_time < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY
UNION ALL SELECT 'throughput_metrics', count(*) FROM tput WHERE start_time < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY
UNION ALL SELECT 'file_metadata', count(*) FROM files WHERE file_path NOT IN (
  SELECT file_path FROM accesses WHERE access_time >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY)""")
def _(t: Tables):
    return profiles.apply_retention(t.accesses, t.tput, t.files, 7, AS_OF)["deleted"]


@query("st_retention_kept", """
SELECT 'file_access' AS table_name, count(*) AS row_count FROM accesses WHERE access_time >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY
UNION ALL SELECT 'throughput_metrics', count(*) FROM tput WHERE start_time >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY
UNION ALL SELECT 'file_metadata', count(*) FROM files WHERE file_path IN (
  SELECT file_path FROM accesses WHERE access_time >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY)""")
def _(t: Tables):
    kept = profiles.apply_retention(t.accesses, t.tput, t.files, 7, AS_OF)
    parts = [kept[n].agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("table_name"), "row_count")
             for n in ("file_access", "throughput_metrics", "file_metadata")]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@query("st_retention_stored", """
SELECT 'file_access' AS table_name, count(*) FILTER (WHERE old) AS deleted, count(*) FILTER (WHERE NOT old) AS row_count,
  0::BIGINT AS days_before FROM (SELECT access_time < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY AS old FROM accesses)
UNION ALL SELECT 'throughput_metrics', count(*) FILTER (WHERE old), count(*) FILTER (WHERE NOT old), 0
  FROM (SELECT start_time < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY AS old FROM tput)
UNION ALL SELECT 'file_metadata', count(*) FILTER (WHERE old), count(*) FILTER (WHERE NOT old), 0 FROM (SELECT file_path NOT IN (
  SELECT file_path FROM accesses WHERE access_time >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY) AS old FROM files)""")
def _(t: Tables):
    """The same on the stored tables: what goes, what is left on disk, and how many of its days and months lie before the cut-off."""
    base = stored_tables(t)
    deleted = logs.retain(t.spark, base, 7, AS_OF)
    left = logs.load_tables(t.spark, base)
    early = {n: F.count_distinct(F.when(F.col(d) < F.lit(first).cast("date"), F.col(d)))
             for n, d, first in (("file_access", "access_date", "2024-01-24"), ("throughput_metrics", "start_month", "2024-01-01")) if d in left[n].columns}
    parts = [left[n].agg(F.count(F.lit(1)).alias("row_count"), early.get(n, F.lit(0).cast("bigint")).alias("days_before"))
             .select(F.lit(n).alias("table_name"), "*") for n in ("file_access", "throughput_metrics", "file_metadata")]
    return deleted.join(parts[0].unionAll(parts[1]).unionAll(parts[2]), "table_name")


@query("st_new_rows", """
SELECT 'batch' AS kind, count(*) AS new_rows FROM accesses WHERE access_time > TIMESTAMP '2024-01-20 00:00:00'
UNION ALL SELECT 'stream', count(*) FROM accesses WHERE access_time > TIMESTAMP '2024-01-20 00:00:00'""")
def _(t: Tables):
    since = "2024-01-20 00:00:00"
    counted = ingest.count_stream(live_accesses(t), "access_time", since)

    def start(out, ckpt):
        return (counted.writeStream.outputMode("complete").foreachBatch(lambda b, _: b.write.mode("overwrite").parquet(out))
                .option("checkpointLocation", ckpt).trigger(**NOW).start())

    streamed = t.spark.read.schema("new_rows bigint").parquet(ingest.drain(t.spark, start, "new-rows"))
    batch = profiles.new_rows(t.accesses, "access_time", since)
    return batch.select(F.lit("batch").alias("kind"), "new_rows").unionAll(streamed.select(F.lit("stream"), "new_rows"))


@query("st_scan_loop", f"""
SELECT file_path, CAST(chunk_size AS BIGINT) AS old_chunk_size, CAST(least(greatest(chunk, 64), 4096) AS BIGINT) AS new_chunk_size, round(best, 6) AS confidence
FROM {BEST_OF_FILES} WHERE chunk_size <> least(greatest(chunk, 64), 4096)
  AND file_path IN (SELECT file_path FROM accesses GROUP BY file_path HAVING count(*) >= 5)""")
def _(t: Tables):
    path = ingest.drain(t.spark, lambda out, ckpt: ingest.scan_loop(
        live_accesses(t), live_transfers(t), lambda: t.files, closed_form, out, ckpt, trigger=NOW), "scan-loop")
    return rounded(ingest.current_plan(t.spark, path))


ACTIVITY = """
SELECT window_start, window_start + INTERVAL 24 HOUR AS window_end, count(*) AS events, count(*) FILTER (WHERE access_type = 'read') AS read_events,
  count(*) FILTER (WHERE access_type = 'write') AS write_events
FROM (SELECT access_type, unnest(generate_series(date_trunc('hour', access_time) - INTERVAL 23 HOUR, date_trunc('hour', access_time), INTERVAL 1 HOUR)) AS window_start
  FROM accesses) GROUP BY 1"""


@query("st_activity", ACTIVITY)
def _(t: Tables):
    batch = ingest.live_activity(t.accesses.withColumn("access_time", F.col("access_time").cast("timestamp")))
    return batch.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


@query("st_activity_stream", ACTIVITY)
def _(t: Tables):
    path = ingest.drain(t.spark, lambda out, ckpt: ingest.publish_activity(live_accesses(t), out, ckpt, NOW), "activity")
    live = ingest.current_activity(t.spark, path)
    return live.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})
