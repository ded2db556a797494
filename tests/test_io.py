import pytest
from pyspark.sql import functions as F

from accesslake import schemas
from accesslake.operators.profiles import dedup_throughput, latest_metadata, throughput_rows
from accesslake.sources import logs, sinks
from accesslake.streaming import ingest

NOW = {"availableNow": True}
V1 = ",".join(schemas.ACCESS_LOG_V1.names)


def write(path, *lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_log_checks(spark, tmp_path):
    good = write(tmp_path / "a.csv", V1, "/f,1,2,3,4,5,6,7,8,9,1.5")
    assert logs.read_access_log(spark, good).first()["throughput_mbps"] == 1.5
    with pytest.raises(ValueError, match="not a CSV"):
        logs.read_access_log(spark, str(tmp_path / "a.txt"))
    with pytest.raises(ValueError, match="missing values"):
        logs.read_access_log(spark, write(tmp_path / "b.csv", V1, "/f,1,,3,4,5,6,7,8,9,1.5"))
    with pytest.raises(ValueError, match="lacks the columns"):
        logs.read_access_log(spark, write(tmp_path / "c.csv", "file_path,file_size", "/f,1"))


def test_bench_log_in_any_column_order(spark, tmp_path):
    path = write(tmp_path / "b.csv", "throughput_KBps,chunk_size_KB,note,file_size_KB,file_path", "10.5,64,x,1024,/f")
    row = logs.read_bench_log(spark, path).first()
    assert (row["file_path"], row["file_size_KB"], row["chunk_size_KB"], row["throughput_KBps"]) == ("/f", 1024, 64, 10.5)


def test_scan(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, size in (("a.log", 5), ("b.LOG", 5), ("c.log", 50), ("sub/d.log", 5)):
        (tmp_path / name).write_bytes(b"x" * size)
    found = logs.scan_files(spark, str(tmp_path), recursive=True, suffixes=[".log"], min_size=1, max_size=10)
    assert sorted(r["path"].rsplit("/", 1)[1] for r in found.where("kept").collect()) == ["a.log", "d.log"]
    assert tuple(logs.scan_counts(found).first()) == (2, 2)
    assert logs.scan_files(spark, str(tmp_path), suffixes=[".log"]).where("kept").count() == 2


def test_report_without_figures(spark, tmp_path):
    block = ["Test Combination:", "  File Size    = 10 MB", "  Chunk Size   = 64 KB", "  Block Size   = 1M", "Results:",
             "  DD Write : Time =  sec, Throughput =  MB/s", "  DD Read  : Time = 2.5 sec, Throughput = .40 MB/s",
             "  FIO Write: Bandwidth = N/A", "  FIO Read : Bandwidth = 12MiB/s (13MB/s)", logs.REPORT_RULE]
    rows = logs.read_trial_report(spark, write(tmp_path / "r.txt", *block, *block)).collect()
    assert len(rows) == 2
    r = rows[0]
    assert (r["file_size_mb"], r["chunk_size_kb"], r["block_size"], r["dd_write_seconds"], r["dd_read_seconds"], r["dd_read_mbps"]) == (
        10, 64, "1M", None, 2.5, 0.4)
    assert r["fio_write_bandwidth"] is None and r["fio_read_bandwidth"] == "12MiB/s (13MB/s)"


def test_csv_round_trip(spark, tmp_path):
    sinks.write_csv(spark.range(3), str(tmp_path / "o"))
    assert spark.read.option("header", True).schema("id bigint").csv(str(tmp_path / "o")).count() == 3


def test_files_whose_columns_differ_in_order_are_an_error(spark, tmp_path):
    import pytest
    from accesslake.sources.logs import read_bench_log
    row = spark.createDataFrame([("/a", 64, 128, 5.0)], "file_path string, file_size_KB bigint, chunk_size_KB bigint, throughput_KBps double")
    row.coalesce(1).write.option("header", True).csv(str(tmp_path / "logs"))
    assert read_bench_log(spark, str(tmp_path / "logs")).count() == 1
    row.select(*reversed(row.columns)).coalesce(1).write.mode("append").option("header", True).csv(str(tmp_path / "logs"))
    with pytest.raises(Exception):
        read_bench_log(spark, str(tmp_path / "logs")).collect()


EVENTS = "id bigint, file_path string, access_time timestamp, file_size bigint, chunk_size bigint"


def test_metadata_over_batches_equals_one_batch(spark, tmp_path):
    source = tmp_path / "in"
    rows = spark.range(300).select(
        "id", F.concat(F.lit("/f"), (F.col("id") % 17).cast("string")).alias("file_path"),
        F.timestamp_seconds((F.col("id") * 7919) % 1000).alias("access_time"), (F.col("id") * 3).alias("file_size"),
        (F.col("id") % 4 * 64).alias("chunk_size"))
    for part in range(3):
        rows.where(F.col("id") % 3 == part).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(source))
        ingest.upsert_metadata(stream, str(tmp_path / "out"), str(tmp_path / "ckpt"), NOW).awaitTermination()
    columns = ["file_path", "file_size", "chunk_size", "first_seen", "last_seen"]
    streamed = ingest.current_metadata(spark, str(tmp_path / "out")).select(*columns)
    whole = latest_metadata(rows).select(*columns)
    assert streamed.exceptAll(whole).isEmpty() and whole.exceptAll(streamed).isEmpty()


def test_first_transfer_wins(spark, tmp_path):
    kind = "ingest_id bigint, file_path string, start_time timestamp, end_time timestamp, bytes_transferred bigint, operation_type string"
    rows = spark.range(60).select(
        F.col("id").alias("ingest_id"), F.concat(F.lit("/f"), (F.col("id") % 5).cast("string")).alias("file_path"),
        F.timestamp_seconds(10 ** 9 + F.col("id") % 10).alias("start_time"), F.timestamp_seconds(10 ** 9 + F.col("id") % 10 + F.col("id") % 3).alias("end_time"),
        (F.col("id") * 1000).alias("bytes_transferred"), F.lit("read").alias("operation_type"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
    ingest.append_to(ingest.record_throughput(stream, "1 day"), str(tmp_path / "out"), str(tmp_path / "ckpt"), NOW).awaitTermination()
    streamed = spark.read.parquet(str(tmp_path / "out")).select("file_path", "start_time")
    batch = dedup_throughput(throughput_rows(rows)).select("file_path", "start_time")
    assert streamed.exceptAll(batch).isEmpty() and batch.exceptAll(streamed).isEmpty()
