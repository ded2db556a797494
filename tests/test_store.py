"""The stored log: pruning by day, retention on disk, change logs, and plans kept by a stream."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from accesslake.operators import profiles
from accesslake.operators.common import lookback
from accesslake.plans.recommend import change_plan, closed_form
from accesslake.sources import logs
from accesslake.sources.versions import ChangeLog, Folder, current_path, replace
from accesslake.streaming import ingest

AS_OF = "2024-01-31 12:00:00"
NOW = {"availableNow": True}


def at(day, hour=0):
    return dt.datetime(2024, 1, day, hour, tzinfo=dt.timezone.utc)


@pytest.fixture
def store(spark, tmp_path):
    accesses = [(i, f"/f{i % 7}", "read" if i % 3 else "write", at(1 + i % 30, i % 24), i, 2 * i) for i in range(600)]
    accesses += [(1000, "/old", "read", at(2), 1, 1), (1001, "/edge", "read", at(24, 12), 1, 1), (1002, "/none", "read", None, 1, 1)]
    transfers = [(f"/f{i % 7}", at(1 + i % 30, i % 24), at(1 + i % 30, i % 24), 10, "read", float(i)) for i in range(300)]
    files = [(p, 1 << 20, 512, at(1), at(30)) for p in [f"/f{k}" for k in range(7)] + ["/old", "/edge", "/none", "/never"]]
    base = str(tmp_path / "store")
    logs.save_tables({
        "file_access": spark.createDataFrame(accesses, logs.schemas.FILE_ACCESS), "file_metadata": spark.createDataFrame(files, logs.schemas.FILE_METADATA),
        "throughput_metrics": spark.createDataFrame(transfers, logs.schemas.THROUGHPUT),
        "optimization_history": spark.createDataFrame([], logs.schemas.OPTIMIZATION_HISTORY)}, base)
    return base


def scans(df):
    """The partition filters of the scans in the plan."""
    text = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return [line for line in text.splitlines() if "PartitionFilters" in line]


def test_lookbacks_open_their_days_only(spark, store):
    t = logs.load_tables(spark, store)
    recent = lookback(t["file_access"], "access_time", 7, AS_OF)
    assert len(scans(recent)) == 1 and "access_date" in scans(recent)[0]
    whole = t["file_access"].where(F.col("access_time") > F.lit("2024-01-24 12:00:00").cast("timestamp"))
    assert recent.count() == whole.count() > 100
    opened = recent.select(F.input_file_name().alias("f")).distinct().collect()
    assert all("access_date=2024-01-2" in r.f or "access_date=2024-01-3" in r.f for r in opened)
    profiled = profiles.file_profiles(t["file_metadata"], t["file_access"], t["throughput_metrics"], AS_OF, 7)
    assert {"access_date" in s or "start_month" in s for s in scans(profiled)} == {True}
    assert profiled.count() == 11


def test_days_are_those_of_utc_in_every_session(spark, store):
    wanted = lookback(logs.load_tables(spark, store)["file_access"], "access_time", 7, AS_OF + "Z").count()
    try:
        for zone in ("Pacific/Kiritimati", "Pacific/Pago_Pago"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert lookback(logs.load_tables(spark, store)["file_access"], "access_time", 7, AS_OF + "Z").count() == wanted
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_retention_on_disk(spark, store):
    t = logs.load_tables(spark, store)
    plain = {n: t[n].drop("access_date", "start_month") for n in t}
    wanted = {r.table_name: r.deleted for r in profiles.apply_retention(
        plain["file_access"], plain["throughput_metrics"], plain["file_metadata"], 7, AS_OF)["deleted"].collect()}
    got = {r.table_name: r.deleted for r in logs.retain(spark, store, 7, AS_OF).collect()}
    assert got == wanted and got["file_metadata"] == 2  # /old has lost its accesses, /never had none
    left = logs.load_tables(spark, store)
    assert {r.file_path for r in left["file_metadata"].collect()} == {*(f"/f{k}" for k in range(7)), "/edge", "/none"}
    assert left["file_access"].where("access_time < timestamp'2024-01-24 12:00:00'").count() == 0
    assert left["file_access"].where("access_time IS NULL").count() == 1 and left["file_access"].where("file_path = '/edge'").count() == 1
    days = [n for n in Folder(spark, f"{store}/file_access").names() if n.startswith("access_date=2")]
    assert min(days) == "access_date=2024-01-24"
    assert {r.deleted for r in logs.retain(spark, store, 7, AS_OF).collect()} == {0}
    # everything goes
    logs.retain(spark, store, 0, "2025-01-01 00:00:00")
    assert logs.load_tables(spark, store)["file_access"].count() == 1


def test_retention_reads_accesses_once(spark, store):
    t = logs.load_tables(spark, store)
    kept = profiles.apply_retention(t["file_access"], t["throughput_metrics"], t["file_metadata"], 7, AS_OF)
    assert not any("access_date" in s for s in scans(kept["deleted"]))  # the counts stand in the stored table
    assert any("access_date" in s for s in scans(kept["file_access"]))


def test_replace(spark, tmp_path):
    path = str(tmp_path / "t")
    assert current_path(spark, path) == path
    for n in range(4):
        replace(spark.range(n + 1), path)
        replace(spark.read.parquet(current_path(spark, path)).where(f"id < {n}"), path)
        assert spark.read.parquet(current_path(spark, path)).count() == n
    assert len([x for x in Folder(spark, path).names() if x.startswith("v")]) == 2


def test_change_log(spark, tmp_path):
    log = ChangeLog(spark, str(tmp_path / "log"), "k long, v long", ["k"], every=3)
    assert log.rows().count() == 0
    state = {}
    for b in range(11):
        changes = {k: 100 * b + k for k in range(b % 4, 8, 3)}
        state |= changes
        rows = spark.createDataFrame([*changes.items()], "k long, v long")
        log.store(rows, b)
        if b % 2:
            log.store(rows, b)  # the same batch once more
        assert {r.k: r.v for r in log.rows().collect()} == state
        assert len(log.parts()) <= 4
    names = log.folder.names()
    assert len([n for n in names if n.startswith("snapshot")]) <= 2 and len([n for n in names if n.startswith("batch")]) <= 7


def test_change_log_after_a_stop(spark, tmp_path, monkeypatch):
    """A writer that stops between the snapshot and the pointer, or in the middle of a snapshot, loses nothing."""
    log = ChangeLog(spark, str(tmp_path / "log"), "k long, v long", ["k"], every=2)
    rows = lambda b: spark.createDataFrame([(b, b), (99, b)], "k long, v long")
    log.store(rows(0), 0)

    def stop(version):
        raise RuntimeError("stopped")

    monkeypatch.setattr(log.folder, "point_to", stop)
    with pytest.raises(RuntimeError):
        log.store(rows(1), 1)
    again = ChangeLog(spark, str(tmp_path / "log"), "k long, v long", ["k"], every=2)
    assert {r.k: r.v for r in again.rows().collect()} == {0: 0, 1: 1, 99: 1}
    again.store(rows(1), 1)  # the batch runs again, and is merged over what was left
    assert again.parts() == ["snapshot=1"]
    assert {r.k: r.v for r in again.rows().collect()} == {0: 0, 1: 1, 99: 1}


def test_plan_kept_by_a_stream(spark, tmp_path):
    """After every batch the stored plan equals the plan over all rows so far."""
    accesses, transfers = str(tmp_path / "accesses"), str(tmp_path / "transfers")
    files = spark.createDataFrame([(f"/f{k}", 300_000 * (k + 1), 64 << k % 5) for k in range(12)], "file_path string, file_size long, chunk_size long")
    predict = closed_form(lambda c: 1.0 / (1.0 + F.abs(c - F.col("access_count") * 40.0 - F.col("throughput_mbps"))), (64.0, 128.0, 256.0, 512.0, 1024.0))
    shapes = {accesses: "file_path string, access_type string, read_size long, write_size long", transfers: "file_path string, throughput_mbps double"}
    seen = 0
    for b in range(5):
        spark.createDataFrame([(f"/f{(i * (b + 1)) % 13}", "read" if i % 2 else "write", i, None if i % 5 else b) for i in range(10 + 9 * b)],
                              shapes[accesses]).write.mode("append").parquet(accesses)
        spark.createDataFrame([(f"/f{(i + b) % 12}", 10.0 * b + i) for i in range(b * 2)], shapes[transfers]).write.mode("append").parquet(transfers)
        streams = [spark.readStream.schema(s).parquet(p) for p, s in shapes.items()]
        ingest.scan_loop(*streams, lambda: files, predict, str(tmp_path / "plan"), str(tmp_path / "ckpt"), trigger=NOW, every=2).awaitTermination()
        wanted = change_plan(files, spark.read.schema(shapes[accesses]).parquet(accesses), spark.read.schema(shapes[transfers]).parquet(transfers),
                             predict, min_access=5)
        got = ingest.current_plan(spark, str(tmp_path / "plan"))
        rows = [{(r.file_path, r.old_chunk_size, r.new_chunk_size, round(r.confidence, 9)) for r in d.collect()} for d in (got, wanted)]
        assert rows[0] == rows[1]
        seen += len(rows[0])
    assert seen > 10


def test_rates_kept_by_a_stream(spark, tmp_path):
    """Copies of a transfer in any order and batch: the first ingested stays; too late ones are not seen."""
    path = str(tmp_path / "transfers")
    kinds = "ingest_id long, file_path string, start_time timestamp, end_time timestamp, bytes_transferred long, operation_type string"

    def arrive(*rows):
        spark.createDataFrame([(i, f, s, s + dt.timedelta(seconds=d), b, "read") for i, f, s, d, b in rows], kinds).write.mode("append").parquet(path)
        ingest.publish_throughput(spark.readStream.schema(kinds).parquet(path), str(tmp_path / "out"), str(tmp_path / "ckpt"), NOW, "2 days",
                                  every=2).awaitTermination()
        return {(r.file_path, r.start_time.day): (r.ingest_id, r.throughput_mbps) for r in ingest.current_throughput(spark, str(tmp_path / "out")).collect()}

    mb = 1 << 20
    assert arrive((5, "/a", at(3), 1, 5 * mb), (2, "/a", at(3), 1, 2 * mb), (3, "/b", at(3), 0, mb)) == {("/a", 3): (2, 2.0)}
    assert arrive((7, "/a", at(3), 1, 7 * mb), (8, "/b", at(4), 2, mb), (1, "/c", at(4), 1, mb)) == {("/a", 3): (2, 2.0), ("/b", 4): (8, 0.5), ("/c", 4): (1, 1.0)}
    wanted = {("/a", 3): (2, 2.0), ("/b", 4): (8, 0.5), ("/c", 4): (1, 1.0), ("/a", 20): (9, 1.0)}
    assert arrive((9, "/a", at(20), 1, mb)) == wanted
    assert arrive((10, "/d", at(5), 1, mb), (11, "/a", at(20), 1, 3 * mb)) == wanted  # the fifth is long past
