"""Sources, sinks, filters, cleaning, joins, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from accesslake import schemas
from accesslake.functions import sizing
from accesslake.operators import candidates, clean, profiles, som, stats, trials
from accesslake.operators.common import lookback
from accesslake.operators.models import load_model, require_samples, save_model
from accesslake.plans.monitor import export_training_data
from accesslake.session import work_dir
from accesslake.sources import logs, sinks
from .registry import Tables, query, rounded

AS_OF = "2024-01-31 00:00:00"
ORDERS_AS_OF = "2001-08-02 00:00:00"
HISTORY_AS_OF = "2001-11-05 00:00:00"
EXTENSIONS = (".txt", ".csv", ".gz")

# -- sources and sinks ----------------------------------------------------------------------------


@query("src_log_v1", """
SELECT file_path, file_size, chunk_size, access_count, avg_read_size AS avg_read_size,
  avg_write_size AS avg_write_size, max_read_size, max_write_size, read_count, write_count,
  throughput_mbps AS throughput_mbps
FROM v1""")
def _(t: Tables):
    path = work_dir(t.spark, "v1") + ".csv"
    sinks.write_csv(t.v1.drop("k1", "k2", "k3"), path)
    return logs.read_access_log(t.spark, path)


@query("src_log_v2", """
SELECT file_path, file_size_kb AS "file_size_KB", chunk_size_kb AS "chunk_size_KB", access_count,
  avg_read_kb AS "avg_read_KB", avg_write_kb AS "avg_write_KB", max_read_kb AS "max_read_KB",
  max_write_kb AS "max_write_KB", read_ops, write_ops, throughput_kbps AS "throughput_KBps",
  CAST(NULL AS VARCHAR) AS error_message
FROM bench_log""")
def _(t: Tables):
    path = work_dir(t.spark, "v2") + ".csv"
    named = {c.lower(): c for c in schemas.BENCH_LOG_V2.names}
    log = t.bench_log.drop("k1", "k2", "k3").withColumnsRenamed({k: v for k, v in named.items()})
    sinks.write_csv(log.withColumn("error_message", F.lit(None).cast("string")), path)
    return logs.read_bench_log(t.spark, path)


@query("src_min_samples", "SELECT count(*) AS row_count FROM bench_log HAVING count(*) >= 100")
def _(t: Tables):
    return require_samples(t.bench_log, 100).agg(F.count(F.lit(1)).alias("row_count"))


def stored_tables(t: Tables) -> str:
    """The given tables as a log store in a folder of its own."""
    base = work_dir(t.spark, "tables")
    now = F.lit(AS_OF).cast("timestamp")
    logs.save_tables({
        "file_access": t.accesses.withColumn("access_time", F.col("access_time").cast("timestamp")),
        "file_metadata": t.files.withColumn("first_seen", now).withColumn("last_seen", now),
        "throughput_metrics": t.tput.withColumns({c: F.col(c).cast("timestamp") for c in ("start_time", "end_time")}),
        "optimization_history": t.history.withColumn("optimization_time", F.col("optimization_time").cast("timestamp"))
        .withColumn("id", F.xxhash64("file_path", "optimization_time")),
    }, base)
    return base


@query("src_tables", """
SELECT 'file_access' AS table_name, count(*) AS row_count, sum(read_size + write_size)::BIGINT AS total FROM accesses
UNION ALL SELECT 'file_metadata', count(*), sum(file_size)::BIGINT FROM files
UNION ALL SELECT 'throughput_metrics', count(*), sum(bytes_transferred)::BIGINT FROM tput
UNION ALL SELECT 'optimization_history', count(*), sum(new_chunk_size)::BIGINT FROM history""")
def _(t: Tables):
    loaded = logs.load_tables(t.spark, stored_tables(t))
    total = {"file_access": F.sum(F.col("read_size") + F.col("write_size")), "file_metadata": F.sum("file_size"),
             "throughput_metrics": F.sum("bytes_transferred"), "optimization_history": F.sum("new_chunk_size")}
    parts = [loaded[n].agg(F.count(F.lit(1)).alias("row_count"), s.alias("total")).select(F.lit(n).alias("table_name"), "*")
             for n, s in total.items()]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])


@query("src_files")
def _(t: Tables):
    scanned = logs.scan_files(t.spark, t.sf_dir, recursive=True, suffixes=[".parquet"], min_size=1)
    return scanned.where("kept").select("path", "length")


ENTRY_TEXT = "concat('EntryID: 0-1 ', CASE id % 5 WHEN 0 THEN 'Chunksize: 512K' WHEN 1 THEN 'chunkSize:2M' WHEN 2 THEN " \
             "concat('ChunkSize: ', CAST(id AS STRING)) WHEN 3 THEN 'Chunksize: 1G, chunksize: 3K' ELSE 'no stripe' END)"


@query("src_entry_info", """
SELECT id, CAST(CASE id % 5 WHEN 0 THEN 512 WHEN 1 THEN 2048 WHEN 2 THEN id // 1024 WHEN 3 THEN 1048576 ELSE 512 END AS BIGINT) AS watcher_kb,
  CAST(CASE id % 5 WHEN 0 THEN 512 WHEN 1 THEN 2048 WHEN 2 THEN id // 1024 WHEN 3 THEN 1048576 END AS BIGINT) AS optimizer_kb
FROM accesses""")
def _(t: Tables):
    text = F.expr(ENTRY_TEXT)
    return t.accesses.select("id", sizing.parse_chunk_kb(text, 512).alias("watcher_kb"),
                             sizing.parse_chunk_kb(text).alias("optimizer_kb"))


@query("src_trial_report", """
SELECT CAST(file_size_mb AS BIGINT) AS file_size_mb, new_chunk_size AS chunk_size_kb,
  CASE WHEN trial_id % 2 = 0 THEN '256K' ELSE '1M' END AS block_size,
  CAST(trial_id % 9 + 1 AS DOUBLE) AS dd_write_seconds, before_write_speed AS dd_write_mbps,
  CAST(trial_id % 4 + 1 AS DOUBLE) AS dd_read_seconds, before_read_speed AS dd_read_mbps,
  CASE WHEN trial_id % 3 > 0 THEN concat(CAST(trial_id % 700 AS STRING), 'MiB/s (', CAST(trial_id % 734 AS STRING), 'MB/s)') END AS fio_write_bandwidth,
  CASE WHEN trial_id % 5 > 0 THEN concat(CAST(trial_id % 900 AS STRING), 'MiB/s') END AS fio_read_bandwidth
FROM trials""")
def _(t: Tables):
    path = work_dir(t.spark, "report")
    n = F.col("trial_id")

    def text(c):
        return c.cast("string")

    block = F.concat(
        F.lit("Test Combination:\n  File Size    = "), text(F.col("file_size_mb").cast("bigint")), F.lit(" MB\n  Chunk Size   = "),
        text(F.col("new_chunk_size")), F.lit(" KB\n  Block Size   = "), F.when(n % 2 == 0, "256K").otherwise("1M"),
        F.lit("\nResults:\n  DD Write : Time = "), text(n % 9 + 1), F.lit(" sec, Throughput = "), text(F.col("before_write_speed")),
        F.lit(" MB/s\n  DD Read  : Time = "), text(n % 4 + 1), F.lit(" sec, Throughput = "), text(F.col("before_read_speed")),
        F.lit(" MB/s\n  FIO Write: Bandwidth = "),
        F.when(n % 3 > 0, F.concat(text(n % 700), F.lit("MiB/s ("), text(n % 734), F.lit("MB/s)"))).otherwise("N/A"),
        F.lit("\n  FIO Read : Bandwidth = "), F.when(n % 5 > 0, F.concat(text(n % 900), F.lit("MiB/s"))).otherwise("N/A"),
        F.lit("\n" + logs.REPORT_RULE))
    t.trials.select(block.alias("value")).write.text(path)
    return logs.read_trial_report(t.spark, path)


@query("src_block_size", """
SELECT trial_id, CASE trial_id % 3 WHEN 0 THEN (trial_id % 512 + 1) * 1024 WHEN 1 THEN (trial_id % 16 + 1) * 1048576
  ELSE trial_id END AS block_bytes
FROM trials""")
def _(t: Tables):
    n = F.col("trial_id")
    text = (F.when(n % 3 == 0, F.concat((n % 512 + 1).cast("string"), F.lit("K")))
            .when(n % 3 == 1, F.concat((n % 16 + 1).cast("string"), F.lit("M"))).otherwise(n.cast("string")))
    return t.trials.select("trial_id", sizing.parse_block_bytes(text).alias("block_bytes"))


@query("sink_csv", """
SELECT file_path, file_size, chunk_size, access_count, read_count, write_count FROM profiles""")
def _(t: Tables):
    path = work_dir(t.spark, "export") + ".csv"
    wanted = ["file_path", "file_size", "chunk_size", "access_count", "read_count", "write_count"]
    sinks.write_csv(profiles.file_profiles(t.files, t.accesses, t.tput).select(*wanted), path)
    kinds = "file_path string, file_size bigint, chunk_size bigint, access_count bigint, read_count bigint, write_count bigint"
    return t.spark.read.option("header", True).schema(kinds).csv(path)


@query("sink_model_info", """
SELECT round(quantile_cont(throughput_kbps, 0.65), 4) AS global_threshold, 2 AS feature_count,
  round(avg(avg_read_kb), 6) AS mean_logloss, '2024-01-31 00:00:00' AS trained_at
FROM bench_log""")
def _(t: Tables):
    from accesslake.operators.quantiles import global_quantile
    path = work_dir(t.spark, "model-info")
    limits = global_quantile(t.bench_log, "throughput_kbps", 0.65, "value").select(F.lit("global_throughput").alias("name"), "value")
    cv = t.bench_log.agg(F.avg("avg_read_kb").alias("mean")).select(F.lit("logloss").alias("metric"), "mean")
    sinks.write_model_info(sinks.model_info(t.spark, ["file_size_kb", "chunk_size_kb"], limits, cv, AS_OF), path)
    return sinks.read_model_info(t.spark, path).select(
        F.round(F.col("thresholds")["global_throughput"], 4).alias("global_threshold"),
        F.size("features").alias("feature_count"), F.round(F.col("metrics")["logloss"], 6).alias("mean_logloss"),
        F.date_format("trained_at", "yyyy-MM-dd HH:mm:ss").alias("trained_at"))


STORED = """
SELECT file_path, count(*) AS row_count, 0::BIGINT AS differing, (SELECT count(DISTINCT chunk_size_kb) FROM bench_log)::INT AS candidates
FROM bench_log GROUP BY 1"""
STORED_FEATURES = ["file_size_kb", "chunk_size_kb", "access_count", "read_ops", "write_ops"]


def differing(log, before, after):
    """Rows of each file, and how many get another probability from the one model than from the other."""
    from accesslake.operators.models import with_probability
    both = with_probability(after, with_probability(before, log).withColumnRenamed("p", "_p"))
    return both.groupBy("file_path").agg(F.count(F.lit(1)).alias("row_count"), F.count_if(~F.col("p").eqNullSafe(F.col("_p"))).alias("differing"))


@query("sink_model", STORED)
def _(t: Tables):
    from accesslake.operators.models import fit_rf_stack
    log = t.bench_log.withColumn("OT", (F.col("throughput_kbps") > 50000).cast("int"))
    path = work_dir(t.spark, "model")
    fitted = fit_rf_stack(log, STORED_FEATURES)
    save_model(fitted, candidates.candidate_list(log), path, t.spark)
    model, chunks = load_model(path, t.spark)
    return differing(log, fitted, model).withColumn("candidates", F.lit(len(chunks)))


@query("sink_model_boosted", """
SELECT file_path, count(*) AS row_count, 0::BIGINT AS differing, 5::BIGINT AS folds, true AS same_metrics,
  (SELECT round(quantile_cont(throughput_kbps, 0.65), 4) FROM bench_log) AS global_threshold
FROM bench_log GROUP BY 1""")
def _(t: Tables):
    """Boosted trees with thresholds and metrics, stored twice over and loaded."""
    from accesslake.operators.models import METRICS, load_boosted, save_boosted
    from accesslake.plans.train import train_gbt
    path = work_dir(t.spark, "boosted")
    fit = train_gbt(t.bench_log, ["k1", "k2", "k3"], STORED_FEATURES)
    save_boosted(fit, path, t.spark, AS_OF)
    save_boosted(fit, path, t.spark, AS_OF)
    again, facts = load_boosted(path, t.spark)
    means = again.folds.agg(*[F.avg(m).alias(m) for m in METRICS]).first().asDict()
    same = all(abs(means[m] - facts["metrics"][m]) < 1e-9 for m in METRICS) and facts["features"] == STORED_FEATURES
    limit = {r["name"]: r["value"] for r in again.thresholds.collect()}["global_threshold"]
    return differing(t.bench_log, fit.model, again.model).withColumns({
        "folds": F.lit(again.folds.count()), "same_metrics": F.lit(same), "global_threshold": F.round(F.lit(limit), 4)})


# -- filters and cleaning -------------------------------------------------------------------------

EVENT_TYPE = "CASE WHEN id % 11 = 0 THEN 'rename' ELSE access_type END"


@query("flt_validate_event", """
SELECT coalesce(reason, 'valid') AS reason, count(*) AS row_count, sum(id)::BIGINT AS id_sum FROM (
  SELECT id, CASE WHEN id % 11 = 0 THEN 'access_type' WHEN id % 13 = 0 THEN 'file_size' WHEN id % 17 = 0 THEN 'chunk_size' END AS reason
  FROM accesses) GROUP BY 1""")
def _(t: Tables):
    events = t.accesses.select(
        "id", F.expr(EVENT_TYPE).alias("access_type"), F.expr("CASE WHEN id % 13 = 0 THEN -1 ELSE read_size END").alias("file_size"),
        F.expr("CASE WHEN id % 17 = 0 THEN -5 ELSE 512 END").alias("chunk_size"))
    good, bad = clean.validate_events(events)
    both = good.withColumn("reason", F.lit("valid")).unionByName(bad)
    return both.groupBy("reason").agg(F.count(F.lit(1)).alias("row_count"), F.sum("id").alias("id_sum"))


@query("flt_point", "SELECT file_path, chunk_size FROM files WHERE file_path = '/mnt/data/d0/f7.DAT'")
def _(t: Tables):
    return clean.lookup_file(t.files, "/mnt/data/d0/f7.DAT")


@query("flt_lookback", """
SELECT id, file_path, access_time FROM accesses WHERE access_time > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY""")
def _(t: Tables):
    return lookback(t.accesses, "access_time", 7, AS_OF).select("id", "file_path", "access_time")


@query("flt_lookback_stored", """
SELECT id, file_path, access_time FROM accesses WHERE access_time > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY""")
def _(t: Tables):
    """The same out of the stored table, of which only the days in question are opened."""
    stored = logs.load_tables(t.spark, stored_tables(t))["file_access"]
    return lookback(stored, "access_time", 7, AS_OF).select("id", "file_path", F.col("access_time").cast("timestamp_ntz"))


@query("flt_dynamic", """
SELECT DISTINCT f.file_path FROM files f JOIN accesses a ON f.file_path = a.file_path
WHERE f.file_size >= 1000000 AND f.file_size <= 800000000
  AND (SELECT count(*) FROM accesses x WHERE x.file_path = f.file_path) >= 5
  AND lower(regexp_extract(f.file_path, '[^/]*[^/.][^/]*(\\.[^./]*)$', 1)) IN ('.txt', '.csv', '.gz')""")
def _(t: Tables):
    return profiles.select_files(t.files, t.accesses, min_size=1_000_000, max_size=800_000_000, min_access=5, extensions=EXTENSIONS)


HOLES = {"throughput_kbps": 7, "chunk_size_kb": 11, "file_size_kb": 13}


def with_holes(t: Tables):
    return t.bench_log.withColumns(
        {c: F.when(F.col("k1") % n != 0, F.col(c)) for c, n in HOLES.items()})


@query("cln_dropna_subset", """
SELECT count(*) AS total, count(*) FILTER (WHERE k1 % 7 = 0 OR k1 % 11 = 0 OR k1 % 13 = 0) AS dropped,
  count(*) FILTER (WHERE NOT (k1 % 7 = 0 OR k1 % 11 = 0 OR k1 % 13 = 0)) AS kept
FROM bench_log""")
def _(t: Tables):
    holed = with_holes(t)
    kept = clean.drop_missing(holed, list(HOLES)).agg(F.count(F.lit(1)).alias("kept"))
    return clean.missing_count(holed, list(HOLES)).withColumn("kept", kept.scalar())


@query("cln_dropna_dedup", """
SELECT DISTINCT file_path, file_size_kb, chunk_size_kb, access_count FROM bench_log
WHERE k1 % 11 <> 0 AND k1 % 13 <> 0""")
def _(t: Tables):
    return clean.clean_rows(with_holes(t).select("file_path", "file_size_kb", "chunk_size_kb", "access_count"))


@query("cln_fill_zero", """
SELECT file_path, access_count, round(coalesce(avg_read_size, 0), 4) AS avg_read_size, coalesce(max_write_size, 0) AS max_write_size,
  round(coalesce(throughput_mbps, 0), 4) AS throughput_mbps FROM profiles""")
def _(t: Tables):
    filled = clean.fill_zero(profiles.file_profiles(t.files, t.accesses, t.tput))
    return rounded(filled.select("file_path", "access_count", "avg_read_size", "max_write_size", "throughput_mbps"), 4)


@query("cln_impute_median", """
SELECT k1, k2, k3, round(coalesce(CASE WHEN k1 % 7 <> 0 THEN throughput_kbps END, m.t), 4) AS throughput_kbps,
  CAST(coalesce(CASE WHEN k1 % 11 <> 0 THEN chunk_size_kb END, m.c) AS DOUBLE) AS chunk_size_kb
FROM bench_log, (SELECT quantile_cont(throughput_kbps, 0.5) FILTER (WHERE k1 % 7 <> 0) AS t,
  quantile_cont(chunk_size_kb, 0.5) FILTER (WHERE k1 % 11 <> 0) AS c FROM bench_log) m""")
def _(t: Tables):
    return rounded(clean.impute(with_holes(t), ["throughput_kbps", "chunk_size_kb"], "median")
                   .select("k1", "k2", "k3", "throughput_kbps", "chunk_size_kb"), 4)


@query("cln_impute_mean", """
SELECT k1, k2, k3, round(coalesce(CASE WHEN k1 % 7 <> 0 THEN throughput_kbps END, m.t), 4) AS throughput_kbps,
  round(CAST(coalesce(CASE WHEN k1 % 11 <> 0 THEN chunk_size_kb END, m.c) AS DOUBLE), 4) AS chunk_size_kb
FROM bench_log, (SELECT avg(throughput_kbps) FILTER (WHERE k1 % 7 <> 0) AS t, avg(chunk_size_kb) FILTER (WHERE k1 % 11 <> 0) AS c FROM bench_log) m""")
def _(t: Tables):
    return rounded(clean.impute(with_holes(t), ["throughput_kbps", "chunk_size_kb"], "mean")
                   .select("k1", "k2", "k3", "throughput_kbps", "chunk_size_kb"), 4)


@query("cln_to_numeric", """
SELECT k1, k2, k3, throughput_kbps FROM bench_log WHERE k1 % 7 <> 0 AND k1 % 11 <> 0""")
def _(t: Tables):
    text = F.when(F.col("k1") % 7 == 0, "").when(F.col("k1") % 11 == 0, "n/a").otherwise(F.col("throughput_kbps").cast("string"))
    return clean.to_numeric(t.bench_log.withColumn("throughput_kbps", text), ["throughput_kbps"]).select("k1", "k2", "k3", "throughput_kbps")


@query("prj_units", """
SELECT k1, k2, k3, file_size / 1024.0e0 AS "file_size_KB", chunk_size / 1024.0e0 AS "chunk_size_KB",
  throughput_mbps * 1024 AS "throughput_KBps", avg_read_size / 1024 AS "avg_read_KB",
  max_write_size / 1024.0e0 AS "max_write_KB", read_count AS read_ops, write_count AS write_ops
FROM v1""")
def _(t: Tables):
    return clean.normalise_units(t.v1).select(
        "k1", "k2", "k3", "file_size_KB", "chunk_size_KB", "throughput_KBps", "avg_read_KB", "max_write_KB", "read_ops", "write_ops")


@query("prj_defaults", """
SELECT file_path, access_count, round(avg_read_size, 4) AS avg_read_size, round(avg_write_size, 4) AS avg_write_size,
  round(max_read_size, 4) AS max_read_size, round(max_write_size, 4) AS max_write_size, read_count, write_count,
  round(throughput_mbps, 4) AS throughput_mbps
FROM features""")
def _(t: Tables):
    done = clean.with_default_features(profiles.file_profiles(t.files, t.accesses, t.tput))
    return rounded(done.drop("file_size", "chunk_size"), 4)


@query("prj_xgb_format", """
SELECT file_path, round(file_size / 1024.0e0, 4) AS "file_size_KB", round(avg_read_size / 1024, 4) AS "avg_read_KB",
  round(avg_write_size / 1024, 4) AS "avg_write_KB", round(max_read_size / 1024, 4) AS "max_read_KB", round(max_write_size / 1024, 4) AS "max_write_KB",
  read_count AS read_ops, write_count AS write_ops, access_count, round(throughput_mbps * 1024, 4) AS "throughput_KBps", 0.0e0 AS "chunk_size_KB"
FROM features""")
def _(t: Tables):
    done = clean.with_default_features(profiles.file_profiles(t.files, t.accesses, t.tput))
    return rounded(clean.to_model_columns(done), 4)


# -- joins ----------------------------------------------------------------------------------------

PROFILE_SQL = """
SELECT f.file_path, f.file_size, f.chunk_size, coalesce(a.n, 0) AS access_count, round(a.ar, 4) AS avg_read_size,
  round(a.aw, 4) AS avg_write_size, a.mr AS max_read_size, a.mw AS max_write_size, coalesce(a.nr, 0) AS read_count,
  coalesce(a.nw, 0) AS write_count, round(t.tp, 4) AS throughput_mbps
FROM files f
LEFT JOIN (SELECT file_path, count(*) AS n, avg(read_size) AS ar, avg(write_size) AS aw, max(read_size) AS mr, max(write_size) AS mw,
    count(*) FILTER (WHERE access_type = 'read') AS nr, count(*) FILTER (WHERE access_type = 'write') AS nw
  FROM accesses {access} GROUP BY 1) a ON f.file_path = a.file_path
LEFT JOIN (SELECT file_path, avg(throughput_mbps) AS tp FROM tput {transfer} GROUP BY 1) t ON f.file_path = t.file_path"""


@query("jn_profile_left", PROFILE_SQL.format(
    access="WHERE access_time > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY",
    transfer="WHERE start_time > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY"))
def _(t: Tables):
    return rounded(profiles.file_profiles(t.files, t.accesses, t.tput, AS_OF, 7), 4)


@query("agg_profile", PROFILE_SQL.format(access="", transfer=""))
def _(t: Tables):
    return rounded(profiles.file_profiles(t.files, t.accesses, t.tput), 4)


@query("jn_train_inner", """
SELECT f.file_path, f.file_size, f.chunk_size, count(*) AS access_count, round(avg(read_size), 4) AS avg_read_size,
  round(avg(write_size), 4) AS avg_write_size, max(read_size) AS max_read_size, max(write_size) AS max_write_size,
  count(*) FILTER (WHERE access_type = 'read') AS read_count, count(*) FILTER (WHERE access_type = 'write') AS write_count
FROM accesses a JOIN files f ON a.file_path = f.file_path GROUP BY 1, 2, 3""")
def _(t: Tables):
    return rounded(profiles.training_profiles(t.files, t.accesses), 4)


@query("jn_semi_active", "SELECT DISTINCT f.file_path FROM files f JOIN accesses a ON f.file_path = a.file_path")
def _(t: Tables):
    return profiles.active_files(t.files, t.accesses)


@query("jn_scalar_subquery", """
SELECT file_path, file_size FROM files f WHERE (SELECT count(*) FROM accesses a WHERE a.file_path = f.file_path) >= 60""")
def _(t: Tables):
    return profiles.min_access_filter(t.files, t.accesses, 60).select("file_path", "file_size")


@query("jn_anti_retention", """
SELECT file_path, file_size FROM files WHERE file_path NOT IN (
  SELECT file_path FROM accesses WHERE access_time > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY)""")
def _(t: Tables):
    return profiles.orphan_files(t.files, lookback(t.accesses, "access_time", 7, AS_OF)).select("file_path", "file_size")


@query("jn_merge_two_keys", """
SELECT model_type, file_size_mb, round(avg(old_chunk_size), 4) AS old_chunk, round(avg(new_chunk_size), 4) AS new_chunk,
  round(avg((new_chunk_size - old_chunk_size) / CAST(old_chunk_size AS DOUBLE) * 100), 4) AS chunk_change_pct
FROM trials GROUP BY 1, 2""")
def _(t: Tables):
    return rounded(trials.chunk_selection_report(t.trials), 4)


@query("jn_cross_candidates", """
SELECT b.file_size_kb, c.chunk_size_kb AS candidate, count(*) AS row_count, sum(b.chunk_size_kb)::BIGINT AS current_sum
FROM bench_log b CROSS JOIN (SELECT DISTINCT chunk_size_kb FROM bench_log) c GROUP BY 1, 2""")
def _(t: Tables):
    log = t.bench_log
    wide = candidates.expand_candidates(log, candidates.candidate_list(log))
    return wide.groupBy("file_size_kb", F.col("chunk_size_kb").alias("candidate")).agg(
        F.count(F.lit(1)).alias("row_count"), F.sum("current_chunk").alias("current_sum"))


def mean_codebook(t: Tables, side: int = 4):
    """A codebook of mean vectors: every embedding counts towards one of side x side units."""
    units = side * side
    cells = t.embeddings.select((F.col("vec_id") % units).alias("unit"), F.posexplode("embedding").alias("pos", "v"))
    means = cells.groupBy("unit", "pos").agg(F.avg(F.col("v").cast("double")).alias("m"))
    vectors = means.groupBy("unit").agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("w"))
    return vectors.select(F.floor(F.col("unit") / side).cast("int").alias("i"), (F.col("unit") % side).cast("int").alias("j"),
                          F.col("w.m").alias("weights"))


def assigned_units(t: Tables):
    rows = t.embeddings.select("vec_id", F.col("embedding").alias("vector"),
                               (F.lit(64) * F.pow(F.lit(2.0), F.col("vec_id") % 7)).cast("bigint").alias("chunk_size_kb"))
    return som.nearest_unit(rows, mean_codebook(t))


@query("jn_nearest_unit", "SELECT vec_id, CAST(i AS INT) AS i, CAST(j AS INT) AS j, round(distance, 6) AS distance FROM assigned")
def _(t: Tables):
    return rounded(assigned_units(t).select("vec_id", "unit.i", "unit.j", "distance"))


# -- sort, limit, sets ----------------------------------------------------------------------------


@query("top_files", "SELECT file_path, count(*) AS events FROM accesses GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def _(t: Tables):
    return profiles.top_files(t.accesses, 5)


@query("top_changes", """
SELECT *, new_chunk_size - old_chunk_size AS change FROM history
ORDER BY abs(new_chunk_size - old_chunk_size) DESC, file_path, old_chunk_size, new_chunk_size, optimization_time LIMIT 5""")
def _(t: Tables):
    return profiles.top_changes(t.history, 5)


NUMERIC = ("file_size_kb", "chunk_size_kb", "access_count", "avg_read_kb", "avg_write_kb", "max_read_kb", "max_write_kb",
           "read_ops", "write_ops", "throughput_kbps")
FEATURES = tuple(c for c in NUMERIC if c != "chunk_size_kb")


@query("top_features_corr", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(corr({c}, chunk_size_kb), 6) AS r FROM bench_log" for c in FEATURES))
def _(t: Tables):
    return rounded(stats.select_by_corr(stats.corr_matrix(t.bench_log, NUMERIC), "chunk_size_kb", FEATURES, 10))


@query("top_features_f", "SELECT feature, round(r * r / (1 - r * r) * (n - 2), 4) AS f_score FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, corr({c}, chunk_size_kb) AS r, count(*) AS n FROM bench_log" for c in FEATURES)
    + ") ORDER BY r * r DESC, feature LIMIT 4")
def _(t: Tables):
    return rounded(stats.select_by_f(stats.f_scores(t.bench_log, FEATURES, "chunk_size_kb"), 4), 4)


@query("lim_files", """
SELECT DISTINCT f.file_path FROM files f JOIN accesses a ON f.file_path = a.file_path ORDER BY 1 LIMIT 20""")
def _(t: Tables):
    return profiles.select_files(t.files, t.accesses, limit=20)


@query("set_union_rw", """
SELECT trial_id, model_type, 'read' AS operation, read_speed_pct AS pct FROM trial_results
UNION ALL SELECT trial_id, model_type, 'write', write_speed_pct FROM trial_results""")
def _(t: Tables):
    return trials.stack_rw(t.trial_results)


@query("set_melt_chunks", """
SELECT trial_id, model_type, 'old_chunk_size' AS chunk_type, old_chunk_size AS chunk_size FROM trials
UNION ALL SELECT trial_id, model_type, 'new_chunk_size', new_chunk_size FROM trials""")
def _(t: Tables):
    return trials.melt_chunks(t.trials)


@query("set_distinct_paths", "SELECT DISTINCT file_path FROM accesses")
def _(t: Tables):
    return profiles.accessed_paths(t.accesses)


@query("exp_training", """
SELECT p.file_path, p.file_size, p.chunk_size, p.access_count, coalesce(p.avg_read_size, 0) AS avg_read_size,
  coalesce(p.avg_write_size, 0) AS avg_write_size, coalesce(p.max_read_size, 0) AS max_read_size, coalesce(p.max_write_size, 0) AS max_write_size,
  p.read_count, p.write_count, coalesce(p.throughput_mbps, 0) AS throughput_mbps,
  round(p.read_count / (p.write_count + 1.0e0), 4) AS read_write_ratio,
  lower(regexp_extract(p.file_path, '[^/]*[^/.][^/]*(\\.[^./]*)$', 1)) AS file_extension,
  CAST(len(string_split(p.file_path, '/')) AS INT) AS dir_depth
FROM (""" + PROFILE_SQL.format(
    access="WHERE access_time > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 8700 DAY",
    transfer="WHERE start_time > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 8700 DAY") + ") p")
def _(t: Tables):
    return rounded(export_training_data(t.files, t.accesses, t.tput, AS_OF, 8700), 4)
