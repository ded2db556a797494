"""Column functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from accesslake.functions import measures, paths, sizing
from accesslake.operators import candidates, features, trials
from .aggregates import score
from .registry import Tables, query

# Paths of the accesses and three odd forms of each: a dotted folder, a dotfile, a file without folder.
PATHS = """(SELECT id, CASE id % 4 WHEN 0 THEN file_path WHEN 1 THEN replace(file_path, '/data/', '/da.ta/')
  WHEN 2 THEN concat('/mnt/.f', CAST(id % 100 AS STRING)) ELSE concat('Run', CAST(id AS STRING), '.Log') END AS path FROM accesses)"""


def odd_paths(t: Tables):
    return t.spark.sql("SELECT * FROM " + PATHS.replace("FROM accesses", "FROM {accesses}"), accesses=t.accesses)


@query("fn_extension", f"SELECT id, lower(regexp_extract(path, '[^/]*[^/.][^/]*(\\.[^./]*)$', 1)) AS ext FROM {PATHS}")
def _(t: Tables):
    return odd_paths(t).select("id", paths.extension(F.col("path")).alias("ext"))


@query("fn_first_dot_ext", f"SELECT id, lower(substr(path, greatest(instr(path, '.'), 1))) AS ext FROM {PATHS}")
def _(t: Tables):
    return odd_paths(t).select("id", paths.first_dot_ext(F.col("path")).alias("ext"))


@query("fn_dir_depth", f"SELECT id, CAST(len(string_split(path, '/')) AS INT) AS depth FROM {PATHS}")
def _(t: Tables):
    return odd_paths(t).select("id", paths.dir_depth(F.col("path")).alias("depth"))


@query("fn_path_hint", """
SELECT k1, k2, k3, file_path, coalesce(try_cast(regexp_extract(file_path, 'testdir_([0-9]+)K', 1) AS BIGINT) * 1024, 0) AS hint FROM bench_log
UNION ALL SELECT NULL, NULL, NULL, file_path, 0 FROM files""")
def _(t: Tables):
    none = [F.lit(None).cast(k).alias(c) for c, k in (("k1", "bigint"), ("k2", "int"), ("k3", "timestamp_ntz"))]
    rows = t.bench_log.select("k1", "k2", "k3", "file_path").unionAll(t.files.select(*none, "file_path"))
    return rows.withColumn("hint", paths.path_chunk_hint(F.col("file_path")))


EXT = "lower(regexp_extract(path, '[^/]*[^/.][^/]*(\\.[^./]*)$', 1))"


@query("fn_ext_onehot", "SELECT id, " + ", ".join(
    f"CAST({EXT} = '{e}' AS INT) AS \"ext_{e}\"" for e in paths.COMMON_EXTENSIONS)
    + f", CAST({EXT} <> '' AND {EXT} NOT IN {paths.COMMON_EXTENSIONS} AS INT) AS ext_other FROM {PATHS}")
def _(t: Tables):
    return features.ext_onehot(odd_paths(t), "path").drop("path")


@query("fn_onehot_dropfirst", """
SELECT trial_id, CAST(access_pattern = 'random' AS INT) AS access_pattern_random, CAST(access_pattern = 'read_heavy' AS INT) AS access_pattern_read_heavy,
  CAST(access_pattern = 'sequential' AS INT) AS access_pattern_sequential, CAST(access_pattern = 'write_heavy' AS INT) AS access_pattern_write_heavy,
  CAST(model_type = 'xgb' AS INT) AS model_type_xgb FROM trials""")
def _(t: Tables):
    return features.onehot(t.trials.select("trial_id", "access_pattern", "model_type"), ["access_pattern", "model_type"])


@query("fn_onehot_sparse", """
SELECT trial_id, file_path AS level FROM (SELECT o_orderkey AS trial_id, concat('c', o_custkey % 5000) AS file_path FROM orders)
WHERE file_path <> (SELECT min(concat('c', o_custkey % 5000)) FROM orders)""")
def _(t: Tables):
    """Thousands of levels as one sparse vector: each row's level is read back from it."""
    rows = t.orders.select(F.col("o_orderkey").alias("trial_id"), F.concat(F.lit("c"), F.col("o_custkey") % 5000).alias("customer"))
    fitted = features.fit_onehot(rows, "customer")
    return features.decode_onehot(fitted, fitted.transform(rows, "v"), "v").select("trial_id", "level")


@query("fn_access_band", """
SELECT k1, k2, k3, access_count, CASE WHEN access_count <= 10 THEN 1 WHEN access_count <= 20 THEN 2 ELSE 3 END AS band FROM bench_log""")
def _(t: Tables):
    return t.bench_log.select("k1", "k2", "k3", "access_count", sizing.access_band(F.col("access_count")).alias("band"))


@query("fn_combination", """
SELECT k1, k2, k3, concat(file_size_kb, ' | ', access_count_label) AS combination FROM banded""")
def _(t: Tables):
    band = sizing.access_band(F.col("access_count"))
    return t.bench_log.select("k1", "k2", "k3", sizing.combination(F.col("file_size_kb"), band).alias("combination"))


def counted(t: Tables):
    """Rows in which either count, and the total, can be zero."""
    return t.spark.sql(COUNTED.format(source="{accesses}"), accesses=t.accesses)


COUNTED = """SELECT id, id % 7 AS reads, id % 5 AS writes, id % 7 + id % 5 AS total, read_size % 9000 AS ar, write_size % 7000 AS aw FROM {source}"""
COUNTED_SQL = "(" + COUNTED.format(source="accesses") + ")"


@query("fn_rw_ratio_export", f"SELECT id, reads / (writes + 1.0e0) AS ratio FROM {COUNTED_SQL}")
def _(t: Tables):
    return counted(t).select("id", measures.rw_ratio_smoothed(F.col("reads"), F.col("writes")).alias("ratio"))


@query("fn_rw_ratio", f"SELECT id, reads / CASE WHEN writes = 0 THEN 1.0e0 ELSE writes END AS ratio FROM {COUNTED_SQL}")
def _(t: Tables):
    return counted(t).select("id", measures.rw_ratio(F.col("reads"), F.col("writes")).alias("ratio"))


@query("fn_avg_access", f"""
SELECT id, (ar * reads + aw * writes) / CASE WHEN total = 0 THEN 1.0e0 ELSE total END AS avg_access FROM {COUNTED_SQL}""")
def _(t: Tables):
    value = measures.avg_access(*[F.col(c) for c in ("ar", "reads", "aw", "writes", "total")])
    return counted(t).select("id", value.alias("avg_access"))


@query("fn_max_access", f"SELECT id, greatest(ar, aw) AS max_access FROM {COUNTED_SQL}")
def _(t: Tables):
    return counted(t).select("id", measures.max_access(F.col("ar"), F.col("aw")).alias("max_access"))


@query("fn_read_pct", f"SELECT id, reads / CASE WHEN total = 0 THEN 1.0e0 ELSE total END * 100 AS pct FROM {COUNTED_SQL}")
def _(t: Tables):
    return counted(t).select("id", measures.read_pct(F.col("reads"), F.col("total")).alias("pct"))


@query("fn_size_units", """
SELECT file_path, file_size / 1048576.0e0 AS file_size_mb, chunk_size / 1024.0e0 AS chunk_size_kb FROM files""")
def _(t: Tables):
    return t.files.select("file_path", measures.to_mb(F.col("file_size")).alias("file_size_mb"),
                          measures.to_kb(F.col("chunk_size")).alias("chunk_size_kb"))


# Zero sizes and zero operations occur, so every ratio is null somewhere.
RATIO_ROWS = """(SELECT k1, k2, k3, CASE WHEN k1 % 7 = 0 THEN 0 ELSE file_size END AS fs, CASE WHEN k1 % 11 = 0 THEN 0 ELSE chunk_size END AS cs,
  CASE WHEN k1 % 13 = 0 THEN 0 ELSE read_count END AS r, CASE WHEN k1 % 13 = 0 THEN 0 ELSE write_count END AS w, throughput_mbps AS m FROM v1)"""


def io_ratio(name: str, sql: str):
    @query(f"fn_{name}", f"SELECT k1, k2, k3, fs, cs, r, w, {sql} AS value FROM {RATIO_ROWS}")
    def _(t: Tables):
        rows = t.spark.sql("SELECT * FROM " + RATIO_ROWS.replace("FROM v1", "FROM {v1}"), v1=t.v1)
        column = {"io_per_chunk": "io_per_chunk", "bytes_per_io": "bytes_per_io", "tput_per_chunk": "throughput_per_chunk",
                  "chunk_ratio": "chunk_to_file_ratio", "io_eff": "io_efficiency", "chunk_eff": "chunk_efficiency"}[name]
        value = measures.io_ratios(*[F.col(c) for c in ("fs", "cs", "r", "w", "m")])[column]
        return rows.select("k1", "k2", "k3", "fs", "cs", "r", "w", value.alias("value"))


io_ratio("io_per_chunk", "(r + w) / nullif(fs / nullif(cs, 0)::DOUBLE, 0)")
io_ratio("bytes_per_io", "fs / nullif(r + w, 0)::DOUBLE")
io_ratio("tput_per_chunk", "m / nullif(fs / nullif(cs, 0)::DOUBLE, 0)")
io_ratio("chunk_ratio", "cs / nullif(fs, 0)::DOUBLE")
io_ratio("io_eff", "m * 1048576 / nullif(fs * (r + w), 0)::DOUBLE")
io_ratio("chunk_eff", "m / nullif(cs, 0)::DOUBLE")


@query("fn_calendar", """
SELECT id, CAST(hour(access_time) AS INT) AS hour, CAST(isodow(access_time) - 1 AS INT) AS day_of_week FROM accesses""")
def _(t: Tables):
    return t.accesses.select("id", *[c.alias(n) for n, c in measures.calendar(F.col("access_time")).items()])


@query("fn_throughput", "SELECT ingest_id, throughput_mbps AS throughput_mbps FROM tput")
def _(t: Tables):
    return t.tput.select("ingest_id", "throughput_mbps")


@query("fn_change_pct", """
SELECT trial_id, after_read_speed - before_read_speed AS read_speed_change, read_speed_pct AS read_speed_pct,
  after_write_speed - before_write_speed AS write_speed_change, write_speed_pct AS write_speed_pct,
  after_throughput - before_throughput AS throughput_change, throughput_pct AS throughput_pct,
  (new_chunk_size - old_chunk_size) / 512.0e0 * 100 AS chunk_pct FROM trial_results""")
def _(t: Tables):
    chunk = measures.change_pct(F.col("old_chunk_size"), F.col("new_chunk_size")).alias("chunk_pct")
    return t.trial_results.select("trial_id", *[f"{w}_{k}" for w in ("read_speed", "write_speed", "throughput") for k in ("change", "pct")], chunk)


@query("fn_avg_throughput", """
SELECT trial_id, r AS read_speed, w AS write_speed, (r + w) / 2 AS throughput FROM (
  SELECT trial_id, CASE WHEN trial_id % 6 > 0 THEN file_size_mb / (trial_id % 6) ELSE 0 END AS r,
    CASE WHEN trial_id % 4 > 0 THEN file_size_mb / (trial_id % 4) ELSE 0 END AS w FROM trials)""")
def _(t: Tables):
    timed = t.trials.select("trial_id", "file_size_mb", (F.col("trial_id") % 6).cast("double").alias("avg_read_seconds"),
                            (F.col("trial_id") % 4).cast("double").alias("avg_write_seconds"))
    return trials.trial_speeds(timed).select("trial_id", "read_speed", "write_speed", "throughput")


@query("fn_result_flag", """
SELECT trial_id, (new_chunk_size - old_chunk_size) / 512.0e0 * 100 AS chunk_pct, throughput_pct AS throughput_pct,
  CASE WHEN throughput_pct > 0 THEN 'Improved' ELSE 'Degraded' END AS result FROM trial_results""")
def _(t: Tables):
    return trials.comparison_table(t.trial_results).select("trial_id", "chunk_pct", "throughput_pct", "result")


@query("fn_recommend", """
SELECT *, CASE WHEN old_chunk_size = new_chunk_size THEN 'Already optimal' WHEN old_chunk_size < new_chunk_size THEN 'Increase' ELSE 'Decrease' END AS recommendation
FROM history""")
def _(t: Tables):
    return t.history.withColumn("recommendation", measures.recommend(F.col("old_chunk_size"), F.col("new_chunk_size")))


@query("fn_human_size", """
SELECT id, CASE WHEN s >= 1048576 THEN printf('%.2f MB', s / 1048576.0e0) WHEN s >= 1024 THEN printf('%.2f KB', s / 1024.0e0)
  ELSE concat(s, ' bytes') END AS size_text
FROM (SELECT id, CASE id % 3 WHEN 0 THEN read_size % 2000 WHEN 1 THEN read_size ELSE read_size * 37 END AS s FROM accesses)""")
def _(t: Tables):
    size = F.expr("CASE id % 3 WHEN 0 THEN read_size % 2000 WHEN 1 THEN read_size ELSE read_size * 37 END")
    return t.accesses.select("id", measures.human_size(size).alias("size_text"))


@query("fn_round128", """
SELECT id, CAST(least(greatest(round_even(CASE WHEN s > 10000 THEN s / 1024.0e0 ELSE s END / 128.0e0, 0) * 128, 64), 4096) AS BIGINT) AS chunk_kb
FROM (SELECT id, read_size % 20000 AS s FROM accesses)""")
def _(t: Tables):
    return t.accesses.select("id", sizing.round_chunk(F.col("read_size") % 20000).alias("chunk_kb"))


@query("fn_clamp", "SELECT id, least(greatest(read_size % 9000, 64), 4096) AS chunk_kb FROM accesses")
def _(t: Tables):
    return t.accesses.select("id", sizing.clamp(F.col("read_size") % 9000).alias("chunk_kb"))


# File sizes of every tier and current sizes inside and outside the tier's list.
SIZED = "(SELECT id, 20 + (id * id) % 40000 AS size, CASE id % 3 WHEN 0 THEN CAST(64 * power(2, id % 8) AS BIGINT) ELSE 50 + (id * 7) % 3000 END AS cur FROM accesses)"
TIERED = f"""(SELECT id, size, cur, list_filter(CASE WHEN list_contains(base, cur) THEN base ELSE list_sort(list_append(base, cur)) END, lambda c: c <= size) AS cands
FROM (SELECT *, CASE WHEN size < 256 THEN [64, 128, least(size, 256)] WHEN size < 1024 THEN [64, 128, 256, least(size, 512)]
  WHEN size < 4096 THEN [128, 256, 512, least(size, 1024)] WHEN size < 16384 THEN [256, 512, 1024, least(size, 2048)]
  ELSE [512, 1024, 2048, 4096, least(size, 8192)] END AS base FROM {SIZED}))"""


def sized(t: Tables):
    return t.spark.sql("SELECT * FROM " + SIZED.replace("FROM accesses", "FROM {accesses}"), accesses=t.accesses)


@query("fn_candidates_by_size", f"SELECT id, size, cur, list_aggregate(cands, 'string_agg', ',') AS candidates FROM {TIERED}")
def _(t: Tables):
    listed = sizing.tier_candidates(F.col("size"), F.col("cur"))
    text = F.concat_ws(",", F.transform(listed, lambda c: c.cast("bigint").cast("string")))
    return sized(t).select("id", "size", "cur", F.when(F.size(listed) > 0, text).alias("candidates"))


@query("fn_decision", f"""
SELECT id, size, cur, CAST(CASE WHEN best IS NULL THEN 64 WHEN p_cur IS NULL THEN best WHEN best = cur THEN cur WHEN size > 1024 AND cur < best THEN best
  WHEN size <= 1024 AND cur > best THEN best WHEN p_best > p_cur + 0.1e0 THEN best ELSE cur END AS BIGINT) AS optimal_chunk
FROM (SELECT s.id, s.size, s.cur, b.chunk AS best, b.p AS p_best, c.p AS p_cur FROM {SIZED} s
  LEFT JOIN (SELECT id, chunk, p FROM (SELECT id, chunk, p, row_number() OVER (PARTITION BY id ORDER BY p DESC, pos) AS rn FROM
    (SELECT id, chunk, pos, 1.0e0 / (1.0e0 + abs(chunk - (size / 8.0e0 + id % 50 * 10.0e0)) / 512.0e0) AS p
     FROM (SELECT id, size, unnest(cands) AS chunk, generate_subscripts(cands, 1) AS pos FROM {TIERED}))) WHERE rn = 1) b ON s.id = b.id
  LEFT JOIN (SELECT id, max(1.0e0 / (1.0e0 + abs(cur - (size / 8.0e0 + id % 50 * 10.0e0)) / 512.0e0)) AS p FROM {TIERED}
    WHERE list_contains(cands, cur) GROUP BY id) c ON s.id = c.id)""")
def _(t: Tables):
    rows = sized(t).withColumn("file_size_kb", F.col("size")).withColumn("chunk_size_kb", F.col("cur")).withColumn("access_count", F.col("id") % 50)
    return candidates.decide_inline(rows, score).select("id", "size", "cur", "optimal_chunk")
