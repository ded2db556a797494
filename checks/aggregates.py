"""Aggregations, labels, outliers, arg-max and other per-group operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from accesslake.operators import candidates, evaluate, labels, profiles, quantiles, som, stats, trials
from accesslake.operators.common import melt
from .registry import Tables, query, rounded
from .relational import AS_OF, FEATURES, HISTORY_AS_OF, NUMERIC, assigned_units, mean_codebook, with_holes

# -- monitor and history --------------------------------------------------------------------------


@query("agg_bench_rollup", """
SELECT run_id, file_path, file_size_kb, chunk_size_kb, access_count, avg_read_kb, avg_write_kb, max_read_kb, max_write_kb, read_ops, write_ops,
  floor(least(file_size_kb, 102400) / secs * 100) / 100 AS throughput_kbps
FROM (SELECT a.file_path AS run_id, a.file_path, f.file_size // 1024 AS file_size_kb, f.chunk_size AS chunk_size_kb, count(*) AS access_count,
    coalesce(floor(sum(read_size) FILTER (WHERE access_type = 'read') / count(*) FILTER (WHERE access_type = 'read')::DOUBLE * 100) / 100, 0) AS avg_read_kb,
    coalesce(floor(sum(write_size) FILTER (WHERE access_type = 'write') / count(*) FILTER (WHERE access_type = 'write')::DOUBLE * 100) / 100, 0) AS avg_write_kb,
    coalesce(max(read_size) FILTER (WHERE access_type = 'read'), 0) AS max_read_kb,
    coalesce(max(write_size) FILTER (WHERE access_type = 'write'), 0) AS max_write_kb,
    count(*) FILTER (WHERE access_type = 'read') AS read_ops, count(*) FILTER (WHERE access_type = 'write') AS write_ops,
    1.0e0 + (f.chunk_size % 7) AS secs
  FROM accesses a JOIN files f ON a.file_path = f.file_path GROUP BY a.file_path, f.file_size, f.chunk_size)""")
def _(t: Tables):
    operations = t.accesses.join(t.files, "file_path").select(
        F.col("file_path").alias("run_id"), "file_path", F.floor(F.col("file_size") / 1024).alias("file_size_kb"),
        F.col("chunk_size").alias("chunk_size_kb"), F.col("access_type").alias("operation"),
        (F.col("read_size") + F.col("write_size")).alias("size_kb"), (1.0 + F.col("chunk_size") % 7).alias("sample_seconds"))
    return profiles.bench_rollup(operations)


@query("agg_safe_rate", """
SELECT file_path, round(sum(CASE WHEN operation_type = 'read' THEN bytes_transferred ELSE 0 END) /
  nullif(sum(CASE WHEN operation_type = 'read' THEN elapsed_s ELSE 0 END), 0), 4) AS read_rate
FROM tput GROUP BY 1""")
def _(t: Tables):
    return rounded(profiles.read_throughput(t.tput), 4)


@query("agg_monitor_stats", """
SELECT count(*) AS total_events, count(DISTINCT file_path) AS unique_files, count(*) FILTER (WHERE access_type = 'read') AS read_events,
  count(*) FILTER (WHERE access_type = 'write') AS write_events,
  count(*) FILTER (WHERE access_time > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 1 DAY) AS recent_events FROM accesses""")
def _(t: Tables):
    return profiles.monitor_stats(t.accesses, AS_OF)


@query("agg_by_type", "SELECT access_type, count(*) AS events FROM accesses GROUP BY 1")
def _(t: Tables):
    return profiles.count_by_type(t.accesses)


@query("agg_history_stats", """
SELECT count(*) AS total, count(*) FILTER (WHERE optimization_time > TIMESTAMP '2001-11-05 00:00:00' - INTERVAL 1 DAY) AS recent,
  round(avg(old_chunk_size), 4) AS avg_old, round(avg(new_chunk_size), 4) AS avg_new, round(avg(new_chunk_size - old_chunk_size), 4) AS avg_change,
  count(*) FILTER (WHERE new_chunk_size > old_chunk_size) AS increases, count(*) FILTER (WHERE new_chunk_size < old_chunk_size) AS decreases,
  count(*) FILTER (WHERE new_chunk_size = old_chunk_size) AS unchanged FROM history""")
def _(t: Tables):
    return rounded(profiles.history_stats(t.history, HISTORY_AS_OF), 4)


# -- quantiles and summaries ----------------------------------------------------------------------

@query("agg_group_quantile", """
SELECT file_size_kb, access_count_label, round(quantile_cont(throughput_kbps, 0.65), 4) AS threshold, count(throughput_kbps) AS row_count
FROM banded GROUP BY 1, 2""")
def _(t: Tables):
    return rounded(quantiles.group_quantile(labels.with_band(t.bench_log), ["file_size_kb", "access_count_label"], "throughput_kbps",
                                            count_as="row_count"), 4)


@query("agg_global_quantile", "SELECT round(quantile_cont(throughput_kbps, 0.65), 4) AS threshold FROM bench_log")
def _(t: Tables):
    return rounded(quantiles.global_quantile(t.bench_log, "throughput_kbps"), 4)


@query("agg_candidates", "SELECT DISTINCT chunk_size_kb AS chunk FROM bench_log")
def _(t: Tables):
    return candidates.candidate_chunks(t.bench_log)


LABELLED = """
SELECT b.*, CAST(round(b.throughput_kbps, 6) >= round(CASE WHEN g.n >= {min_rows} THEN g.q ELSE o.q END, 6) AS INT) AS {label}
FROM banded b
JOIN (SELECT {keys}, quantile_cont(throughput_kbps, 0.65) AS q, count(*) AS n FROM banded GROUP BY {keys}) g USING ({keys})
CROSS JOIN (SELECT quantile_cont(throughput_kbps, 0.65) AS q FROM bench_log) o"""
SIZE_BAND = "file_size_kb, access_count_label"
PATH_BAND = "file_path, access_count_label"


@query("agg_label_stats", f"""
SELECT count(DISTINCT (file_size_kb, access_count_label)) AS combinations, sum(is_optimal)::BIGINT AS optimal, count(*) AS total,
  round(sum(is_optimal) / count(*)::DOUBLE, 6) AS optimal_ratio,
  round((SELECT quantile_cont(throughput_kbps, 0.65) FROM bench_log), 6) AS global_threshold
FROM ({LABELLED.format(min_rows=3, label='is_optimal', keys=SIZE_BAND)})""")
def _(t: Tables):
    return rounded(labels.label_stats(labels.label_ot(t.bench_log, min_rows=3, label="is_optimal")))


@query("agg_summary", """
SELECT count(*) AS row_count, count(DISTINCT chunk_size_kb) AS distinct_chunks, min(chunk_size_kb) AS min_chunk, max(chunk_size_kb) AS max_chunk
FROM bench_log""")
def _(t: Tables):
    return stats.dataset_summary(t.bench_log)


@query("agg_missing", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE k1 % {n} = 0) AS missing FROM bench_log"
    for c, n in (("throughput_kbps", 7), ("chunk_size_kb", 11), ("file_size_kb", 13)))
    + " UNION ALL SELECT 'file_path', 0 FROM region WHERE r_regionkey = 0")
def _(t: Tables):
    from accesslake.operators.clean import missing_report
    return missing_report(with_holes(t), ["throughput_kbps", "chunk_size_kb", "file_size_kb", "file_path"])


@query("agg_quartiles", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, round(min({c})::DOUBLE, 4) AS minimum, round(quantile_cont({c}, 0.25), 4) AS q1, "
    f"round(quantile_cont({c}, 0.5), 4) AS median, round(quantile_cont({c}, 0.75), 4) AS q3, round(max({c})::DOUBLE, 4) AS maximum FROM bench_log"
    for c in FEATURES))
def _(t: Tables):
    return rounded(stats.quartiles(t.bench_log, FEATURES), 4)


@query("agg_histogram", """
SELECT CAST(least(floor((p - lo) / ((hi - lo) / 10.0e0)), 9) AS INT) AS bin, count(*) AS row_count,
  round(lo + (hi - lo) / 10.0e0 * least(floor((p - lo) / ((hi - lo) / 10.0e0)), 9), 6) AS low,
  round(lo + (hi - lo) / 10.0e0 * (least(floor((p - lo) / ((hi - lo) / 10.0e0)), 9) + 1), 6) AS high
FROM (SELECT throughput_kbps AS p, min(throughput_kbps) OVER () AS lo, max(throughput_kbps) OVER () AS hi FROM bench_log)
GROUP BY ALL""")
def _(t: Tables):
    return rounded(stats.histogram(t.bench_log, "throughput_kbps", 10))


CORR_SQL = " UNION ALL ".join(
    f"SELECT '{x}' AS feature_x, '{y}' AS feature_y, corr({x}, {y}) AS r FROM bench_log" for x in NUMERIC for y in NUMERIC)


@query("agg_corr_matrix", f"SELECT feature_x, feature_y, round(r, 6) AS r FROM ({CORR_SQL})")
def _(t: Tables):
    return rounded(stats.corr_matrix(t.bench_log, NUMERIC))


@query("agg_corr_pairs", f"""
SELECT feature_x, feature_y, round(r, 6) AS r FROM ({CORR_SQL}) WHERE feature_x < feature_y AND round(abs(r), 9) > 0.85 AND round(abs(r), 9) < 1""")
def _(t: Tables):
    return rounded(stats.redundant_pairs(stats.corr_matrix(t.bench_log, NUMERIC)))


@query("agg_fscore", "SELECT feature, round(r * r / (1 - r * r) * (n - 2), 4) AS f_score FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, corr({c}, chunk_size_kb) AS r, count(*) AS n FROM bench_log" for c in FEATURES) + ")")
def _(t: Tables):
    return rounded(stats.f_scores(t.bench_log, FEATURES, "chunk_size_kb"), 4)


# -- trials ---------------------------------------------------------------------------------------

@query("agg_model_stats", """
SELECT model_type, round(avg(throughput_pct), 4) AS mean, round(stddev_samp(throughput_pct), 4) AS std, round(min(throughput_pct), 4) AS min,
  round(max(throughput_pct), 4) AS max, count(*) AS count FROM trial_results GROUP BY 1""")
def _(t: Tables):
    return rounded(trials.model_stats(t.trial_results), 4)


PIVOT = """
SELECT {0}, round(avg(throughput_pct) FILTER (WHERE model_type = 'rf'), 4) AS rf,
  round(avg(throughput_pct) FILTER (WHERE model_type = 'xgb'), 4) AS xgb FROM trial_results GROUP BY 1"""


@query("agg_pivot_size", PIVOT.format("file_size_mb"))
def _(t: Tables):
    return rounded(trials.pivot_mean(t.trial_results, "file_size_mb"), 4)


@query("agg_pivot_pattern", PIVOT.format("access_pattern"))
def _(t: Tables):
    return rounded(trials.pivot_mean(t.trial_results, "access_pattern"), 4)


@query("agg_rw_gain", """
SELECT model_type, round(avg(read_speed_pct), 4) AS read_pct, round(avg(write_speed_pct), 4) AS write_pct FROM trial_results GROUP BY 1""")
def _(t: Tables):
    return rounded(trials.rw_gain(t.trial_results), 4)


@query("agg_chunk_selection", """
SELECT model_type, file_size_mb, round(avg(old_chunk_size), 4) AS old_chunk, round(avg(new_chunk_size), 4) AS new_chunk,
  round(avg((new_chunk_size - old_chunk_size) / CAST(old_chunk_size AS DOUBLE) * 100), 4) AS chunk_change_pct FROM trials GROUP BY 1, 2""")
def _(t: Tables):
    return rounded(trials.chunk_selection_report(t.trials), 4)


def _mean_pair(what: str, where: str) -> str:
    return ", ".join(f"avg({what}_pct) FILTER (WHERE model_type = '{m}' AND {where}) AS {m}" for m in ("rf", "xgb"))


CARD = "SELECT category, round(rf, 4) AS rf, round(xgb, 4) AS xgb, CASE WHEN rf > xgb THEN 'RF' ELSE 'XGBoost' END AS winner FROM (" + \
    " UNION ALL ".join(
        [f"SELECT 'Overall Performance' AS category, {_mean_pair('throughput', 'true')} FROM trial_results",
         f"SELECT 'Read Operations', {_mean_pair('read_speed', 'true')} FROM trial_results",
         f"SELECT 'Write Operations', {_mean_pair('write_speed', 'true')} FROM trial_results",
         *[f"SELECT '{s}MB Files', {_mean_pair('throughput', f'file_size_mb = {s}')} FROM trial_results" for s in (10, 100, 1024)],
         *[f"SELECT '{name} Access', {_mean_pair('throughput', f'''access_pattern = '{p}' ''')} FROM trial_results"
           for p, name in (("read_heavy", "Read Heavy"), ("write_heavy", "Write Heavy"), ("mixed", "Mixed"), ("sequential", "Sequential"),
                           ("random", "Random"))]]) + ")"


@query("agg_scorecard", CARD)
def _(t: Tables):
    return rounded(trials.scorecard(t.trial_results), 4)


@query("agg_verdict", f"""
SELECT rf_wins, xgb_wins, categories, CASE WHEN rf_wins > xgb_wins THEN 'RF' WHEN xgb_wins > rf_wins THEN 'XGBoost' ELSE 'Tie' END AS verdict
FROM (SELECT count(*) FILTER (WHERE winner = 'RF') AS rf_wins, count(*) FILTER (WHERE winner = 'XGBoost') AS xgb_wins, count(*) AS categories
  FROM ({CARD}))""")
def _(t: Tables):
    return trials.verdict(trials.scorecard(t.trial_results))


T_TEST = """
SELECT (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0e0 / n1 + 1.0e0 / n2)) AS t_stat,
  n1 + n2 - 2 AS dof, m1 AS mean_rf, m2 AS mean_xgb
FROM (SELECT avg(throughput_pct) FILTER (WHERE model_type = 'rf') AS m1, avg(throughput_pct) FILTER (WHERE model_type = 'xgb') AS m2,
  var_samp(throughput_pct) FILTER (WHERE model_type = 'rf') AS v1, var_samp(throughput_pct) FILTER (WHERE model_type = 'xgb') AS v2,
  count(*) FILTER (WHERE model_type = 'rf') AS n1, count(*) FILTER (WHERE model_type = 'xgb') AS n2 FROM trial_results)"""


@query("agg_ttest", f"""
SELECT round(t_stat, 6) AS t_stat, dof, round(mean_rf, 6) AS mean_rf, round(mean_xgb, 6) AS mean_xgb FROM ({T_TEST})""")
def _(t: Tables):
    return rounded(trials.t_test(t.trial_results))


# The tail beyond |t| over half the whole, of cos^(v-1) over the angle, by Simpson's rule in 4000 parts.
@query("agg_ttest_p", f"""
WITH tested AS ({T_TEST}), ends AS (SELECT *, dof::DOUBLE AS v, atan(abs(t_stat) / sqrt(dof)) AS a, least(pi() / 2, 40 / sqrt(dof)) AS c FROM tested),
parts AS (SELECT k, CASE WHEN k = 0 OR k = 4000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END AS w FROM (SELECT unnest(range(4001)) AS k)),
tails AS (SELECT t_stat, dof, mean_rf, mean_xgb, least(1, any_value(least(pi() / 2, a + 40 / sqrt(v)) - a)
    * sum(w * exp((v - 1) * ln(greatest(cos(a + (least(pi() / 2, a + 40 / sqrt(v)) - a) * k / 4000), 1e-300))))
    / any_value(c) / sum(w * exp((v - 1) * ln(greatest(cos(c * k / 4000), 1e-300))))) AS p
  FROM ends CROSS JOIN parts GROUP BY t_stat, dof, mean_rf, mean_xgb)
SELECT round(t_stat, 6) AS t_stat, dof, round(mean_rf, 6) AS mean_rf, round(mean_xgb, 6) AS mean_xgb, round(p, 6) AS p_value, p < 0.05 AS significant,
  CASE WHEN p < 0.05 THEN CASE WHEN mean_rf > mean_xgb THEN 'RF' ELSE 'XGBoost' END END AS better FROM tails""")
def _(t: Tables):
    return rounded(trials.t_test_with_p(t.trial_results))


@query("agg_demo_summary", """
SELECT round(avg(throughput_pct), 4) AS avg_change, count(*) FILTER (WHERE throughput_pct > 0) AS improved, count(*) AS total FROM trial_results""")
def _(t: Tables):
    return rounded(trials.improvement_summary(t.trial_results), 4)


@query("agg_storage_impact", """
SELECT round(c, 4) AS current_kb, round(p, 4) AS predicted_kb, round(abs(p - c) / c * 100, 4) AS change_pct,
  CASE WHEN p < c THEN 'reduction' ELSE 'increase' END AS direction
FROM (SELECT sum(old_chunk_size * 1024)::DOUBLE / 1024 AS c, sum(new_chunk_size)::DOUBLE AS p FROM history)""")
def _(t: Tables):
    sizes = t.history.select((F.col("old_chunk_size") * 1024).alias("current_chunk_bytes"), F.col("new_chunk_size").alias("predicted_chunk_kb"))
    return rounded(evaluate.storage_impact(sizes), 4)


# -- model quality --------------------------------------------------------------------------------

def scored_rows(t: Tables):
    label = (F.col("throughput_kbps") > 50000).cast("int")
    noise = 0.7 * ((F.col("k1") * 7919 + F.col("k2") * 131) % 1000) / 1000.0
    return t.bench_log.select("k1", "k2", label.alias("label"), (0.3 * label + noise).alias("p"))


@query("agg_confusion", "SELECT label, CAST(p > 0.5e0 AS INT) AS predicted, count(*) AS row_count FROM scored_rows GROUP BY 1, 2")
def _(t: Tables):
    return evaluate.confusion(scored_rows(t))


@query("agg_metrics", """
SELECT n, round(logloss, 6) AS logloss, round((tp + tn) / n::DOUBLE, 6) AS accuracy, round(tp / (tp + fp)::DOUBLE, 6) AS precision,
  round(tp / (tp + fn)::DOUBLE, 6) AS recall, round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 6) AS f1, round(auc, 6) AS auc
FROM (SELECT count(*) AS n,
    avg(-(label * ln(least(greatest(p, 1e-15), 1 - 1e-15)) + (1 - label) * ln(1 - least(greatest(p, 1e-15), 1 - 1e-15)))) AS logloss,
    count(*) FILTER (WHERE p > 0.5e0 AND label = 1) AS tp, count(*) FILTER (WHERE p > 0.5e0 AND label = 0) AS fp,
    count(*) FILTER (WHERE p <= 0.5e0 AND label = 1) AS fn, count(*) FILTER (WHERE p <= 0.5e0 AND label = 0) AS tn FROM scored_rows),
  (SELECT (sum(rk) FILTER (WHERE label = 1) - np * (np + 1) / 2.0e0) / (np * nn) AS auc
   FROM (SELECT label, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0e0 AS rk,
           count(*) FILTER (WHERE label = 1) OVER () AS np, count(*) FILTER (WHERE label = 0) OVER () AS nn FROM scored_rows) GROUP BY np, nn)""")
def _(t: Tables):
    return rounded(evaluate.binary_metrics(scored_rows(t)))


@query("agg_cv_summary", """
SELECT metric, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std
FROM (SELECT 'logloss' AS metric, avg(avg_read_kb) AS v FROM bench_log GROUP BY k1 % 5
  UNION ALL SELECT 'auc', avg(avg_write_kb) FROM bench_log GROUP BY k1 % 5) GROUP BY 1""")
def _(t: Tables):
    folds = t.bench_log.groupBy((F.col("k1") % 5).alias("fold")).agg(F.avg("avg_read_kb").alias("logloss"), F.avg("avg_write_kb").alias("auc"))
    return rounded(evaluate.cv_summary(folds, ["logloss", "auc"]))


# -- map units ------------------------------------------------------------------------------------

@query("agg_hit_map", "SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, count(*) AS hits FROM assigned GROUP BY 1, 2")
def _(t: Tables):
    return som.hit_map(assigned_units(t))


def grid(t: Tables, side: int = 6):
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(side) for j in range(side)])
    return t.spark.range(1).select(F.inline(cells))


@query("agg_unit_mean", "SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, round(chunk, 6) AS chunk FROM unit_map")
def _(t: Tables):
    return rounded(som.unit_chunk_map(assigned_units(t), grid(t)))


@query("agg_quant_error", "SELECT round(avg(distance), 6) AS quantization_error FROM assigned")
def _(t: Tables):
    return rounded(som.quantization_error(assigned_units(t)))


@query("agg_u_matrix", """
SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, round(s, 6) AS sum_distance, round(m, 6) AS mean_distance, round(s / max(s) OVER (), 6) AS scaled
FROM (SELECT a.i, a.j, sum(list_distance(a.weights, b.weights)) AS s, avg(list_distance(a.weights, b.weights)) AS m
  FROM codebook a JOIN codebook b ON abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 AND (a.i <> b.i OR a.j <> b.j) GROUP BY 1, 2)""")
def _(t: Tables):
    return rounded(som.u_matrix(mean_codebook(t)))


# -- labels, outliers, arg-max --------------------------------------------------------------------

LABEL_COLUMNS = ("k1", "k2", "k3", "file_path", "throughput_kbps", "access_count_label", "combination")


@query("win_ot_label", f"""
SELECT k1, k2, k3, file_path, throughput_kbps, access_count_label, concat(file_size_kb, ' | ', access_count_label) AS combination, "OT"
FROM ({LABELLED.format(min_rows=1, label='"OT"', keys=SIZE_BAND)})""")
def _(t: Tables):
    return labels.label_ot(t.bench_log).select(*LABEL_COLUMNS, "OT")


@query("win_label_minsize", f"""
SELECT k1, k2, k3, file_path, throughput_kbps, is_optimal FROM ({LABELLED.format(min_rows=3, label='is_optimal', keys=PATH_BAND)})""")
def _(t: Tables):
    # Groups of one file and band are small enough for the fallback to the overall quantile to matter.
    done = labels.label_ot(t.bench_log, min_rows=3, label="is_optimal", keys=("file_path", "access_count_label"))
    return done.select("k1", "k2", "k3", "file_path", "throughput_kbps", "is_optimal")


PRUNED = """
SELECT l.k1, l.k2, l.k3, l.file_path, l.chunk_size_kb, CASE WHEN l.is_optimal = 1 AND m.n >= 2 AND
  ((l.file_size_kb > 1024 AND l.chunk_size_kb < m.med) OR (l.file_size_kb <= 1024 AND l.chunk_size_kb > m.med)) THEN 0 ELSE l.is_optimal END AS is_optimal
FROM ({0}) l LEFT JOIN (SELECT file_path, file_size_kb > 1024 AS big, quantile_cont(chunk_size_kb, 0.5) AS med, count(*) AS n
  FROM ({0}) WHERE is_optimal = 1 GROUP BY 1, 2) m ON l.file_path = m.file_path AND (l.file_size_kb > 1024) = m.big""".format(
    LABELLED.format(min_rows=3, label="is_optimal", keys=SIZE_BAND))


@query("win_label_prune", PRUNED)
def _(t: Tables):
    return labels.label_optimal(t.bench_log).select("k1", "k2", "k3", "file_path", "chunk_size_kb", "is_optimal")


@query("win_label_balance", """
SELECT trial_id, CAST(rn <= n // 4 AS INT) AS is_optimal FROM (
  SELECT trial_id, row_number() OVER (ORDER BY new_chunk_size DESC, trial_id) AS rn, count(*) OVER () AS n FROM trials)""")
def _(t: Tables):
    # All labels 0: the top quarter by the value becomes 1. Only seven values, so ties decide.
    none = t.trials.withColumn("is_optimal", F.lit(0))
    return labels.balance_labels(none, "is_optimal", "new_chunk_size", "trial_id").select("trial_id", "is_optimal")


@query("win_zscore_outlier", """
SELECT id, file_path, read_size, write_size, CASE WHEN abs((read_size - mr) / sr) > 3 OR abs((write_size - mw) / sw) > 3 THEN 'outlier' ELSE 'clean' END AS part
FROM accesses, (SELECT avg(read_size) AS mr, stddev_pop(read_size) AS sr, avg(write_size) AS mw, stddev_pop(write_size) AS sw FROM accesses)""")
def _(t: Tables):
    rows = t.accesses.select("id", "file_path", "read_size", "write_size")
    clean, out = stats.split_outliers(rows, ["read_size", "write_size"])
    return clean.withColumn("part", F.lit("clean")).unionByName(out.withColumn("part", F.lit("outlier")))


def score(chunk):
    """A closed-form score that prefers chunks near a size the file and its accesses suggest."""
    target = F.col("file_size_kb") / 8.0 + F.col("access_count") * 10.0
    return 1.0 / (1.0 + F.abs(chunk - target) / 512.0)


SCORE = "1.0e0 / (1.0e0 + abs({c} - (file_size_kb / 8.0e0 + access_count * 10.0e0)) / 512.0e0)"


@query("win_best_candidate", f"""
SELECT k1, k2, k3, file_path, access_count, CAST(max(chunk) AS DOUBLE) AS optimal_chunk, round(max(best), 6) AS confidence FROM (
  SELECT *, max(p) OVER (PARTITION BY rid) AS best FROM (
    SELECT b.*, c.chunk, {SCORE.format(c='c.chunk')} AS p FROM (SELECT *, row_number() OVER () AS rid FROM bench_log) b
    CROSS JOIN (SELECT DISTINCT chunk_size_kb AS chunk FROM bench_log) c))
WHERE best - p < 1e-4 GROUP BY rid, k1, k2, k3, file_path, access_count""")
def _(t: Tables):
    log = t.bench_log
    best = candidates.best_candidate_inline(log, candidates.candidate_list(log), score)
    return rounded(best.select("k1", "k2", "k3", "file_path", "access_count", "optimal_chunk", "confidence"))


@query("win_first_argmax", f"""
SELECT file_path, file_size_kb, access_count, chunk AS best_chunk, round(p, 6) AS best_p FROM (
  SELECT *, row_number() OVER (PARTITION BY file_path, access_count ORDER BY p DESC, position) AS rn FROM (
    SELECT b.*, c.chunk, c.position, round({SCORE.format(c='c.chunk')}, 1) AS p
    FROM (SELECT DISTINCT file_path, file_size_kb, access_count FROM bench_log) b
    CROSS JOIN (SELECT chunk, row_number() OVER (ORDER BY chunk DESC) AS position FROM (SELECT DISTINCT chunk_size_kb AS chunk FROM bench_log)) c))
WHERE rn = 1""")
def _(t: Tables):
    # Scores rounded to one digit tie often; the list runs from the largest chunk down.
    rows = t.bench_log.select("file_path", "file_size_kb", "access_count").distinct()
    chunks = F.array(*[F.lit(c) for c in reversed(candidates.candidate_list(t.bench_log))])
    scored = rows.withColumn("scored", F.transform(chunks, lambda c, i: F.struct(
        F.round(score(c), 1).alias("p"), i.alias("position"), c.alias("chunk"))))
    return rounded(candidates.argmax_candidate(scored, ["file_path", "file_size_kb", "access_count"], listed="scored"))


@query("win_top_confidence", """
SELECT trial_id, after_read_speed AS confidence FROM trials ORDER BY 2 DESC, 1 LIMIT 1""")
def _(t: Tables):
    return candidates.most_confident(t.trials.select("trial_id", F.col("after_read_speed").alias("confidence")), ["trial_id"])


@query("win_upsert_latest", """
SELECT file_path, min(access_time) AS first_seen, max(access_time) AS last_seen,
  arg_max(size, (access_time, id)) AS file_size, arg_max(chunk, (access_time, id)) AS chunk_size
FROM (SELECT *, read_size + write_size AS size, 64 * (1 + id % 8) AS chunk FROM accesses) GROUP BY 1""")
def _(t: Tables):
    return profiles.latest_metadata(events_with_facts(t))


def events_with_facts(t: Tables):
    """Accesses that also carry the file's size and chunk size at that time."""
    return t.accesses.withColumns({"file_size": F.col("read_size") + F.col("write_size"), "chunk_size": 64 * (1 + F.col("id") % 8)})


@query("win_dedup_first", """
SELECT file_path, start_time, ingest_id, bytes_transferred, operation_type FROM (
  SELECT *, row_number() OVER (PARTITION BY file_path, start_time ORDER BY ingest_id) AS rn FROM (
    SELECT ingest_id, file_path, date_trunc('month', start_time)::TIMESTAMP AS start_time, bytes_transferred, operation_type FROM tput)) WHERE rn = 1""")
def _(t: Tables):
    rows = t.tput.select("ingest_id", "file_path", F.date_trunc("month", "start_time").cast("timestamp_ntz").alias("start_time"),
                         "bytes_transferred", "operation_type")
    return profiles.dedup_throughput(rows)


@query("win_cum_variance", "SELECT CAST(min(pos) AS INT) AS components FROM (SELECT row_number() OVER (ORDER BY v DESC, c) AS pos, "
       "sum(v) OVER (ORDER BY v DESC, c) / sum(v) OVER () AS share FROM (" + " UNION ALL ".join(
           f"SELECT '{c}' AS c, var_pop({c}) AS v FROM bench_log" for c in NUMERIC) + ")) WHERE round(share, 12) >= 0.95")
def _(t: Tables):
    variances = melt(t.bench_log, NUMERIC, "component").groupBy("component").agg(F.var_pop("value").alias("variance"))
    return stats.pca_k(variances)
