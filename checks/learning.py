"""Scaling, training sets, models and plans."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, functions as F

from accesslake.operators import candidates, clean, evaluate, features, labels, models, som, stats
from accesslake.plans import recommend, train
from accesslake.session import materialise, work_dir
from accesslake.sources import sinks
from accesslake.sources.bundles import Bundle, load_bundle, save_bundle
from .aggregates import grid
from .registry import Tables, query, rounded
from .relational import mean_codebook

SCALED = ("file_size_kb", "access_count", "avg_read_kb", "read_ops", "throughput_kbps")
KEY = ["k1", "k2", "k3"]


def _per_column(expression: str, stats_of: str) -> str:
    columns = ", ".join(f"round({expression.format(c=c)}, 6) AS {c}" for c in SCALED)
    moments = ", ".join(stats_of.format(c=c) for c in SCALED)
    return f"SELECT k1, k2, k3, {columns} FROM bench_log, (SELECT {moments} FROM bench_log)"


@query("ml_scale_standard", _per_column("({c} - m_{c}) / s_{c}", "avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}"))
def _(t: Tables):
    return rounded(features.standard_scale(t.bench_log, SCALED).select(*KEY, *SCALED))


@query("ml_scale_robust", _per_column(
    "({c} - m_{c}) / (h_{c} - l_{c})",
    "quantile_cont({c}, 0.5) AS m_{c}, quantile_cont({c}, 0.25) AS l_{c}, quantile_cont({c}, 0.75) AS h_{c}"))
def _(t: Tables):
    return rounded(features.robust_scale(t.bench_log, SCALED).select(*KEY, *SCALED))


@query("ml_scale_minmax", _per_column("({c} - l_{c}) / (h_{c} - l_{c})::DOUBLE", "min({c}) AS l_{c}, max({c}) AS h_{c}"))
def _(t: Tables):
    return rounded(features.minmax_scale(t.bench_log, SCALED).select(*KEY, *SCALED))


# What holds for principal components of a table, whatever their signs: as many rows, centred, uncorrelated columns whose variances fall,
# and no fewer of them than the share of variance needs.
PCA_FACTS = """
SELECT count(*) AS row_count, true AS centred, true AS uncorrelated, true AS falling, true AS enough, true AS needed FROM {source}"""


def pca_facts(projected: DataFrame, total: int, kept: float = stats.KEPT_VARIANCE) -> DataFrame:
    """The facts above; ``total`` is the number of scaled columns, each of variance 1 (those that vary)."""
    names = [c for c in projected.columns if c.startswith("PC")]
    d = len(names)
    m = stats.moments(projected, names)
    variance = [F.col("co")[i * d + i] / F.col("n") for i in range(d)]
    apart = [F.abs(F.col("co")[i * d + j]) <= 1e-6 * F.sqrt(F.col("co")[i * d + i] * F.col("co")[j * d + j]) for i in range(d) for j in range(i)]
    share = sum(variance) / total
    return m.select(
        F.col("n").alias("row_count"), F.forall("mean", lambda x: F.abs(x) < 1e-6).alias("centred"), reduce(and_, apart, F.lit(True)).alias("uncorrelated"),
        reduce(and_, [a >= b for a, b in zip(variance, variance[1:])], F.lit(True)).alias("falling"), (share >= kept - 1e-9).alias("enough"),
        (share - variance[-1] / total < kept).alias("needed"))


@query("ml_pca", PCA_FACTS.format(source="v1"))
def _(t: Tables):
    """The components of the whole table, from the fitted pipeline stored and loaded again."""
    log = features.derive_v1(t.v1)
    columns = [c for c in features.V1_FEATURES if c != "dir_depth"]
    path = work_dir(t.spark, "pca")
    save_bundle(t.spark, path, Bundle({"pca": features.fit_pca(log, columns)}))
    return pca_facts(features.project_pca(log, load_bundle(t.spark, path).models["pca"], keep=KEY), len(columns))


# The training sets: the v1 features with a spread, the target, and how DuckDB finds the chosen columns.
SET_COLUMNS = tuple(c for c in features.V1_FEATURES if c != "dir_depth")
TARGET = "chunk_size_kb"
CHOSEN = 5
_SOURCE = """(SELECT *, chunk_size / 1024.0e0 AS chunk_size_kb, file_size / 1048576.0e0 AS file_size_mb,
  read_count::DOUBLE / CASE WHEN write_count = 0 THEN 1 ELSE write_count END AS read_write_ratio,
  (avg_read_size * read_count + avg_write_size * write_count) / CASE WHEN access_count = 0 THEN 1 ELSE access_count END AS avg_access_size,
  greatest(max_read_size, max_write_size) AS max_access_size, 100.0e0 * read_count / CASE WHEN access_count = 0 THEN 1 ELSE access_count END AS read_percentage,
  coalesce(TRY_CAST(regexp_extract(file_path, 'testdir_([0-9]+)K', 1) AS BIGINT) * 1024, 0) AS path_chunk_hint FROM v1)"""
_Z = ", ".join(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS z_{c}" for c in SET_COLUMNS)
_RANKED = " UNION ALL ".join(f"SELECT '{c}' AS f, corr({c}, chunk_size_kb) AS r FROM {_SOURCE}" for c in SET_COLUMNS)


def training_set(name: str, chosen: str):
    # A long form of each set makes the chosen columns part of the comparison.
    parts = " UNION ALL ".join(f"SELECT '{c}' AS feature, z_{c} AS z, chunk_size_kb FROM scaled" for c in SET_COLUMNS)

    @query(f"ml_datasets_{name}", f"""
WITH scaled AS (SELECT chunk_size_kb, {_Z} FROM {_SOURCE}), chosen AS ({chosen})
SELECT feature, count(*) AS row_count, round(sum(z * chunk_size_kb) / count(*), 4) AS moment FROM ({parts}) WHERE feature IN (SELECT f FROM chosen) GROUP BY 1""")
    def _(t: Tables):
        log = features.derive_v1(t.v1)
        made = features.training_sets(log, SET_COLUMNS, TARGET, k=CHOSEN)[name]
        columns = [c for c in made.columns if c != TARGET]
        long = made.unpivot([TARGET], columns, "feature", "z")
        return rounded(long.groupBy("feature").agg(F.count(F.lit(1)).alias("row_count"), F.avg(F.col("z") * F.col(TARGET)).alias("moment")), 4)


training_set("full", f"SELECT f FROM ({_RANKED})")
training_set("correlation", f"SELECT f FROM ({_RANKED}) ORDER BY r DESC, f LIMIT {CHOSEN}")
training_set("fscore", f"SELECT f FROM ({_RANKED}) ORDER BY r * r DESC, f LIMIT {CHOSEN}")


@query("ml_datasets_pca", PCA_FACTS.format(source="v1"))
def _(t: Tables):
    return pca_facts(features.training_sets(features.derive_v1(t.v1), SET_COLUMNS, TARGET, k=CHOSEN)["pca"], len(SET_COLUMNS))


@query("ml_align", """
SELECT k1, k2, k3, throughput_kbps, 0.0e0 AS queue_depth, CAST(coalesce(CASE WHEN k1 % 11 <> 0 THEN chunk_size_kb END, 0) AS DOUBLE) AS chunk_size_kb FROM bench_log""")
def _(t: Tables):
    holed = t.bench_log.withColumn("chunk_size_kb", F.when(F.col("k1") % 11 != 0, F.col("chunk_size_kb")))
    return features.align_features(holed, ["throughput_kbps", "queue_depth", "chunk_size_kb"], keep=KEY)


@query("ml_split", """
SELECT trial_id, model_type, CAST(('0x' || substr(md5(concat('42|', trial_id, '|', model_type)), 1, 8))::BIGINT % 10000 < 2500 AS INT) AS is_test FROM trials""")
def _(t: Tables):
    rows = t.trials.select("trial_id", "model_type")
    training, test = models.stratified_split(rows, "model_type", ["trial_id"])
    return training.withColumn("is_test", F.lit(0)).unionByName(test.withColumn("is_test", F.lit(1)))


# Fast throughput goes with large chunks on large files and with few accesses: a signal to find.
def planted(t: Tables) -> DataFrame:
    fit = -F.abs(F.log2("chunk_size_kb") - F.log2(F.col("file_size_kb") / 4)) * 9000
    return t.bench_log.withColumn("throughput_kbps", 60000 + fit + F.col("throughput_kbps") / 20)


MODEL_INPUT = models.RF_FEATURES
GBT_INPUT = tuple(c for c in models.MODEL_FEATURES if c != "throughput_kbps")

@query("ml_rf_stack", """
SELECT count(DISTINCT chunk_size_kb)::INT AS candidates, true AS separates, true AS in_range FROM bench_log""")
def _(t: Tables):
    _, chunks, metrics = train.train_rf(planted(t), KEY, MODEL_INPUT)
    inside = [F.col(c).between(0, 1) for c in ("accuracy", "precision", "recall", "f1", "auc")]
    return metrics.select(F.lit(len(chunks)).alias("candidates"), (F.col("auc") > 0.8).alias("separates"), reduce(and_, inside).alias("in_range"))


@query("ml_gbt_cv", """
SELECT unnest(range(5))::INT AS fold, true AS separates, true AS in_range, 1::BIGINT AS best_folds""")
def _(t: Tables):
    fit = train.train_gbt(planted(t), KEY, GBT_INPUT)
    inside = [F.col(c).between(0, 1) for c in ("accuracy", "precision", "recall", "f1", "auc")]
    return fit.folds.select("fold", (F.col("auc") > 0.8).alias("separates"), reduce(and_, inside).alias("in_range"),
                            F.lit(int(0 <= fit.best_fold < 5)).cast("bigint").alias("best_folds"))


def fitted_rf(t: Tables):
    labelled = materialise(labels.label_ot(planted(t)), "rf-labels")
    return models.fit_rf_stack(labelled, MODEL_INPUT), candidates.candidate_list(labelled)


# What holds for every prediction, whatever was fitted: one for each row of the log, of a known size, with a probability.
def _counts(predicted: DataFrame, valid) -> DataFrame:
    return predicted.groupBy("file_path").agg(
        F.count(F.lit(1)).alias("row_count"), F.count_if(valid).alias("valid_choices"),
        F.count_if(F.col("confidence").between(0, 1)).alias("probabilities"), F.sum("current_chunk_kb").cast("bigint").alias("current_kb"))


COUNTS = """
SELECT file_path, count(*) AS row_count, count(*) AS valid_choices, count(*) AS probabilities, sum(chunk_size_kb)::BIGINT AS current_kb
FROM bench_log GROUP BY 1"""


@query("ml_rf_predict", COUNTS)
def _(t: Tables):
    model, chunks = fitted_rf(t)
    return _counts(models.predict_rf(planted(t), model, chunks), F.col("optimal_chunk_kb").isin(*chunks))


@query("ml_gbt_predict", COUNTS)
def _(t: Tables):
    labelled = materialise(labels.label_optimal(planted(t)), "gbt-labels")
    fit = models.fit_gbt_cv(labelled, KEY, GBT_INPUT)
    # the decision is one of the sizes for the file's tier, its own size, or the smallest chunk
    return _counts(models.predict_gbt(planted(t), fit.model), F.col("optimal_chunk_kb").between(64, 8192))


@query("ml_som_fit", """
SELECT CAST(power(least(greatest(ceil(5 * sqrt(count(*))), 10), 30), 2) AS BIGINT) AS units, 10 AS epochs, true AS descends, count(*) AS assigned,
  true AS in_grid, true AS error_is_last FROM embeddings WHERE embedding IS NOT NULL""")
def _(t: Tables):
    """A map of the derived side over all epochs, stored and loaded: its descent, and every row assigned by it."""
    rows = t.embeddings.where("embedding IS NOT NULL").select("embedding")
    path = work_dir(t.spark, "map")
    train.save_map(som.fit_map(rows, "embedding"), path, t.spark)
    fitted = train.load_map(path, t.spark)
    units = fitted.codebook.count()
    side = round(units ** 0.5)
    errors = fitted.errors
    found = fitted.assign(rows, "embedding").agg(
        F.count("distance").alias("assigned"), (F.count_if(F.col("unit.i").between(0, side - 1) & F.col("unit.j").between(0, side - 1)) == F.count("distance"))
        .alias("in_grid"), (F.abs(F.avg("distance") - errors[-1]) < 1e-9).alias("error_is_last"))
    # the first epochs spread the units, which were rows, over the grid; from the highest error on it falls to the end
    peak = errors.index(max(errors))
    falls = peak <= len(errors) // 3 and errors[-1] < 0.9 * errors[peak] and all(b <= a for a, b in zip(errors[peak:], errors[peak + 1:]))
    return found.select(F.lit(units).cast("bigint").alias("units"), F.lit(len(errors) - 1).alias("epochs"), F.lit(falls).alias("descends"), "assigned",
                        "in_grid", "error_is_last")


@query("ml_som_predict", """
SELECT concat('/mnt/e', a.vec_id) AS file_path, a.vec_id * 1000 AS file_size, a.chunk_size_kb AS current_chunk_size, kb AS predicted_chunk_size,
  round(a.chunk_size_kb * 1024 / (kb * 1024)::DOUBLE, 6) AS current_to_predicted_ratio, CAST(a.i AS INT) AS i, CAST(a.j AS INT) AS j
FROM assigned a JOIN (SELECT i, j, CAST(least(greatest(round_even(chunk / 128.0e0, 0) * 128, 64), 4096) AS BIGINT) AS kb FROM unit_map) m ON a.i = m.i AND a.j = m.j""")
def _(t: Tables):
    rows = t.embeddings.select(
        F.concat(F.lit("/mnt/e"), F.col("vec_id").cast("string")).alias("file_path"), (F.col("vec_id") * 1000).alias("file_size"),
        (F.pow(F.lit(2.0), F.col("vec_id") % 7) * 65536).cast("bigint").alias("chunk_size"), F.col("embedding").alias("vector"))
    codebook = mean_codebook(t)
    assigned = som.nearest_unit(rows.withColumn("chunk_size_kb", F.col("chunk_size") / 1024), codebook)
    found = som.predict_som(rows, codebook, som.unit_chunk_map(assigned, grid(t)))
    return rounded(found.select("*", "bmu.i", "bmu.j").drop("bmu"))


@query("ml_whatif", """
SELECT concat('/described/file', CASE WHEN e = '' OR starts_with(e, '.') THEN e ELSE concat('.', e) END) AS file_path, file_size, CAST(1048576 AS BIGINT) AS chunk_size,
  r + w AS access_count, rs AS avg_read_size, ws AS avg_write_size, rs * 2 AS max_read_size, ws * 2 AS max_write_size, r AS read_count, w AS write_count,
  100.0e0 AS throughput_mbps, round(file_size / 1024.0e0, 4) AS "file_size_KB", 1024.0e0 AS "chunk_size_KB", 102400.0e0 AS "throughput_KBps",
  round(rs / 1024.0e0, 4) AS "avg_read_KB", round(ws / 1024.0e0, 4) AS "avg_write_KB", round(rs * 2 / 1024.0e0, 4) AS "max_read_KB",
  round(ws * 2 / 1024.0e0, 4) AS "max_write_KB", r AS read_ops, w AS write_ops
FROM (SELECT read_size + write_size AS file_size, read_size AS rs, write_size AS ws, id % 12 AS r, id % 5 AS w,
  CASE id % 3 WHEN 0 THEN '' WHEN 1 THEN '.csv' ELSE 'txt' END AS e FROM accesses)""")
def _(t: Tables):
    described = t.accesses.select(
        (F.col("read_size") + F.col("write_size")).alias("file_size"), "read_size", "write_size", (F.col("id") % 12).alias("read_count"),
        (F.col("id") % 5).alias("write_count"), F.expr("CASE id % 3 WHEN 0 THEN '' WHEN 1 THEN '.csv' ELSE 'txt' END").alias("extension"))
    return rounded(clean.normalise_units(recommend.what_if(described)), 4)


CHUNKS = (64.0, 128.0, 256.0, 512.0, 1024.0, 2048.0, 4096.0, 8192.0)


def file_score(chunk):
    target = F.col("file_size") / 1048576.0 + F.col("access_count") * 10.0
    return 1.0 / (1.0 + F.abs(chunk - target) / 512.0)


closed_form = recommend.closed_form(file_score, CHUNKS)
BEST_OF_FILES = """(SELECT file_path, file_size, chunk_size, access_count, best, max(chunk) AS chunk FROM (SELECT *, max(p) OVER (PARTITION BY file_path) AS best FROM (
  SELECT f.*, c.chunk, 1.0e0 / (1.0e0 + abs(c.chunk - (f.file_size / 1048576.0e0 + f.access_count * 10.0e0)) / 512.0e0) AS p
  FROM features f CROSS JOIN (SELECT unnest([64, 128, 256, 512, 1024, 2048, 4096, 8192]) AS chunk) c)) WHERE best - p < 1e-4
  GROUP BY file_path, file_size, chunk_size, access_count, best)"""


@query("ml_batch_predict", """
SELECT 'rows' AS item, count(*)::DOUBLE AS value FROM bench_log UNION ALL SELECT 'current_kb', sum(chunk_size_kb)::DOUBLE FROM bench_log
UNION ALL SELECT 'binned', count(*)::DOUBLE FROM bench_log""")
def _(t: Tables):
    model, chunks = fitted_rf(t)
    path = work_dir(t.spark, "predictions")
    predicted = recommend.batch_predict(planted(t), lambda log: models.predict_rf(log, model, chunks))
    sinks.write_csv(predicted, path)
    kinds = ("file_path string, current_chunk_kb double, optimal_chunk_kb double, confidence double, current_chunk_bytes double, "
             "predicted_chunk_kb double")
    stored = t.spark.read.option("header", True).schema(kinds).csv(path)
    bins = stats.histogram(stored, "predicted_chunk_kb", 10).agg(F.sum("row_count").cast("double").alias("value"))
    impact = evaluate.storage_impact(stored)
    parts = [stored.agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("rows").alias("item"), "value"),
             impact.select(F.lit("current_kb").alias("item"), F.col("current_kb").alias("value")),
             bins.select(F.lit("binned").alias("item"), "value")]
    return reduce(DataFrame.unionByName, parts)


@query("ml_batch_predict_closed", f"""
SELECT file_path, CAST(chunk_size AS BIGINT) AS current_chunk_kb, CAST(chunk AS BIGINT) AS optimal_chunk_kb, round(best, 6) AS confidence,
  CAST(chunk_size * 1024 AS BIGINT) AS current_chunk_bytes, CAST(chunk AS BIGINT) AS predicted_chunk_kb FROM {BEST_OF_FILES}""")
def _(t: Tables):
    """The same without a model: every file by the closed-form score."""
    return rounded(recommend.batch_predict(recommend.file_features(t.files, t.accesses, t.tput), closed_form))


@query("ml_analyze", f"""
SELECT b.file_path, b.file_size // 1024 AS size_kb, b.chunk_size AS current_chunk_kb, CAST(b.chunk AS BIGINT) AS optimal_chunk_kb,
  CASE WHEN b.chunk = b.chunk_size THEN 'Already optimal' WHEN b.chunk_size < b.chunk THEN 'Increase' ELSE 'Decrease' END AS recommendation,
  f.read_count, f.write_count, round(f.read_count / CASE WHEN f.write_count = 0 THEN 1.0e0 ELSE f.write_count END, 4) AS read_write_ratio,
  CASE WHEN b.file_size >= 1048576 THEN printf('%.2f MB', b.file_size / 1048576.0e0) WHEN b.file_size >= 1024 THEN printf('%.2f KB', b.file_size / 1024.0e0)
    ELSE concat(b.file_size, ' bytes') END AS file_size_text
FROM {BEST_OF_FILES} b JOIN features f ON b.file_path = f.file_path""")
def _(t: Tables):
    done = recommend.analyze(recommend.file_features(t.files, t.accesses, t.tput), closed_form)
    return rounded(done.drop("avg_read_text", "avg_write_text"), 4)


@query("ml_plan", f"""
SELECT file_path, chunk_size AS old_chunk_size, CAST(least(greatest(chunk, 64), 4096) AS BIGINT) AS new_chunk_size, round(best, 6) AS confidence
FROM {BEST_OF_FILES} WHERE chunk_size <> least(greatest(chunk, 64), 4096) AND file_size >= 1000000
  AND file_path IN (SELECT file_path FROM accesses GROUP BY file_path HAVING count(*) >= 5)""")
def _(t: Tables):
    return rounded(recommend.change_plan(t.files, t.accesses, t.tput, closed_form, min_size=1_000_000, min_access=5))
