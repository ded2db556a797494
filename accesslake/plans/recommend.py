"""Recommending chunk sizes: change plans, per-file analysis, batches and described files."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.measures import human_size, recommend, rw_ratio
from ..functions.sizing import clamp
from ..operators.candidates import best_candidate_inline
from ..operators.clean import normalise_units, to_model_columns, with_default_features
from ..operators.models import predict_gbt, predict_rf
from ..operators.profiles import file_profiles, matching_files

# A predictor takes file features and returns them with current_chunk_kb, optimal_chunk_kb and confidence.
Predictor = Callable[[DataFrame], DataFrame]


def file_features(meta: DataFrame, access: DataFrame, throughput: DataFrame, chosen: DataFrame | None = None,
                  as_of: str | None = None, days: int = 30) -> DataFrame:
    """Complete features of all files, or of the chosen paths only, in one job."""
    if chosen is not None:
        meta = meta.join(chosen.select("file_path"), "file_path", "left_semi")
    return with_default_features(file_profiles(meta, access, throughput, as_of, days))


def change_plan(meta: DataFrame, access: DataFrame, throughput: DataFrame, predict: Predictor, force: bool = False,
                min_access: int | None = None, limit: int | None = None, **selection) -> DataFrame:
    """Files whose chunk size should change: path, old and new size in KB.

    The new size is clamped to what the file system accepts; files that are right stay out unless forced. Active files are told by
    the accesses of their profiles, so each fact table is read once.
    """
    profiles = file_profiles(matching_files(meta, **selection), access, throughput)
    return plan_of(profiles, predict, force, min_access, limit)


def plan_of(profiles: DataFrame, predict: Predictor, force: bool = False, min_access: int | None = None,
            limit: int | None = None) -> DataFrame:
    """The plan for files whose profiles are known."""
    active = profiles.where(F.col("access_count") >= max(1, min_access or 1))
    if limit:
        active = active.orderBy("file_path").limit(limit)
    predicted = predict(with_default_features(active))
    plan = predicted.select("file_path", F.col("current_chunk_kb").cast("bigint").alias("old_chunk_size"),
                            clamp(F.col("optimal_chunk_kb")).cast("bigint").alias("new_chunk_size"), "confidence")
    if force:
        return plan
    # A filter would be pushed below the scoring with every score written out in it; generating one row
    # or none keeps each score computed once.
    changed = F.col("old_chunk_size") != F.col("new_chunk_size")
    return plan.select(F.inline(F.when(changed, F.array(F.struct(*plan.columns)))))


def history_rows(plan: DataFrame, applied_at: str) -> DataFrame:
    """The plan as rows to append to the optimization history."""
    return plan.select("file_path", "old_chunk_size", "new_chunk_size",
                       F.lit(applied_at).cast("timestamp").alias("optimization_time"))


def analyze(features: DataFrame, predict: Predictor) -> DataFrame:
    """Per file: current and optimal chunk, recommendation, and the features that matter, readable."""
    predicted = predict(features)
    return predicted.select(
        "file_path", F.floor(F.col("file_size") / 1024).alias("size_kb"),
        human_size(F.col("file_size")).alias("file_size_text"),
        human_size(F.col("avg_read_size").cast("bigint")).alias("avg_read_text"),
        human_size(F.col("avg_write_size").cast("bigint")).alias("avg_write_text"),
        "read_count", "write_count", rw_ratio(F.col("read_count"), F.col("write_count")).alias("read_write_ratio"),
        "current_chunk_kb", "optimal_chunk_kb",
        recommend(F.col("current_chunk_kb"), F.col("optimal_chunk_kb")).alias("recommendation"))


def what_if(scenarios: DataFrame, stem: str = "/described/file") -> DataFrame:
    """Model input for described files: path, size, mean sizes and counts in, v1 log columns out.

    ``scenarios`` has file_size, read_size, write_size, read_count, write_count and extension; ``stem`` is the path before it.
    """
    ext = F.col("extension")
    dotted = F.when((ext == "") | ext.startswith("."), ext).otherwise(F.concat(F.lit("."), ext))
    return scenarios.select(
        F.concat(F.lit(stem), dotted).alias("file_path"), "file_size",
        F.lit(1048576).cast("bigint").alias("chunk_size"),
        (F.col("read_count") + F.col("write_count")).alias("access_count"),
        F.col("read_size").alias("avg_read_size"), F.col("write_size").alias("avg_write_size"),
        (F.col("read_size") * 2).alias("max_read_size"), (F.col("write_size") * 2).alias("max_write_size"),
        "read_count", "write_count", F.lit(100.0).alias("throughput_mbps"))


def predict_one(spark: SparkSession, file_size: int, read_size: int = 4096, write_size: int = 4096, read_count: int = 10,
                write_count: int = 5, extension: str = "") -> DataFrame:
    """One described file as normalised model input."""
    row = [(file_size, read_size, write_size, read_count, write_count, extension)]
    kind = ("file_size bigint, read_size bigint, write_size bigint, read_count bigint, write_count bigint, "
            "extension string")
    return normalise_units(what_if(spark.createDataFrame(row, kind)))


def batch_predict(log: DataFrame, predict: Predictor) -> DataFrame:
    """Predictions for a whole log with the columns ``storage_impact`` and ``histogram`` read."""
    predicted = predict(log)
    return predicted.select(
        "file_path", "current_chunk_kb", "optimal_chunk_kb", "confidence",
        (F.col("current_chunk_kb") * 1024).alias("current_chunk_bytes"),
        F.col("optimal_chunk_kb").alias("predicted_chunk_kb"))


def closed_form(score, candidates: Sequence[float]) -> Predictor:
    """A predictor out of a score expression: no model, no expansion."""
    def predict(df: DataFrame) -> DataFrame:
        best = best_candidate_inline(df, candidates, score)
        return best.select(*df.columns, F.col("chunk_size").alias("current_chunk_kb"),
                           F.col("optimal_chunk").cast("bigint").alias("optimal_chunk_kb"), "confidence")

    return predict


def fitted(model: PipelineModel, candidates: Sequence[float] | None = None) -> Predictor:
    """A predictor out of a fitted model: the forest over its trained candidates or, without any, the boosted trees over tiers.

    File features become model columns, the file's own chunk size among them; the features are carried through the scoring.
    """
    def predict(df: DataFrame) -> DataFrame:
        facts = df.withColumn("_facts", F.struct(*df.columns))
        rows = to_model_columns(facts, F.col("chunk_size"), keep=["_facts"])
        rows = rows.toDF(*[c.lower() for c in rows.columns])
        best = predict_gbt(rows, model, keep=["_facts"]) if candidates is None else predict_rf(rows, model, candidates, keep=["_facts"])
        return best.select("_facts.*", "current_chunk_kb", "optimal_chunk_kb", "confidence")

    return predict
