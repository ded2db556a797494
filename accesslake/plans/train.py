"""Training jobs: from a bench log to fitted models."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.clean import drop_missing, to_numeric
from ..operators.evaluate import binary_metrics
from ..operators.labels import label_optimal, label_ot, label_stats
from ..operators.models import (
    MODEL_FEATURES, RF_FEATURES, BoostedFit, candidate_list, fit_gbt_cv, fit_rf_stack, require_samples, stratified_split,
    with_probability)
from ..operators.som import FittedMap
from ..session import materialise
from ..sources.bundles import Bundle, load_bundle, save_bundle


def train_rf(log: DataFrame, key: Sequence[str], features: Sequence[str] = RF_FEATURES, min_samples: int = 100,
             **settings) -> tuple[PipelineModel, list[float], DataFrame]:
    """Label, split and fit the stacked forest: model, candidate chunks, hold-out metrics.

    The labelled rows are written once, so neither the split nor the fits repeat the labelling.
    """
    clean = to_numeric(drop_missing(log, ["throughput_kbps"]), ["throughput_kbps"])
    labelled = materialise(label_ot(require_samples(clean, min_samples)), "rf-labels")
    train, test = stratified_split(labelled, "OT", key)
    model = fit_rf_stack(train, features, **settings)
    scored = with_probability(model, test).select(F.col("OT").alias("label"), "p")
    return model, candidate_list(labelled), binary_metrics(scored)


def train_gbt(log: DataFrame, key: Sequence[str], features: Sequence[str] = MODEL_FEATURES, min_samples: int = 100,
              **settings) -> BoostedFit:
    """Label with pruning and balancing, and fit the boosted trees over folds.

    A log in which no run, or every run, is optimal is balanced by throughput; ``key`` tells rows of equal throughput apart.
    """
    clean = drop_missing(log, ["file_size_kb", "chunk_size_kb", "throughput_kbps"])
    ordered = require_samples(clean, min_samples).withColumn("_order", F.xxhash64(*key))
    labelled = materialise(label_optimal(ordered, order="_order").drop("_order"), "gbt-labels")
    fit = fit_gbt_cv(labelled, key, features, **settings)
    names = ("combinations", "optimal", "total", "optimal_ratio", "global_threshold")
    known = label_stats(labelled).select(*[F.col(c).cast("double").alias(c) for c in names])
    return replace(fit, thresholds=materialise(known.unpivot([], list(names), "name", "value"), "thresholds"))


def save_map(fitted: FittedMap, path: str, spark: SparkSession, chunk_map: DataFrame | None = None) -> None:
    """A map with its scaler, the errors of its epochs and, if there is one, the chunk size of every unit."""
    tables = {"codebook": fitted.codebook} | ({"chunk_map": chunk_map} if chunk_map is not None else {})
    save_bundle(spark, path, Bundle({"scaler": PipelineModel([fitted.scaler])}, tables, {"errors": fitted.errors}))


def load_map(path: str, spark: SparkSession) -> FittedMap:
    stored = load_bundle(spark, path)
    return FittedMap(stored.tables["codebook"], stored.models["scaler"].stages[0], list(stored.facts["errors"]), stored.tables.get("chunk_map"))
