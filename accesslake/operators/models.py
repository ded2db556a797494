"""Training, scoring and storing the two tree models as pipelines of Spark ML."""

from __future__ import annotations

from collections.abc import Collection, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, ImputerModel, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegralType

from .candidates import TIE, candidate_list
from .common import spread, with_row
from .ensembles import boosted_probability, trees_of, with_best_candidate, with_candidate_scores
from .evaluate import binary_metrics, cv_summary
from .forests import fit_boosted, fit_forest, scored, to_blocks
from .labels import with_band
from ..functions.sizing import decide, tier_candidates
from ..session import work_dir
from ..sources.bundles import Bundle, load_bundle, save_bundle

# The features of the bench-log models.
MODEL_FEATURES = ("file_size_kb", "chunk_size_kb", "access_count", "avg_read_kb", "avg_write_kb",
                  "max_read_kb", "max_write_kb", "read_ops", "write_ops", "throughput_kbps")
# The forest sees the access band, and not the throughput that its label is computed from.
RF_FEATURES = (*(f for f in MODEL_FEATURES if f != "throughput_kbps"), "access_count_label")
TEST_SHARE = 0.25
METRICS = ("logloss", "accuracy", "precision", "recall", "f1", "auc")


def require_samples(df: DataFrame, n: int = 100) -> DataFrame:
    """``df`` if it has at least ``n`` rows; looks at no more than that."""
    # take() widens from one partition as needed; a counted limit would start a task on every one.
    found = len(df.select(F.lit(1)).take(n))
    if found < n:
        raise ValueError(f"{found} rows are too few to train on, at least {n} are needed")
    return df


def hash_bucket(columns: Sequence[str], buckets: int, seed: int = 42):
    """A repeatable bucket from the md5 of the columns, the same on every run and partitioning."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns])
    return F.conv(F.substr(F.md5(text), F.lit(1), F.lit(8)), 16, 10).cast("bigint") % buckets


def stratified_split(df: DataFrame, label: str, key: Sequence[str], share: float = TEST_SHARE,
                     seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Train and test rows. The hash includes the label, so every label is split in the same share."""
    test = hash_bucket([*key, label], 10_000, seed) < int(round(share * 10_000))
    return df.where(~test), df.where(test)


def with_class_weight(df: DataFrame, label: str) -> DataFrame:
    """``weight`` = n / (2 * rows of the row's class)."""
    counts = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 1).alias("ones"))
    of_class = F.when(F.col(label) == 1, F.col("_m.ones")).otherwise(F.col("_m.n") - F.col("_m.ones"))
    return with_row(df, counts).withColumn("weight", F.try_divide(F.col("_m.n"), 2 * of_class)).drop("_m")


def feature_stages(df: DataFrame, features: Sequence[str]) -> list:
    """Fitted stages from feature columns to one vector. Nulls become the medians of the training rows, which travel along."""
    filled = [f"_{c}" for c in features]
    numbers = df.select(*[F.col(c).cast("double").alias(c) for c in features])
    return [Imputer(inputCols=list(features), outputCols=filled, strategy="median").fit(numbers),
            VectorAssembler(inputCols=filled, outputCol="features")]


def medians_of(imputer: ImputerModel) -> list[float]:
    known = imputer.surrogateDF.first().asDict()
    return [known[c] for c in imputer.getInputCols()]


def model_input(model: PipelineModel, df: DataFrame, as_is: Collection[str] = ()) -> DataFrame:
    """``df`` with the columns that the model reads, as numbers (but for those to be left as they are); the access band is derived where
    it is missing."""
    features = model.stages[0].getInputCols()
    if "access_count_label" in features and "access_count_label" not in df.columns:
        df = with_band(df)
    return df.withColumns({c: F.col(c).cast("double") for c in features if c not in as_is})


def without_summary(model, spark: SparkSession):
    """The same fitted trees, stored and loaded: a training summary would tie them to the session that made them."""
    path = work_dir(spark, "forest")
    model.write().overwrite().save(path)
    return type(model).load(path)


def fit_rf_stack(df: DataFrame, features: Sequence[str] = MODEL_FEATURES, label: str = "OT", trees: int = 100,
                 rounds: int = 50, depth: int = 5, seed: int = 42) -> PipelineModel:
    """Balanced forest and boosted trees, and a balanced logistic model over their probabilities.

    The labelled rows are dealt out evenly in bins once for both fits, and what the trees say of them for the last.
    """
    prepare = feature_stages(df, features)
    data = to_blocks(df, features, medians_of(prepare[0]), label, spread)
    stacked = None
    try:
        weights = tuple(data.rows / (2 * n) if n else 0.0 for n in (data.rows - data.ones, data.ones))
        forest = fit_forest(data, RandomForestClassifier(
            labelCol=label, weightCol="weight", numTrees=trees, maxDepth=depth, featureSubsetStrategy="sqrt", seed=seed,
            predictionCol="rf_prediction", probabilityCol="rf_probability", rawPredictionCol="rf_raw"), weights, seed)
        boosted, = fit_boosted(data, GBTClassifier(
            labelCol=label, maxIter=rounds, maxDepth=depth, stepSize=0.1, seed=seed,
            predictionCol="gb_prediction").setRawPredictionCol("gb_raw").setProbabilityCol("gb_probability"), seed=seed)
        base = [forest, boosted,
                VectorSlicer(inputCol="rf_probability", outputCol="rf_p", indices=[1]),
                VectorSlicer(inputCol="gb_probability", outputCol="gb_p", indices=[1]),
                VectorAssembler(inputCols=["rf_p", "gb_p"], outputCol="stack")]
        said = scored(data, [trees_of(forest), trees_of(boosted)], lambda y, _, sums: (
            y, np.array(weights)[y], sums[0][:, 1] / sums[0].sum(axis=1), boosted_probability(sums[1])),
            "label double, weight double, rf_p double, gb_p double")
        stacked = base[-1].transform(said).select("stack", F.col("label").alias(label), "weight").persist()
        meta = LogisticRegression(featuresCol="stack", labelCol=label, weightCol="weight",
                                  probabilityCol="probability").fit(stacked)
        meta = without_summary(meta, df.sparkSession)
    finally:
        if stacked is not None:
            stacked.unpersist()
        data.release()
    return PipelineModel([*prepare, *base, meta])


def with_probability(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Adds ``p``, the probability of class 1, and drops the model's inner columns."""
    scored = model.transform(model_input(model, df))
    return scored.withColumn("p", vector_to_array("probability")[1]).select(*df.columns, "p")


@dataclass
class BoostedFit:
    """The best fold's model, the metrics of every fold, and what the labels were made with (name, value), if they were made here."""

    model: PipelineModel
    folds: DataFrame
    best_fold: int
    thresholds: DataFrame | None = None


def fit_gbt_cv(df: DataFrame, key: Sequence[str], features: Sequence[str] = MODEL_FEATURES, label: str = "is_optimal",
               folds: int = 5, rounds: int = 100, depth: int = 6, seed: int = 42) -> BoostedFit:
    """Boosted trees over hash folds, stopping when the left-out fold no longer gains.

    The model of the fold with the lowest logloss is kept; ``folds`` has one metric row per fold.
    """
    spark = df.sparkSession
    prepare = feature_stages(df, features)
    marked = df.withColumn("_fold", hash_bucket(key, folds, seed))
    data = to_blocks(marked, features, medians_of(prepare[0]), label, spread, "_fold")
    metrics, models = [], []
    try:
        fitted = fit_boosted(data, GBTClassifier(
            labelCol=label, maxIter=rounds, maxDepth=depth, stepSize=0.1, subsamplingRate=0.8, featureSubsetStrategy="0.8",
            validationIndicatorCol="_held_out", seed=seed), folds, 0.8, 0.8, seed)
        for fold, model in enumerate(fitted):
            def held_out(y, folds_of, sums, fold=fold):
                parts = [(c, *np.unique(boosted_probability(sums[0][(folds_of == fold) & (y == c)]), return_counts=True)) for c in (0, 1)]
                return [np.concatenate(v) for v in zip(*[(np.full(len(p), c), p, n) for c, p, n in parts])]

            said = scored(data, [trees_of(model)], held_out, "label double, p double, n double")
            metrics.append({"fold": fold, **binary_metrics(said, "n").first().asDict()})
            models.append(PipelineModel([*prepare, model]))
    finally:
        data.release()
    best = min(range(folds), key=lambda i: metrics[i]["logloss"])
    table = spark.createDataFrame([(r["fold"], *[float(r[m]) for m in METRICS]) for r in metrics],
                                  "fold int, " + ", ".join(f"{m} double" for m in METRICS))
    return BoostedFit(models[best], table, best)


def predict_rf(df: DataFrame, model: PipelineModel, candidates: Sequence[float], key: Sequence[str] = ("file_path",),
               size: str = "file_size_kb", chunk: str = "chunk_size_kb", keep: Sequence[str] = ()) -> DataFrame:
    """Best trained chunk size and its confidence for every row, whether or not others have its ``key``.

    Among candidates whose probabilities are nearly equal the largest is chosen. A row's candidates are scored within the row: every
    input row comes out once, and nothing is shuffled. ``keep`` names further columns to carry along.
    """
    kind = df.schema[chunk].dataType
    chunks = [float(int(c)) if isinstance(kind, IntegralType) else float(c) for c in candidates]
    best = with_best_candidate(model_input(model, df, {chunk}), model, chunks, chunk, TIE)
    return best.select(*key, size, F.col(chunk).alias("current_chunk_kb"), F.col("_optimal").cast(kind).alias("optimal_chunk_kb"),
                       "confidence", *keep)


def predict_gbt(df: DataFrame, model: PipelineModel, key: Sequence[str] = ("file_path",),
                size: str = "file_size_kb", chunk: str = "chunk_size_kb", keep: Sequence[str] = ()) -> DataFrame:
    """Tiered candidates, model scores and the keep-or-change decision for every row, whether or not others have its ``key``.

    The candidates of a row are an array, scored within the row; among equals the first counts. Every input row comes out once; ``keep``
    names further columns to carry along. A row of a file too small for any candidate has no confidence, and is decided for 64 KB.
    """
    listed = model_input(model, df, {chunk, size}).withColumn("_c", tier_candidates(F.col(size), F.col(chunk)))
    scored = with_candidate_scores(listed, model, F.col("_c"), chunk, "_p")
    best = F.array_max("_p")
    current = F.array_position("_c", F.col(chunk).cast("double"))
    chosen = scored.withColumns({"_best": best, "_own": F.when(current > 0, F.get("_p", current.cast("int") - 1))}).withColumn(
        "_chunk", F.get("_c", F.array_position("_p", F.col("_best")).cast("int") - 1))
    return chosen.select(
        *key, size, F.col(chunk).alias("current_chunk_kb"),
        decide(F.col(size), F.col(chunk), F.col("_chunk"), F.col("_own"), F.col("_best")).alias("optimal_chunk_kb"),
        F.col("_best").alias("confidence"), *keep)


def save_model(model: PipelineModel, candidates: Sequence[float], path: str, spark: SparkSession) -> None:
    """The fitted stages with the candidate list next to them, as the next version of ``path``."""
    chunks = spark.createDataFrame([(float(c),) for c in candidates], "chunk double")
    save_bundle(spark, path, Bundle({"model": model}, {"candidates": chunks}))


def load_model(path: str, spark: SparkSession) -> tuple[PipelineModel, list[float]]:
    stored = load_bundle(spark, path)
    return stored.models["model"], candidate_list(stored.tables["candidates"], "chunk")


def save_boosted(fit: BoostedFit, path: str, spark: SparkSession, trained_at: str) -> None:
    """Boosted trees with the metrics of their folds, the means of those, and the thresholds of their labels."""
    means = cv_summary(fit.folds.drop("fold"), METRICS).collect()  # a row for each metric
    tables = {"folds": fit.folds} | ({"thresholds": fit.thresholds} if fit.thresholds is not None else {})
    save_bundle(spark, path, Bundle({"model": fit.model}, tables, {
        "features": list(fit.model.stages[0].getInputCols()), "best_fold": fit.best_fold, "trained_at": trained_at,
        "metrics": {r["metric"]: r["mean"] for r in means}}))


def load_boosted(path: str, spark: SparkSession) -> tuple[BoostedFit, dict]:
    """The stored fit, and its features, time and mean metrics."""
    stored = load_bundle(spark, path)
    fit = BoostedFit(stored.models["model"], stored.tables["folds"], stored.facts["best_fold"], stored.tables.get("thresholds"))
    return fit, dict(stored.facts)
