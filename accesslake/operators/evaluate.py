"""Quality of binary predictions. Input columns: ``label`` (0/1) and ``p``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import DataFrame, functions as F

from ..session import materialise

SMALLEST_P = 1e-15


def confusion(pred: DataFrame) -> DataFrame:
    """(label, predicted, rows) at a cut of 0.5, half-even as rounding does."""
    return (pred.groupBy(F.col("label").cast("int").alias("label"), (F.col("p") > 0.5).cast("int").alias("predicted"))
            .agg(F.count(F.lit(1)).alias("row_count")))


def _counted(pred: DataFrame, rows: str | None = None) -> DataFrame:
    """(label, p, n): the predictions, evaluated and stored once, as counts of equal ones; ``rows`` names how many rows one stands for."""
    scored = pred.select(F.col("label").cast("double").alias("label"), F.col("p").cast("double").alias("p"),
                         (F.col(rows) if rows else F.lit(1)).cast("bigint").alias("n"))
    return materialise(scored.groupBy("label", "p").agg(F.sum("n").cast("double").alias("n")), "scores")


def roc_auc(pred: DataFrame) -> float:
    """Exact area under the ROC curve. Scores are counted per value, then sorted across the cluster."""
    return _auc(_counted(pred))


def _auc(counted: DataFrame) -> float:
    return BinaryClassificationEvaluator(rawPredictionCol="p", labelCol="label", weightCol="n", numBins=0).evaluate(counted)


def binary_metrics(pred: DataFrame, rows: str | None = None) -> DataFrame:
    """One row: rows, logloss, accuracy, precision, recall, f1, auc. The predictions are evaluated once, when this is called; ``rows``
    names the column, if there is one, of how many rows each stands for."""
    pred = _counted(pred, rows)
    label, hit = F.col("label"), F.col("p") > 0.5
    p = F.least(F.greatest(F.col("p"), F.lit(SMALLEST_P)), F.lit(1 - SMALLEST_P))
    loss = -(label * F.ln(p) + (1 - label) * F.ln(1 - p))
    of_rows = lambda which: F.sum(F.when(which, F.col("n")).otherwise(0)).cast("bigint")
    counted = pred.agg(
        F.sum("n").cast("bigint").alias("n"), (F.sum(loss * F.col("n")) / F.sum("n")).alias("logloss"),
        of_rows(hit & (label == 1)).alias("tp"), of_rows(hit & (label == 0)).alias("fp"),
        of_rows(~hit & (label == 1)).alias("fn"), of_rows(~hit & (label == 0)).alias("tn"))

    def ratio(top, bottom):
        return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))

    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counted.select(
        "n", "logloss", ratio(tp + F.col("tn"), F.col("n")).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), F.lit(_auc(pred)).alias("auc"))


def cv_summary(folds: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """(metric, mean, std) over folds, with the population deviation."""
    return (folds.select(*[F.col(m).cast("double").alias(m) for m in metrics])
            .unpivot([], list(metrics), "metric", "value")
            .groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")))


def storage_impact(df: DataFrame) -> DataFrame:
    """Summed current (bytes / 1024) and predicted KB with the percent change and its direction."""
    s = df.agg((F.sum("current_chunk_bytes") / 1024).alias("current_kb"),
               F.sum("predicted_chunk_kb").cast("double").alias("predicted_kb"))
    less = F.col("predicted_kb") < F.col("current_kb")
    pct = F.try_divide(F.abs(F.col("predicted_kb") - F.col("current_kb")), F.col("current_kb")) * 100
    return s.select("current_kb", "predicted_kb", pct.alias("change_pct"),
                    F.when(less, "reduction").otherwise("increase").alias("direction"))
