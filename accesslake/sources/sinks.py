"""Results out: CSV with header, and the description of a trained model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schemas


def write_csv(df: DataFrame, path: str) -> None:
    """CSV part files with a header; the tasks write side by side."""
    df.write.option("header", True).csv(path)


def model_info(spark: SparkSession, features: Sequence[str], thresholds: DataFrame, cv: DataFrame, trained_at: str) -> DataFrame:
    """One row: features, thresholds (name, value), time and mean metrics (metric, mean)."""
    row = spark.range(1).select(
        F.array(*[F.lit(f) for f in features]).alias("features"), F.lit(trained_at).cast("timestamp").alias("trained_at"))
    limits = thresholds.agg(F.map_from_entries(F.collect_list(F.struct("name", "value")))).scalar()
    means = cv.agg(F.map_from_entries(F.collect_list(F.struct("metric", "mean")))).scalar()
    return row.withColumns({"thresholds": limits, "metrics": means}).select(*schemas.MODEL_INFO.names)


def write_model_info(info: DataFrame, path: str) -> None:
    info.write.json(path)


def read_model_info(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.MODEL_INFO).json(path)
