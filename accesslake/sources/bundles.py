"""A trained model with all that belongs to it, stored as one version.

A bundle holds fitted pipelines, tables (candidates, thresholds, metrics, codebooks, chunk maps) and named numbers. It is written whole into
a folder of its own; then the pointer moves, so that whoever loads it gets one training's parts together, and a training that stops halfway
is never seen.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel, Transformer
from pyspark.sql import DataFrame, SparkSession

from .versions import Folder


@dataclass
class Bundle:
    models: Mapping[str, PipelineModel] = field(default_factory=dict)
    tables: Mapping[str, DataFrame] = field(default_factory=dict)
    facts: Mapping[str, object] = field(default_factory=dict)


def save_bundle(spark: SparkSession, path: str, bundle: Bundle) -> str:
    """Write the bundle as the next version and make it the current one; returns the version. The one before is kept, older ones go."""
    folder = Folder(spark, path)
    now = folder.pointer()
    after = f"v{int(now[1:]) + 1}" if now else "v0"
    base = f"{folder.path}/{after}"
    folder.delete(after)  # what a stopped training left
    for name, model in bundle.models.items():
        whole = model if isinstance(model, PipelineModel) else PipelineModel([model])
        whole.write().overwrite().save(f"{base}/models/{name}")
    for name, table in bundle.tables.items():
        table.write.mode("overwrite").parquet(f"{base}/tables/{name}")
    listed = json.dumps({"models": sorted(bundle.models), "tables": {n: t.schema.jsonValue() for n, t in bundle.tables.items()},
                         "facts": dict(bundle.facts)})
    spark.createDataFrame([(listed,)], "value string").coalesce(1).write.mode("overwrite").text(f"{base}/contents")
    folder.point_to(after)
    for name in folder.names():
        if name.startswith("v") and name not in (now, after):
            folder.delete(name)
    return after


def load_bundle(spark: SparkSession, path: str, version: str | None = None) -> Bundle:
    """The current bundle, or the version asked for; an error if there is none."""
    from pyspark.sql.types import StructType

    at = version or Folder(spark, path).pointer()
    if at is None:
        raise FileNotFoundError(f"{path} holds no model")
    base = f"{path}/{at}"
    listed = json.loads("\n".join(r["value"] for r in spark.read.text(f"{base}/contents").collect()))
    models = {n: PipelineModel.load(f"{base}/models/{n}") for n in listed["models"]}
    tables = {n: spark.read.schema(StructType.fromJson(s)).parquet(f"{base}/tables/{n}") for n, s in listed["tables"].items()}
    return Bundle(models, tables, listed["facts"])


def only(model: PipelineModel) -> Transformer:
    """The stage of a pipeline that was stored as one."""
    return model.stages[0]
