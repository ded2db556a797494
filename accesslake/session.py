"""Session defaults and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job of this package is written for. A cluster may override any of them.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join side even where that costs one more exchange downstream.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # State larger than executor memory stays on local disk, with its changelog in the checkpoint.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(app: str = "accesslake", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder for one run below the cluster's shared checkpoint folder.

    The folder comes from ``spark.checkpoint.dir``. Only on a local master may that be unset: a temporary folder of this machine
    is then chosen. Elsewhere that is an error, since executors would each write to a disk of their own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="accesslake-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/accesslake/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later plans start from stored rows."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Stored intermediate tables of one job, each of which can be deleted as soon as nothing reads it any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, work_dir(spark, name)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` under a new name and read it back."""
        df.write.parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def release(self, *names: str) -> None:
        """Delete the named tables, or all of them. Frames that read them must not be used afterwards."""
        jvm = self.spark._jvm
        for path in [f"{self.folder}/{n}" for n in names] or [self.folder]:
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)
