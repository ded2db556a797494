"""Registration of queries and access to the given and derived tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from accesslake.operators.profiles import throughput_rows
from accesslake.operators.trials import trial_changes
from . import domain

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Given tables by name, and the same data as file accesses, bench logs and trials."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in domain.SQL:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        sources = set(re.findall(r"\b(?:FROM|JOIN) (\w+)", domain.SQL[name]))
        text = re.sub(r"\b(FROM|JOIN) (\w+)", r"\1 {\2}", domain.SQL[name])
        return self.spark.sql(text, **{s: getattr(self, s) for s in sources})

    @property
    def transfer_rows(self) -> DataFrame:
        seconds = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("elapsed_s").cast("decimal(18,6)"))
        return self.transfers.withColumn("end_time", F.col("start_time") + seconds)

    @property
    def tput(self) -> DataFrame:
        return throughput_rows(self.transfer_rows)

    @property
    def trial_results(self) -> DataFrame:
        return trial_changes(self.trials)


def query(name: str, sql: str | None = None):
    """Register a function of ``Tables`` under ``name`` with the SQL that must give the same rows."""
    def register(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[name] = domain.with_tables(sql)
        return f

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Every double column rounded, so that summation order does not show."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
