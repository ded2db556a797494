"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from accesslake.session import materialise


def refuse_clash(df: DataFrame, *names: str) -> None:
    """An error if the input already has a column that the operator adds."""
    if clash := sorted(set(names) & set(df.columns)):
        raise ValueError(f"the input already has columns {clash}")


#: Rows of texts that a Python worker gets at once. Texts are long, so Spark's default of 10,000 rows can be hundreds of MB.
TEXT_ROWS = 500


def text_batches(spark: SparkSession) -> None:
    """Settings for jobs on texts: batches that Python workers can hold several times over."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_ROWS))


def give_back() -> None:
    """At the end of a task: what this worker no longer uses goes back to the system, for workers stay while other stages run."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another system's library
        pass


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component_id) for every node of an edge: component_id is the smallest node that links reach.

    Every round first hands each node's larger neighbours the smallest node it knows, then does the same for the smaller ones,
    until every node points at the smallest of its component. Minima are aggregated before the shuffle and joined back, so that a
    node with very many edges is never gathered in one task. Edges with a null end are left out; no edges give no rows.
    """
    links = materialise(
        edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
        .filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct(), "links")
    for _ in range(rounds):
        both = links.union(links.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = materialise(both.groupBy(F.col("hi").alias("node")).agg(F.least(F.min("lo"), F.first("hi")).alias("to")), "least")
        large = materialise(
            links.join(least, links.lo == least.node).select("hi", F.col("to").alias("lo")).distinct(), "large")
        least = materialise(large.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("to")), "least")
        small = materialise(
            large.join(least, large.hi == least.node).select(F.col("lo").alias("hi"), F.col("to").alias("lo"))
            .filter("hi != lo").union(least.select(F.col("node").alias("hi"), F.col("to").alias("lo"))).distinct(), "small")
        # done when no node points at two others and no target points on
        chained = small.join(small.select(F.col("lo").alias("x")).distinct(), F.col("hi") == F.col("x"), "left_semi")
        twice = small.groupBy("hi").count().filter("count > 1").select("hi")
        links = small
        if chained.isEmpty() and twice.isEmpty():
            return links.select(F.col("hi").alias("node"), F.col("lo").alias("component_id")).union(
                links.select("lo", "lo").distinct())
    raise RuntimeError(f"components did not settle in {rounds} rounds")
