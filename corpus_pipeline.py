"""The corpus pipeline: stages that each take documents and return what they keep of them.

1. ``quality``: documents that the quality classifier rejects go.
2. ``line_dedup``: repeated runs of lines are deleted; documents of which nothing is left go.
3. ``near_duplicates``: of each group of near-duplicates the document with the smallest id stays.
4. ``mixing``: documents are kept at the rates that meet the target weights; no document is repeated, and none stays whose likeliest
   domain has the weight 0.
5. ``encode``: token ids and decoded text are added.

Quality and mixing decide for each row, not for each id. Rows with a null id are judged by their text alone there, and pass the stages
that link documents. Empty tables pass through. Columns
beside doc_id, text, lang, source and n_chars are kept up to the last stage, whatever their names, but for names that begin with
``__pipeline_`` or ``__dedup_``; the last stage renames ``ids`` and ``decoded``. n_chars follows the text.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from accesslake.llm.bpe import bpe_encode
from accesslake.llm.common import text_batches
from accesslake.llm.jaccard import jaccard_join
from accesslake.llm.linedup import dedup_lines
from accesslake.llm.mixing import mixing_rates
from accesslake.llm.quality import score_quality
from accesslake.llm.queries import label_domains
from accesslake.session import Scratch, work_dir

#: Keys of rows are broadcast up to this number (16 bytes each); beyond it they are joined by a shuffle.
BROADCAST_KEYS = 500_000
#: Weights of the domains in the corpus: all clean tokens, as many as there are. What the labelled table calls toxic is left out, and
#: so is junk: quality has removed almost all of it, so that a share of it could not be met.
TARGETS = {"clean": 1.0, "junk": 0.0, "toxic": 0.0}


#: Columns that stages add for themselves and take away again.
ROW, NODE, ID, REMOVED = "__pipeline_row", "__pipeline_node", "__pipeline_id", "__pipeline_removed"


def _few(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= BROADCAST_KEYS else rows


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ROW, a digest of the id and of all that a decision depends on: rows of one key are judged alike."""
    return docs.withColumn(ROW, F.unhex(F.md5(F.to_json(F.struct("doc_id", "source", "lang", F.md5("text").alias("text"))))))


def _without(docs: DataFrame, gone: DataFrame, key: str, name: str) -> DataFrame:
    """``docs`` without the rows whose ``key`` is one of ``gone``; the key is never null for rows to leave out."""
    gone = Scratch(docs.sparkSession, name).keep(gone.select(key).distinct(), "gone")
    return docs.join(_few(gone), key, "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior quality is high enough."""
    text_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = _keyed(docs)
    scored = score_quality(rows, labels, F.col("source"), F.col("lang"), keep=[ROW])
    return _without(rows, scored.filter(~F.col("kept")), ROW, "quality").select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the runs of lines that stood before; documents that held nothing else go."""
    text_batches(spark)
    cut = dedup_lines(docs, removed=REMOVED)
    return cut.filter((F.col(REMOVED) == 0) | (F.trim("text") != "")).withColumn(
        "n_chars", F.length("text").cast("long")).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates.

    Texts that share an id are documents of their own, linked under hashes of id and text; of rows that repeat both, one stays.
    """
    text_batches(spark)
    scratch = Scratch(spark, "near")
    ids = docs.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias(ID)).count().filter("count > 1")
    twice = _few(scratch.keep(ids.select(ID), "twice"))
    rest = F.struct(*[c for c in docs.columns if c not in ("doc_id", "text")])
    same = (docs.join(twice, F.col("doc_id") == F.col(ID), "left_semi").groupBy("doc_id", "text")
            .agg(F.min_by(rest, F.to_json(rest)).alias("rest")).select("doc_id", "text", "rest.*").select(docs.columns))
    same = scratch.keep(same.withColumn(NODE, F.xxhash64("doc_id", "text")), "same")
    rows = docs.join(twice, F.col("doc_id") == F.col(ID), "left_anti").withColumn(NODE, F.col("doc_id")).union(same)
    joined = scratch.keep(jaccard_join(rows, id_col=NODE).select(F.col("doc_id").alias(NODE), "component_id"), "joined")
    # the smallest node is not the smallest id in components that hold hashes
    names = same.select(NODE, F.col("doc_id").alias(ID))
    mixed = scratch.keep(joined.join(_few(names), NODE, "left_semi").select("component_id").distinct(), "mixed")
    least = joined.join(_few(mixed), "component_id", "left_semi").join(_few(names), NODE, "left").groupBy("component_id").agg(
        F.min(F.struct(F.coalesce(ID, NODE).alias("id"), NODE)).alias("least"))
    least = _few(scratch.keep(least.select("component_id", F.col(f"least.{NODE}").alias("_first")), "least"))
    gone = joined.join(least, "component_id", "left").filter(F.col(NODE) != F.coalesce("_first", "component_id"))
    return _without(rows, gone, NODE, "near").select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn at the rates that meet the target weights; those whose likeliest domain has no weight go."""
    text_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = _keyed(docs)
    rates = mixing_rates(rows, label_domains(labels), TARGETS, max_rate=1.0, keep=[ROW])
    unwanted = [d for d, weight in TARGETS.items() if not weight]
    gone = rates.filter((F.col("copies") == 0) | F.col("domain").isin(unwanted))
    return _without(rows, gone, ROW, "mixing").select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and the decoded text of every document that is left; columns of their names get the prefix ``input_``."""
    text_batches(spark)
    docs = docs.withColumnsRenamed({c: f"input_{c}" for c in ("ids", "decoded") if c in docs.columns})
    return bpe_encode(docs, public_tokenizers.path("word_bpe_49k.json"), ids="ids", decoded="decoded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("mixing", mixing), ("encode", encode)]

#: The stages fit models and walk texts; SQL cannot express them, tests/llm/test_pipeline.py runs them on planted cases.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the last stage returns; every stage's result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = work_dir(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
