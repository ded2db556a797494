"""One query for each operator of this package, over the whole given tables, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from . import html, pii
from .bpe import bpe_encode
from .common import text_batches
from .hardneg import hard_negatives
from .jaccard import jaccard_join
from .langid import fit, identify
from .linedup import dedup_lines
from .mixing import mixing_rates
from .quality import score_quality
from .rangejoin import range_join
from .runs import periodic_runs
from .sharding import shard_documents
from .topk import top_k

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_bpe")
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and the decoded text of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_encode(docs, public_tokenizers.path("word_bpe_49k.json"), digests=True).drop("text")


@query("op2_ngram_jaccard")
def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set sizes and near-duplicate components of every document: five-word shingles, Jaccard 0.75 or more."""
    return jaccard_join(table(spark, sf_dir, "documents"), width=5, percent=75)


@query("op4_line_dedup")
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its repeated runs of lines deleted: lines removed, and digest and size of what is left."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_removed", F.length("text").cast("long").alias("n_chars_left"),
                                    F.md5(F.encode("text", "UTF-8")).alias("text_md5"))


@query("op3_html_text")
def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page, by a labeller learned from a sample of them."""
    pages = table(spark, sf_dir, "pages")
    return html.extract(pages.select("page_id", "url", "html"), html.fit(pages)).drop("html")


#: Domains of the labelled table and their target weights.
TARGETS = {"clean": 0.90, "junk": 0.07, "toxic": 0.03}


def label_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain): toxic, junk (of low quality) or clean."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "junk").when(F.col("quality") == 1, "clean")
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), domain.alias("domain"))


@query("op5_mixing")
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domain posteriors, rate and copies of every document for the target weights."""
    return mixing_rates(table(spark, sf_dir, "documents"), label_domains(table(spark, sf_dir, "labels")), TARGETS)


@query("op6_language")
def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from three quarters of them."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = fit(docs.filter(~held_out))
    return identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")


_SOUND = "embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0"


@query("op7_topk", f"""
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda e: floor(64 * e::DOUBLE)) AS x FROM embeddings WHERE {_SOUND}),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
          FROM v q JOIN v c ON q.vec_id != c.vec_id WHERE q.vec_id % 20 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""")
def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best vectors for every vector whose id is divisible by 20."""
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.filter(F.col("vec_id") % 20 == 0), k=20)


@query("op8_near_embeddings", f"""
    WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda e: e::DOUBLE) AS x FROM embeddings WHERE {_SOUND}),
    l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id != b.vec_id
          WHERE list_cosine_similarity(a.x, b.x) >= 0.9),
    r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
    c AS (SELECT a, least(a, min(b)) AS c FROM r GROUP BY a)
    SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = vec_id)::BIGINT AS n_links, coalesce(c, vec_id) AS component_id,
           vec_id = coalesce(c, vec_id) AS kept
    FROM embeddings LEFT JOIN c ON a = vec_id""")
def op8_near_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of vectors with a cosine of 0.9 or more."""
    return range_join(table(spark, sf_dir, "embeddings"), 0.9)


@query("op9_sharding")
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards with counts at most one apart."""
    return shard_documents(table(spark, sf_dir, "documents"), 40)


@query("op10_quality")
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence, site rates, posterior and decision for every document; hosts are sources, paths a source's languages."""
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))


_CLASS = "CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END"


@query("op11_hard_negatives", f"""
    WITH v AS (SELECT vec_id, {_CLASS} AS label, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)) AS x
      FROM embeddings WHERE label IS NOT NULL AND {_SOUND}),
    s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id != b.vec_id WHERE a.vec_id % 100 = 0),
    p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
    SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
      vec_id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
    QUALIFY rank <= 10""")
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten hard negatives for each of the five positives of every vector whose id is divisible by 100."""
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, F.expr(_CLASS))


def with_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) where a tenth of the texts repeats a stretch of its words from some word on to the end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.withColumn("_g", F.when(h % 10 == 0, F.floor(h / 10)))
    rows = rows.withColumn("_w", F.when(F.col("_g").isNotNull(), F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"))))
    rows = rows.withColumn("_n", F.size("_w")).withColumn("_a", F.when(F.col("_n") > 0, F.expr("int(_g % _n)")))
    rows = rows.withColumn("_p", F.expr("int(1 + (_n - _a) div (3 + _g % 8))"))
    tail = "slice(flatten(array_repeat(slice(_w, _a + 1, _p), int((_n - _a + _p - 1) div _p))), 1, _n - _a)"
    repeated = F.expr(f"array_join(concat(slice(_w, 1, _a), {tail}), ' ')")
    return rows.select("doc_id", F.when(F.col("_a").isNotNull(), repeated).otherwise(F.col("text")).alias("text"))


@query("op12_periodic_runs")
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeated words in every document, and digests of all runs and of the text without the repeats."""
    return periodic_runs(with_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))).drop("text", "n_words")


@query("op13_pii")
def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: what patterns find, and what the field adds to it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.find_pii(docs, pii.fit(docs)).drop("text")
