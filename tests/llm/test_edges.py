"""Every operator on nulls, empty and long texts, repeated rows, empty tables, and columns whose names clash."""

import pytest
from pyspark.sql import functions as F

from accesslake.llm import html, langid
from accesslake.llm.bpe import bpe_decode, bpe_encode
from accesslake.llm.jaccard import jaccard_join
from accesslake.llm.linedup import dedup_lines
from accesslake.llm.mixing import mixing_rates
from accesslake.llm.quality import score_quality
from accesslake.llm.rangejoin import range_join
from accesslake.llm.sharding import shard_documents
from accesslake.llm.topk import top_k
import public_tokenizers

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n long, h long, rep long, node long, domain string"
LONG = " ".join(f"word{i % 997} and{i}" for i in range(60_000))
VOCAB = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, None, "en", "a", None), (2, "", None, None, 0), (3, "   \n \t", "en", "a", 6), (4, LONG, "en", "a", len(LONG)),
            (5, "same words here for two documents that are equal", "en", "b", 1), (6, "same words here for two documents that are equal", "en", "b", 1),
            (6, "same words here for two documents that are equal", "en", "b", 1), (None, "a text without an id", "fr", "b", 1), (7, "one", None, "c", 3)]
    return spark.createDataFrame([(*r, 1, 2, 3, 4, "x") for r in rows], DOCS)


@pytest.fixture(scope="module")
def none(docs):
    return docs.filter("false")


def test_bpe(docs, none):
    out = bpe_encode(docs, VOCAB, ids="ids", decoded="decoded")
    rows = out.collect()
    assert len(rows) == 9 and out.columns == [*docs.columns, "ids", "decoded"]
    assert all(r.ids == [] and r.decoded == "" for r in rows if r.doc_id in (1, 2, 3))
    again = {(r.decoded, r.back) for r in bpe_decode(out, VOCAB, "ids", "back").collect()}
    assert all(a == b for a, b in again)
    assert bpe_encode(none, VOCAB).count() == 0
    with pytest.raises(ValueError):
        bpe_encode(docs, VOCAB, ids="text")


def test_jaccard(docs, none):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join(docs).collect()}
    assert {(1, 0, 1), (2, 0, 2), (3, 0, 3), (5, 5, 5), (6, 5, 5), (7, 1, 7), (None, 1, None)} <= got
    assert jaccard_join(docs).count() == 9 and jaccard_join(none).count() == 0


def test_html(spark):
    pages = spark.createDataFrame([
        (1, "u", None), (2, "u", ""), (3, "u", "no markup at all"), (4, None, "<p>" + "A sentence of a page. " * 20_000),
        (5, "u", "<html><body><nav><a href=x>Home</a></nav><article><h1>T</h1><p>A &amp; B&nbsp;c<br>d</article>"),
        (5, "u", "<html><body><nav><a href=x>Home</a></nav><article><h1>T</h1><p>A &amp; B&nbsp;c<br>d</article>")],
        "page_id long, url string, html string")
    model = html.fit(pages)
    rows = html.extract(pages, model).collect()
    assert len(rows) == 6 and all(r.n_chars == len(r.text) for r in rows)
    assert all(r.text == "" for r in rows if r.page_id in (1, 2))
    assert {r.text for r in rows if r.page_id == 5} == {"T\n\nA & B c d"}
    assert html.extract(pages.filter("false"), html.fit(pages.filter("false"))).count() == 0
    with pytest.raises(ValueError):
        html.extract(pages.withColumn("text", F.lit("")), model)


def test_line_dedup(docs, none):
    rows = dedup_lines(docs, min_words=5).collect()
    assert len(rows) == 9
    assert {r.doc_id: r.text for r in rows if r.doc_id in (1, 2, 6)} == {1: None, 2: "", 6: ""}
    assert next(r.text for r in rows if r.doc_id == 4) == LONG
    assert dedup_lines(none).count() == 0
    with pytest.raises(ValueError):
        dedup_lines(docs, removed="text")


def test_line_dedup_of_texts_that_share_an_id(spark):
    run = "\n".join(f"a line of five words{i}" for i in range(5))
    own = "\n".join(f"another line of its own{i}" for i in range(8))
    rows = [(1, run), (2, run + "\ntail of the second"), (2, own), (3, own), (4, "x\n" + run), (4, "x\n" + run), (5, own + "\nmore")]
    table = spark.createDataFrame([(*r, "gone", 1, 2) for r in rows], "doc_id long, text string, gone string, _id long, digest long")
    got = sorted((r.doc_id, r.n_removed, r.text) for r in dedup_lines(table, min_words=20).collect())
    # the digest decides which of the two texts of id 2 comes first, not that either loses the other's lines
    assert got == sorted([(1, 0, run), (2, 5, "tail of the second"), (2, 0, own), (3, 8, ""), (4, 5, "x"), (4, 5, "x"), (5, 8, "more")])
    assert {r.gone for r in dedup_lines(table, min_words=20).collect()} == {"gone"}


def test_mixing(spark, docs, none):
    labels = spark.createDataFrame([(4, "a"), (5, "b"), (5, "b"), (None, "a"), (7, None), (99, "c")], "doc_id long, domain string")
    rows = mixing_rates(docs, labels, {"a": 1.0, "b": 1.0}).collect()
    assert len(rows) == 9 and all(r.rate >= 0 and abs(sum(r.p) - 1) < 1e-9 for r in rows)
    assert all(r.n_tokens == 0 for r in rows if r.doc_id in (1, 2))
    assert mixing_rates(none, labels.filter("false"), {"a": 1.0}).count() == 0


def test_language(docs, none):
    model = langid.fit(docs)
    rows = langid.identify(docs, model).collect()
    assert len(rows) == 9 and all((r.lang_pred, r.score) == ("und", 0.0) for r in rows if r.doc_id in (1, 2, 3))
    assert {r.lang_pred for r in langid.identify(docs, langid.fit(none)).collect()} == {"und"}
    with pytest.raises(ValueError):
        langid.identify(docs, model, lang_pred="lang")


@pytest.fixture(scope="module")
def vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.99, 0.1]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]),
            (8, [float("inf"), 0.0]), (9, [0.0, -1.0]), (None, [1.0, 0.0]), (10, [1e-200, 0.0]), (11, [1.0, 0.0, 0.0])]
    return spark.createDataFrame([(*r, 0, 0) for r in rows], "vec_id long, embedding array<double>, rep long, u int")


def test_top_k(vectors):
    got = {(r.query_id, r.rank, r.vec_id, r.score) for r in top_k(vectors, vectors.filter("vec_id IN (1, 4, 9)"), k=3).collect()}
    # ids 5 and 9 are vectors as well; 11 has another length
    assert got == {(1, 1, 2, 4096), (1, 2, 3, 4032), (1, 3, 5, 0), (9, 1, 1, 0), (9, 2, 2, 0), (9, 3, 5, 0)}
    assert top_k(vectors.filter("false"), vectors.filter("false")).count() == 0
    assert top_k(vectors.filter("vec_id = 1"), vectors.filter("vec_id = 1")).count() == 0


def test_range_join(vectors):
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in range_join(vectors, 0.9).collect()}
    assert got == {1: (3, 1, True), 2: (3, 1, False), 3: (3, 1, False), 10: (3, 1, False), 9: (0, 9, True), 11: (0, 11, True), None: (0, None, None),
                   **{k: (0, k, True) for k in (4, 5, 6, 7, 8)}}
    assert range_join(vectors.filter("false")).count() == 0
    assert range_join(vectors.filter("vec_id = 4")).count() == 1


def test_sharding(docs, none):
    rows = shard_documents(docs, 4).collect()
    sizes = [sum(r.shard == s for r in rows) for s in range(4)]
    assert sorted(sizes) == [2, 2, 2, 3]
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s])) for s in range(4))
    assert {r.size for r in rows if r.doc_id in (1, 2)} == {16}
    assert shard_documents(none, 4).count() == 0


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(4, 1), (5, 0), (5, 0), (None, 1), (7, None)], "doc_id long, quality int")
    assert score_quality(docs, labels, F.col("source"), F.col("lang")).count() == 9
    rows = score_quality(docs, labels.filter("false"), F.col("source"), F.col("lang")).collect()
    assert len(rows) == 9 and all(r.evidence == 0 for r in rows)
    assert score_quality(none, labels, F.col("source"), F.col("lang")).count() == 0
