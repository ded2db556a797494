"""The stages of the pipeline on labelled rows and on planted cases."""

import random

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from accesslake.llm.mixing import mixing_rates
from accesslake.llm.quality import score_quality
from accesslake.llm.queries import label_domains
from accesslake.session import Scratch

SF = "/root/testdata/sf0.1"


def test_mixing_drops_toxic_and_keeps_clean(spark):
    scratch = Scratch(spark, "test_mixing")
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    known = label_domains(labels)
    # labelled rows with as little junk as quality leaves
    rows = scratch.keep(docs.join(known.filter("domain != 'junk' OR doc_id % 100 = 0"), "doc_id", "left_semi"), "rows")
    rates = scratch.keep(mixing_rates(rows, known, corpus_pipeline.TARGETS, max_rate=1.0), "rates")
    likeliest = {r.doc_id: (r.domain, r.rate) for r in rates.collect()}
    toxic = {i for i, (d, _) in likeliest.items() if d == "toxic"}
    assert len(toxic) > 300 and all(likeliest[i][1] == 0 for i in toxic)
    clean = {r.doc_id for r in known.filter("domain = 'clean'").collect()} & likeliest.keys()
    left = {r.doc_id for r in corpus_pipeline.mixing(spark, rows, SF).select("doc_id").collect()}
    assert not toxic & left and len(clean & left) >= 0.99 * len(clean)


def test_decisions_are_for_rows_not_ids(spark):
    """Rows without an id are judged, and of rows that share an id only the bad ones go."""
    good = "a plain sentence of the usual kind that says something about number {} and stops there."
    bad = "BAD BAD ### BAD $$$ {} ### BAD"
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(i, (bad if i % 2 else good).format(i), "en", "s", 9) for i in range(400)]
    rows += [(None, bad.format("x"), "en", "s", 9), (None, good.format("x"), "en", "s", 9), (1000, bad.format("y"), "en", "s", 9),
             (1000, good.format("y"), "en", "s", 9), (1001, good.format("z"), None, None, None), (1001, good.format("z"), None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    wanted = sorted(((i, t) for i, t, *_ in rows if "BAD" not in t), key=str)
    quality = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(400)], "doc_id long, quality int, toxic int")
    toxic = spark.createDataFrame([(i, 1, i % 2) for i in range(400)], "doc_id long, quality int, toxic int")
    for stage, labels in ((corpus_pipeline.quality, quality), (corpus_pipeline.mixing, toxic)):
        folder = Scratch(spark, "labels").folder
        labels.write.parquet(f"{folder}/labels.parquet")
        assert sorted(((r.doc_id, r.text) for r in stage(spark, docs, folder).collect()), key=str) == wanted


def test_near_duplicates_of_shared_ids(spark):
    base, other, third = (" ".join(f"{w}{i}" for i in range(40)) for w in "xyz")
    rows = [(-3, base), (5, base + " end"), (5, other), (5, other), (4, third), (4, "short text"), (3, third + " end"), (6, other + " end"), (8, "alone here"),
            (8, "alone here"), (None, base)]
    docs = spark.createDataFrame([(i, t, None, "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()), key=str)
    assert got == sorted([(-3, base), (5, other), (4, "short text"), (3, third + " end"), (8, "alone here"), (None, base)], key=str)
    assert corpus_pipeline.near_duplicates(spark, docs.filter("false"), "").count() == 0


def test_columns_of_any_name_stay(spark):
    """Every stage keeps its input's further columns and their values, also those named like its own."""
    names = ["_row", "_node", "_id", "ids", "decoded", "n_removed", "gone", "rest", "row", "p", "host", "x", "digest", "copies", "component_id"]
    text = "a plain sentence of the usual kind that says something about number {} and stops there, long enough to be told from all others {}."
    rows = [(i, text.format(i, f"w{i} " * 9), "en", "s", 9, *[f"{n}{i}" for n in names]) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    folder = Scratch(spark, "names").folder
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = docs.select(*docs.columns)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        docs = Scratch(spark, "stage").keep(docs, "docs")
        assert docs.count() >= (36 if name in ("mixing", "encode") else 40), name  # so few labels leave traces of the other domains
    for r in docs.collect():
        assert all(r[f"input_{n}" if n in ("ids", "decoded") else n] == f"{n}{r.doc_id}" for n in names)
    for name, stage in corpus_pipeline.STAGES[:3]:  # the last two have their own tests
        assert stage(spark, docs.select("doc_id", "text", "lang", "source", "n_chars").filter("false"), folder).count() == 0, name


def test_run_on_planted_cases(spark):
    rnd = random.Random(2)
    word = lambda: rnd.choice("bcdfgklm") + rnd.choice("aeiou") + rnd.choice("nrst") + rnd.choice("aeiou") + str(rnd.randrange(9))
    prose = lambda n: " ".join(word() for _ in range(n)) + "."
    kinds = {0: lambda: prose(40), 1: lambda: " ".join("BAD ### $$$ " + word() for _ in range(10)), 2: lambda: prose(20) + " vile hateful slur " + prose(20)}
    rows = [(i, kinds[i % 3]()) for i in range(600)]
    passage = "\n".join(prose(25) for _ in range(2))
    near = rows[0][1] + " more"
    rows += [(9000, near), (9001, prose(30) + "\n" + passage), (9002, passage + "\n" + prose(35)), (9003, passage), (None, kinds[1]()), (None, kinds[2]())]
    folder = Scratch(spark, "planted").folder
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long"
                          ).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 != 1), int(i % 3 == 2)) for i in range(600)], "doc_id long, quality int, toxic int").write.parquet(
        f"{folder}/labels.parquet")
    got = corpus_pipeline.run(spark, folder).collect()
    text = {r.doc_id: r.text for r in got}
    assert len(got) == len(text) and text.keys() == {*range(0, 600, 3), 9001, 9002}
    assert passage in text[9001] and text[9002] == rows[602][1].split("\n")[-1]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in got:
        ids = library.encode(r.text, add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == library.decode(ids, skip_special_tokens=False) and r.n_chars == len(r.text)


def test_quality_of_held_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    scored = score_quality(docs, labels.filter(~held), F.col("source"), F.col("lang"))
    rows = scored.join(labels.filter(held).select("doc_id", F.col("quality").alias("y")), "doc_id").select("kept", "y").collect()
    bad, good = [r.kept for r in rows if r.y == 0], [r.kept for r in rows if r.y == 1]
    assert len(bad) >= 10 and sum(bad) <= 0.15 * len(bad) and sum(good) >= 0.97 * len(good)
