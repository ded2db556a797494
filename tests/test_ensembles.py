"""Scoring within the row against the fitted pipeline itself."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from accesslake.functions.sizing import decide, tier_candidates
from accesslake.operators import candidates, models
from accesslake.operators.ensembles import scorer_of, with_candidate_scores

USED = ["file_size_kb", "chunk_size_kb", "access_count", "avg_read_kb"]


@pytest.fixture(scope="module")
def log(spark):
    r = np.random.default_rng(3)
    rows = [(f"/f{i}", int(2 ** r.integers(4, 18)), int(64 * 2 ** r.integers(0, 7)), int(r.integers(1, 40)) if r.random() < 0.9 else None,
             float(r.normal(100, 50)) if r.random() < 0.8 else (None if r.random() < 0.5 else float("nan"))) for i in range(900)]
    df = spark.createDataFrame(rows, "file_path string, file_size_kb long, chunk_size_kb long, access_count long, avg_read_kb double")
    noise = F.abs(F.xxhash64("file_path") % 100) / 40
    return df.withColumn("OT", (F.abs(F.log2("chunk_size_kb") - F.log2("file_size_kb") + 3) < noise).cast("int")).cache()


@pytest.fixture(scope="module")
def stack(log):
    return models.fit_rf_stack(log, USED, trees=25, rounds=12, depth=5)


@pytest.fixture(scope="module")
def boosted(log):
    return models.fit_gbt_cv(log, ["file_path"], USED, "OT", folds=3, rounds=15, depth=4).model


def test_probabilities_are_those_of_the_pipeline(log, stack, boosted):
    for model in (stack, boosted):
        wanted = {r.file_path: r.p for r in models.with_probability(model, log).collect()}
        rows = log.select("file_path", *USED).toPandas()
        got = scorer_of(model).probability(rows[USED].to_numpy(np.float64, na_value=np.nan))
        assert max(abs(g - wanted[f]) for f, g in zip(rows.file_path, got)) < 1e-12
        assert len(set(np.round(got, 6))) > 50


def test_a_stored_pipeline_is_scored_alike(spark, log, stack, tmp_path):
    stack.write().save(str(tmp_path / "m"))
    rows = log.select(*USED).toPandas().to_numpy(np.float64, na_value=np.nan)
    again = scorer_of(PipelineModel.load(str(tmp_path / "m")))
    assert (again.probability(rows) == scorer_of(stack).probability(rows)).all()


def test_forest_predictions_equal_those_of_expanded_rows(spark, log, stack):
    chunks = [64.0, 128.0, 256.0, 512.0, 1024.0, 4096.0]
    log = log.drop("OT").unionByName(log.drop("OT").limit(20))  # equal rows come out once each
    rows = log.withColumn("_row", F.monotonically_increasing_id()).cache()
    wide = candidates.expand_candidates(rows, chunks)
    best = candidates.best_candidate(models.with_probability(stack, wide), ["_row", "file_path"])
    wanted = sorted((r.file_path, r.optimal_chunk, round(r.confidence, 10)) for r in best.collect())
    got = models.predict_rf(log, stack, chunks)
    assert sorted((r.file_path, r.optimal_chunk_kb, round(r.confidence, 10)) for r in got.collect()) == wanted and len(wanted) == 920
    assert got.schema["optimal_chunk_kb"].dataType == log.schema["chunk_size_kb"].dataType
    assert models.predict_rf(log, stack, []).where("optimal_chunk_kb IS NULL AND confidence IS NULL").count() == 920
    assert models.predict_rf(log.limit(0), stack, chunks).count() == 0


def test_tiered_predictions_equal_those_of_expanded_rows(log, boosted):
    size, chunk = F.col("file_size_kb"), F.col("chunk_size_kb")
    wide = log.drop("OT").select("*", F.posexplode(tier_candidates(size, chunk)).alias("n", "c")).withColumn("old", chunk)
    scored = models.with_probability(boosted, wide.withColumn("chunk_size_kb", F.col("c").cast("long")))
    by_file = scored.groupBy("file_path", "file_size_kb", "old").agg(
        F.max(F.struct("p", -F.col("n"), "c")).alias("b"), F.max(F.when(F.col("c") == F.col("old"), F.col("p"))).alias("own"))
    wanted = by_file.select("file_path", decide(size, F.col("old"), F.col("b.c"), F.col("own"), F.col("b.p")).alias("chunk"), "b.p")
    got = models.predict_gbt(log.drop("OT"), boosted)
    pick = lambda rows: {(r[0], r[1], None if r[2] is None else round(r[2], 10)) for r in rows}
    assert pick(got.where("confidence IS NOT NULL").select("file_path", "optimal_chunk_kb", "confidence").collect()) == pick(wanted.collect())
    assert got.count() == 900


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_row_is_multiplied_or_shuffled(spark, log, stack, boosted):
    for df in (models.predict_rf(log, stack, [64.0, 512.0]), models.predict_gbt(log, boosted)):
        plan = plan_of(df)
        assert "Exchange" not in plan and "Generate" not in plan and "collect_list" not in plan and plan.count("ArrowEvalPython") == 1


def test_candidate_arrays_of_any_length(spark, log, stack):
    rows = log.limit(4).withColumn("n", F.monotonically_increasing_id()).withColumn("c", F.expr(
        "CASE n WHEN 0 THEN array(64.0D, 4096.0D, 64.0D) WHEN 1 THEN array() WHEN 2 THEN null ELSE array(128.0D, null) END"))
    got = {r.n: r.p for r in with_candidate_scores(rows, stack, F.col("c"), "chunk_size_kb", "p").collect()}
    assert [len(got[k]) for k in range(4)] == [3, 0, 0, 2] and got[0][0] == got[0][2] and got[3][1] is None


def test_other_pipelines_are_refused(spark, log):
    with pytest.raises(ValueError):
        scorer_of(PipelineModel([VectorAssembler(inputCols=["file_size_kb"], outputCol="x")]))


def test_one_described_run(spark):
    """One run of a 200 MB file made by hand, as a model trained on the bench columns scores it."""
    r = np.random.default_rng(5)
    n = 400
    rows = [(f"/t{i}", int(s), int(c), int(a), 64.0, 32.0, 128, 64, int(a * 0.8), int(a * 0.2), int(c >= 512 and s > 10_000))
            for i, (s, c, a) in enumerate(zip(2 ** r.integers(8, 20, n), 64 * 2 ** r.integers(0, 6, n), r.integers(5, 100, n)))]
    names = [f for f in models.RF_FEATURES if f != "access_count_label"]
    kinds = ", ".join(f"{f} {'double' if f.startswith('avg') else 'long'}" for f in names)
    train = spark.createDataFrame(rows, f"file_path string, {kinds}, OT int")
    from accesslake.operators.labels import with_band

    model = models.fit_rf_stack(with_band(train), models.RF_FEATURES, trees=20, rounds=10)
    run = spark.createDataFrame([("fileA", 204_800, 1733, 20, 57.7, 70.3, 130, 124, 12, 8)], f"file_path string, {kinds}")
    best = models.predict_rf(run, model, [64.0, 128.0, 256.0, 512.0, 1024.0, 2048.0]).first()
    assert (best.file_path, best.current_chunk_kb) == ("fileA", 1733) and best.optimal_chunk_kb >= 512 and best.confidence > 0.8


def walked(trees, x):
    """Leaf values summed by following every path, one step at a time."""
    out = np.zeros((len(x), trees.value.shape[1]))
    for r, row in enumerate(x):
        for at in trees.roots:
            while trees.left[at] != at:
                at = trees.left[at] if row[trees.feature[at]] <= trees.threshold[at] else trees.right[at]
            out[r] += trees.value[at]
    return out


def test_leaves_by_bits_are_those_of_the_paths(log, stack, boosted):
    x = log.select(*USED).toPandas()[USED].to_numpy(np.float64, na_value=np.nan)[:150]
    for trees in (scorer_of(stack).forest, scorer_of(stack).boosted, scorer_of(boosted).boosted):
        edges = np.where(trees.left != np.arange(len(trees.left)), trees.threshold, 0.0)
        y = np.vstack([x, np.repeat(edges[:60, None], len(USED), axis=1), np.full((1, len(USED)), np.nan), np.full((1, len(USED)), np.inf)])
        assert trees.leaves is not None and np.allclose(trees.sums(y), walked(trees, y), rtol=0, atol=1e-11)
        for v, got in zip((64.0, 300.0, 1e9), trees.sums_with(y, 1, np.array([64.0, 300.0, 1e9]))):
            z = y.copy()
            z[:, 1] = v
            assert (got == trees.sums(z)).all()
        trees.leaves = None  # as trees of more leaves are
        assert np.allclose(trees.sums(y), walked(trees, y), rtol=0, atol=1e-11)


def test_few_tasks_are_dealt_out_before_trees_are_fitted(spark, log, monkeypatch):
    parts = []
    monkeypatch.setattr(models, "spread", lambda df, rows=None, real=models.spread: parts.append(real(df, rows)) or parts[-1])
    models.fit_rf_stack(log.coalesce(1), USED, trees=2, rounds=2, depth=2)
    models.fit_gbt_cv(log.coalesce(1), ["file_path"], USED, "OT", folds=2, rounds=2, depth=2)
    assert [p.rdd.getNumPartitions() for p in parts] == [spark.sparkContext.defaultParallelism] * 2
