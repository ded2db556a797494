import numpy as np
import pytest
from pyspark.sql import functions as F

from accesslake.operators import candidates, clean, evaluate, features, models, profiles, som, stats, trials
from accesslake.plans import recommend


def test_best_candidate_prefers_the_largest_near_the_top(spark):
    rows = [("a", 64, 0.50000), ("a", 128, 0.49995), ("a", 256, 0.4998), ("b", 64, 0.1), ("b", 512, 0.9)]
    df = spark.createDataFrame(rows, "k string, chunk_size_kb bigint, p double")
    found = {r["k"]: (r["optimal_chunk"], r["confidence"]) for r in candidates.best_candidate(df, ["k"]).collect()}
    assert found == {"a": (128, 0.5), "b": (512, 0.9)}


def test_inline_best_equals_expanded_best(spark):
    df = spark.range(200).select(F.col("id"), (F.col("id") % 9 * 100).alias("peak"), F.lit(64).cast("double").alias("chunk_size_kb"))
    chunks = [64.0, 128.0, 256.0, 512.0]

    def score(c):
        return F.round(1 / (1 + F.abs(c - F.col("peak")) / 300), 2)

    inline = candidates.best_candidate_inline(df, chunks, score).select("id", "optimal_chunk", "confidence")
    wide = candidates.expand_candidates(df, chunks).withColumn("p", score(F.col("chunk_size_kb")))
    grouped = candidates.best_candidate(wide, ["id"]).select("id", "optimal_chunk", "confidence")
    assert inline.exceptAll(grouped).isEmpty() and grouped.count() == 200


def test_candidate_slices_lose_none(spark):
    df = spark.createDataFrame([(1.0,)], "chunk_size_kb double")
    assert candidates.expand_candidates(df, [float(i) for i in range(2500)]).count() == 2500


def test_outliers_ignore_constant_columns(spark):
    df = spark.createDataFrame([(float(i % 5), 7.0) for i in range(100)] + [(1000.0, 7.0)], "x double, c double")
    kept, out = stats.split_outliers(df, ["x", "c"])
    assert kept.count() == 100 and [r["x"] for r in out.collect()] == [1000.0]


def test_correlation_of_a_constant_is_null(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, 0.1) for i in range(9)], "a double, b double, c double")
    r = {(x["feature_x"], x["feature_y"]): x["r"] for x in stats.corr_matrix(df, ["a", "b", "c"]).collect()}
    assert r["a", "b"] == pytest.approx(1.0) and r["a", "c"] is None and r["c", "c"] is None
    assert stats.redundant_pairs(stats.corr_matrix(df, ["a", "b", "c"])).isEmpty()


def test_scalers_keep_constants_finite(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, c double")
    assert sorted(tuple(r) for r in features.standard_scale(df, ["a", "c"]).collect()) == [(-1.0, 0.0), (1.0, 0.0)]
    assert sorted(tuple(r) for r in features.minmax_scale(df, ["a", "c"]).collect()) == [(0.0, 0.0), (1.0, 0.0)]
    assert sorted(tuple(r) for r in features.robust_scale(df, ["a", "c"]).collect()) == [(-1.0, 0.0), (1.0, 0.0)]


def test_validation_names_the_reason(spark):
    rows = [("read", 1, 1), ("move", 1, 1), (None, 1, 1), ("write", -1, 1), ("write", 1, -1)]
    good, bad = clean.validate_events(spark.createDataFrame(rows, "access_type string, file_size int, chunk_size int"))
    assert good.count() == 1
    assert sorted(r["reason"] for r in bad.collect()) == ["access_type", "access_type", "chunk_size", "file_size"]


def test_dropped_rows_are_observed(spark):
    df = spark.createDataFrame([(1, None), (2, 3.0)], "a int, b double")
    kept, seen = clean.drop_missing_observed(df, ["b"])
    assert kept.count() == 1 and seen.get["dropped"] == 1


def test_profiles_do_not_multiply_facts(spark):
    meta = spark.createDataFrame([("f", 10, 1), ("g", 20, 2)], "file_path string, file_size bigint, chunk_size bigint")
    access = spark.createDataFrame([("f", "read", 4, 0), ("f", "write", 0, 2)],
                                   "file_path string, access_type string, read_size bigint, write_size bigint")
    rates = spark.createDataFrame([("f", 1.0), ("f", 2.0), ("f", 6.0)], "file_path string, throughput_mbps double")
    found = {r["file_path"]: r for r in profiles.file_profiles(meta, access, rates).collect()}
    assert found["f"]["access_count"] == 2 and found["f"]["throughput_mbps"] == 3.0 and found["f"]["avg_read_size"] == 2.0
    assert found["g"]["access_count"] == 0 and found["g"]["avg_read_size"] is None


@pytest.mark.parametrize("t,dof,want", [(2.0, 10.0, 0.07338803477074), (1.0, 1.0, 0.5), (0.0, 5.0, 1.0), (-3.0, 30.0, 0.005390),
                                        (1.959963985, 1e7, 0.05), (12.706204736, 1.0, 0.05)])
def test_p_of_students_t(spark, t, dof, want):
    df = spark.createDataFrame([(t, dof)], "t double, dof double")
    assert df.select(trials.two_sided_p("t", "dof")).first()[0] == pytest.approx(want, abs=1e-5)


def test_auc_counts_ties_as_half(spark):
    rows = [(1, 0.9), (1, 0.5), (0, 0.5), (0, 0.1)]
    assert evaluate.roc_auc(spark.createDataFrame(rows, "label int, p double")) == pytest.approx(0.875)


def test_split_keeps_every_row_once_and_each_label_in_share(spark):
    df = spark.range(8000).select("id", (F.col("id") % 5 == 0).cast("int").alias("y"))
    train, test = models.stratified_split(df, "y", ["id"])
    assert train.count() + test.count() == 8000 and train.join(test, "id").isEmpty()
    for r in test.groupBy("y").count().collect():
        assert r["count"] / (1600 if r["y"] else 6400) == pytest.approx(0.25, abs=0.04)


def test_too_few_samples(spark):
    with pytest.raises(ValueError, match="too few"):
        models.require_samples(spark.range(9), 10)
    models.require_samples(spark.range(10), 10)


def planted(spark, n=600):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(n):
        size, chunk = int(2 ** rng.integers(6, 15)), int(2 ** rng.integers(6, 13))
        rows.append((f"f{i}", size, chunk, float(-abs(np.log2(chunk) - np.log2(size / 4)) + rng.normal(0, 0.3))))
    df = spark.createDataFrame(rows, "file_path string, file_size_kb bigint, chunk_size_kb bigint, gain double")
    return df.withColumn("OT", (F.col("gain") > -1.5).cast("int"))


FEATURES = ["file_size_kb", "chunk_size_kb"]


def test_stack_finds_a_planted_signal_and_survives_storage(spark, tmp_path):
    df = planted(spark)
    train, test = models.stratified_split(df, "OT", ["file_path"])
    model = models.fit_rf_stack(train, FEATURES, trees=10, rounds=5)
    scored = models.with_probability(model, test)
    assert evaluate.roc_auc(scored.select(F.col("OT").alias("label"), "p")) > 0.85
    chunks = candidates.candidate_list(df)
    models.save_model(model, chunks, str(tmp_path / "m"), spark)
    again, known = models.load_model(str(tmp_path / "m"), spark)
    assert known == [float(c) for c in chunks]
    predicted = models.predict_rf(test, model, chunks)
    assert predicted.exceptAll(models.predict_rf(test, again, chunks)).isEmpty()
    assert predicted.count() == test.count()
    assert {r[0] for r in predicted.select("optimal_chunk_kb").distinct().collect()} <= set(chunks)


def test_a_fit_after_an_observation(spark):
    df = planted(spark, 120)
    kept, seen = clean.drop_missing_observed(df, ["OT"])
    assert kept.count() == 120 and seen.get["dropped"] == 0
    model = models.fit_rf_stack(df, FEATURES, trees=3, rounds=2, depth=3)
    assert models.with_probability(model, df).where("p BETWEEN 0 AND 1").count() == 120


def test_every_row_of_a_log_is_scored(spark):
    df, used = planted(spark, 200), [*FEATURES, "gain"]
    model = models.fit_rf_stack(df, used, trees=3, rounds=2, depth=3)
    log = df.select("file_path", *used).withColumn("file_path", F.concat(F.lit("f"), (F.monotonically_increasing_id() % 5).cast("string")))
    log = log.unionByName(log.limit(10)).withColumn("gain", F.when(F.rand(1) < 0.9, F.col("gain")))
    log = log.cache()
    wanted = {r["file_path"]: r["count"] for r in log.groupBy("file_path").count().collect()}
    rf = models.predict_rf(log, model, [64.0, 128.0, 256.0])
    assert {r["file_path"]: r["count"] for r in rf.groupBy("file_path").count().collect()} == wanted
    boosted = models.fit_gbt_cv(df, ["file_path"], used, "OT", folds=2, rounds=2, depth=3)
    gbt = models.predict_gbt(log, boosted.model)
    assert {r["file_path"]: r["count"] for r in gbt.groupBy("file_path").count().collect()} == wanted


def test_plans_by_fitted_models(spark):
    df = planted(spark, 200)
    meta = spark.createDataFrame([("a", 100 << 20, 512), ("b", 3 << 20, 64)], "file_path string, file_size bigint, chunk_size bigint")
    access = spark.createDataFrame([("a", "read", 4096, 0), ("b", "read", 1, 0)],
                                   "file_path string, access_type string, read_size bigint, write_size bigint")
    rates = spark.createDataFrame([], "file_path string, throughput_mbps double")
    names = [f for f in FEATURES]
    forest = models.fit_rf_stack(df, names, trees=3, rounds=2, depth=3)
    boosted = models.fit_gbt_cv(df, ["file_path"], names, "OT", folds=2, rounds=2, depth=3).model
    for predict in (recommend.fitted(forest, [64.0, 512.0]), recommend.fitted(boosted)):
        plan = recommend.change_plan(meta, access, rates, predict, force=True).collect()
        assert {(r["file_path"], r["old_chunk_size"]) for r in plan} == {("a", 512), ("b", 64)}
        done = recommend.analyze(recommend.file_features(meta, access, rates), predict)
        assert done.count() == 2 and done.where("recommendation IS NULL").isEmpty()


def test_a_log_of_one_class_is_balanced_in_training(spark):
    from accesslake.plans.train import train_gbt
    log = planted(spark, 150).withColumn("throughput_kbps", F.lit(1.0)).withColumns({"n": F.monotonically_increasing_id(), "access_count": F.lit(3)})
    fit = train_gbt(log, ["file_path", "n"], [f for f in FEATURES if f != "throughput_kbps"], folds=2, rounds=2, depth=2)
    assert fit.folds.count() == 2


def test_work_folders_need_a_shared_place_off_this_machine(spark):
    from accesslake import session

    class Context:
        master = "spark://elsewhere:7077"

    class Elsewhere:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    import pytest
    with pytest.raises(ValueError):
        session.work_dir(Elsewhere(), "x")
    scratch = session.Scratch(spark, "released")
    kept = scratch.keep(spark.range(5), "five")
    assert kept.count() == 5
    scratch.release("five")
    with pytest.raises(Exception):
        spark.read.parquet(f"{scratch.folder}/five").count()


def test_boosted_trees_decide_for_every_row(spark):
    df = planted(spark, 300)
    fit = models.fit_gbt_cv(df, ["file_path"], FEATURES, "OT", folds=3, rounds=5, depth=3)
    assert fit.folds.count() == 3 and fit.folds.agg(F.min("auc")).first()[0] > 0.6
    # A file of 20 KB has its own size as the only candidate.
    small = spark.createDataFrame([("tiny", 20, 512)], "file_path string, file_size_kb bigint, chunk_size_kb bigint")
    rows = df.select("file_path", *FEATURES).unionByName(small)
    predicted = models.predict_gbt(rows, fit.model)
    assert predicted.count() == 301
    assert predicted.where("file_path = 'tiny'").first()["optimal_chunk_kb"] == 20


def test_map_fit_lowers_the_error(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 5, (4, 3))
    rows = [(centres[i % 4] + rng.normal(0, 0.1, 3)).tolist() for i in range(400)]
    df = spark.createDataFrame([(r,) for r in rows], "vector array<double>")
    book = som.fit_som(df, epochs=5, side=10)
    assert book.count() == 100
    error = som.quantization_error(som.nearest_unit(df, book)).first()[0]
    assert error < 1.0


def test_nearest_unit_takes_the_first_among_equals(spark):
    book = spark.createDataFrame([(0, 1, [1.0]), (0, 0, [-1.0])], "i int, j int, weights array<double>")
    row = som.nearest_unit(spark.createDataFrame([([0.0],)], "vector array<double>"), book).first()
    assert (row["unit"]["i"], row["unit"]["j"], row["distance"]) == (0, 0, 1.0)


def test_map_side():
    assert [som.map_side(n) for n in (1, 4, 9, 10_000)] == [10, 10, 15, 30]


def test_described_file(spark):
    row = recommend.predict_one(spark, 10 * 1024 * 1024, extension="csv").first()
    assert row["file_path"] == "/described/file.csv" and row["access_count"] == 15 and row["file_size_KB"] == 10240.0
    assert row["chunk_size_KB"] == 1024.0 and row["max_read_KB"] == 8.0 and row["throughput_KBps"] == 102400.0


def test_plan_drops_what_is_right_unless_forced(spark):
    meta = spark.createDataFrame([("a", 100 << 20, 512), ("b", 100 << 20, 64)], "file_path string, file_size bigint, chunk_size bigint")
    access = spark.createDataFrame([("a", "read", 1, 0), ("b", "read", 1, 0)],
                                   "file_path string, access_type string, read_size bigint, write_size bigint")
    rates = spark.createDataFrame([], "file_path string, throughput_mbps double")
    predict = recommend.closed_form(lambda c: 1 / (1 + F.abs(c - 512)), [64.0, 512.0, 8192.0])
    assert [tuple(r)[:3] for r in recommend.change_plan(meta, access, rates, predict).collect()] == [("b", 64, 512)]
    assert recommend.change_plan(meta, access, rates, predict, force=True).count() == 2


def test_listed_candidates_are_not_expanded(spark):
    rows = [("a", 0, 8, 0.5), ("a", 1, 4, 0.5), ("a", 2, 2, 0.1), ("b", 0, 8, None), ("b", 1, 4, 0.2), (None, 0, 8, float("nan")), (None, 1, 4, 9.0)]
    wide = spark.createDataFrame(rows, "k string, position int, chunk int, p double")
    lists = wide.groupBy("k").agg(F.collect_list(F.struct("p", "position", "chunk")).alias("scored"))
    lists = lists.union(spark.createDataFrame([("b", [(0.9, 5, 1)]), ("c", [])], lists.schema))  # a key in two rows, and one without candidates
    found = candidates.argmax_candidate(lists, ["k"], listed="scored")
    got = {r.k: (r.best_chunk, r.best_p) for r in found.collect()}
    assert got["a"] == (8, 0.5) and got["b"] == (1, 0.9) and "c" not in got and got[None][0] == 8
    assert got["a"] == {r.k: (r.best_chunk, r.best_p) for r in candidates.argmax_candidate(wide, ["k"]).collect()}["a"]
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
