"""Trees fitted over bins against Spark ML's own, and how many passes they take."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from accesslake.operators import forests, models
from accesslake.operators.common import spread
from accesslake.operators.ensembles import boosted_probability, trees_of

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    """Features of up to 20 values, so that Spark ML and the bins have the same split points."""
    r = np.random.default_rng(4)
    x = np.stack([r.integers(0, 20, 1500), 2 ** r.integers(0, 9, 1500), r.integers(-5, 6, 1500) / 3], axis=1).astype(float)
    y = (np.abs(x[:, 0] - np.log2(x[:, 1]) * 2) + r.normal(0, 2, 1500) < 5 + x[:, 2]).astype(int)
    made = [(i, *map(float, v), int(k)) for i, (v, k) in enumerate(zip(x, y))]
    return spark.createDataFrame(made, "id int, a double, b double, c double, y int").repartition(3).cache()


def splits(model):
    return [t.toDebugString.split("\n", 1)[1] for t in model.trees]


def test_boosted_trees_are_those_of_spark_ml(rows):
    estimator = GBTClassifier(labelCol="y", maxIter=6, maxDepth=4, stepSize=0.1, seed=1)
    wanted = estimator.fit(VectorAssembler(inputCols=NAMES, outputCol="features").transform(rows))
    data = forests.to_blocks(rows, NAMES, [0.0] * 3, "y", spread)
    got, = forests.fit_boosted(data, estimator)
    assert got.treeWeights == wanted.treeWeights and got.getMaxIter() == 6
    assert splits(got)[0] == splits(wanted)[0]
    scored = VectorAssembler(inputCols=NAMES, outputCol="features").transform(rows)
    p = [np.array([r.p for r in m.transform(scored).select("id", vector_to_array("probability")[1].alias("p")).orderBy("id").collect()])
         for m in (got, wanted)]
    assert np.abs(p[0] - p[1]).max() < 1e-4 and len(set(p[0].round(6))) > 50
    assert np.allclose(got.featureImportances.toArray(), wanted.featureImportances.toArray(), atol=1e-4)
    # blocks are scored as the rows are
    said = forests.scored(data, [trees_of(got)], lambda y, _, sums: (y, boosted_probability(sums[0])), "y double, p double")
    assert np.allclose(sorted(r.p for r in said.collect()), np.sort(p[0]), rtol=0, atol=1e-12)
    data.release()


def test_a_forest_draws_and_weighs_as_spark_ml_does(rows):
    estimator = RandomForestClassifier(labelCol="y", weightCol="w", numTrees=40, maxDepth=5, featureSubsetStrategy="sqrt", seed=1)
    n, ones = rows.count(), rows.where("y = 1").count()
    weights = (n / (2 * (n - ones)), n / (2 * ones))
    weighted = VectorAssembler(inputCols=NAMES, outputCol="features").transform(
        rows.withColumn("w", F.when(F.col("y") == 1, weights[1]).otherwise(weights[0])))
    data = forests.to_blocks(rows, NAMES, [0.0] * 3, "y", spread)
    got, wanted = forests.fit_forest(data, estimator, weights), estimator.fit(weighted)
    other = estimator.copy({estimator.seed: 2}).fit(weighted)
    data.release()
    assert got.getNumTrees == 40 and got.numClasses == 2 and max(t.depth for t in got.trees) <= 5
    p = [np.array([r.p for r in m.transform(weighted).select("id", vector_to_array("probability")[1].alias("p")).orderBy("id").collect()])
         for m in (got, wanted, other)]
    apart = lambda i, k: np.abs(p[i] - p[k]).mean()
    assert apart(0, 1) < 1.6 * apart(1, 2) and np.corrcoef(p)[0, 1] > 0.97  # no further apart than by Spark ML's own draws
    assert len(set(splits(got))) == 40 and {int(t.numFeatures) for t in got.trees} == {3}


def test_folds_grow_side_by_side_and_stop_by_their_own_rows(rows, monkeypatch):
    passes = []
    monkeypatch.setattr(forests, "_total", lambda found, real=forests._total: passes.append(1) or real(found))
    fit = models.fit_gbt_cv(rows, ["id"], NAMES, "y", folds=4, rounds=60, depth=3)
    found = fit.folds.collect()
    assert [r.fold for r in found] == [0, 1, 2, 3] and all(0.8 < r.auc <= 1 for r in found)
    grown = len(fit.model.stages[-1].trees)
    assert 1 < grown < 60  # the left-out rows gain no more
    assert len(passes) <= 60 * 3 + 1  # before, as many for each fold
    # the metrics of the best fold are those of its model on the rows left out
    held = rows.withColumn("_f", models.hash_bucket(["id"], 4, 42)).where(F.col("_f") == fit.best_fold)
    again = models.binary_metrics(models.with_probability(fit.model, held).select(F.col("y").alias("label"), "p")).first()
    assert again.logloss == pytest.approx(found[fit.best_fold].logloss, abs=1e-9) and again.auc == pytest.approx(found[fit.best_fold].auc)


def test_split_points_and_missing_values(spark):
    few = forests._thresholds(np.array([1.0, 2.0, 4.0]), np.array([5, 1, 1]))
    assert few.tolist() == [1.5, 3.0] and forests._thresholds(np.array([7.0]), np.array([9])).tolist() == []
    x = np.random.default_rng(2).lognormal(size=200_000)
    known = (np.zeros(0), np.zeros(0, np.int64))
    for part in np.array_split(x, 20):
        known = forests._joined(known, forests._shortened(*np.unique(part, return_counts=True)))
    assert known[1].sum() == len(x) and len(known[0]) <= forests.SUMMARY
    cuts = forests._thresholds(*known)
    assert len(cuts) == 31 and np.abs((x[:, None] <= cuts).mean(axis=0) - np.arange(1, 32) / 32).max() < 0.005
    df = spark.createDataFrame([(1.0, 0), (None, 1), (float("nan"), 1), (9.0, 1)], "a double, y int")
    data = forests.to_blocks(df.coalesce(1), ["a"], [5.0], "y", spread)
    assert data.thresholds[0].tolist() == [3.0, 7.0] and (data.rows, data.ones) == (4, 3)
    assert sorted(int(p) >> forests.BITS for b in data.blocks.collect() for p in b[1][0]) == [0, 1, 1, 2]
    with pytest.raises(ValueError):
        forests.to_blocks(df.withColumn("y", F.lit(2)), ["a"], [5.0], "y", spread)
    with pytest.raises(ValueError):
        forests.to_blocks(df.where("false"), ["a"], [5.0], "y", spread)


@pytest.mark.parametrize("size", [40, 40_000])
def test_histograms_by_pairs_and_by_features(size):
    r = np.random.default_rng(6)
    bins, group, w = r.integers(0, 32, (3, size)), r.integers(0, 4, size), r.normal(size=size)
    pairs = np.stack([bins[0] << 5 | bins[1], bins[2] << 5]).astype(np.uint16)
    got = forests._histogram(pairs, group, 4, 3, w)
    for f in range(3):
        wanted = np.zeros((4, 32))
        np.add.at(wanted, (group, bins[f]), w)
        assert np.allclose(got[:, f], wanted)


def test_draws_are_the_same_again_and_of_the_right_law():
    drawn = forests._drawn((1, 2, 3), 100_000)
    assert (drawn == forests._drawn((1, 2, 3), 100_000)).all() and (drawn != forests._drawn((1, 2, 4), 100_000)).any()
    times = np.bincount(forests._poisson()[drawn], minlength=4) / len(drawn)
    assert np.allclose(times[:4], [0.3679, 0.3679, 0.1839, 0.0613], atol=0.005)
    assert (forests._subset((1,), 50, 9, 3).sum(axis=1) == 3).all()
