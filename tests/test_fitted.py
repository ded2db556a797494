"""What fits keep: scalers, components, dictionaries, bundles, maps; and moments from one scan."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from accesslake.operators import features, som, stats
from accesslake.operators.scalers import ColumnScaler, fit_scaler
from accesslake.plans import train
from accesslake.sources.bundles import Bundle, load_bundle, save_bundle
from accesslake.sources.versions import Folder


@pytest.fixture(scope="module")
def table(spark):
    r = np.random.default_rng(1)
    rows = [(i, float(a), float(2 * a + b), float(b) if i % 7 else None, 5.0) for i, (a, b) in enumerate(zip(r.lognormal(3, 1, 400), r.normal(0, 9, 400)))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, same double").repartition(3).cache()


@pytest.mark.parametrize("kind", ["standard", "robust", "minmax"])
def test_a_row_alone_is_scaled_as_in_its_table(spark, table, tmp_path, kind):
    columns = ["a", "b", "c", "same"]
    model = fit_scaler(table, columns, kind)
    PipelineModel([model]).write().save(str(tmp_path / kind))
    again = PipelineModel.load(str(tmp_path / kind))
    whole = {r.id: tuple(r) for r in model.transform(table).collect()}
    for i in (0, 7, 250):
        assert tuple(again.transform(table.where(F.col("id") == i)).first()) == whole[i]
    known = table.toPandas()
    for c, at in zip(columns, range(1, 5)):
        x = known[c].dropna()
        centre, width = {"standard": (x.mean(), x.std(ddof=0)), "minmax": (x.min(), x.max() - x.min()),
                         "robust": (x.median(), x.quantile(0.75) - x.quantile(0.25))}[kind]
        for i, v in zip(known.id, known[c]):
            assert whole[i][at] is None if np.isnan(v) else whole[i][at] == pytest.approx((v - centre) / (width or 1), abs=1e-9)
    with pytest.raises(ValueError):
        ColumnScaler(inputCols=["a"], kind="other")
    nothing = fit_scaler(table.where("false"), ["a"], kind).transform(table.limit(1)).first()
    assert nothing.a is not None


def test_components_keep_their_scaler(spark, table, tmp_path):
    model = features.fit_pca(table.na.fill(0.0), ["a", "b", "c"])
    save_bundle(spark, str(tmp_path / "pca"), Bundle({"pca": model}))
    again = load_bundle(spark, str(tmp_path / "pca")).models["pca"]
    whole = {r.id: tuple(r) for r in features.project_pca(table.na.fill(0.0), model, keep=["id", "a"]).collect()}
    one = features.project_pca(table.na.fill(0.0).where("id = 11"), again, keep=["id", "a"]).first()
    assert tuple(one) == pytest.approx(whole[11]) and one.a == table.where("id = 11").first().a


def test_moments_of_close_and_large_values(spark):
    r = np.random.default_rng(2)
    x = 1e12 + r.normal(0, 1, (3000, 3)) @ np.array([[1, 0.5, 0], [0, 1, 0.2], [0, 0, 1]])
    x[:, 2] += np.linspace(0, 50, 3000)  # tasks see different means
    df = spark.createDataFrame([(*map(float, v), 3.0) for v in x], "p double, q double, s double, k double").repartition(7)
    m = stats.moments(df, ["p", "q", "s", "k"]).first()
    centred = np.c_[x - 1e12, np.full(3000, 3.0)]  # exact; the doubles near 1e12 are a ten-thousandth apart
    centred -= centred.mean(axis=0)
    assert m.n == 3000 and np.allclose(np.array(m.co).reshape(4, 4), centred.T @ centred, rtol=1e-4)
    r = {(c.feature_x, c.feature_y): c.r for c in stats.corr_matrix(df, ["p", "q", "s", "k"]).collect()}
    assert r["p", "q"] == pytest.approx(np.corrcoef((x - 1e12).T)[0, 1], abs=1e-4) and r["p", "p"] == 1 and r["k", "p"] is None and r["k", "k"] is None
    plan = stats.corr_matrix(df, ["p", "q"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1
    assert stats.moments(df.where("false"), ["p"]).count() == 0


def test_dictionary_of_any_number_of_levels(spark):
    n = 30_000
    df = spark.range(n).select("id", F.format_string("level %05d", (F.col("id") * 7919) % n).alias("v"))
    df = df.unionByName(spark.createDataFrame([(-1, None)], "id long, v string"))
    fitted = features.fit_onehot(df, "v")
    assert fitted.levels.count() == n and fitted.levels.orderBy("position").limit(3).collect()[2].level == "level 00002"
    unknown = spark.createDataFrame([(-2, "never seen")], "id long, v string")
    coded = fitted.transform(df.unionByName(unknown), "x")
    sample = {r.id: r.x for r in coded.where("id IN (-2, -1, 0, 1, 2)").collect()}
    assert all(x.size == n - 1 for x in sample.values())
    assert [sample[i].numNonzeros() for i in (-2, -1, 0, 1)] == [0, 0, 0, 1] and sample[1].indices[0] == 7918
    back = features.decode_onehot(fitted, coded, "x")
    assert back.count() == n - 1 and back.where("level <> v").isEmpty()
    assert features.fit_onehot(df.where("v IS NULL"), "v") is None


def test_bundles_are_whole_or_not_there(spark, table, tmp_path, monkeypatch):
    path = str(tmp_path / "b")
    with pytest.raises(FileNotFoundError):
        load_bundle(spark, path)
    model = fit_scaler(table, ["a"])
    for n in range(3):
        save_bundle(spark, path, Bundle({"m": model}, {"t": spark.range(n)}, {"n": n, "list": [1.5]}))
    now = load_bundle(spark, path)
    assert now.tables["t"].count() == 2 and now.facts == {"n": 2, "list": [1.5]}
    assert [n for n in Folder(spark, path).names() if n.startswith("v")] == ["v1", "v2"]

    def stop(self, version):
        raise RuntimeError("stopped")

    monkeypatch.setattr(Folder, "point_to", stop)
    with pytest.raises(RuntimeError):
        save_bundle(spark, path, Bundle({"m": model}, {"t": spark.range(9)}, {"n": 9}))
    monkeypatch.undo()
    assert load_bundle(spark, path).facts["n"] == 2
    save_bundle(spark, path, Bundle({}, {"t": spark.range(5)}, {"n": 5}))
    assert load_bundle(spark, path).tables["t"].count() == 5 and load_bundle(spark, path).models == {}


def test_a_stored_map_scores_alike(spark, tmp_path):
    r = np.random.default_rng(3)
    centres = r.normal(0, 5, (4, 3)) * [1, 1000, 0.001]  # of very different spans
    rows = [((centres[i % 4] + r.normal(0, 0.1, 3) * [1, 1000, 0.001]).tolist(), 64 << i % 4, f"/f{i}", 1 << 20) for i in range(300)]
    df = spark.createDataFrame(rows, "vector array<double>, chunk_size long, file_path string, file_size long")
    fitted = som.fit_map(df, epochs=6, side=10)
    assert len(fitted.errors) == 7 and fitted.errors[-1] < max(fitted.errors) / 2
    grid = fitted.codebook.select("i", "j")
    chunks = som.unit_chunk_map(fitted.assign(df), grid, "chunk_size")
    train.save_map(fitted, str(tmp_path / "map"), spark, chunks)
    again = train.load_map(str(tmp_path / "map"), spark)
    assert again.errors == fitted.errors
    unit = lambda m: {r.file_path: (r.unit.i, r.unit.j, r.distance) for r in m.assign(df).collect()}
    assert unit(again) == unit(fitted)
    # rows of one centre share units that rows of others have not
    by_centre = [{unit(fitted)[f"/f{i}"][:2] for i in range(k, 300, 4)} for k in range(4)]
    assert all(not by_centre[a] & by_centre[b] for a in range(4) for b in range(a))
    assert again.predict(df).count() == 300
    with pytest.raises(ValueError):
        fitted.predict(df)


def test_a_map_over_tasks_without_rows(spark):
    """A file of one row group is read by many tasks, all but one of them without rows."""
    df = spark.createDataFrame([([float(k % 5), float(k % 3)],) for k in range(40)], "vector array<double>").coalesce(1)
    sparse = df.union(spark.createDataFrame([], df.schema).repartition(4))
    weights = np.array([[0.0, 0.0], [4.0, 2.0], [2.0, 1.0]])
    sums, hits, error = som._unit_sums(sparse, "vector", weights)
    x = np.array([r.vector for r in df.collect()])
    d = np.sqrt(((x[:, None, :] - weights) ** 2).sum(axis=2))
    assert hits.tolist() == np.bincount(d.argmin(axis=1), minlength=3).tolist() and abs(error - d.min(axis=1).mean()) < 1e-12


def test_nearest_units_are_exact():
    r = np.random.default_rng(1)
    x, w = r.normal(1000, 1, (3000, 7)), r.normal(1000, 1, (50, 7))
    w[20], w[7], x[:5] = w[3], w[5], w[[3, 20, 5, 7, 49]]  # equal units: the first counts
    x[9, 2] = np.nan
    d = np.sqrt(np.stack([((x - v) ** 2).sum(axis=1) for v in w], axis=1))
    best, far = som._nearest()(x, w)
    assert (best == d.argmin(axis=1)).all() and np.array_equal(far, d[np.arange(len(x)), best], equal_nan=True)
    assert len(som._nearest()(x[:0], w)[0]) == 0
