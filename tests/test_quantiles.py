"""Exact quantiles with groups too large for one task, against numpy."""

import numpy as np
import pytest

from accesslake.operators.quantiles import exact_quantiles, few_group_quantiles, stored_counts, values_at_ranks
from pyspark.sql import functions as F

QS = {"low": 0.0, "mid": 0.5, "q": 0.65, "high": 1.0}


def skewed_rows():
    rng = np.random.default_rng(7)
    rows = [("hot", float(v)) for v in rng.lognormal(0, 6, 3000)]
    rows += [("ties", float(v)) for v in rng.integers(0, 5, 900)]
    rows += [("nested", float(10.0 ** -i)) for i in range(24)]
    rows += [("one", 4.5), ("two", 1.0), ("two", 2.0)]
    rows += [(None, float(v)) for v in range(40)]
    rows += [("hot", None), ("empty", None)]
    return rows


@pytest.mark.parametrize("hot_values", [8, 10_000])
def test_grouped_equals_numpy(spark, hot_values):
    rows = skewed_rows()
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    found = {r["k"]: r for r in exact_quantiles(df, ["k"], "v", QS, count_as="n", hot_values=hot_values).collect()}
    groups = {}
    for k, v in rows:
        if v is not None:
            groups.setdefault(k, []).append(v)
    assert set(found) == set(groups)
    for k, values in groups.items():
        assert found[k]["n"] == len(values)
        for name, q in QS.items():
            assert found[k][name] == pytest.approx(np.quantile(values, q), rel=1e-9, abs=1e-300), (k, name)


@pytest.mark.parametrize("hot_values", [40, 10_000])
def test_overall_equals_numpy(spark, hot_values):
    values = [v for _, v in skewed_rows() if v is not None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    row = exact_quantiles(df, [], "v", QS, hot_values=hot_values).first()
    for name, q in QS.items():
        assert row[name] == pytest.approx(np.quantile(values, q), rel=1e-9, abs=1e-300)


def test_ranks_of_large_integers(spark):
    base = 2 ** 60
    df = spark.range(500).select((F.lit(base) + F.col("id") * 3).alias("v"))
    counts = stored_counts(df, [], "v")
    target = counts.agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi")).withColumn("_rank", F.lit(123).cast("bigint"))
    assert values_at_ranks(counts, [], target, hot_values=5).first()["_v"] == base + 369


@pytest.mark.parametrize("hot_values, fanout", [(8, 4), (100_000, 4096)])
def test_few_groups_equal_numpy(spark, hot_values, fanout):
    rng = np.random.default_rng(8)
    rows = [("hot", float(x)) for x in rng.normal(0, 1e6, 3000)] + [("ties", float(x)) for x in rng.integers(0, 4, 2000)]
    rows += [("one", 5.0), ("none", None)] + [(f"g{i % 40}", float(i)) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, v double")
    found = {r["k"]: r for r in few_group_quantiles(df, ["k"], "v", QS, "n", hot_values, fanout).collect()}
    for k in {k for k, v in rows if v is not None}:
        values = [v for g, v in rows if g == k]
        assert found[k]["n"] == len(values)
        for name, q in QS.items():
            assert found[k][name] == pytest.approx(np.quantile(values, q), rel=1e-12)
    whole = few_group_quantiles(df, [], "v", QS, None, hot_values, fanout).first()
    for name, q in QS.items():
        assert whole[name] == pytest.approx(np.quantile([v for _, v in rows if v is not None], q), rel=1e-12)


def test_groups_and_all_rows_from_the_same_scans(spark):
    """Signs, zeros, denormals, huge and close values; the overall quantile comes along; one table is stored."""
    import os

    rng = np.random.default_rng(9)
    rows = [("mixed", float(x)) for x in rng.normal(0, 1, 2000) * 10.0 ** rng.integers(-300, 300, 2000)]
    rows += [("near", 1e12 + float(x)) for x in rng.integers(0, 999, 1500)] + [("zero", float(x)) for x in (0.0, -0.0, 5e-324, -5e-324, 1e308)]
    rows += [(None, float(x)) for x in rng.lognormal(0, 3, 700)] + [("same", 7.0)] * 300 + [("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    base = spark.conf.get("spark.checkpoint.dir") + "/accesslake"
    for hot in (100, 100_000):
        stored = set(os.listdir(base)) if os.path.isdir(base) else set()
        found = {r["k"]: r for r in few_group_quantiles(df, ["k"], "v", QS, "n", hot, 16, overall={"all_mid": 0.5, "all_q": 0.65}).collect()}
        if hot > 1000:
            assert len(set(os.listdir(base)) - stored) == 1
        every = [v for _, v in rows if v is not None]
        for k in {k for k, v in rows if v is not None}:
            values = [v for g, v in rows if g == k and v is not None]
            assert found[k]["n"] == len(values)
            for name, q in QS.items():
                assert found[k][name] == pytest.approx(np.quantile(values, q), rel=1e-12, abs=1e-300)
            assert (found[k]["all_mid"], found[k]["all_q"]) == pytest.approx((np.quantile(every, 0.5), np.quantile(every, 0.65)), rel=1e-12)
    assert "none" not in found


def test_buckets_rise_with_the_values(spark):
    from accesslake.operators.quantiles import log_bucket

    rng = np.random.default_rng(10)
    values = np.r_[rng.normal(0, 1, 4000) * 10.0 ** rng.integers(-308, 308, 4000), 0.0, 5e-324, -5e-324, 1.7e308, -1.7e308, np.inf, -np.inf]
    df = spark.createDataFrame([(float(v),) for v in values], "v double").select("v", log_bucket(F.col("v")).alias("b"))
    buckets = [r.b for r in sorted(df.collect(), key=lambda r: r.v)]
    assert buckets == sorted(buckets) and len(set(buckets)) > 2000
