import pytest
from pyspark.sql import functions as F

from accesslake.operators import labels

COLUMNS = "file_path string, file_size_kb bigint, chunk_size_kb bigint, access_count bigint, throughput_kbps double"


def test_golden_labels(spark):
    rows = [("f", 1024, 128, 30, 25624.04), ("f", 1024, 256, 22, 23971.52), ("f", 1024, 512, 22, 25931.37), ("f", 1024, 64, 7, 25755.14)]
    found = {r["chunk_size_kb"]: r for r in labels.label_ot(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert {c: r["access_count_label"] for c, r in found.items()} == {128: 3, 256: 3, 512: 3, 64: 1}
    assert {c: r["OT"] for c, r in found.items()} == {128: 0, 256: 0, 512: 1, 64: 1}
    assert found[64]["combination"] == "1024 | 1"


def test_small_groups_use_the_overall_quantile(spark):
    rows = [("a", 10, 64, 5, 1.0), ("b", 20, 64, 5, 9.0), ("b", 20, 128, 5, 8.0)] + [("c", 30, 64, 5, float(v)) for v in (4, 5, 6, 7)]
    found = {(r["file_size_kb"], r["throughput_kbps"]): r["x"] for r in
             labels.label_ot(spark.createDataFrame(rows, COLUMNS), min_rows=3, label="x").collect()}
    # The overall 65th percentile of 1, 4, 5, 6, 7, 8, 9 is 6.9.
    assert found == {(10, 1.0): 0, (20, 9.0): 1, (20, 8.0): 1, (30, 4.0): 0, (30, 5.0): 0, (30, 6.0): 1, (30, 7.0): 1}


def test_exact_tie_with_the_quantile_counts(spark):
    rows = [("a", 10, 64, 5, 3.0)] * 5
    assert [r["OT"] for r in labels.label_ot(spark.createDataFrame(rows, COLUMNS)).collect()] == [1] * 5


@pytest.mark.parametrize("hot_values", [2, 1000])
def test_labels_do_not_depend_on_the_path(spark, hot_values):
    rows = [("f%d" % (i % 3), 512 if i % 3 else 4096, 64 * 2 ** (i % 6), i % 25, float((i * 37) % 101)) for i in range(300)]
    df = spark.createDataFrame(rows, COLUMNS)
    assert labels.label_optimal(df, hot_values=hot_values).select(*df.columns, "is_optimal").exceptAll(
        labels.label_optimal(df).select(*df.columns, "is_optimal")).isEmpty()


@pytest.mark.parametrize("start,value", [(0, 1), (1, 0)])
def test_balance_takes_a_quarter_in_order(spark, start, value):
    rows = [(i, float(i // 3), start) for i in range(22)]
    df = spark.createDataFrame(rows, "id bigint, t double, y int")
    done = labels.balance_labels(df, "y", "t", "id").where(F.col("y") == value)
    want = sorted(rows, key=lambda r: (-r[1] if start == 0 else r[1], r[0]))[:22 // 4]
    assert sorted(r["id"] for r in done.collect()) == sorted(r[0] for r in want)


def test_balance_leaves_mixed_labels_alone(spark):
    df = spark.createDataFrame([(1, 1.0, 0), (2, 2.0, 1)], "id bigint, t double, y int")
    assert labels.balance_labels(df, "y", "t", "id") is df


def test_many_groups_are_counted_once(spark, monkeypatch):
    """Groups by other keys may be as many as files: no histogram for each of them, and the same labels as with one."""
    rows = [(k % 40, 64, k % 25, float(k * 37 % 101) if k % 9 else None) for k in range(400)]
    df = spark.createDataFrame([(f"f{a}" if a else None, b, c, d) for a, b, c, d in rows],
                               "file_path string, file_size_kb long, access_count long, throughput_kbps double")
    keys = ("file_path", "access_count_label")
    made = labels.few_group_quantiles
    monkeypatch.setattr(labels, "few_group_quantiles", None)
    for min_rows in (1, 4):
        got = labels.label_ot(df, min_rows=min_rows, keys=keys)
        limits = made(labels.with_band(df), keys, "throughput_kbps", {"_limit": 0.65}, "_rows", overall={"_all": 0.65}).withColumnsRenamed(
            {k: f"_{k}" for k in keys})
        limit = F.when(F.col("_rows") >= min_rows, F.col("_limit")).otherwise(F.col("_all"))
        match = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        wanted = got.join(limits, match, "left").where(
            F.col("OT") != F.when(F.round("throughput_kbps", 6) >= F.round(limit, 6), 1).otherwise(0))
        assert got.count() == 400 and wanted.count() == 0 and 0 < got.agg(F.sum("OT")).first()[0] < 400
