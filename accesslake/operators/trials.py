"""Before/after trials of two models: statistics, pivots, scorecard and t-test."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.measures import change, change_pct, mean_speed, result_flag, speed

MODELS = ("rf", "xgb")
SIGNIFICANT = 0.05


def trial_speeds(df: DataFrame) -> DataFrame:
    """Speeds from the file size and the mean seconds of reading and writing."""
    return (df.withColumns({"read_speed": speed(F.col("file_size_mb"), F.col("avg_read_seconds")),
                            "write_speed": speed(F.col("file_size_mb"), F.col("avg_write_seconds"))})
            .withColumn("throughput", mean_speed(F.col("read_speed"), F.col("write_speed"))))


def trial_changes(df: DataFrame) -> DataFrame:
    """Adds throughput and, for read, write and throughput, difference and percent change."""
    df = df.withColumns({f"{when}_throughput": mean_speed(F.col(f"{when}_read_speed"), F.col(f"{when}_write_speed"))
                         for when in ("before", "after")})
    new = {}
    for what in ("read_speed", "write_speed", "throughput"):
        before, after = F.col(f"before_{what}"), F.col(f"after_{what}")
        new[f"{what}_change"] = change(before, after)
        new[f"{what}_pct"] = change_pct(before, after)
    return df.withColumns(new)


def model_stats(trials: DataFrame) -> DataFrame:
    v = "throughput_pct"
    return trials.groupBy("model_type").agg(
        F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.count(v).alias("count"))


def pivot_mean(trials: DataFrame, row: str, models: Sequence[str] = MODELS) -> DataFrame:
    """Mean throughput change: a row per value of ``row``, a column per model."""
    return trials.groupBy(row).pivot("model_type", list(models)).agg(F.avg("throughput_pct"))


def rw_gain(trials: DataFrame) -> DataFrame:
    return trials.groupBy("model_type").agg(
        F.avg("read_speed_pct").alias("read_pct"), F.avg("write_speed_pct").alias("write_pct"))


def chunk_selection_report(trials: DataFrame) -> DataFrame:
    """Mean old and new chunk and mean percent change per model and file size, in one aggregation."""
    old, new = F.col("old_chunk_size"), F.col("new_chunk_size")
    return trials.groupBy("model_type", "file_size_mb").agg(
        F.avg(old).alias("old_chunk"), F.avg(new).alias("new_chunk"),
        F.avg(F.try_divide(new - old, old) * 100).alias("chunk_change_pct"))


def scorecard(trials: DataFrame) -> DataFrame:
    """(category, rf, xgb, winner): overall, per size, per pattern, reads, writes.

    One aggregation over grouping sets gives every mean; rf wins only if strictly better.
    """
    def mean_of(model, what):
        return F.avg(F.when(F.col("model_type") == model, F.col(what)))

    means = trials.groupingSets([[], ["file_size_mb"], ["access_pattern"]], "file_size_mb", "access_pattern").agg(
        F.grouping_id().alias("_g"),
        *[mean_of(m, f"{w}_pct").alias(f"{w}_{m}") for w in ("throughput", "read_speed", "write_speed") for m in MODELS])
    name = (F.when(F.col("_g") == 3, F.lit("Overall Performance"))
            .when(F.col("_g") == 1, F.format_string("%.0fMB Files", "file_size_mb"))
            .otherwise(F.concat(F.initcap(F.replace("access_pattern", F.lit("_"), F.lit(" "))), F.lit(" Access"))))
    rows = means.select("_g", name.alias("category"), F.col("throughput_rf").alias("rf"), F.col("throughput_xgb").alias("xgb"),
                        "read_speed_rf", "read_speed_xgb", "write_speed_rf", "write_speed_xgb")
    # The overall row also yields the two operation rows.
    operations = F.when(F.col("_g") == 3, F.array(
        F.struct("category", "rf", "xgb"),
        F.struct(F.lit("Read Operations").alias("category"), F.col("read_speed_rf").alias("rf"), F.col("read_speed_xgb").alias("xgb")),
        F.struct(F.lit("Write Operations").alias("category"), F.col("write_speed_rf").alias("rf"), F.col("write_speed_xgb").alias("xgb")),
    )).otherwise(F.array(F.struct("category", "rf", "xgb")))
    return (rows.select(F.inline(operations))
            .withColumn("winner", F.when(F.col("rf") > F.col("xgb"), "RF").otherwise("XGBoost")))


def verdict(card: DataFrame) -> DataFrame:
    wins = card.agg(F.count_if(F.col("winner") == "RF").alias("rf_wins"),
                    F.count_if(F.col("winner") == "XGBoost").alias("xgb_wins"),
                    F.count(F.lit(1)).alias("categories"))
    rf, xgb = F.col("rf_wins"), F.col("xgb_wins")
    return wins.withColumn("verdict", F.when(rf > xgb, "RF").when(xgb > rf, "XGBoost").otherwise("Tie"))


def t_test(trials: DataFrame, value: str = "throughput_pct") -> DataFrame:
    """Pooled-variance two-sample t statistic and degrees of freedom of rf against xgb."""
    def of(model):
        return F.when(F.col("model_type") == model, F.col(value))

    m = trials.agg(*[e for k in MODELS for e in (
        F.count(of(k)).alias(f"n_{k}"), F.avg(of(k)).alias(f"m_{k}"), F.var_samp(of(k)).alias(f"v_{k}"))])
    n1, n2 = F.col("n_rf"), F.col("n_xgb")
    dof = n1 + n2 - 2
    pooled = F.try_divide((n1 - 1) * F.col("v_rf") + (n2 - 1) * F.col("v_xgb"), dof)
    error = F.sqrt(pooled * (F.try_divide(F.lit(1.0), n1) + F.try_divide(F.lit(1.0), n2)))
    return m.select(F.try_divide(F.col("m_rf") - F.col("m_xgb"), error).alias("t_stat"), dof.alias("dof"),
                    F.col("m_rf").alias("mean_rf"), F.col("m_xgb").alias("mean_xgb"))


def two_sided_p(t: Column | str, dof: Column | str) -> Column:
    """Two-sided p of Student's t, by integrating the density over the angle atan(t / sqrt(dof)); null where it has none."""
    t, dof = (F.col(c) if isinstance(c, str) else c for c in (t, dof))
    nodes = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(w)).alias("w"))
                      for x, w in zip(*np.polynomial.legendre.leggauss(200))])
    right_angle, v = F.lit(float(np.pi / 2)), dof.cast("double")

    def mass(a: Column) -> Column:
        # Beyond the peak's width the density is below any double, so the interval can end there.
        b = F.least(right_angle, a + 40.0 / F.sqrt(v))
        half, middle = (b - a) / 2, (a + b) / 2
        return half * F.aggregate(nodes, F.lit(0.0), lambda total, n: total + n["w"] * F.exp(
            (v - 1) * F.log(F.cos(half * n["x"] + middle))))

    p = F.least(F.lit(1.0), mass(F.atan(F.abs(t) / F.sqrt(v))) / mass(F.lit(0.0)))
    return F.when(t.isNotNull() & ~F.isnan(t) & (F.abs(t) < float("inf")) & (v > 0), p)


def t_test_with_p(trials: DataFrame, value: str = "throughput_pct") -> DataFrame:
    """The one-row test with p, whether it is significant, and which model is better then."""
    tested = t_test(trials, value).withColumn("p_value", two_sided_p(F.col("t_stat"), F.col("dof")))
    better = F.when(F.col("mean_rf") > F.col("mean_xgb"), "RF").otherwise("XGBoost")
    return (tested.withColumn("significant", F.col("p_value") < SIGNIFICANT)
            .withColumn("better", F.when(F.col("significant"), better)))


def stack_rw(trials: DataFrame) -> DataFrame:
    """Read gains above write gains, tagged with the operation."""
    def part(tag, column):
        return trials.select("trial_id", "model_type", F.lit(tag).alias("operation"), F.col(column).alias("pct"))

    return part("read", "read_speed_pct").unionByName(part("write", "write_speed_pct"))


def melt_chunks(trials: DataFrame) -> DataFrame:
    return trials.unpivot(["trial_id", "model_type"], ["old_chunk_size", "new_chunk_size"], "chunk_type", "chunk_size")


def improvement_summary(comparison: DataFrame) -> DataFrame:
    return comparison.agg(F.avg("throughput_pct").alias("avg_change"),
                          F.count_if(F.col("throughput_pct") > 0).alias("improved"),
                          F.count(F.lit(1)).alias("total"))


def comparison_table(trials: DataFrame) -> DataFrame:
    """One line per trial with chunk and throughput before and after, and the result flag."""
    return trials.select(
        "trial_id", "old_chunk_size", "new_chunk_size",
        change_pct(F.col("old_chunk_size"), F.col("new_chunk_size")).alias("chunk_pct"),
        "before_throughput", "after_throughput", "throughput_pct", result_flag(F.col("throughput_pct")).alias("result"))
