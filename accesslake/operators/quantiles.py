"""Exact grouped quantiles that hold when one group has a third of all rows.

The caller says which of two ways fits. For a few groups, such as the columns of a table or bands of sizes, ``few_group_quantiles``
scans the rows twice. The first scan counts them per group and bucket of a fixed logarithmic scale, which needs no extremes and merges from
task to task; these counts are the one table that is stored, and tell the bucket of every wanted rank, for the groups and for all rows
alike. The second scan takes the values of those buckets only. For many groups, such as files, ``exact_quantiles`` reduces the rows to
counted values:

The rows are reduced once to (group, value, count), with map-side combine, and that table is stored in
the shared work folder: the input is evaluated one time, whatever follows. A group with few distinct
values goes to the built-in ``percentile``. A group with many is never brought into one task: rank
selection narrows the value range that holds the wanted rank, by counting rows per equal-width bucket
of the range, until few values are left in it. Each step reads the stored counts against a table with
one row per hot group and rank; only bucket counts are shuffled. The same happens to a logarithmic bucket that holds too many rows.

The functions run jobs when called; what they return is lazy over stored tables.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import join_on, with_row
from ..session import materialise

# Most distinct values of one group that one task may hold.
HOT_VALUES = 200_000
FANOUT = 4096


def stored_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, _v, _n) as a stored table: how often each non-null value occurs in each group."""
    counts = (df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v"))
              .agg(F.count(F.lit(1)).alias("_n")))
    return materialise(counts, "value-counts")


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, quantiles: Mapping[str, float],
                    count_as: str | None = None, hot_values: int = HOT_VALUES) -> DataFrame:
    """One row per group: its keys, one column per named quantile, optionally the non-null count.

    Quantiles interpolate linearly between neighbours, as ``percentile`` does. Null values do not count.
    """
    typed = df.select(*keys, F.col(value).cast("double").alias(value))
    return quantiles_of_counts(stored_counts(typed, keys, value), keys, quantiles, count_as, hot_values)


def log_bucket(v: Column) -> Column:
    """The place of a double on a logarithmic scale of 128 steps for each doubling: never falls as the value grows; NaN comes last."""
    size = F.floor(F.log2(F.abs(v)) * F.lit(128.0))
    code = F.lit(140_000) + F.least(F.greatest(size, F.lit(-139_999)), F.lit(131_072))
    return F.when(F.isnan(v), F.lit(400_000)).when(v > 0, code).when(v < 0, -code).otherwise(F.lit(0)).cast("int")


def few_group_quantiles(df: DataFrame, keys: Sequence[str], value: str, quantiles: Mapping[str, float],
                        count_as: str | None = None, hot_values: int = HOT_VALUES, fanout: int = FANOUT,
                        overall: Mapping[str, float] | None = None) -> DataFrame:
    """As ``exact_quantiles`` for few groups, from two scans of ``df``, whatever the sizes of the groups.

    ``overall`` names quantiles of all rows, which come as further columns, the same in every row, out of the same scans.
    """
    keys, points = list(keys), [float(q) for q in quantiles.values()]
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    rows = rows.withColumn("_b", log_bucket(F.col("_v")))
    counts = materialise(rows.groupBy(*keys, "_b").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")), "histogram")
    levels = [_Level(counts, keys, points)] + ([_Level(counts, [], [float(q) for q in overall.values()])] if overall else [])
    # the buckets whose values are wanted, of any level, group by group
    wanted = [join_on(counts, level.open, [*level.keys, "_b"], "left_semi").select(*keys, "_b") for level in levels]
    hit = reduce(DataFrame.union, wanted).distinct() if len(wanted) > 1 else wanted[0]
    values = join_on(rows, hit, [*keys, "_b"], "left_semi").groupBy(*keys, "_b", "_v").agg(F.count(F.lit(1)).alias("_n"))
    found = [level.quantiles(values, rows, hot_values, fanout) for level in levels]
    columns = [F.col("_q")[i].alias(n) for i, n in enumerate(quantiles)]
    result = found[0].select(*keys, *columns, *([F.col("_t").alias(count_as)] if count_as else []))
    if overall:
        result = with_row(result, found[1].select(*[F.col("_q")[i].alias(n) for i, n in enumerate(overall)]), "_all")
        result = result.select(*[c for c in result.columns if c != "_all"], "_all.*")
    return result


class _Level:
    """The ranks of the quantiles of some groups, located in a stored histogram of finer groups."""

    def __init__(self, counts: DataFrame, keys: list[str], points: list[float]):
        self.keys, self.points = keys, points
        merged = counts.groupBy(*keys, "_b").agg(F.sum("_n").alias("_n"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
        self.sizes = merged.groupBy(*keys).agg(F.sum("_n").alias("_t")).where("_t > 0")
        ranks = self.sizes.select(*keys, F.lit(0).cast("bigint").alias("_base"), F.explode(_ranks(points)).alias("_rank"))
        ranked = join_on(ranks, merged, keys) if keys else ranks.join(merged, F.lit(True))
        # the buckets of a group at most, for each of its ranks
        self.held = _at_rank(ranked, [*keys, "_rank"], "_b", "_n").select(
            *keys, "_rank", "_b", "_lo", "_hi", (F.col("_upto") - F.col("_n")).alias("_base"), F.col("_n").alias("_d"))
        self.open = self.held.where("_lo < _hi").select(*keys, "_b").distinct()

    def quantiles(self, values: DataFrame, rows: DataFrame, hot_values: int, fanout: int) -> DataFrame:
        """(keys, _q, _t): from the counted values of the open buckets or, if one holds too many rows, by narrowing its range."""
        largest = self.held.where("_lo < _hi").agg(F.max("_d")).first()[0]  # one number
        if largest is not None and largest > hot_values:
            found = _settle(rows.withColumn("_n", F.lit(1).cast("bigint")), self.keys, self.held.drop("_b"), hot_values, fanout)
        else:
            group = [*self.keys, "_b"]
            merged = values.groupBy(*group, "_v").agg(F.sum("_n").alias("_n"))
            ranked = join_on(merged, self.held.where("_lo < _hi").select(*group, "_rank", "_base"), group)
            found = _at_rank(ranked, [*self.keys, "_rank"], "_v", "_n").select(*self.keys, "_rank", "_v").unionByName(
                self.held.where("_lo >= _hi").select(*self.keys, "_rank", F.col("_lo").alias("_v")))
        return _interpolated(self.sizes, self.keys, found, self.points)


def quantiles_of_counts(counts: DataFrame, keys: Sequence[str], quantiles: Mapping[str, float],
                        count_as: str | None = None, hot_values: int = HOT_VALUES) -> DataFrame:
    """As ``exact_quantiles`` from a stored table with the keys, ``_v`` and ``_n``.

    The keys may be fewer than those the table was counted by: equal values then occur in several rows.
    """
    keys, points = list(keys), [float(q) for q in quantiles.values()]
    sizes = counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_d"), F.sum("_n").alias("_t"),
                                      F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    # There are at most (rows of the table / hot_values) such groups. Storing them tells the optimizer
    # their true size before it chooses how to join.
    columns = [F.col("_q")[i].alias(n) for i, n in enumerate(quantiles)]
    result = [*keys, *columns, *([F.col("_t").alias(count_as)] if count_as else [])]
    largest = sizes.agg(F.max("_d")).first()[0]  # one number
    if largest is None or largest <= hot_values:
        return _percentiles(counts, keys, points).select(*result)
    hot = materialise(sizes.where(F.col("_d") > hot_values), "hot-groups")
    large = _selected(counts, keys, hot, points, hot_values).select(*result)
    if not keys:
        return large
    return _percentiles(join_on(counts, hot, keys, "left_anti"), keys, points).select(*result).unionByName(large)


def _percentiles(counts: DataFrame, keys: Sequence[str], points: Sequence[float]) -> DataFrame:
    return counts.groupBy(*keys).agg(
        F.percentile("_v", F.array(*[F.lit(q) for q in points]), F.col("_n")).alias("_q"), F.sum("_n").alias("_t"))


def _selected(counts: DataFrame, keys: Sequence[str], hot: DataFrame, points: Sequence[float],
              hot_values: int) -> DataFrame:
    """The quantiles of groups too large for one task, by rank selection."""
    found = values_at_ranks(counts, keys, hot.select("*", F.explode(_ranks(points)).alias("_rank")), hot_values)
    return _interpolated(hot, keys, found, points)


def _positions(points: Sequence[float]) -> list[Column]:
    return [F.lit(q) * (F.col("_t") - 1) for q in points]


def _ranks(points: Sequence[float]) -> Column:
    """The ranks next to each quantile of a group of ``_t`` rows."""
    return F.array_distinct(F.array(*[f(p).cast("bigint") for p in _positions(points) for f in (F.floor, F.ceil)]))


def _interpolated(groups: DataFrame, keys: Sequence[str], found: DataFrame, points: Sequence[float]) -> DataFrame:
    """(keys, _q, _t) from the groups' sizes and the values at their ranks."""
    # At most two ranks per quantile.
    by_rank = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_at"))

    def between(p: Column) -> Column:
        low, high = F.floor(p).cast("bigint"), F.ceil(p).cast("bigint")
        at = F.col("_at")
        return F.when(low == high, at[low]).otherwise((high - p) * at[low] + (p - low) * at[high])

    known = join_on(groups, by_rank, keys) if keys else groups.withColumn("_at", by_rank.scalar())
    return known.select(*keys, F.array(*[between(p) for p in _positions(points)]).alias("_q"), "_t")


def values_at_ranks(counts: DataFrame, keys: Sequence[str], targets: DataFrame, hot_values: int = HOT_VALUES,
                    fanout: int = FANOUT) -> DataFrame:
    """(keys, _rank, _v): the value at each 0-based ascending rank.

    ``counts`` is a stored table with the keys, ``_v`` and ``_n``; ``targets`` has one row per group and
    ``_rank`` with the group's extremes ``_lo`` and ``_hi``. Each round's buckets part the extremes of
    the range, so every range shrinks; the rounds end when all are single values or small.
    """
    start = materialise(
        targets.select(*keys, "_rank", "_lo", "_hi", F.lit(0).cast("bigint").alias("_base")), "rank-selection")
    return _settle(counts, keys, _bucket_of_rank(counts, keys, start, fanout), hot_values, fanout)


def _settle(counts: DataFrame, keys: Sequence[str], targets: DataFrame, hot_values: int, fanout: int) -> DataFrame:
    """(keys, _rank, _v) from targets whose ranges are narrowed until they are single values or small."""
    group = [*keys, "_rank"]
    while True:
        targets = materialise(targets, "rank-selection")
        # One number reaches the driver.
        largest = targets.where(F.col("_lo") < F.col("_hi")).agg(F.max("_d")).first()[0]
        if largest is None or largest <= hot_values:
            break
        targets = _bucket_of_rank(counts, keys, targets, fanout)
    settled = targets.where(F.col("_lo") == F.col("_hi")).select(*group, F.col("_lo").alias("_v"))
    rows = _within(counts, keys, targets.where(F.col("_lo") < F.col("_hi")))
    return settled.unionByName(_at_rank(rows, group, "_v", "_n").select(*group, "_v"))


def _within(counts: DataFrame, keys: Sequence[str], targets: DataFrame) -> DataFrame:
    """The counted rows inside each target's range, with the target's columns."""
    rows = counts.select(*keys, "_v", "_n")
    if keys:
        joined = join_on(rows, targets, keys)
    else:
        # Without groups there are but two targets per quantile.
        fields = targets.schema.fields
        literals = [F.struct(*[F.lit(r[f.name]).cast(f.dataType).alias(f.name) for f in fields]) for r in targets.collect()]
        kind = f"array<{targets.schema.simpleString()}>"
        joined = rows.select("*", F.inline(F.array(*literals).cast(kind)))
    return joined.where(F.col("_v").between(F.col("_lo"), F.col("_hi")))


def _bucket(fanout: int) -> Column:
    """Which of ``fanout`` equal parts of [_lo, _hi] holds _v."""
    def gap(a: str, b: str) -> Column:
        # Subtracted before the cast: large whole numbers next to each other are one double.
        return F.coalesce(F.try_subtract(F.col(a), F.col(b)).cast("double"), F.col(a).cast("double") - F.col(b).cast("double"))

    share = F.try_divide(gap("_v", "_lo"), gap("_hi", "_lo"))
    return F.coalesce(F.least(F.floor(share * fanout), F.lit(fanout - 1)), F.lit(0)).cast("int")


def _bucket_of_rank(counts: DataFrame, keys: Sequence[str], targets: DataFrame, fanout: int) -> DataFrame:
    """The targets with their range narrowed to the bucket that holds the rank.

    Minimum, maximum and counts do not depend on task order, so a recomputed task gives the same buckets.
    """
    group = [*keys, "_rank"]
    totals = (_within(counts, keys, targets).groupBy(*group, "_base", _bucket(fanout).alias("_b"))
              .agg(F.sum("_n").alias("_bn"), F.count(F.lit(1)).alias("_d"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")))
    # At most ``fanout`` rows per group and rank reach the window.
    held = _at_rank(totals, group, "_b", "_bn")
    return held.select(*group, "_lo", "_hi", (F.col("_upto") - F.col("_bn")).alias("_base"), "_d")


def _at_rank(rows: DataFrame, group: Sequence[str], order: str, n: str) -> DataFrame:
    """Of each group the row in which the running count, from ``_base`` on, passes ``_rank``."""
    so_far = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = rows.withColumn("_upto", F.col("_base") + F.sum(n).over(so_far))
    return counted.where((F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col(n)))


def group_quantile(df: DataFrame, keys: Sequence[str], value: str, q: float = 0.65,
                   name: str = "threshold", **options) -> DataFrame:
    """The threshold of each of a few groups."""
    return few_group_quantiles(df, keys, value, {name: q}, **options)


def global_quantile(df: DataFrame, value: str, q: float = 0.65, name: str = "threshold", **options) -> DataFrame:
    return few_group_quantiles(df, [], value, {name: q}, **options)
