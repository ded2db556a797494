"""Small helpers shared by the operators."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DataType, TimestampNTZType


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on key columns where null equals null; the right side's keys are dropped.

    Unlike a plain equi-join this keeps the rows of a null group together.
    """
    renamed = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    match = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return left.join(renamed, match, how).drop(*[f"__{k}" for k in keys])


def spread(df: DataFrame, rows: int | None = None, most: int = 1_000_000) -> DataFrame:
    """``df`` dealt out evenly for work that costs much more than a shuffle: as many parts as the cluster has cores or, told the
    number of ``rows``, as many as hold ``most`` each.

    A file is read by as many tasks as it has row groups, however many cores there are and however long each row takes.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, math.ceil((rows or 0) / most)))


def melt(df: DataFrame, columns: Sequence[str], name: str = "column_name", value: str = "value",
         keep: Sequence[str] = ()) -> DataFrame:
    """Long form: one row per input row and listed column, values as double."""
    typed = df.select(*keep, *[F.col(c).cast("double").alias(c) for c in columns])
    return typed.unpivot(list(keep), list(columns), name, value)


def with_row(df: DataFrame, row: DataFrame, name: str = "_m") -> DataFrame:
    """Adds the single row of an ungrouped aggregate as a struct column, through a scalar subquery."""
    return df.withColumn(name, row.select(F.struct(*row.columns)).scalar())


#: Time columns of stored tables that are partitioned by their time in UTC: the column of the day, or of the first day of the month.
PERIODS = {"access_time": ("access_date", "day"), "start_time": ("start_month", "month")}


def period_column(ts: str) -> str | None:
    return PERIODS[ts][0] if ts in PERIODS else None


def period_of(ts: str, at: Column, kind: DataType) -> Column:
    """The period of a time of type ``kind`` in the column ``ts``, the same whatever the session's time zone."""
    day = at.cast("date") if isinstance(kind, TimestampNTZType) else F.date_from_unix_date(
        F.floor(F.unix_micros(at) / F.lit(86_400_000_000)).cast("int"))
    return F.trunc(day, "month") if PERIODS[ts][1] == "month" else day


def lookback(df: DataFrame, ts: str, days: int, as_of: str) -> DataFrame:
    """Rows with ``ts`` strictly after ``as_of`` minus ``days``; of a table stored by day or month, no other's files are opened."""
    return df.where(after(df, ts, cutoff(df, ts, days, as_of)))


def after(df: DataFrame, ts: str, bound: Column) -> Column:
    """``ts`` lies strictly after the foldable ``bound``, with what that says about the table's partitions, if it has one."""
    in_time = F.col(ts) > bound
    period = period_column(ts)
    return (F.col(period) >= period_of(ts, bound, df.schema[ts].dataType)) & in_time if period in df.columns else in_time


def before(df: DataFrame, ts: str, bound: Column) -> Column:
    """``ts`` lies strictly before the foldable ``bound``, with what that says about the table's partitions, if it has one."""
    period = period_column(ts)
    in_time = F.col(ts) < bound
    return (F.col(period) <= period_of(ts, bound, df.schema[ts].dataType)) & in_time if period in df.columns else in_time


def not_before(df: DataFrame, ts: str, bound: Column) -> Column:
    """The opposite of ``before``: at the bound, after it, or without a time."""
    period = period_column(ts)
    in_time = F.col(ts).isNull() | (F.col(ts) >= bound)
    if period not in df.columns:
        return in_time
    return (F.col(period).isNull() | (F.col(period) >= period_of(ts, bound, df.schema[ts].dataType))) & in_time


def cutoff(df: DataFrame, ts: str, days: int, as_of: str) -> Column:
    """A foldable timestamp of the column's own type, so the comparison reaches the scan."""
    return F.lit(as_of).cast(df.schema[ts].dataType) - F.make_dt_interval(F.lit(days))
