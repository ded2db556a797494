"""Ratios, rates, units and changes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MIB = 1024 * 1024


def nonzero(c: Column) -> Column:
    """Zero becomes one, so that the value can be a divisor."""
    return F.when(c == 0, 1).otherwise(c)


def rw_ratio_smoothed(reads: Column, writes: Column) -> Column:
    return reads / (writes + 1)


def rw_ratio(reads: Column, writes: Column) -> Column:
    return reads / nonzero(writes)


def avg_access(avg_read: Column, reads: Column, avg_write: Column, writes: Column, accesses: Column) -> Column:
    """Mean size over reads and writes together."""
    return (avg_read * reads + avg_write * writes) / nonzero(accesses)


def max_access(max_read: Column, max_write: Column) -> Column:
    return F.greatest(max_read, max_write)


def read_pct(reads: Column, accesses: Column) -> Column:
    return reads / nonzero(accesses) * 100


def to_mb(size: Column) -> Column:
    return size / MIB


def to_kb(size: Column) -> Column:
    return size / 1024


def io_ratios(file_size: Column, chunk_size: Column, reads: Column, writes: Column, mbps: Column) -> dict[str, Column]:
    """The six derived I/O ratios; a zero divisor gives null, to be imputed later."""
    ops = reads + writes
    chunks = F.try_divide(file_size, chunk_size)
    return {
        "io_per_chunk": F.try_divide(ops, chunks),
        "bytes_per_io": F.try_divide(file_size, ops),
        "throughput_per_chunk": F.try_divide(mbps, chunks),
        "chunk_to_file_ratio": F.try_divide(chunk_size, file_size),
        "io_efficiency": F.try_divide(mbps * MIB, file_size * ops),
        "chunk_efficiency": F.try_divide(mbps, chunk_size),
    }


def calendar(ts: Column) -> dict[str, Column]:
    """Hour of day, and day of week with Monday as 0."""
    return {"hour": F.hour(ts), "day_of_week": F.weekday(ts)}


def seconds_between(start: Column, end: Column) -> Column:
    """Elapsed seconds with their fraction."""
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1_000_000


def throughput_mbps(size: Column, seconds: Column) -> Column:
    """MiB per second; null unless time went by."""
    return F.when(seconds > 0, F.try_divide(size, seconds) / MIB)


def change(before: Column, after: Column) -> Column:
    return after - before


def change_pct(before: Column, after: Column) -> Column:
    """Change in percent of the old value, 0 where there was none."""
    return F.when(before > 0, F.try_divide(after - before, before) * 100).otherwise(0.0)


def speed(megabytes: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, F.try_divide(megabytes, seconds)).otherwise(0.0)


def mean_speed(read_speed: Column, write_speed: Column) -> Column:
    return (read_speed + write_speed) / 2


def result_flag(pct: Column) -> Column:
    return F.when(pct > 0, "Improved").otherwise("Degraded")


def recommend(current: Column, optimal: Column) -> Column:
    return (F.when(current == optimal, "Already optimal")
            .when(current < optimal, "Increase").otherwise("Decrease"))


def human_size(size: Column) -> Column:
    """``x.xx MB``, ``x.xx KB`` or ``n bytes``; halves go to the even digit."""
    return (F.when(size >= MIB, F.format_string("%.2f MB", F.bround(size / MIB, 2)))
            .when(size >= 1024, F.format_string("%.2f KB", F.bround(size / 1024, 2)))
            .otherwise(F.concat(size.cast("string"), F.lit(" bytes"))))
