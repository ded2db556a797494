"""Schemas of every table and file the package reads; nothing is inferred."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType, DoubleType, IntegerType, LongType, MapType, StringType, StructField, StructType, TimestampType,
)


def _struct(**columns) -> StructType:
    return StructType([StructField(name, kind) for name, kind in columns.items()])


_S, _L, _D, _I, _T = StringType(), LongType(), DoubleType(), IntegerType(), TimestampType()

FILE_METADATA = _struct(file_path=_S, file_size=_L, chunk_size=_L, first_seen=_T, last_seen=_T)

FILE_ACCESS = _struct(id=_L, file_path=_S, access_type=_S, access_time=_T, read_size=_L, write_size=_L)

THROUGHPUT = _struct(
    file_path=_S, start_time=_T, end_time=_T, bytes_transferred=_L, operation_type=_S, throughput_mbps=_D)

OPTIMIZATION_HISTORY = _struct(id=_L, file_path=_S, old_chunk_size=_L, new_chunk_size=_L, optimization_time=_T)

ACCESS_EVENT = _struct(
    file_path=_S, file_size=_L, chunk_size=_L, access_type=_S, access_time=_T, read_size=_L, write_size=_L)

# A file-system notification before it becomes an access event.
NOTIFICATION = _struct(kind=_S, is_directory=_I, file_path=_S, file_size=_L, entry_info=_S, seen_at=_T)

# Sizes in bytes, throughput in MB/s.
ACCESS_LOG_V1 = _struct(
    file_path=_S, file_size=_L, chunk_size=_L, access_count=_L, avg_read_size=_D, avg_write_size=_D,
    max_read_size=_L, max_write_size=_L, read_count=_L, write_count=_L, throughput_mbps=_D)

# Sizes in KB, throughput in KB/s.
BENCH_LOG_V2 = _struct(
    file_path=_S, file_size_KB=_L, chunk_size_KB=_L, access_count=_L, avg_read_KB=_D, avg_write_KB=_D,
    max_read_KB=_L, max_write_KB=_L, read_ops=_L, write_ops=_L, throughput_KBps=_D, error_message=_S)

BENCH_REQUIRED = ("file_path", "file_size_KB", "chunk_size_KB", "throughput_KBps")

MODEL_INFO = StructType([
    StructField("features", ArrayType(_S)),
    StructField("thresholds", MapType(_S, _D)),
    StructField("trained_at", _T),
    StructField("metrics", MapType(_S, _D)),
])
