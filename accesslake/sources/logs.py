"""CSV logs, stored tables, directory listings and text reports."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from .. import schemas
from ..operators.common import cutoff, period_column, period_of
from ..operators.profiles import apply_retention
from ..session import materialise
from .versions import Folder, current_path, replace


def _header(spark: SparkSession, path: str) -> list[str]:
    """Column names of the CSV's first line."""
    return spark.read.option("header", True).csv(path).columns


def _read_csv(spark: SparkSession, path: str, schema: StructType, required: Sequence[str]) -> DataFrame:
    names = _header(spark, path)
    missing = [c for c in required if c not in names]
    if missing:
        raise ValueError(f"{path} lacks the columns {missing}")
    # The file's own column order, the schema's types; columns of no interest are read as text. A file of the folder whose header
    # differs is an error.
    kinds = {f.name: f for f in schema.fields}
    ordered = reduce(lambda s, n: s.add(kinds[n]) if n in kinds else s.add(n, "string"), names, StructType())
    df = spark.read.option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).schema(ordered).csv(path)
    return df.select(*[f.name for f in schema.fields if f.name in names])


def read_access_log(spark: SparkSession, path: str) -> DataFrame:
    """The v1 log. The name must end in ``.csv``, every column must be there and no value be missing."""
    if not path.endswith(".csv"):
        raise ValueError(f"{path} is not a CSV file")
    df = _read_csv(spark, path, schemas.ACCESS_LOG_V1, schemas.ACCESS_LOG_V1.names)
    missing = reduce(or_, [F.col(c).isNull() for c in df.columns])
    if not df.where(missing).limit(1).isEmpty():
        raise ValueError(f"{path} has missing values")
    return df


def read_bench_log(spark: SparkSession, path: str) -> DataFrame:
    """The v2 log; only path, sizes and throughput are required."""
    return _read_csv(spark, path, schemas.BENCH_LOG_V2, schemas.BENCH_REQUIRED)


#: Tables that are stored by day or month, with the time that says which.
BY_TIME = {"file_access": "access_time", "throughput_metrics": "start_time"}
KINDS = {"file_metadata": schemas.FILE_METADATA, "file_access": schemas.FILE_ACCESS,
         "throughput_metrics": schemas.THROUGHPUT, "optimization_history": schemas.OPTIMIZATION_HISTORY}


def load_tables(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    """The log store's Parquet tables below ``base``.

    Accesses and transfers come with the day and the month they are stored by (``access_date``, ``start_month``, in UTC): ``lookback``,
    profiles and retention use them to open the files in question only.
    """
    found = {}
    for name, kind in KINDS.items():
        rows = spark.read.schema(kind).parquet(current_path(spark, f"{base}/{name}"))
        period = period_column(BY_TIME.get(name, ""))
        found[name] = rows.select(*kind.names, *[c for c in rows.columns if c == period])
    return found


def save_tables(tables: dict[str, DataFrame], base: str) -> None:
    """Write the log store, accesses by day and transfers by month.

    Rows are gathered by that before, in parts of a size: a busy day is several files, and quiet days don't leave one file for each task.
    """
    for name, df in tables.items():
        if name in BY_TIME:
            ts = BY_TIME[name]
            period = period_column(ts)
            stored = df.withColumn(period, period_of(ts, F.col(ts), df.schema[ts].dataType)).hint("rebalance", period)
            stored.write.partitionBy(period).parquet(f"{base}/{name}")
        else:
            replace(df, f"{base}/{name}")


def retain(spark: SparkSession, base: str, days: int, as_of: str) -> DataFrame:
    """Delete what is older than ``days`` from the log store; (table_name, deleted) comes back, as stored counts.

    Whole days and months go as folders, the one of the cut-off is rewritten by an overwrite of that partition alone, and file metadata
    without accesses left goes with a new version of its table. Accesses are scanned once, for the counts and for the files they leave. A run
    that was stopped is completed by running it again; what it had deleted before is not counted again.
    """
    tables = load_tables(spark, base)
    done = apply_retention(tables["file_access"], tables["throughput_metrics"], tables["file_metadata"], days, as_of)
    deleted = materialise(done["deleted"], "deleted")
    replace(done["file_metadata"], f"{base}/file_metadata")
    for name, ts in BY_TIME.items():
        _drop_before(tables[name], f"{base}/{name}", ts, cutoff(tables[name], ts, days, as_of))
    return deleted


def _drop_before(rows: DataFrame, path: str, ts: str, bound: Column) -> None:
    """Delete the rows of a table stored by time whose ``ts`` lies before ``bound``."""
    spark, period = rows.sparkSession, period_column(ts)
    border = str(spark.range(1).select(period_of(ts, bound, rows.schema[ts].dataType)).first()[0])
    folder = Folder(spark, path)
    stored = sorted(n.partition("=")[2] for n in folder.names() if n.startswith(f"{period}="))
    if border in stored:
        inside = rows.where(F.col(period) == F.lit(border).cast("date"))
        left = inside.where(F.col(ts) >= bound)
        if left.isEmpty():
            folder.delete(f"{period}={border}")
        elif not inside.where(F.col(ts) < bound).isEmpty():
            left.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(period).parquet(path)
    for date in stored:
        if date[:1].isdigit() and date < border:  # rows without a time have a folder of another name, and stay
            folder.delete(f"{period}={date}")


def scan_files(spark: SparkSession, directory: str, recursive: bool = False, suffixes: Sequence[str] = (),
               min_size: int | None = None, max_size: int | None = None) -> DataFrame:
    """(path, length, kept) of a directory's files; contents are never read.

    A file is kept when its name ends in one of the suffixes (if any are given) and its size lies
    within the bounds (0 or None is no bound).
    """
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(directory)
             .select("path", "length"))
    kept = F.lit(True)
    if suffixes:
        kept = kept & reduce(or_, [F.col("path").endswith(s) for s in suffixes])
    if min_size:
        kept = kept & (F.col("length") >= min_size)
    if max_size:
        kept = kept & (F.col("length") <= max_size)
    return files.withColumn("kept", kept)


def scan_counts(scanned: DataFrame) -> DataFrame:
    return scanned.agg(F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("skipped"))


# The rule that ends a report block.
REPORT_RULE = "-" * 60


def read_trial_report(spark: SparkSession, path: str) -> DataFrame:
    """One row per block of a benchmark report; figures that are absent or "N/A" are null."""
    blocks = (spark.read.option("lineSep", REPORT_RULE + "\n").text(path)
              .where(F.col("value").contains("Test Combination:")))

    def text(pattern):
        return F.regexp_extract("value", pattern, 1)

    def number(pattern, kind="double"):
        return text(pattern).try_cast(kind)

    def bandwidth(name):
        found = F.trim(text(rf"FIO {name}\s*: Bandwidth = ([^\n]*)"))
        return F.nullif(F.nullif(found, F.lit("N/A")), F.lit(""))

    return blocks.select(
        number(r"File Size\s*= (\d+) MB", "bigint").alias("file_size_mb"),
        number(r"Chunk Size\s*= (\d+) KB", "bigint").alias("chunk_size_kb"),
        text(r"Block Size\s*= (\S+)").alias("block_size"),
        number(r"DD Write\s*: Time = ([\d.]+) sec").alias("dd_write_seconds"),
        number(r"DD Write\s*: Time = [\d.]* sec, Throughput = ([\d.]+)").alias("dd_write_mbps"),
        number(r"DD Read\s*: Time = ([\d.]+) sec").alias("dd_read_seconds"),
        number(r"DD Read\s*: Time = [\d.]* sec, Throughput = ([\d.]+)").alias("dd_read_mbps"),
        bandwidth("Write").alias("fio_write_bandwidth"), bandwidth("Read").alias("fio_read_bandwidth"))
