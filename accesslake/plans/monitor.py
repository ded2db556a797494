"""Exports of the log store."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.measures import rw_ratio_smoothed
from ..functions.paths import dir_depth, extension
from ..operators.clean import fill_zero
from ..operators.profiles import file_profiles


def export_training_data(meta: DataFrame, access: DataFrame, throughput: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Profiles of the window with zeros for gaps and the derived columns, ready to be written."""
    return fill_zero(file_profiles(meta, access, throughput, as_of, days)).withColumns({
        "read_write_ratio": rw_ratio_smoothed(F.col("read_count"), F.col("write_count")),
        "file_extension": extension(F.col("file_path")),
        "dir_depth": dir_depth(F.col("file_path")),
    })
