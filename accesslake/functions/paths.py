"""Facts read out of a file path."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The extensions that get a 0/1 column of their own.
COMMON_EXTENSIONS = (".txt", ".csv", ".log", ".dat", ".bin", ".json", ".xml", ".db")


def extension(path: Column) -> Column:
    """Lower-case suffix from the last dot of the base name; a dotfile has none."""
    return F.lower(F.regexp_extract(path, r"[^/]*[^/.][^/]*(\.[^./]*)$", 1))


def first_dot_ext(path: Column) -> Column:
    """Lower-case rest of the path from its first dot, or the whole path when it has none.

    This is the looser rule of the file filter: ``/a/x.tar.gz`` gives ``.tar.gz``.
    """
    return F.lower(F.substr(path, F.greatest(F.instr(path, ".") , F.lit(1))))


def dir_depth(path: Column) -> Column:
    """Number of parts between slashes; a leading slash counts as an empty first part."""
    return F.size(F.split(path, "/"))


def path_chunk_hint(path: Column) -> Column:
    """Bytes named by a ``testdir_<n>K`` folder, else 0."""
    kb = F.regexp_extract(path, r"testdir_(\d+)K", 1).try_cast("bigint")
    return F.coalesce(kb * 1024, F.lit(0).cast("bigint"))


def extension_flags(ext: Column, known=COMMON_EXTENSIONS) -> dict[str, Column]:
    """0/1 columns ``ext_<.suffix>`` plus ``ext_other`` for any other non-empty suffix."""
    flags = {f"ext_{name}": F.when(ext == name, 1).otherwise(0) for name in known}
    flags["ext_other"] = F.when((ext != "") & ~ext.isin(*known), 1).otherwise(0)
    return flags
