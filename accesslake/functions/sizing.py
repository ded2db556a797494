"""Chunk-size rules: bands, parsing, rounding, candidate lists and the keep-or-change decision."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, functions as F

# Fixed values: (file size below, in KB) -> candidate chunk sizes in KB and the cap of the last one.
# The last candidate of a tier is the file size itself, at most the cap.
SIZE_TIERS = (
    (256, (64, 128), 256),
    (1024, (64, 128, 256), 512),
    (4096, (128, 256, 512), 1024),
    (16384, (256, 512, 1024), 2048),
    (None, (512, 1024, 2048, 4096), 8192),
)
SMALLEST_CHUNK_KB = 64
MIN_CHUNK_KB, MAX_CHUNK_KB = 64, 4096
LARGE_FILE_KB = 1024
CLEAR_GAIN = 0.1


def access_band(accesses: Column) -> Column:
    """1 up to ten accesses, 2 up to twenty, else (also for null) 3."""
    return F.when(accesses <= 10, 1).when(accesses <= 20, 2).otherwise(3)


def combination(file_size_kb: Column, band: Column) -> Column:
    return F.concat_ws(" | ", file_size_kb.cast("string"), band.cast("string"))


def parse_chunk_kb(text: Column, default: int | None = None) -> Column:
    """Chunk size in KB named in an entry-info text; ``default`` when there is none."""
    pattern = r"[Cc]hunk[Ss]ize:\s*(\d+)([KMG]?)"
    n = F.regexp_extract(text, pattern, 1).try_cast("bigint")
    unit = F.regexp_extract(text, pattern, 2)
    kb = (F.when(unit == "K", n).when(unit == "M", n * 1024).when(unit == "G", n * 1024 * 1024)
          .otherwise(F.floor(n / 1024)))
    return F.coalesce(kb, F.lit(default).cast("bigint")).cast("bigint")


def parse_block_bytes(text: Column) -> Column:
    """Bytes of a block-size string: ``256K``, ``1M`` or plain bytes."""
    n = F.regexp_extract(text, r"^(\d+)[KM]?$", 1).try_cast("bigint")
    return F.when(text.endswith("K"), n * 1024).when(text.endswith("M"), n * 1024 * 1024).otherwise(n)


def clamp(kb: Column, low: int = MIN_CHUNK_KB, high: int = MAX_CHUNK_KB) -> Column:
    return F.least(F.greatest(kb, F.lit(low)), F.lit(high))


def round_chunk(size: Column, low: int = MIN_CHUNK_KB, high: int = MAX_CHUNK_KB) -> Column:
    """Nearest multiple of 128 KB (halves to even), clamped; values over 10000 are taken as bytes."""
    kb = F.when(size > 10000, size / 1024).otherwise(size)
    return clamp((F.bround(kb / 128) * 128).cast("bigint"), low, high)


def tier_slots(file_size_kb: Column, current_kb: Column) -> list[Column]:
    """The candidate chunk sizes of one file as columns, null where a slot holds none.

    A tier's list ends in the file size, and sizes above that are no candidates, so what remains is
    ascending: ties go to the smaller chunk. The last slot is the current size if the list lacks it.
    """
    def by_tier(values):
        *bounded, last = values
        chosen = F
        for (below, _, _), value in zip(SIZE_TIERS, bounded):
            chosen = chosen.when(file_size_kb < below, value)
        return chosen.otherwise(last)

    longest = max(len(sizes) for _, sizes, _ in SIZE_TIERS)
    fixed = [by_tier([F.lit(sizes[i] if i < len(sizes) else None).cast("double") for _, sizes, _ in SIZE_TIERS])
             for i in range(longest)]
    end = F.least(file_size_kb, by_tier([F.lit(cap) for _, _, cap in SIZE_TIERS])).cast("double")
    listed = [*fixed, end]
    current = current_kb.cast("double")
    missing = reduce(and_, [F.coalesce(c != current, F.lit(True)) for c in listed])
    own = F.when(missing, F.floor(current_kb).cast("double"))
    return [F.when(c <= file_size_kb, c) for c in (*listed, own)]


def tier_candidates(file_size_kb: Column, current_kb: Column) -> Column:
    """The same candidates as an ascending array, empty when none fits."""
    return F.array_sort(F.array_compact(F.array(*tier_slots(file_size_kb, current_kb))))


def decide(file_size_kb: Column, current_kb: Column, best_kb: Column, p_current: Column, p_best: Column) -> Column:
    """The chunk size to use, given the best candidate and the score of the current size.

    ``best_kb`` is null when no candidate fits; ``p_current`` is null when the current size is none.
    Large files only move up and small files only move down, unless the gain is clear.
    """
    large = file_size_kb > LARGE_FILE_KB
    return (F.when(best_kb.isNull(), F.lit(SMALLEST_CHUNK_KB))
            .when(p_current.isNull(), best_kb)
            .when(best_kb == current_kb, current_kb)
            .when(large & (current_kb < best_kb), best_kb)
            .when(~large & (current_kb > best_kb), best_kb)
            .when(p_best > p_current + CLEAR_GAIN, best_kb)
            .otherwise(current_kb)).cast("bigint")
