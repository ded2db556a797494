import os

import pytest
from pyspark.sql import functions as F

from accesslake.functions import measures, paths, sizing


def values(spark, column, rows, kind):
    """The column of (x) for each row, in order."""
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r[1] for r in df.select("i", column(F.col("x"))).orderBy("i").collect()]


def test_extension_is_that_of_the_base_name(spark):
    odd = ["/a/b.TXT", "/a.b/c", "/a/.bashrc", "/a/..x", "/a/..a.b", "noslash.log", "/a/x.", "/a/x.tar.gz", "", "/a/b/.c.d"]
    assert values(spark, paths.extension, odd, "string") == [os.path.splitext(p)[1].lower() for p in odd]


def test_first_dot_extension(spark):
    assert values(spark, paths.first_dot_ext, ["/a/x.tar.GZ", "/a.b/c.txt"], "string") == [".tar.gz", ".b/c.txt"]


def test_path_hint(spark):
    assert values(spark, paths.path_chunk_hint, ["/m/testdir_64K/f", "/m/f", "/testdir_K/f"], "string") == [65536, 0, 0]


def test_human_size(spark):
    sizes = [0, 1023, 1024, 1152, 1408, 1048575, 1048576, 5 * 1048576 + 12345]
    want = [f"{v / 1048576:.2f} MB" if v >= 1048576 else f"{v / 1024:.2f} KB" if v >= 1024 else f"{v} bytes" for v in sizes]
    assert values(spark, measures.human_size, sizes, "bigint") == want


def test_parse_chunk(spark):
    texts = ["Chunksize: 512K", "x chunkSize:2M", "ChunkSize: 1G", "chunksize: 2047", "none", None, "Chunksize: 4K Chunksize: 9K"]
    assert values(spark, lambda c: sizing.parse_chunk_kb(c, 512), texts, "string") == [512, 2048, 1048576, 1, 512, 512, 4]


def test_block_bytes(spark):
    assert values(spark, sizing.parse_block_bytes, ["256K", "1M", "4096", "bad"], "string") == [262144, 1048576, 4096, None]


def test_round_chunk_halves_to_even(spark):
    # 192 / 128 is 1.5 and goes to 2; 320 / 128 is 2.5 and goes to 2.
    assert values(spark, sizing.round_chunk, [192.0, 320.0, 1.0, 9000.0, 1048576.0], "double") == [256, 256, 64, 4096, 1024]


def test_ratios_of_zero_are_null(spark):
    df = spark.createDataFrame([(0, 0, 0, 0, 0.0)], "f bigint, c bigint, r bigint, w bigint, m double")
    ratios = measures.io_ratios(*[F.col(c) for c in "fcrwm"])
    assert list(df.select(*ratios.values()).first()) == [None] * 6


def test_access_band_of_null(spark):
    assert values(spark, sizing.access_band, [10, 11, 20, 21, None], "int") == [1, 2, 2, 3, 3]


def tiers(size, current):
    """The candidate rule written out for one file."""
    for below, sizes, cap in sizing.SIZE_TIERS:
        if below is None or size < below:
            chunks = [*sizes, min(size, cap)]
            break
    if current not in chunks:
        chunks = sorted([*chunks, int(current)])
    return [c for c in chunks if c <= size]


def decision(size, current, score):
    chunks = tiers(size, current)
    if not chunks:
        return 64
    ps = [score(c) for c in chunks]
    best = chunks[ps.index(max(ps))]
    if current not in chunks:
        return int(best)
    p = ps[chunks.index(current)]
    if best == current or not (
            (size > 1024 and current < best) or (size <= 1024 and current > best) or max(ps) > p + 0.1):
        return int(current)
    return int(best)


FILES = [(s, c) for s in (10, 63, 64, 100, 128, 200, 256, 300, 512, 1000, 1024, 1025, 2000, 4096, 9000, 16384, 50000)
         for c in (0.5, 10, 64, 64.5, 128, 200, 256, 512, 1024, 4096, 8192)]


def test_candidates_equal_the_written_out_rule(spark):
    df = spark.createDataFrame([(float(s), float(c)) for s, c in FILES], "s double, c double")
    for r in df.select("*", sizing.tier_candidates(F.col("s"), F.col("c")).alias("found")).collect():
        assert r["found"] == tiers(r["s"], r["c"]), (r["s"], r["c"])


@pytest.mark.parametrize("peak", [64, 300, 1024, 6000])
def test_decisions_equal_the_written_out_rule(spark, peak):
    from accesslake.operators.candidates import decide_inline
    df = spark.createDataFrame([(float(s), float(c)) for s, c in FILES], "file_size_kb double, chunk_size_kb double")
    # Rounded to one digit, so that ties occur.
    done = decide_inline(df, lambda c: F.round(1 / (1 + F.abs(c - peak) / 512), 1))
    for r in done.collect():
        want = decision(r["file_size_kb"], r["chunk_size_kb"], lambda c: round(1 / (1 + abs(c - peak) / 512) + 1e-12, 1))
        assert r["optimal_chunk"] == want, r


def test_change_of_nothing_is_zero(spark):
    df = spark.createDataFrame([(0.0, 5.0), (2.0, 3.0)], "b double, a double")
    assert [r[0] for r in df.select(measures.change_pct(F.col("b"), F.col("a"))).collect()] == [0.0, 50.0]
