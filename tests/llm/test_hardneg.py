"""Hard negatives against brute force, and on rows that take no part."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from accesslake.llm import hardneg
from accesslake.llm.hardneg import hard_negatives


def brute(rows, anchor, n_pos, n_neg):
    v = [(i, np.floor(256 * np.asarray(x)).astype(int), c) for i, x, c in rows]
    out = set()
    for a, x, c in v:
        if not anchor(a):
            continue
        scored = sorted(((-int(x @ y), b, d) for b, y, d in v if b != a), key=lambda r: r[:2])
        for p, pid, _ in [r for r in scored if r[2] == c][:n_pos]:
            fits = [(s, b) for s, b, d in scored if d != c and 30 * -p <= 100 * -s <= 90 * -p][:n_neg]
            out |= {(a, pid, k + 1, b, -p, -s) for k, (s, b) in enumerate(fits)}
    return out


@pytest.mark.parametrize("sizes", [(8192, 512, 2048), (16, 7, 13)])
def test_by_brute_force(spark, monkeypatch, sizes):
    for name, size in zip(("ANCHOR_BLOCK", "ANCHORS", "ROWS"), sizes):
        monkeypatch.setattr(hardneg, name, size)
    r = np.random.default_rng(2)
    centres = r.normal(size=(5, 12)) * np.linspace(3, 0.1, 12)
    x = np.round(centres[r.integers(5, size=700)] + r.normal(size=(700, 12)), 1) / 5  # many ties
    x[200:260] = x[3]  # a group of copies
    rows = [(i, v.tolist(), str(c)) for i, (v, c) in enumerate(zip(x, r.choice(3, p=(0.6, 0.3, 0.1), size=700)))]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").repartition(3)
    got = hard_negatives(table, F.col("vec_id") % 10 == 0, F.col("label"), 4, 6).collect()
    wanted = brute(rows, lambda a: a % 10 == 0, 4, 6)
    assert len(wanted) > 1000 and len(got) == len(wanted) and {tuple(g) for g in got} == wanted


def test_bounds_leave_out_nothing():
    """Pairs at or above a threshold, whatever the share of indexed dimensions."""
    import pandas as pd

    r = np.random.default_rng(5)
    x = np.floor(r.normal(size=(300, 16)) * np.linspace(60, 1, 16))
    block = hardneg._Anchors(pd.DataFrame({"vec_id": range(40), "label": "a", "v": list(x[:40])}))
    scores = block.x @ x[:, block.order].T
    for share in (0, 10, 50, 90, 99.9, 100):
        limit = np.percentile(scores, share, axis=1)
        a, n, s = hardneg._matches(block, np.arange(40), x[:, block.order], limit)
        assert sorted(zip(a, n)) == sorted(zip(*np.nonzero(scores >= limit[:, None]))) and (s == scores[a, n]).all()


def test_rows_that_take_no_part(spark):
    nan, kinds = float("nan"), "vec_id long, embedding array<double>, label int, rank int, anchor_id long, x binary"
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.5, 0.1], 2), (2, [0.5, 0.1], 2), (3, [0.5, 0.1], None),
            (4, None, 2), (5, [nan, 0.0], 2), (6, [None, 0.5], 2), (7, [float("inf"), 0.5], 2), (8, [], 2), (9, [0.5], 2),
            (None, [0.5, 0.1], 2), (11, [0.5, -0.1], 3), (12, [-1.0, 0.0], 1), (20, [0.0, 1.0], 2), (0, [1.0, 0.0], 1)]
    table = spark.createDataFrame([(*r, 7, 8, b"") for r in rows], kinds)
    got = {tuple(r) for r in hard_negatives(table, F.col("vec_id") % 10 == 0, F.col("label")).collect()}
    # repeated rows are rows each; the window of the score 0 holds the scores 0; that below it holds nothing
    assert got == {(0, 1, 1, 2, 65536, 32768), (0, 1, 2, 2, 65536, 32768), (0, 1, 3, 11, 65536, 32768)}
    empty = table.filter("false")
    assert hard_negatives(empty, F.col("vec_id") % 10 == 0, F.col("label")).count() == 0
    assert hard_negatives(table, F.lit(False), F.col("label")).count() == 0
