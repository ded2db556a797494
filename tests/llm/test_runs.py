"""Runs of words against brute force: every run, the greatest exponent, and the digests."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from accesslake.llm import queries, runs

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, least, times):
    """All maximal stretches of a period, those of a smaller period that divides it left out."""
    n, found = len(words), set()
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i >= q and not any(s == i and k == j - i + q and q % p == 0 for s, k, p in found):
                found.add((i, j - i + q, q))
            i = max(i + 1, j)
    return sorted((r for r in found if r[1] >= max(least, times * r[2])), key=lambda r: (r[0], r[2]))


def described(text):
    words = WORDS.findall(text or "")
    found = brute(words, 6, 4)
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    gone = {i for s, k, q in found for i in range(s + q, s + k)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join("%d,%d,%d\n" % r for r in found)), sha(kept))


def test_all_runs_of_two_periods():
    rnd = random.Random(0)
    for _ in range(2000):
        k = rnd.choice((1, 2, 3))
        letters = [rnd.randrange(k) for _ in range(rnd.randint(0, 40))]
        assert sorted(map(tuple, runs.runs_of(letters).tolist())) == sorted(brute(letters, 2, 2))


def test_common_extensions():
    rnd = random.Random(1)
    for size in (5, 60, 700):
        letters = [rnd.randrange(2) for _ in range(size)]
        tree = runs.SuffixTree(letters)
        pairs = [(i, j) for i in range(size + 1) for j in range(size + 1) if i != j]
        pairs = rnd.sample(pairs, min(3000, len(pairs)))
        import numpy as np

        got = tree.extension(*map(np.array, zip(*pairs)))
        for (i, j), k in zip(pairs, got):
            n = 0
            while max(i, j) + n < size and letters[i + n] == letters[j + n]:
                n += 1
            assert n == k
        suffixes = sorted(range(size + 1), key=lambda i: letters[i:])
        assert tree.rank[suffixes].tolist() == list(range(size + 1))
        suffixes = sorted(range(size + 1), key=lambda i: [-x for x in letters[i:]])
        assert tree.back_rank[suffixes].tolist() == list(range(size + 1))


def test_stretches_lose_no_run():
    rnd = random.Random(2)
    seen = 0
    for _ in range(1500):
        words = []
        for _ in range(rnd.randint(1, 5)):
            root = [b"%d" % rnd.randrange(rnd.choice((2, 5, 50))) for _ in range(rnd.randint(1, 9))]
            words += root * rnd.randint(1, 7) + root[:rnd.randint(0, len(root))]
        wanted = brute(words, 6, 4)
        seen += len(wanted)
        assert runs.find_runs(words) == wanted
    assert seen > 1000


def test_documents_and_edges(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdeéß　\x1c\x85") for _ in range(rnd.randint(1, 4)))
    texts = [None, "", " \n\t ", "a", "a a a a a a", "a  a\na\ta a\x0ba\x0ca", "x " * 5, "A a a a a a a"]
    for _ in range(60):
        text = [word() for _ in range(rnd.randint(0, 60))]
        root = [word() for _ in range(rnd.randint(1, 5))]
        text[rnd.randint(0, len(text)):0] = root * rnd.randint(3, 9)
        texts.append(rnd.choice((" ", "\n", "  ")).join(text + root * rnd.randint(0, 5)))
    rows = [(i, t, "s", 1) for i, t in enumerate(texts + texts[3:5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rank string, period_ int")
    got = runs.periodic_runs(docs, collapsed="left").collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) == described(r.text)
        assert hashlib.sha256(r.left.encode()).hexdigest() == r.collapsed_sha256 and r.rank == "s"
    assert runs.periodic_runs(docs.filter("false")).count() == 0
    with pytest.raises(ValueError):
        runs.periodic_runs(docs.withColumn("period", F.lit(1)))
    with pytest.raises(ValueError):
        runs.periodic_runs(docs, times=2)


def test_long_text(spark):
    long = " ".join(f"w{i % 4999}" for i in range(60_000))
    row = runs.periodic_runs(spark.createDataFrame([(1, long), (None, long)], "doc_id long, text string")).collect()
    assert [(r.n_runs, r.start, r.length, r.period, r.exponent_milli) for r in row] == [(1, 0, 60_000, 4999, 12002)] * 2


def test_query_on_its_documents(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(None, "b b b b b b b"), (1_000_010, None), (1_000_011, "")], docs.schema))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_periodic_runs(spark, str(tmp_path)).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    changed = 0
    for r in got:
        words = WORDS.findall(texts[r.doc_id] or "")
        h = zlib.crc32(str(r.doc_id).encode()) if r.doc_id is not None else 1
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            changed += 1
        assert tuple(r)[1:] == described(" ".join(words))
    assert len(got) == docs.count() and changed > 10
