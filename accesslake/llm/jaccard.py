"""Near-duplicate documents: an exact Jaccard join of word shingle sets, with different methods for light and heavy sets.

Sets of a and b shingles link when they share at least c(a, b) = ceil(P (a + b) / (100 + P)) of them, P the percentage.

* **Light sets** enumerate their subsets of c shingles for every c that a light partner can ask for. Sets with a common subset of c
  link exactly if a + b <= (100 + P) c / P, so each need only be tied to the smallest set with that subset: a line for each
  member, never all pairs. Up to which size sets are light follows from the cost of either way, estimated from the table of sizes.
* **Heavy sets** scan inverted lists. Sorted by any one order, sets that link share one of their first p(n) = n - ceil(P n / 100) + 1
  shingles, and k + 1 of their first p(n) + k. A first pass by hash order drops every set that shares too few of these with anyone.
  A second one orders the shingles of the rest by their frequency, rarest first, so that passages that many texts have come last
  and their lists stay short. In lists of up to LIST sets all pairs are candidates; in longer ones, members are first compared with
  the list's most typical set and then, in blocks, those that are still apart with all others.

Candidates are counted exactly, on 64-bit hashes of shingles: two of a pair's shingles collide with a probability of about
n² / 2^65, and a collision changes one count by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from accesslake.session import Scratch
from .common import components, give_back
from .shingles import set_digest, shingle_sets

#: Lists of up to so many sets compare all pairs, longer ones go by blocks; decides cost alone.
LIST = 32
#: Sets in a block of a longer list.
BLOCK = 512
#: Share of a set by which prefixes are longer in the first pass, so that sharing a single passage is not enough; cost alone.
EXTRA = 0.06
#: Sets are never light beyond this size; the number of subsets is exponential.
MOST_LIGHT = 16
#: Ids are broadcast up to this number (8 bytes each); beyond it they are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Characters whose shingles are made at once.
CHARS = 1_000_000

#: Columns of links between two documents.
_PAIR = "a long, b long"


def needed(a: int, b: int, percent: int) -> int:
    """Shared shingles that sets of these sizes need to link."""
    return -(-percent * (a + b) // (100 + percent))


def prefix(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _subset_sizes(n: int, light: int, percent: int) -> list[int]:
    """The subset sizes that light partners of a set of n ask for."""
    low, high = -(-percent * n // 100), min(light, 100 * n // percent)
    return sorted({needed(n, b, percent) for b in range(low, high + 1) if b > 0})


def _checked(ids: DataFrame, n: int) -> DataFrame:
    return F.broadcast(ids) if n <= BROADCAST_IDS else ids


def _batches(batch: pd.DataFrame, text: str) -> Iterator[pd.DataFrame]:
    sizes = batch[text].map(lambda t: len(t) if isinstance(t, str) else 0).to_numpy()
    for _, part in batch.groupby(np.cumsum(sizes) // CHARS, sort=False):
        yield part


def _sets(docs: DataFrame, width: int, percent: int, whole: bool) -> DataFrame:
    """(doc_id, n, digest, h): h is the whole sorted set, or the first hashes that the first pass needs."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in _batches(batch, "text"):
                sets = shingle_sets([t if isinstance(t, str) else None for t in part["text"]], width)
                n = np.array([len(s) for s in sets])
                # sets that may turn out light are kept whole, they are small
                cut = n if whole else [k if k <= MOST_LIGHT else prefix(k, percent) + ceil(EXTRA * k) for k in n.tolist()]
                yield pd.DataFrame({
                    "doc_id": part["doc_id"], "n": n, "digest": [set_digest(s) if len(s) else None for s in sets],
                    "h": [s[:k].view(np.int64) for s, k in zip(sets, cut)]})
        give_back()

    return docs.mapInPandas(run, "doc_id long, n int, digest binary, h array<long>")


def _boundary(sizes: DataFrame, percent: int) -> int:
    """The largest size up to which subsets of all sets cost less than inverted lists.

    ``sizes`` (n, sets) is counted over all sets; only sizes up to MOST_LIGHT are read. A subset costs a row; a list entry costs a
    row and the comparison of n shingles for the sets, on average, that have the same size.
    """
    count = {r.n: r.sets for r in sizes.filter(F.col("n") <= MOST_LIGHT).collect()}
    best, saved, light = 0, 0, 0
    for n in range(1, MOST_LIGHT + 1):
        rows = sum(comb(n, c) for c in _subset_sizes(n, n, percent))
        saved += count.get(n, 0) * (prefix(n, percent) * (1 + n) - rows)
        if saved > best:
            best, light = saved, n
    return max(light, 4)


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``.

    A document's set holds the distinct shingles of ``width`` words; with fewer words, the whole sequence is one; without words or
    text it is empty and links with nothing. Words are runs of characters other than space and \\t to \\r, A-Z in lower case.
    Documents link when 100 * intersection >= percent * union; ``component_id`` is the smallest id that links reach, the document's
    own included. Equal sets are joined once. Rows with one id are one document: they share a component. Rows with a null id link
    with nothing and have a null component. Empty tables give no rows; columns other than the two named are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sets = scratch.keep(_sets(source, width, percent, whole=False), "sets")
    known = sets.filter("n > 0 AND doc_id IS NOT NULL")
    # stored, so that a set that very many documents have can be split in the join
    same = scratch.keep(known.groupBy("digest").agg(F.min("doc_id").alias("rep")), "same")
    copies = scratch.keep(known.select("doc_id", "digest").join(same, "digest").filter("doc_id != rep")
                          .select("doc_id", "rep").distinct(), "copies")
    light = _boundary(known.groupBy("n").agg(F.count("*").alias("sets")), percent)
    # ids that only repeat another one's set; an id with several texts is kept whole
    spare = copies.join(known.groupBy("doc_id").agg(F.countDistinct("digest").alias("texts")).filter("texts > 1"), "doc_id", "left_anti")
    spare = scratch.keep(spare.select("doc_id").distinct(), "spare")
    reps = known.join(_checked(spare, spare.count()), "doc_id", "left_anti")

    edges = scratch.keep(_light_edges(reps.filter(F.col("n") <= light), light, percent).union(
        _heavy_edges(scratch, source, reps, spare, light, width, percent)).union(
        copies.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))).distinct(), "edges")
    roots = components(edges)
    counted = scratch.keep(sets.select("doc_id", "n"), "counted")
    scratch.release("sets")
    return counted.join(roots, F.col("doc_id") == F.col("node"), "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _light_edges(reps: DataFrame, light: int, percent: int) -> DataFrame:
    """Links between light sets, one for each set and common subset."""
    def subsets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for s in range(0, len(batch), 500):
                rows = []
                for doc_id, n, h in batch.iloc[s:s + 500][["doc_id", "n", "h"]].itertuples(index=False):
                    rows += [(doc_id, n, c, set_digest(np.array(x))) for c in _subset_sizes(n, light, percent) for x in combinations(h, c)]
                yield pd.DataFrame(rows, columns=["doc_id", "n", "c", "key"])

    keys = reps.select("doc_id", "n", "h").mapInPandas(subsets, "doc_id long, n int, c int, key binary")
    least = keys.groupBy("key", "c").agg(F.min(F.struct("n", "doc_id")).alias("first"), F.max("doc_id").alias("last")).filter(
        F.col("first.doc_id") != F.col("last"))
    return (keys.join(least, ["key", "c"]).filter(
        (F.col("doc_id") != F.col("first.doc_id")) & (percent * (F.col("n") + F.col("first.n")) <= (100 + percent) * F.col("c")))
        .select(F.col("doc_id").alias("a"), F.col("first.doc_id").alias("b")).distinct())


def _prefix(n: Column, percent: int) -> Column:
    return n - F.ceil(n * percent / F.lit(100)).cast("int") + 1


def _linked(percent: int) -> Column:
    """Whether the sets xa and xb of na and nb shingles link."""
    return (100 + percent) * F.size(F.array_intersect("xa", "xb")) >= percent * (F.size("xa") + F.size("xb"))


def _reaches(shared: np.ndarray, total: np.ndarray, percent: int) -> np.ndarray:
    """The same for counts of shared shingles, which may be floats, and sums of sizes: compared as integers."""
    return (100 + percent) * shared.astype(np.int64) >= percent * total


def _heavy_edges(scratch: Scratch, source: DataFrame, reps: DataFrame, spare: DataFrame, light: int, width: int,
                 percent: int) -> DataFrame:
    """Links of pairs with a heavy set in them."""
    smallest = -(-percent * (light + 1) // 100)
    # first pass, in hash order: who shares enough of the prefix with anyone
    length = F.least(F.col("n"), _prefix(F.col("n"), percent) + F.ceil(F.col("n") * EXTRA).cast("int"))
    first = reps.filter(F.col("n") >= smallest).select("doc_id", "n", F.explode(F.slice("h", 1, length)).alias("h"))
    common = scratch.keep(first.groupBy("h").agg(F.count("*").alias("sets")).filter("sets > 1").select("h"), "common")
    asked = length - _prefix(F.col("n"), percent) + 1
    alive = scratch.keep(first.join(common, "h").groupBy("doc_id", "n").agg(F.count("*").alias("shared"))
                         .filter(F.col("shared") >= asked).select("doc_id").distinct(), "alive")
    whole = scratch.keep(_sets(
        source.join(_checked(alive, alive.count()), "doc_id", "left_semi"), width, percent, whole=True)
        .filter(F.col("n") >= smallest).dropDuplicates(["doc_id", "digest"])
        .select("doc_id", F.xxhash64("digest").alias("set_id"), "n", "h"), "whole")

    # second pass: rarest shingles first
    rows = whole.select("doc_id", "set_id", F.explode("h").alias("h"))
    often = scratch.keep(rows.groupBy("h").agg(F.count("*").cast("int").alias("df")).filter("df > 1"), "often")
    shared = scratch.keep(rows.join(often, "h").groupBy("doc_id", "set_id").agg(
        F.sort_array(F.collect_list(F.struct("df", "h"))).alias("order")), "shared")
    left = F.col("n") - F.size("order")  # shingles that no other set has come first
    entries = scratch.keep(
        whole.select("doc_id", "set_id", "n").join(shared, ["doc_id", "set_id"])
        .withColumn("alone", left).withColumn("taken", _prefix(F.col("n"), percent) - F.col("alone")).filter("taken > 0")
        .select("doc_id", "set_id", "n", "alone", F.explode(F.slice("order", 1, F.col("taken"))).alias("e"))
        .select("doc_id", "set_id", "n", "alone", F.col("e.h").alias("h")), "entries")
    lists = scratch.keep(entries.groupBy("h").agg(
        F.count("*").alias("size"), F.min(F.struct((F.col("alone") / F.col("n")).alias("odd"), "doc_id", "set_id")).alias("p"))
        .filter("size > 1").select("h", "size", F.col("p.doc_id").alias("p_doc"), F.col("p.set_id").alias("p_set")), "lists")
    sets = scratch.keep(whole.join(entries.select("doc_id", "set_id").distinct(), ["doc_id", "set_id"], "left_semi"), "sets2")
    scratch.release("whole", "shared")

    # pairs of short lists, and every member of a long list with its most typical one
    short = lists.filter(F.col("size") <= LIST).select("h")
    fits = (F.col("a.n") * 100 >= percent * F.col("b.n")) & (F.col("b.n") * 100 >= percent * F.col("a.n"))
    ordered = F.struct("a.doc_id", "a.set_id") < F.struct("b.doc_id", "b.set_id")
    in_short = scratch.keep(entries.join(short, "h"), "in_short")
    a, b = in_short.alias("a"), in_short.alias("b")
    pairs = a.join(b, (F.col("a.h") == F.col("b.h")) & ordered & fits).select(
        F.col("a.doc_id").alias("a"), F.col("a.set_id").alias("sa"), F.col("b.doc_id").alias("b"), F.col("b.set_id").alias("sb"))
    long = scratch.keep(entries.join(lists.filter(F.col("size") > LIST), "h"), "long")
    stars = long.filter("doc_id != p_doc OR set_id != p_set").select(
        F.col("doc_id").alias("a"), F.col("set_id").alias("sa"), F.col("p_doc").alias("b"), F.col("p_set").alias("sb"))
    asked = scratch.keep(pairs.union(stars).distinct(), "asked")
    side = lambda x: sets.select(F.col("doc_id").alias(x), F.col("set_id").alias(f"s{x}"), F.col("h").alias(f"x{x}"))
    half = scratch.keep(asked.join(side("a"), ["a", "sa"]), "half")
    found = scratch.keep(half.join(side("b"), ["b", "sb"]).filter(_linked(percent)).select("a", "b").distinct(), "found")
    scratch.release("half")
    return found.union(_apart(scratch, long, sets, found, percent))


def _apart(scratch: Scratch, long: DataFrame, sets: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Links in long lists between sets that the links found so far leave apart.

    For each list, what hangs together with its most typical set is the main part. Every other member is compared with all
    members, block by block; each task returns what it finds as links to one partner for each group that hangs together.
    """
    roots = components(found)
    placed = scratch.keep(
        long.join(roots, F.col("doc_id") == F.col("node"), "left").withColumn("root", F.coalesce("component_id", "doc_id"))
        .drop("node", "component_id"), "placed")
    # the root of the list's typical set: its own row in the list
    main = placed.filter("doc_id = p_doc AND set_id = p_set").select("h", F.col("root").alias("main"))
    stray = placed.join(main, "h").withColumn("stray", F.col("root") != F.col("main"))
    stray = scratch.keep(stray.select("h", "doc_id", "set_id", "root", "stray"), "stray")
    counts = scratch.keep(stray.groupBy("h").agg(
        F.ceil(F.count_if("stray") / BLOCK).cast("int").alias("wide"), F.ceil(F.count("*") / BLOCK).cast("int").alias("high"))
        .filter("wide > 0"), "counts")
    sized = stray.join(counts, "h")
    x, y = F.pmod(F.xxhash64("set_id"), "wide").cast("int"), F.pmod(F.xxhash64("set_id"), "high").cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = sized.filter("stray").select("h", x.alias("x"), every("high").alias("y"), "doc_id", "set_id", "root", F.lit(True).alias("own")).union(
        sized.select("h", every("wide").alias("x"), y.alias("y"), "doc_id", "set_id", "root", F.lit(False).alias("own")))
    dealt = scratch.keep(dealt, "dealt")
    with_sets = dealt.join(sets.select("doc_id", "set_id", F.col("h").alias("shingles")), ["doc_id", "set_id"])

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        own, other = group[group.own.to_numpy(bool)], group[~group.own.to_numpy(bool)]
        if not len(own) or not len(other):
            return pd.DataFrame({"a": [], "b": []}).astype("int64")
        flat = np.concatenate([*own.shingles, *other.shingles])
        values, at = np.unique(flat, return_inverse=True)
        sizes = np.array([len(s) for s in [*own.shingles, *other.shingles]])
        row = np.repeat(np.arange(len(sizes)), sizes)
        shared = np.zeros((len(own), len(other)), np.float32)
        step = max(256, 32_000_000 // (4 * len(sizes)))
        for s in range(0, len(values), step):  # some shingles at a time, so that memory is bounded
            here = (at >= s) & (at < s + step)
            m = np.zeros((len(sizes), min(step, len(values) - s)), np.float32)
            m[row[here], at[here] - s] = 1
            shared += m[: len(own)] @ m[len(own):].T
        total = sizes[: len(own), None] + sizes[None, len(own):]
        hit = _reaches(shared, total, percent) & (own.root.to_numpy()[:, None] != other.root.to_numpy()[None, :])
        # one link for each stray and root that it reaches
        i, j = np.nonzero(hit)
        links = pd.DataFrame({"a": own.doc_id.to_numpy()[i], "b": other.doc_id.to_numpy()[j], "root": other.root.to_numpy()[j]})
        return links.drop_duplicates(["a", "root"])[["a", "b"]].astype("int64")

    return with_sets.groupBy("h", "x", "y").applyInPandas(compare, _PAIR).distinct()
