"""Deduplication of repeated runs of lines, by winnowing.

A window is the shortest run of whole lines from some line on that holds ``min_words`` words. Every window selects the line of least
hash as its fingerprint, so any repeated run of that many words has fingerprints at the same lines wherever it stands. Fingerprints
of equal windows are joined with their first occurrence; each match is extended line by line both ways; and every run that stood
somewhere before is deleted. First is who has the smallest (document, line). Passages inside longer, otherwise different lines stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from accesslake.session import Scratch
from .common import give_back, refuse_clash

#: Words that a repeated run must have to be deleted.
MIN_WORDS = 40
#: Deleted lines and documents that have any (four times) are broadcast up to this number, a few MB; beyond it the texts that lose lines
#: are joined with them by a shuffle, and told from the others by their keys, which are broadcast up to this number of documents.
BROADCAST_LINES, BROADCAST_KEYS = 500_000, 500_000


def line_hashes(text: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The lines of a text, a 64-bit hash of each (without white space at its ends) and its number of words."""
    lines = text.split("\n")
    clean = [x.strip() for x in lines]
    h = np.array([int.from_bytes(hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
                  for x in clean], np.int64)
    return lines, h, np.array([len(x.split()) for x in clean], np.int64)


def windows(h: np.ndarray, words: np.ndarray, min_words: int) -> list[tuple[int, int, int, bytes]]:
    """(start, end, fingerprint line, key) of every window; lines without words neither start nor end one."""
    upto = np.concatenate([[0], np.cumsum(words)])
    starts = np.flatnonzero(words > 0)
    ends = np.searchsorted(upto, upto[starts] + min_words, side="left")  # lines start .. end - 1 have enough words
    out = []
    for s, e in zip(starts.tolist(), ends.tolist()):
        if e > len(h):
            break
        body = h[s:e]
        own = body[words[s:e] > 0]
        key = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
        first = int(np.argmin(np.where(words[s:e] > 0, body, np.iinfo(np.int64).max)))
        out.append((s, e, s + first, key))
    return out


def _lines(docs: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, digest, h, words, keys, starts, marks): hashes and words of the lines, and key, start and fingerprint of the windows."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, digest, text in zip(batch.doc_id, batch.digest, batch.text):
                _, h, words = line_hashes(text if isinstance(text, str) else "")
                found = windows(h, words, min_words)
                if found:
                    # lines without words play no part: positions are those among the others
                    at = np.cumsum(words > 0) - 1
                    full = words > 0
                    rows.append((doc_id, digest, h[full], words[full].astype(np.int32), [k for *_, k in found],
                                 at[[s for s, *_ in found]].astype(np.int32), at[[m for _, _, m, _ in found]].astype(np.int32)))
            yield pd.DataFrame(rows, columns=["doc_id", "digest", "h", "words", "keys", "starts", "marks"])
        give_back()

    return docs.mapInPandas(
        run, "doc_id long, digest long, h array<long>, words array<int>, keys array<binary>, starts array<int>, marks array<int>")


def _repeats(scratch: Scratch, docs: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, digest, gone): the lines, numbered among those with words, that repeat a run that stood before.

    A document is an id and the digest of a text: texts that share an id are documents of their own, equal rows are one.
    """
    lines = scratch.keep(_lines(docs, min_words), "lines")
    twice = lines.groupBy("doc_id", "digest").count().filter("count > 1").select("doc_id", "digest")
    if not twice.isEmpty():
        once = lines.join(twice, ["doc_id", "digest"], "left_semi").dropDuplicates(["doc_id", "digest"])
        lines = scratch.keep(lines.join(twice, ["doc_id", "digest"], "left_anti").select(once.columns).union(once), "lines-once")
    prints = lines.select("doc_id", "digest", F.explode(F.arrays_zip("keys", "marks")).alias("w")).select(
        "doc_id", "digest", F.col("w.keys").alias("key"), F.col("w.marks").alias("at"))
    first = scratch.keep(prints.groupBy("key").agg(F.min(F.struct("doc_id", "digest", "at")).alias("first"), F.count("*").alias("n")).filter(
        "n > 1").select("key", F.col("first.doc_id").alias("src"), F.col("first.digest").alias("src_digest"), F.col("first.at").alias("src_at")),
        "first")
    elsewhere = (F.col("doc_id") != F.col("src")) | (F.col("digest") != F.col("src_digest"))
    # one alignment for each document, source and shift; the rest of the fingerprints on it add nothing
    matches = scratch.keep(prints.join(first, "key").filter(elsewhere | (F.col("at") != F.col("src_at")))
                           .select("doc_id", "digest", "src", "src_digest", "at", "src_at").distinct(), "matches")
    per_pair = scratch.keep(matches.groupBy("doc_id", "digest", "src", "src_digest").agg(
        F.collect_list(F.struct("at", "src_at")).alias("pairs")), "pairs")
    sources = scratch.keep(lines.select(F.col("doc_id").alias("src"), F.col("digest").alias("src_digest"), F.col("h").alias("src_h")).join(
        per_pair.select("src", "src_digest").distinct(), ["src", "src_digest"], "left_semi"), "sources")
    own = scratch.keep(per_pair.join(lines.select("doc_id", "digest", "h", "words"), ["doc_id", "digest"]), "own")

    def extend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["doc_id", "digest", "src", "src_digest", "pairs", "h", "words", "src_h"]
        for batch in batches:
            rows = []
            for doc_id, digest, src, src_digest, pairs, h, words, src_h in batch[columns].itertuples(index=False):
                same = (doc_id, digest) == (src, src_digest)
                gone: set[int] = set()
                done: dict[int, int] = {}  # shift -> line up to which it is extended
                for at, src_at in sorted((p["at"], p["src_at"]) for p in pairs):
                    shift = at - src_at
                    if done.get(shift, -1) >= at:
                        continue
                    low, high = at, at + 1
                    while low > 0 and low - shift > 0 and h[low - 1] == src_h[low - 1 - shift]:
                        low -= 1
                    while high < len(h) and high - shift < len(src_h) and h[high] == src_h[high - shift]:
                        high += 1
                    done[shift] = high - 1
                    if same:
                        low = max(low, src_at + 1)  # within one text the first occurrence stays
                    if words[low:high].sum() >= min_words or same:
                        gone.update(range(low, high))
                if gone:
                    rows.append((doc_id, digest, sorted(gone)))
            yield pd.DataFrame(rows, columns=["doc_id", "digest", "gone"])
        give_back()

    return (own.join(sources, ["src", "src_digest"]).mapInPandas(extend, "doc_id long, digest long, gone array<int>")
            .groupBy("doc_id", "digest").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone")))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, removed: str = "n_removed",
                out: str | None = None) -> DataFrame:
    """``docs`` with the repeated runs of ``min_words`` words or more deleted from every text, and how many lines that were.

    A run is repeated if it stood in a document with a smaller id, or earlier in the same one. Lines are compared without white
    space at their ends; lines without words are skipped and stay, except that a text of which nothing else is left becomes empty. The new
    text is put in ``out`` (default: in place of ``text``). Null texts stay null; rows with a null id stay as they are. Texts that share an
    id are documents of their own, in the order of a 64-bit digest; rows that repeat both id and text are one document, and lose the same
    lines. Ties do not occur: (id, digest, line) orders all runs. Texts are read whole, of any length; a task holds the lines of some
    documents and of one source for each. Empty tables give no rows. All other columns stay; ``removed`` may not be one of them, nor may
    names that begin with ``__dedup_``.
    """
    out = out or text
    own_id, own_digest, own_gone = "__dedup_id", "__dedup_digest", "__dedup_gone"
    refuse_clash(docs, removed, own_id, own_digest, own_gone, *([out] if out != text else []))
    scratch = Scratch(docs.sparkSession, "linedup")
    rows = docs.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("digest"), F.col(text).alias("text"))
    gone = scratch.keep(_repeats(scratch, rows, min_words).toDF(own_id, own_digest, own_gone), "gone")
    size = gone.agg(F.coalesce(F.sum(F.size(own_gone)), F.lit(0)).alias("lines"), F.count("*").alias("documents")).first()
    same = (F.col(id_col) == F.col(own_id)) & (F.xxhash64(text) == F.col(own_digest))
    if size.lines + 4 * size.documents <= BROADCAST_LINES:
        joined = docs.join(F.broadcast(gone), same, "left")
    elif size.documents <= BROADCAST_KEYS:
        keys = F.broadcast(gone.select(own_id, own_digest))
        others = docs.join(keys, same, "left_anti").withColumns({c: F.lit(None).cast(t) for c, t in gone.dtypes})
        joined = docs.join(keys, same, "left_semi").join(gone, same).unionByName(others)
    else:
        joined = docs.join(gone, same, "left")
    joined = joined.drop(own_id, own_digest)
    fields = [f for f in docs.schema.fields if f.name != out]
    schema = T.StructType([*fields, T.StructField(out, T.StringType()), T.StructField(removed, T.LongType())])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, counts = [], []
            for old, drop in zip(batch[text], batch[own_gone]):
                if drop is None or not isinstance(old, str):
                    texts.append(old if isinstance(old, str) else None)
                    counts.append(0)
                    continue
                lines, dropped, at, kept = old.split("\n"), set(drop), -1, []
                for line in lines:
                    full = bool(line.strip())
                    at += full
                    if not (full and at in dropped):
                        kept.append(line)
                counts.append(len(lines) - len(kept))
                texts.append("\n".join(kept) if any(x.strip() for x in kept) else "")
            batch[out], batch[removed] = texts, counts
            yield batch[schema.names]
        give_back()

    return joined.mapInPandas(cut, schema).select(*[c for c in docs.columns], *([out] if out not in docs.columns else []), removed)
