"""Exact near-duplicate join of vectors by cosine: pivots, the triangle inequality, and blocks that are read where they are compared.

Unit vectors with cosine >= c lie within the distance eps = sqrt(2 - 2c). Every vector lives in the cell of its nearest pivot, and is stored
once, in a block of its cell. A task compares a block with every other whose cell is in reach: of two cells only the vectors can link that,
by the triangle inequality, lie within eps of the border between the pivots. Blocks are read from the shared folder, so no vector
is copied for the cells that it may have links in; what passes between tasks are ids, digests and links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import FloatType

from accesslake.session import materialise, work_dir
from .common import components

#: Vectors of a block, on average: larger cells are stored as several.
BLOCK = 8192
#: Vectors in a cell, on average, and bounds of the number of pivots.
CELL_ROWS, PIVOTS = 4096, (4, 256)
#: Wider than any rounding error of the distances, far below any gap that matters.
SLACK = 1e-9


def sound_vectors(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(vec_id, x) of vectors that can link: not null, finite, not zero; singles stay singles, other numbers become doubles."""
    sound = F.col(vector).isNotNull() & F.forall(
        vector, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < F.lit(float("inf"))))
    x = F.col(vector) if isinstance(vectors.schema[vector].dataType.elementType, FloatType) else F.col(vector).cast("array<double>")
    return (vectors.filter(sound & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"))
            .filter(F.exists("x", lambda e: e != 0)))


def _units(x: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision, scaled by the largest component first, so that squares neither overflow nor vanish."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x + 0.0  # no negative zeros


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The ids of a batch with their vectors as a matrix, for each length."""
    ids, lists = batch.column(0).to_numpy(), batch.column(1)
    flat, lengths = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
    starts = np.cumsum(lengths) - lengths
    for size in np.unique(lengths):
        rows = np.flatnonzero(lengths == size)
        yield ids[rows], flat[starts[rows][:, None] + np.arange(size)]


def _pivots(rows: DataFrame, count: int) -> np.ndarray:
    """Centres of groups of a bounded sample (64 vectors for each pivot): pivots decide cost alone, never results."""
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(64 * count).select("x").toPandas()
    sample = _units(np.stack(some.x.to_numpy()))
    chosen, near = [0], sample @ sample[0]
    while len(chosen) < min(count, len(sample)):
        far = int(np.argmin(near))
        if near[far] > 1 - SLACK:
            break
        chosen.append(far)
        near = np.maximum(near, sample @ sample[far])
    pivots = sample[chosen]
    for _ in range(5):
        nearest = (sample @ pivots.T).argmax(axis=1)
        sums = np.stack([sample[nearest == k].sum(axis=0) for k in range(len(pivots))])
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        pivots = np.where(length > SLACK, sums / np.maximum(length, SLACK), pivots)
    return np.unique(pivots, axis=0)


def range_join(vectors: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row: links are pairs of vectors with cosine >= ``cosine``.

    ``n_links`` counts the other rows that a row is linked with, ``component_id`` is the smallest id that links reach, ``kept``
    whether that is the row itself. Vectors that are null, zero or hold null or non-finite components link with nothing. Equal
    vectors are compared once and counted as often as they occur. Rows with equal ids are one vector with the links of all of them;
    rows with a null id come out with 0 links and a null component. Vectors of different lengths link with nothing unlike in
    length. Empty tables give no rows; other columns are not read.
    """
    rows = sound_vectors(vectors, id_col, vector)
    ids = vectors.select(F.col(id_col).cast("long").alias("vec_id"))
    total = rows.count()
    if not total:
        return ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
                          (F.col("vec_id") == F.col("vec_id")).alias("kept"))
    usual = rows.agg(F.mode(F.size("x"), deterministic=True)).first()[0]
    pivots = _pivots(rows.filter(F.size("x") == usual), int(np.clip(total // CELL_ROWS, *PIVOTS)))
    keys = materialise(rows.mapInArrow(_keyed(pivots), "vec_id long, digest binary, h long, cell int"), "keys")
    # equal vectors: one stands for all; the group is aggregated, never gathered
    same = materialise(keys.groupBy("digest").agg(F.min("vec_id").alias("rep"), F.countDistinct("vec_id").alias("copies"),
                                                  F.min("h").alias("h"), F.min("cell").alias("cell")), "same")
    member = keys.join(same.select("digest", "rep", "copies"), "digest").select("vec_id", "rep", "copies").distinct()
    links = materialise(_links(rows, same, pivots, cosine), "links")
    totals = links.groupBy("rep").agg(F.sum("n").alias("others"))
    roots = components(links.select(F.col("rep").alias("a"), F.col("lowest").alias("b")))
    counted = (materialise(member, "members").join(totals, "rep", "left").join(roots, F.col("rep") == F.col("node"), "left")
               .select("vec_id", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n"),
                       F.coalesce("component_id", "rep").alias("to")))
    counted = counted.groupBy("vec_id").agg(F.max("n").alias("n"), F.min("to").alias("to"))
    component = F.coalesce("to", "vec_id")
    return ids.join(counted, "vec_id", "left").select(
        "vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        (F.col("vec_id") == component).alias("kept"))


def _keyed(pivots: np.ndarray, wide: dict[int, int] | None = None):
    """Of each vector a digest (equal vectors have equal ones), a number out of it, and the cell; or, told how many blocks the cells have,
    the place, the digest and the vector as it came, equal ones of a batch once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, x in _by_length(batch):
                u, size = _units(x), x.shape[1]
                digest = [hashlib.blake2b(row, digest_size=16).digest() for row in u]
                h = np.array([int.from_bytes(d[:4]) for d in digest], np.int64)
                # unlike the others in length: one cell of their own
                cell = (u @ pivots.T).argmax(axis=1).astype(np.int32) if size == pivots.shape[1] else np.full(len(u), -size, np.int32)
                if wide is None:
                    yield pa.RecordBatch.from_pydict({"vec_id": ids, "digest": digest, "h": h, "cell": cell})
                    continue
                first = sorted({d: i for i, d in reversed(list(enumerate(digest)))}.values())
                block = h[first] % np.array([wide.get(int(c), 1) for c in cell[first]])
                yield pa.RecordBatch.from_pydict({"cell": cell[first], "block": block.astype(np.int32), "digest": [digest[i] for i in first],
                                                  "x": [x[i].tobytes() for i in first]})
    return run


def _links(rows: DataFrame, same: DataFrame, pivots: np.ndarray, cosine: float) -> DataFrame:
    """(rep, n, lowest): of each rep and task that compared it the rows linked (their sum counts), and smaller reps that hang together with it."""
    spark = rows.sparkSession
    kind = np.float32 if isinstance(rows.schema["x"].dataType.elementType, FloatType) else np.float64
    sizes = same.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("wide"))  # one row for each pivot, or other length
    wide = {r.cell: r.wide for r in sizes.collect()}
    placed = rows.mapInArrow(_keyed(pivots, wide), "cell int, block int, digest binary, x binary")
    known = same.join(F.broadcast(spark.createDataFrame(list(wide.items()), "cell int, wide int")), "cell").select(
        "cell", F.pmod("h", F.col("wide")).cast("int").alias("block"), "digest", "rep", "copies")

    def store(key, came: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        found = wanted.merge(came.drop_duplicates("digest")[["digest", "x"]], "inner", "digest").sort_values(["rep", "digest"])
        if len(found) != len(wanted):
            raise RuntimeError("a vector has moved to another cell while it was read again")
        if not len(found):  # equal vectors that rounding put into another cell
            return pd.DataFrame({"rep": [], "copies": [], "x": [], "cell": [], "block": []})
        return pd.DataFrame({"rep": [found.rep.to_numpy(np.int64).tobytes()], "copies": [found.copies.to_numpy(np.int64).tobytes()],
                             "x": [b"".join(found.x)], "cell": [key[0]], "block": [key[1]]})

    path = work_dir(spark, "blocks")
    place = ["cell", "block"]
    blocks = placed.groupBy(*place).cogroup(known.groupBy(*place)).applyInPandas(
        store, "rep binary, copies binary, x binary, cell int, block int")
    blocks.write.partitionBy(*place).parquet(path)
    stored = sorted((r.cell, r.block) for r in spark.read.parquet(path).select("cell", "block").collect())
    eps = float(np.sqrt(max(0.0, 2 - 2 * cosine))) + SLACK

    def block(cell: int, number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        files, at = FileSystem.from_uri(path) if "://" in path else (LocalFileSystem(), path.removeprefix("file:"))
        row, = pq.read_table(f"{at}/cell={cell}/block={number}", columns=["rep", "copies", "x"], filesystem=files, partitioning=None).to_pylist()
        rep = np.frombuffer(row["rep"], np.int64)
        return rep, np.frombuffer(row["copies"], np.int64), _units(np.frombuffer(row["x"], kind).reshape(len(rep), -1))

    def near_border(u: np.ndarray, own: int, other: int) -> np.ndarray:
        """Which vectors of a cell may have links in another one."""
        across = pivots[own] - pivots[other]  # never null: pivots differ
        return u @ across <= eps * np.linalg.norm(across)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for cell, number in (pair for batch in batches for pair in zip(batch.cell.tolist(), batch.block.tolist())):
            ids, _, u = block(cell, number)
            n, edges = np.zeros(len(u), np.int64), []
            for other, further in stored:
                if other != cell and min(other, cell) < 0:
                    continue  # vectors of another length
                left = np.arange(len(u)) if other == cell else np.flatnonzero(near_border(u, cell, other))
                if not len(left):
                    continue
                others, copies, v = block(other, further)
                if other != cell:
                    near = near_border(v, other, cell)
                    others, copies, v = others[near], copies[near], v[near]
                if len(others):
                    hits, linked = _compared(u[left], ids[left], v, others, copies, cosine)
                    n[left] += hits
                    edges.append(linked)
            edges = np.unique(np.concatenate([np.zeros((0, 2), np.int64), *edges]), axis=0)
            yield pd.DataFrame({"rep": ids[n > 0], "n": n[n > 0], "lowest": ids[n > 0]})
            yield pd.DataFrame({"rep": edges[:, 0], "n": np.zeros(len(edges), np.int64), "lowest": edges[:, 1]})

    tasks = spark.createDataFrame(stored, "cell int, block int").repartition(max(1, min(len(stored), 4 * spark.sparkContext.defaultParallelism)))
    return tasks.mapInPandas(compare, "rep long, n long, lowest long")


def _compared(u: np.ndarray, ids: np.ndarray, v: np.ndarray, others: np.ndarray, copies: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``u`` the rows of ``v`` linked, and (id, smaller id that hangs together with it here) of both."""
    n, lowest, of_others = np.zeros(len(u), np.int64), ids.copy(), others.copy()
    edges = []
    for s in range(0, len(u), 512):
        hit = u[s:s + 512] @ v.T >= cosine
        hit &= ids[s:s + 512, None] != others[None, :]
        n[s:s + 512] = hit @ copies
        if hit.any():
            edges.append((slice(s, s + len(hit)), hit))
    none = np.iinfo(np.int64).max
    # what hangs together here, by the smallest id: a few sweeps over the hits of the block
    while edges:
        before = lowest.sum(), of_others.sum()
        for some, hit in edges:
            lowest[some] = np.minimum(lowest[some], np.where(hit, of_others[None, :], none).min(axis=1))
            of_others = np.minimum(of_others, np.where(hit, lowest[some, None], none).min(axis=0))
        if (lowest.sum(), of_others.sum()) == before:
            break
    low, low_others = lowest < ids, of_others < others
    return n, np.concatenate([np.stack([ids[low], lowest[low]], axis=1), np.stack([others[low_others], of_others[low_others]], axis=1)])
