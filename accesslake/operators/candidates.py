"""Every row against every candidate chunk size, and picking the best."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.sizing import decide, tier_slots

TIE = 1e-4


def candidate_chunks(df: DataFrame, column: str = "chunk_size_kb") -> DataFrame:
    return df.select(F.col(column).alias("chunk")).where(F.col("chunk").isNotNull()).distinct().orderBy("chunk")


def candidate_list(df: DataFrame, column: str = "chunk_size_kb") -> list[float]:
    """The sorted distinct chunk sizes: one number per size ever configured, not per row."""
    return [r["chunk"] for r in candidate_chunks(df, column).collect()]


def expand_candidates(df: DataFrame, candidates: Sequence[float], column: str = "chunk_size_kb",
                      current: str = "current_chunk") -> DataFrame:
    """Each row once per candidate, the candidate in ``column`` and the old value in ``current``.

    The list is one constant, folded before the plan is made, so expanding is a narrow step without join or shuffle, and the plan is the
    same for lists of any length. Select what is needed before: every other column is repeated with the candidates.
    """
    kind = df.schema[column].dataType.simpleString()
    listed = F.from_json(F.lit(json.dumps([float(c) for c in candidates])), "array<double>").cast(f"array<{kind}>")
    return df.withColumnRenamed(column, current).withColumn(column, F.explode(listed))


def best_candidate(scored: DataFrame, keys: Sequence[str], chunk: str = "chunk_size_kb", p: str = "p",
                   tie: float = TIE) -> DataFrame:
    """Per row key: best p and chosen chunk out of expanded and scored rows.

    ``keys`` identify the row before expansion (carry further columns in ``keys`` as well). All candidates of a row sit next to each
    other, so the map-side step already folds them into one. Fitted models score candidates within the row instead, as
    ``models.predict_rf`` does, and closed-form scores do so in ``best_candidate_inline``.
    """
    pair = F.struct(F.col(p).alias("p"), F.col(chunk).alias("chunk"))
    gathered = scored.groupBy(*keys).agg(F.collect_list(pair).alias("_c"), F.max(p).alias("confidence"))
    near = F.filter("_c", lambda s: F.col("confidence") - s["p"] < tie)
    return gathered.select(*keys, F.array_max(F.transform(near, lambda s: s["chunk"])).alias("optimal_chunk"), "confidence")


def best_candidate_inline(df: DataFrame, candidates: Sequence[float], score: Callable[[Column], Column],
                          tie: float = TIE) -> DataFrame:
    """As ``best_candidate`` for a score that is a column expression: no expansion, no shuffle.

    Every candidate's score is a column of its own, so the choice is generated code without arrays.
    """
    names = {f"_p{i}": F.lit(float(c)) for i, c in enumerate(candidates)}
    scored = df.withColumns({n: score(c) for n, c in names.items()})
    best = scored.withColumn("confidence", F.greatest(*names) if len(names) > 1 else F.col("_p0"))
    near = [F.when(F.col("confidence") - F.col(n) < tie, c) for n, c in names.items()]
    return best.withColumn("optimal_chunk", F.greatest(*near) if len(near) > 1 else near[0]).drop(*names)


def argmax_candidate(scored: DataFrame, keys: Sequence[str], chunk: str = "chunk", p: str = "p",
                     position: str = "position", listed: str | None = None) -> DataFrame:
    """Per row key: the candidate with the highest p, the first in list order among equals.

    The scored candidates are rows or, with ``listed``, an array of structs of these fields in each row. Lists are folded within the row,
    so that what is grouped does not grow with the candidates.
    """
    def pair(c):
        return F.struct(c(p).alias("p"), (-c(position)).alias("n"), c(chunk).alias("chunk"))

    own = pair(F.col) if listed is None else F.array_max(F.transform(listed, lambda s: pair(s.getField)))
    # a key without candidates has no row
    return scored.select(*keys, own.alias("_s")).groupBy(*keys).agg(F.max("_s").alias("_b")).where("_b IS NOT NULL").select(
        *keys, F.col("_b.chunk").alias("best_chunk"), F.col("_b.p").alias("best_p"))


def decide_inline(df: DataFrame, score: Callable[[Column], Column], size: str = "file_size_kb",
                  current: str = "chunk_size_kb") -> DataFrame:
    """Tiered candidates, their scores and the decision for each row, all within the row."""
    slots = tier_slots(F.col(size), F.col(current))
    chunks, ps = [f"_c{i}" for i in range(len(slots))], [f"_p{i}" for i in range(len(slots))]
    scored = (df.withColumns(dict(zip(chunks, slots)))
              .withColumns({p: F.when(F.col(c).isNotNull(), score(F.col(c))) for p, c in zip(ps, chunks)})
              .withColumn("best_p", F.greatest(*ps)))
    own = [F.when(F.col(c) == F.col(current), F.col(p)) for p, c in zip(ps, chunks)]
    best = [F.when(F.col(p) == F.col("best_p"), F.col(c)) for p, c in zip(ps, chunks)]
    chosen = scored.withColumns({"best_chunk": F.least(*best), "current_p": F.coalesce(*own)}).drop(*chunks, *ps)
    return chosen.withColumn("optimal_chunk", decide(
        F.col(size), F.col(current), F.col("best_chunk"), F.col("current_p"), F.col("best_p")))


def most_confident(predictions: DataFrame, order: Sequence[str]) -> DataFrame:
    """The one prediction with the highest confidence, the first by ``order`` among equals."""
    return predictions.orderBy(F.desc("confidence"), *order).limit(1)
