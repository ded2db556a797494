"""Language identification by string kernels.

The kernel of two texts is the number of character n-grams (one to three letters, words apart by a space) that both have, over the
geometric mean of how many each has. Nyström landmarks stand for the training texts; a ridge regression for each language against
the rest is fitted on the kernel values with them. Batches of texts are scored by two matrix products.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from .common import refuse_clash

#: N-grams are hashed to so many bits.
BITS = 16
#: Texts of each language that a fit learns from, on average, and how many of them are landmarks.
SAMPLE, LANDMARKS = 600, 32
#: Texts that a fit learns from in all, on average: with very many languages each gets its part of these.
SAMPLE_ALL = 20_000
#: Weight of the ridge penalty for each training text.
RIDGE = 1e-3
#: Characters and texts whose n-grams are made at once.
CHARS, TEXTS = 1_000_000, 256

_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point, itself if it is a letter, else a space."""
    if not _LETTERS:
        _LETTERS.append(np.array([i if chr(i).isalpha() else 32 for i in range(0x110000)], np.uint32))
    return _LETTERS[0]


def presence(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Which hashed n-grams each text has (texts x 2^BITS), and whether it has a letter."""
    flat = np.frombuffer(" ".join(t.lower() for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = _letters()[np.minimum(flat, 0x10FFFF)].astype(np.uint64)
    sizes = np.array([len(t.lower()) + 1 for t in texts])
    sizes[-1] -= 1
    row = np.repeat(np.arange(len(texts)), sizes)
    has = np.zeros((len(texts), 1 << BITS), bool)
    letter = np.zeros(len(texts), bool)
    letter[row[codes != 32]] = True
    rolled = np.zeros(len(codes), np.uint64)
    for n in (1, 2, 3):
        if len(codes) < n:
            break
        rolled = rolled[: len(codes) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1:] + np.uint64(n)
        # n-grams over the end of a text or with two spaces in a row say nothing
        mine = row[n - 1:] == row[: len(row) - n + 1]
        if n > 1:
            mine &= (codes[: len(codes) - n + 1] != 32) | (codes[1: len(codes) - n + 2] != 32)
        hashed = (rolled * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)
        has[row[: len(mine)][mine], hashed[mine]] = True
    return has, letter


@dataclass
class LanguageModel:
    """Landmarks, their n-grams and the weights of every language."""

    languages: list[str]
    used: np.ndarray  # hashed n-grams that any landmark has
    landmarks: np.ndarray  # used n-grams x landmarks, over the root of each landmark's number of n-grams
    weights: np.ndarray  # landmarks x languages

    def kernel(self, has: np.ndarray) -> np.ndarray:
        size = np.sqrt(np.maximum(1, has.sum(axis=1)))
        return has[:, self.used].astype(np.float32) @ self.landmarks / size[:, None]

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        has, letter = presence(texts)
        return self.kernel(has) @ self.weights, letter


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE,
        landmarks: int = LANDMARKS) -> LanguageModel:
    """Learn from about ``sample`` texts of each language, drawn by a hash of their ids, and SAMPLE_ALL in all: that is the bound of what
    the driver gets, as the hashed n-grams that each text has.

    Rows with a null or empty text, language or id are not learned from; without any, the model knows no language.
    """
    rows = labelled.filter(F.col(lang).isNotNull() & (F.length(text) > 0) & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    counts = rows.groupBy("lang").count()  # a row for each language; however many a dirty column has, the engine joins them
    each = min(float(sample), SAMPLE_ALL / max(1, counts.count()))
    draw = F.shiftrightunsigned(F.xxhash64(F.col("id"), F.lit(3)), 11) / F.lit(float(1 << 53))
    drawn = rows.join(counts, "lang").filter(draw * F.col("count") < each)

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in _parts(batch, "text"):
                has, letter = presence(list(part["text"]))
                yield pd.DataFrame({"lang": part["lang"], "id": part["id"].astype(str),
                                    "codes": [np.flatnonzero(h).astype(np.uint16).tobytes() for h in has]})[letter]

    got = drawn.select("id", "text", "lang").mapInPandas(grams, "lang string, id string, codes binary").toPandas()
    got = got.sort_values(["lang", "id"], kind="stable").reset_index(drop=True)
    languages = sorted(got.lang.unique())
    if not languages:
        return LanguageModel([], np.zeros(0, np.int64), np.zeros((0, 0), np.float32), np.zeros((0, 0), np.float32))
    size = got.codes.map(len).to_numpy() // 2

    def dense(which: Iterable[int]) -> np.ndarray:
        has = np.zeros((len(which), 1 << BITS), bool)
        for k, i in enumerate(which):
            has[k, np.frombuffer(got.codes.iloc[i], np.uint16)] = True
        return has

    # landmarks evenly over each language's texts by length, short ones too
    chosen = []
    for name in languages:
        own = np.flatnonzero((got.lang == name).to_numpy())
        own = own[np.argsort(size[own], kind="stable")]
        chosen += own[np.unique(np.linspace(0, len(own) - 1, min(landmarks, len(own))).astype(int))].tolist()
    used = np.unique(np.concatenate([np.frombuffer(got.codes.iloc[i], np.uint16) for i in chosen])).astype(np.int64)
    marks = np.concatenate([dense(chosen[k:k + TEXTS])[:, used] for k in range(0, len(chosen), TEXTS)])
    marks = (marks / np.sqrt(np.maximum(1, size[chosen]))[:, None]).T.astype(np.float32)
    model = LanguageModel(languages, used, marks, np.zeros((len(chosen), len(languages)), np.float32))
    known = np.concatenate([model.kernel(dense(range(k, min(k + TEXTS, len(got))))) for k in range(0, len(got), TEXTS)]).astype(np.float64)
    within = known[chosen]
    values, vectors = np.linalg.eigh((within + within.T) / 2)
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    features = known @ root
    wanted = (got.lang.to_numpy()[:, None] == np.array(languages)[None, :]).astype(float)
    share = 1 / np.maximum(1, wanted.sum(axis=0))[wanted.argmax(axis=1)]  # every language weighs the same
    gram = features.T @ (features * share[:, None]) + RIDGE * len(languages) / 10 * np.eye(features.shape[1])
    model.weights = (root @ np.linalg.solve(gram, features.T @ (wanted * share[:, None]))).astype(np.float32)
    return model


def _parts(batch: pd.DataFrame, text: str) -> Iterator[pd.DataFrame]:
    """Consecutive rows of a batch, within TEXTS rows and about CHARS characters."""
    sizes = np.array([len(t) if isinstance(t, str) else 0 for t in batch[text]])
    part = np.maximum(np.cumsum(sizes) // CHARS, 0) * (len(batch) // TEXTS + 1) + np.arange(len(batch)) // TEXTS
    for _, rows in batch.groupby(part, sort=False):
        yield rows


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", lang_pred: str = "lang_pred",
             score: str = "score") -> DataFrame:
    """``docs`` with the predicted language of every whole text and a score from 0 to 1.

    ``und`` with score 0 if the text is null or has no letter, or if the model knows no language. Only the text is looked at. Ties go
    to the first language in alphabetical order. Rows stay as they are, repeated ones too; a clash of names is an error.
    """
    refuse_clash(docs, lang_pred, score)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = sent.value
        for batch in batches:
            for part in _parts(batch, text):
                texts = [t if isinstance(t, str) else "" for t in part[text]]
                if m.languages:
                    scores, letter = m.scores(texts)
                    best = scores.argmax(axis=1)
                    names = np.where(letter, np.array(m.languages, object)[best], "und")
                    sure = np.where(letter, np.clip(scores[np.arange(len(texts)), best], 0, 1), 0.0)
                else:
                    names, sure = ["und"] * len(texts), [0.0] * len(texts)
                yield part.assign(**{lang_pred: names, score: np.asarray(sure, np.float64)})

    schema = T.StructType([*docs.schema.fields, T.StructField(lang_pred, T.StringType()), T.StructField(score, T.DoubleType())])
    return docs.mapInPandas(run, schema)
