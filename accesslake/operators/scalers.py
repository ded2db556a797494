"""Fitted scalers: what a table teaches is kept, stored, and applied to other rows alike."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasInputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F

from .common import melt
from .quantiles import few_group_quantiles
from ..functions.measures import nonzero

KINDS = ("standard", "robust", "minmax")


class _HasKind(Params):
    kind = Param(Params._dummy(), "kind", "standard (mean, population deviation), robust (median, quartiles' distance) or minmax",
                 typeConverter=TypeConverters.toString)


class ColumnScaler(Estimator, HasInputCols, _HasKind, DefaultParamsReadable, DefaultParamsWritable):
    """Learns a centre and a width for each column; the columns are scaled in place.

    Statistics are exact, and come from one scan (robust: two); nulls do not count and stay null, a constant column becomes 0.
    """

    @keyword_only
    def __init__(self, *, inputCols: Sequence[str] | None = None, kind: str = "standard"):
        super().__init__()
        self._setDefault(kind="standard")
        self._set(**self._input_kwargs)
        if self.getOrDefault(self.kind) not in KINDS:
            raise ValueError(f"a scaler is one of {KINDS}")

    def _fit(self, df: DataFrame) -> ColumnScalerModel:
        columns, kind = self.getInputCols(), self.getOrDefault(self.kind)
        if kind == "robust":
            found = few_group_quantiles(melt(df, columns), ["column_name"], "value", {"q1": 0.25, "q2": 0.5, "q3": 0.75}).collect()
            known = {r["column_name"]: (r["q2"], r["q3"] - r["q1"]) for r in found}  # a row for each column
        else:
            sides = {"standard": lambda c: (F.avg(c), F.stddev_pop(c)), "minmax": lambda c: (F.min(c), F.max(c) - F.min(c))}[kind]
            row = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).agg(
                *[F.struct(*[s.cast("double") for s in sides(c)]).alias(c) for c in columns]).first()
            known = {c: tuple(row[c]) for c in columns}
        # a column without values is left as it is: it holds nulls only
        centre, width = zip(*[(a, b) if (a := known.get(c, (None, None))[0]) is not None and (b := known[c][1]) is not None else (0.0, 1.0)
                              for c in columns])
        return ColumnScalerModel()._set(inputCols=list(columns), kind=kind, centre=list(centre), width=list(width))


class ColumnScalerModel(Model, HasInputCols, _HasKind, DefaultParamsReadable, DefaultParamsWritable):
    """(x - centre) / width for each column, from stored numbers: a row alone is scaled as it is in its table."""

    centre = Param(Params._dummy(), "centre", "what becomes 0, for each column", typeConverter=TypeConverters.toListFloat)
    width = Param(Params._dummy(), "width", "what becomes 1, for each column", typeConverter=TypeConverters.toListFloat)

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({
            c: (F.col(c) - F.lit(a)) / nonzero(F.lit(w))
            for c, a, w in zip(self.getInputCols(), self.getOrDefault(self.centre), self.getOrDefault(self.width))})


def fit_scaler(df: DataFrame, columns: Sequence[str], kind: str = "standard") -> ColumnScalerModel:
    return ColumnScaler(inputCols=list(columns), kind=kind).fit(df)


class VectorScalerModel(Model, HasInputCol, DefaultParamsReadable, DefaultParamsWritable):
    """(x - low) / width for each position of an array column, from stored numbers."""

    low = Param(Params._dummy(), "low", "what becomes 0, for each position", typeConverter=TypeConverters.toListFloat)
    width = Param(Params._dummy(), "width", "what becomes 1, for each position", typeConverter=TypeConverters.toListFloat)

    def _transform(self, df: DataFrame) -> DataFrame:
        column = self.getInputCol()
        sides = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(w).alias("w"))
                          for a, w in zip(self.getOrDefault(self.low), self.getOrDefault(self.width))])
        return df.withColumn(column, F.zip_with(column, sides, lambda x, s: (x.cast("double") - s["a"]) / s["w"]))


def fit_vector_scaler(df: DataFrame, column: str) -> VectorScalerModel:
    """Brings every position of an array column to [0, 1]; a constant position becomes 0."""
    ends = (df.select(F.posexplode(column).alias("at", "x")).groupBy("at")
            .agg(F.min("x").cast("double").alias("lo"), F.max("x").cast("double").alias("hi")).orderBy("at").collect())
    return VectorScalerModel()._set(inputCol=column, low=[r["lo"] for r in ends], width=[(r["hi"] - r["lo"]) or 1.0 for r in ends])
