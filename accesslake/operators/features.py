"""Feature derivation, encoding, scaling and the training sets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import PCA, OneHotEncoder, OneHotEncoderModel, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.functions import unwrap_udt

from . import stats
from .scalers import fit_scaler
from ..functions import measures, paths
from ..session import materialise

# The numeric features of the v1 log after derivation.
V1_FEATURES = (
    "file_size", "access_count", "avg_read_size", "avg_write_size", "max_read_size", "max_write_size",
    "read_count", "write_count", "throughput_mbps", "file_size_mb", "dir_depth", "read_write_ratio",
    "avg_access_size", "max_access_size", "read_percentage", "path_chunk_hint")


def derive_v1(df: DataFrame) -> DataFrame:
    """The v1 log with its derived columns."""
    c = F.col
    return df.withColumns({
        "file_size_mb": measures.to_mb(c("file_size")),
        "chunk_size_kb": measures.to_kb(c("chunk_size")),
        "file_extension": paths.extension(c("file_path")),
        "dir_depth": paths.dir_depth(c("file_path")),
        "read_write_ratio": measures.rw_ratio(c("read_count"), c("write_count")),
        "avg_access_size": measures.avg_access(c("avg_read_size"), c("read_count"), c("avg_write_size"),
                                               c("write_count"), c("access_count")),
        "max_access_size": measures.max_access(c("max_read_size"), c("max_write_size")),
        "read_percentage": measures.read_pct(c("read_count"), c("access_count")),
        "path_chunk_hint": paths.path_chunk_hint(c("file_path")),
    })


def ext_onehot(df: DataFrame, path: str = "file_path") -> DataFrame:
    return df.withColumns(paths.extension_flags(paths.extension(F.col(path))))


def category_levels(df: DataFrame, column: str) -> list[str]:
    """Sorted levels of a categorical column that is to become columns: give ``onehot`` the wanted ones if there are very many."""
    return [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).collect()]


def onehot(df: DataFrame, columns: Sequence[str], levels: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """0/1 columns ``<column>_<level>`` in place of each categorical column, without its first level.

    For columns with any number of levels there is ``fit_onehot``, which makes one sparse vector of each.
    """
    for column in columns:
        known = levels[column] if levels else category_levels(df, column)
        df = df.withColumns({f"{column}_{v}": F.when(F.col(column) == v, 1).otherwise(0) for v in known[1:]})
    return df.drop(*columns)


@dataclass
class OneHot:
    """A fitted dictionary: (level, position), the first level at position 0, and an encoder that knows how many there are."""

    column: str
    levels: DataFrame
    encoder: OneHotEncoderModel

    def transform(self, df: DataFrame, output: str) -> DataFrame:
        """``df`` with the sparse vector ``output``: a 1 at position - 1 of the row's level, nothing for the first level, nulls and levels
        that the dictionary has not."""
        count = self.encoder.categorySizes[0]
        # the encoder drops the last category, so the first level takes that place
        known = self.levels.select(F.col("level").alias("_level"), F.col("position").alias("_position"))
        placed = df.join(known, F.col(self.column) == F.col("_level"), "left").withColumn(
            "_index", F.coalesce(F.when(F.col("_position") > 0, F.col("_position") - 1), F.lit(count - 1)).cast("double"))
        return self.encoder.copy({self.encoder.outputCols: [output]}).transform(placed).drop("_level", "_position", "_index")


def fit_onehot(df: DataFrame, column: str) -> OneHot | None:
    """The dictionary of a categorical column with any number of levels, in their order; None if there are none.

    Levels are sorted by ranges and numbered within each; only the sizes of the ranges are summed in one place.
    """
    levels = df.select(F.col(column).alias("level")).where(F.col("level").isNotNull()).distinct()
    # stored once dealt out: the ranges must not be drawn anew
    dealt = materialise(levels.repartitionByRange("level").withColumn("_part", F.spark_partition_id()), "levels")
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy("level")) - 1
    numbered = materialise(dealt.withColumn("_n", within).join(before, "_part").select(
        "level", (F.col("_before") + F.col("_n")).alias("position")), "dictionary")
    count = numbered.count()
    if not count:
        return None
    last = df.sparkSession.createDataFrame([(float(count - 1),)], "_index double")
    encoder = OneHotEncoder(inputCols=["_index"], outputCols=["_vector"], dropLast=True).fit(last)
    return OneHot(column, numbered, encoder)


def decode_onehot(fitted: OneHot, df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector holds a level, with that ``level``: the long form of the encoding."""
    at = F.get(F.col("_sparse.indices"), F.lit(0)).alias("_at")
    # the vector's stored form tells its place without spreading it over as many numbers as there are levels
    rows = df.withColumn("_sparse", unwrap_udt(vector)).select("*", at).where("_at IS NOT NULL").drop("_sparse")
    known = fitted.levels.select("level", (F.col("position") - 1).alias("_known"))
    return rows.join(known, F.col("_at") == F.col("_known")).drop("_at", "_known")


def standard_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean 0 and population deviation 1; a constant column becomes 0. ``fit_scaler`` keeps what it takes for other rows."""
    return fit_scaler(df, columns, "standard").transform(df)


def robust_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Median 0 and interquartile range 1, from exact quartiles."""
    return fit_scaler(df, columns, "robust").transform(df)


def minmax_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """To [0, 1]; a constant column becomes 0."""
    return fit_scaler(df, columns, "minmax").transform(df)


def align_features(df: DataFrame, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Exactly the model's features in the model's order; absent ones and nulls are 0."""
    have = {c.lower() for c in df.columns}
    return df.select(*keep, *[
        (F.coalesce(F.col(n).cast("double"), F.lit(0.0)) if n.lower() in have else F.lit(0.0)).alias(n)
        for n in names])


def fit_pca(df: DataFrame, columns: Sequence[str], kept: float = stats.KEPT_VARIANCE) -> PipelineModel:
    """Standard scaling of the columns, their principal components, and the first of those that keep the share of variance.

    The pipeline holds its scaler, so rows scored later are scaled as the rows it was fitted on. It can be stored like any other.
    """
    scaler = fit_scaler(df, columns)
    assembler = VectorAssembler(inputCols=list(columns), outputCol="_x")
    scaled = assembler.transform(scaler.transform(df)).select("_x")
    model = PCA(k=len(columns), inputCol="_x", outputCol="_pc").fit(scaled)
    shares = model.explainedVariance.toArray()
    k = min(int((shares.cumsum().round(12) < kept).sum()) + 1, len(columns))
    return PipelineModel([scaler, assembler, model, VectorSlicer(inputCol="_pc", outputCol="_kept", indices=list(range(k)))])


def project_pca(df: DataFrame, model: PipelineModel, keep: Sequence[str] = ()) -> DataFrame:
    """Columns PC1..PCk of the rows, by a fitted pipeline."""
    pc = vector_to_array(F.col("_kept"))
    count = len(model.stages[-1].getIndices())
    carried = df.withColumns({f"_keep{i}": F.col(c) for i, c in enumerate(keep)})  # a kept column may be scaled as well
    return model.transform(carried).select(
        *[F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep)], *[pc[i].alias(f"PC{i + 1}") for i in range(count)])


def training_sets(df: DataFrame, columns: Sequence[str] = V1_FEATURES, target: str = "chunk_size_kb",
                  k: int = 10) -> dict[str, DataFrame]:
    """Four sets with the target: all scaled features, the best by correlation, by F-score, and PCA."""
    # Two lists of at most k names come to the driver; the rows do not.
    known = materialise(stats.moments(df, [*columns, target]), "moments")
    by_corr = [r["feature"] for r in stats.select_by_corr(
        stats.corr_matrix(df, [*columns, target], known), target, columns, k).collect()]
    by_f = [r["feature"] for r in stats.select_by_f(stats.f_scores(df, columns, target, known), k).collect()]
    components = fit_pca(df, columns)
    scaled = components.stages[0].transform(df.select(*columns, target))
    return {
        "full": scaled.select(*columns, target),
        "correlation": scaled.select(*by_corr, target),
        "fscore": scaled.select(*by_f, target),
        "pca": project_pca(df.select(*columns, target), components, keep=[target]),
    }
