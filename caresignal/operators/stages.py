"""Preparation as ML pipeline stages (F8): imputation, scaling, pooling and level numbers live in the same
`PipelineModel` as the estimator and are saved and loaded with it.

`NumericPrep` fits one median, mean and deviation a column. `CategoryIndexer` fits a table (feature, value, label,
index) of all training levels: rare ones share the pooled label. The table stays a table: it is made by distributed
groupings, kept in the session's shared folder, saved as Parquet with the model, and joined when rows are indexed,
broadcast only while it has at most MAX_BROADCAST_LEVELS rows (their number is fitted). The driver holds a mode and a
number of labels per column."""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col_of
from . import features as feats
from .metrics import _materialize

#: Largest level table that is broadcast.
MAX_BROADCAST_LEVELS = 200_000


class _NumericParams(HasInputCols):
    scale = Param(Params._dummy(), "scale", "standardize after imputation", typeConverter=TypeConverters.toBoolean)


class NumericPrep(Estimator, _NumericParams, DefaultParamsReadable, DefaultParamsWritable):
    """Median imputation and, with `scale`, standardization of inputCols into `_n_<column>`."""

    @keyword_only
    def __init__(self, *, inputCols: Sequence[str] = (), scale: bool = True):
        super().__init__()
        self._set(**{k: list(v) if k == "inputCols" else v for k, v in self._input_kwargs.items()})

    def _fit(self, dataset: DataFrame) -> NumericPrepModel:
        cols = self.getInputCols()
        medians, means, stds = {}, {}, {}
        if cols:
            medians = {r["feature"]: r["median"] for r in feats.numeric_medians(dataset, cols).collect()}
            if self.getOrDefault("scale"):
                for r in feats.standardize_stats(dataset, cols, medians).collect():
                    means[r["feature"]], stds[r["feature"]] = r["mean"], r["std"]
        number = lambda d: [math.nan if d.get(c) is None else float(d[c]) for c in cols]
        return NumericPrepModel(inputCols=cols, scale=self.getOrDefault("scale"), medians=number(medians), means=number(means), stds=number(stds))


class NumericPrepModel(Model, _NumericParams, DefaultParamsReadable, DefaultParamsWritable):
    """A narrow projection. A column without a training value becomes 0."""

    medians = Param(Params._dummy(), "medians", "imputed values (NaN: none)", typeConverter=TypeConverters.toListFloat)
    means = Param(Params._dummy(), "means", "subtracted values", typeConverter=TypeConverters.toListFloat)
    stds = Param(Params._dummy(), "stds", "divisors", typeConverter=TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, inputCols: Sequence[str] = (), scale: bool = True, medians: Sequence[float] = (), means: Sequence[float] = (),
                 stds: Sequence[float] = ()):
        super().__init__()
        self._set(**{k: v if k == "scale" else list(v) for k, v in self._input_kwargs.items()})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        out = []
        fitted = zip(self.getInputCols(), *[self.getOrDefault(p) for p in ("medians", "means", "stds")], strict=True)
        for c, median, mean, std in fitted:
            v = F.coalesce(col_of(c).cast("double"), F.lit(None if math.isnan(median) else median))
            if self.getOrDefault("scale"):
                v = (v - F.lit(0.0 if math.isnan(mean) else mean)) / F.lit(std if std > 0 else 1.0)
            out.append(F.coalesce(v, F.lit(0.0)).alias(f"_n_{c}"))
        return dataset.select("*", *out)


class CategoryIndexer(Estimator, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Level numbers of inputCols into `_i_<column>`; levels seen fewer than minFrequency times are pooled."""

    minFrequency = Param(Params._dummy(), "minFrequency", "occurrences that keep a level apart", typeConverter=TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCols: Sequence[str] = (), minFrequency: int = 10):
        super().__init__()
        self._set(**{k: list(v) if k == "inputCols" else v for k, v in self._input_kwargs.items()})

    def _fit(self, dataset: DataFrame) -> CategoryIndexerModel:
        cols = self.getInputCols()
        if not cols:
            return CategoryIndexerModel(inputCols=[], modes=[], sizes=[], rows=0)
        counts = _materialize(feats.category_counts(dataset, cols))
        modes = {r["feature"]: r["mode"] for r in feats.categorical_modes(counts).collect()}
        pooled = feats.category_pooling(dataset, cols, self.getOrDefault("minFrequency"), counts=counts)
        pooled = pooled.select("feature", "value", F.when(F.col("kept"), F.col("value")).otherwise(F.lit(feats.INFREQUENT)).alias("label"))
        order = Window.partitionBy("feature").orderBy("label")
        labels = pooled.select("feature", "label").distinct().withColumn("index", (F.row_number().over(order) - 1).cast("double"))
        levels = _materialize(pooled.join(labels, ["feature", "label"]).select("feature", "value", "label", "index"))
        sizes = {r["feature"]: (r["labels"], r["rows"]) for r in levels.groupBy("feature").agg(
            (F.max("index") + 1).cast("int").alias("labels"), F.count(F.lit(1)).alias("rows")).collect()}
        model = CategoryIndexerModel(inputCols=cols, modes=[modes.get(c) or "" for c in cols], sizes=[sizes.get(c, (0, 0))[0] for c in cols],
                                     rows=sum(n for _, n in sizes.values()))
        model.levels = levels
        return model


class CategoryIndexerModel(Model, HasInputCols, MLReadable, MLWritable):
    """Joins the level table: `_i_<column>` is the label's number; an unseen level, and a missing one of a column
    without any training level, has the number behind the last, which one-hot encoding turns into zeros."""

    modes = Param(Params._dummy(), "modes", "imputed levels", typeConverter=TypeConverters.toListString)
    sizes = Param(Params._dummy(), "sizes", "labels of each column", typeConverter=TypeConverters.toListInt)
    rows = Param(Params._dummy(), "rows", "rows of the level table", typeConverter=TypeConverters.toInt)
    levels: DataFrame | None = None

    @keyword_only
    def __init__(self, *, inputCols: Sequence[str] = (), modes: Sequence[str] = (), sizes: Sequence[int] = (), rows: int = 0):
        super().__init__()
        self._set(**{k: v if k == "rows" else list(v) for k, v in self._input_kwargs.items()})

    def label_counts(self) -> dict[str, int]:
        return dict(zip(self.getInputCols(), self.getOrDefault("sizes"), strict=True))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        small = self.getOrDefault("rows") <= MAX_BROADCAST_LEVELS
        for c, mode, size in zip(self.getInputCols(), self.getOrDefault("modes"), self.getOrDefault("sizes"), strict=True):
            known = {"ml_attr": {"type": "nominal", "num_vals": size + 1}}
            index = F.lit(float(size))
            if size:
                own = self.levels.where(F.col("feature") == c).select(F.col("value").alias("_level"), F.col("index").alias("_index"))
                value = F.coalesce(col_of(c).cast("string"), F.lit(mode))
                dataset = dataset.withColumn("_value", value).join(F.broadcast(own) if small else own, F.col("_value") == F.col("_level"), "left")
                index = F.coalesce("_index", index)
            dataset = dataset.withColumn(f"_i_{c}", index.alias(f"_i_{c}", metadata=known)).drop("_value", "_level", "_index")
        return dataset

    def write(self) -> MLWriter:
        return _LevelWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _LevelReader()


class _LevelWriter(MLWriter):
    def __init__(self, model: CategoryIndexerModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        if self.model.levels is not None:
            self.model.levels.write.parquet(f"{path}/levels")


class _LevelReader(MLReader):
    def load(self, path: str) -> CategoryIndexerModel:
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = CategoryIndexerModel()
        model._resetUid(meta["uid"])
        DefaultParamsReader.getAndSetParams(model, meta)
        if model.getOrDefault("rows"):
            model.levels = self.sparkSession.read.parquet(f"{path}/levels")
        return model


def encoder_stages(numeric: Sequence[str], categorical: Sequence[str], output: str = "features") -> list:
    """One-hot encoding and assembly behind the two preparations."""
    one_hot = [OneHotEncoder(inputCols=[f"_i_{c}" for c in categorical], outputCols=[f"_o_{c}" for c in categorical], dropLast=True)] if categorical else []
    return [*one_hot, VectorAssembler(inputCols=[f"_n_{c}" for c in numeric] + [f"_o_{c}" for c in categorical], outputCol=output)]
