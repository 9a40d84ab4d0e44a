"""Feature preparation fitted on the training rows.

Statistics are computed as DataFrames in a few passes: numeric columns and
categorical columns are each unpivoted once. `operators.stages` fits them as
pipeline stages.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col_of
from .quantiles import exact_quantiles

INFREQUENT = "__infrequent__"


def numeric_medians(train: DataFrame, numeric: Sequence[str]) -> DataFrame:
    """(feature, median) -- exact median, NULLs skipped."""
    long = train.select(*[col_of(c).cast("double").alias(c) for c in numeric]) \
        .unpivot([], list(numeric), "feature", "value")
    q = exact_quantiles(long, ["feature"], [0.5]).select("feature", F.col("quantiles")[0].alias("median"))
    # a feature without a value has no median
    names = F.explode(F.array(*[F.lit(c) for c in numeric]))
    return train.sparkSession.range(1).select(names.alias("feature")).join(q, "feature", "left")


def category_counts(train: DataFrame, categorical: Sequence[str]) -> DataFrame:
    """(feature, value, n) over non-missing values, one pass for all features."""
    long = train.select(*[col_of(c).cast("string").alias(c) for c in categorical]) \
        .unpivot([], list(categorical), "feature", "value")
    return long.where(F.col("value").isNotNull()).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))


def categorical_modes(counts: DataFrame) -> DataFrame:
    """(feature, mode, n): most frequent value, smallest value on ties."""
    w = Window.partitionBy("feature").orderBy(F.col("n").desc(), F.col("value"))
    return (counts.withColumn("_r", F.row_number().over(w)).where("_r = 1")
            .select("feature", F.col("value").alias("mode"), "n"))


def standardize_stats(train: DataFrame, numeric: Sequence[str],
                      medians: Mapping[str, float] | DataFrame) -> DataFrame:
    """(feature, mean, std) after median imputation; population std.
    `medians` may be the fitted dict or the (feature, median) DataFrame; the
    latter keeps the whole computation in one lazy plan (one row per feature is
    broadcast)."""
    long = train.select(*[col_of(c).cast("double").alias(c) for c in numeric]) \
        .unpivot([], list(numeric), "feature", "value")
    if isinstance(medians, DataFrame):
        long = long.join(F.broadcast(medians.select("feature", "median")), "feature")
    else:
        m = F.create_map(*[x for k, v in medians.items() for x in (F.lit(k), F.lit(v))])
        long = long.withColumn("median", m[F.col("feature")])
    v = F.coalesce(F.col("value"), F.col("median"))
    return long.groupBy("feature").agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"))


def category_pooling(train: DataFrame, categorical: Sequence[str], min_frequency: int = 10,
                     counts: DataFrame | None = None) -> DataFrame:
    """(feature, value, n, kept): counts after mode imputation; levels seen fewer
    than `min_frequency` times are pooled into one infrequent level (F6).
    `counts` may pass an already computed `category_counts` table."""
    counts = counts if counts is not None else category_counts(train, categorical)
    missing = train.select(*[F.count_if(col_of(c).isNull()).alias(c) for c in categorical]) \
        .unpivot([], list(categorical), "feature", "n_missing")
    modes = categorical_modes(counts).select("feature", "mode")
    # modes and missing counts hold one row per feature (a caller's fixed list)
    x = counts.join(F.broadcast(modes), "feature").join(F.broadcast(missing), "feature")
    n = F.col("n") + F.when(F.col("value") == F.col("mode"), F.col("n_missing")).otherwise(0)
    return x.select("feature", "value", n.alias("n"), (n >= min_frequency).alias("kept"))


def class_weights(train: DataFrame, label: str = "label") -> DataFrame:
    """Balanced class weights n / (classes * n_class)."""
    c = train.groupBy(col_of(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    tot = Window.partitionBy()  # at most two rows
    return c.select("label", "n",
                    (F.sum("n").over(tot) / (F.count(F.lit(1)).over(tot) * F.col("n"))).alias("weight"))
