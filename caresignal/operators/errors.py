"""Error profiles of a scored table.

Feature columns are unpivoted to long form so all features are profiled by one
group-by instead of one job per column."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col_of, confusion_label
from ..functions.constants import CATEGORICAL_TOP_K, FOCUS_CATEGORICAL, FOCUS_NUMERIC
from .quantiles import exact_quantiles


def with_confusion_group(df: DataFrame, threshold: float | Column, label: str = "y",
                         score: str = "p", name: str = "group") -> DataFrame:
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    pred = (col_of(score) >= t).cast("int")
    return df.withColumn(name, confusion_label(col_of(label), pred))


def error_groups(df: DataFrame, score: str = "p", group: str = "group") -> DataFrame:
    return df.groupBy(col_of(group).alias("group")).agg(
        F.count(F.lit(1)).alias("count"),
        F.round(F.avg(col_of(score)), 4).alias("mean_predicted_probability"))


def error_profile_numeric(df: DataFrame, features: Sequence[str] = FOCUS_NUMERIC,
                          group: str = "group") -> DataFrame:
    """Per (group, feature): non-null n, mean, median, p25, p75 (exact, linear)."""
    feats = [c for c in features if c in df.columns]
    long = df.select(col_of(group).alias("group"),
                     *[col_of(c).cast("double").alias(c) for c in feats]) \
        .unpivot(["group"], feats, "feature", "value")
    v = F.col("value")
    means = long.groupBy("group", "feature").agg(F.count(v).alias("n_non_null"), F.round(F.avg(v), 4).alias("mean"))
    q = exact_quantiles(long, ["group", "feature"], [0.5, 0.25, 0.75]).withColumnRenamed("quantiles", "_q")
    return means.join(q, ["group", "feature"], "left").select(
        "group", "feature", "n_non_null", "mean",
        F.round(F.col("_q")[0], 4).alias("median"),
        F.round(F.col("_q")[1], 4).alias("p25"),
        F.round(F.col("_q")[2], 4).alias("p75"))


def error_profile_categorical(df: DataFrame, features: Sequence[str] = FOCUS_CATEGORICAL,
                              group: str = "group", k: int = CATEGORICAL_TOP_K) -> DataFrame:
    """Per (group, feature): the k most frequent values (missing as `MISSING`) and
    their share of the group; ties broken by value."""
    feats = [c for c in features if c in df.columns]
    long = df.select(col_of(group).alias("group"),
                     *[F.coalesce(col_of(c).cast("string"), F.lit("MISSING")).alias(c) for c in feats]) \
        .unpivot(["group"], feats, "feature", "value")
    cnt = long.groupBy("group", "feature", "value").agg(F.count(F.lit(1)).alias("n"))
    total = cnt.groupBy("group", "feature").agg(F.sum("n").alias("_tot"))
    # the rank has a window of its own, so its limit moves below the shuffle and a task sends k values a group on
    order = Window.partitionBy("group", "feature").orderBy(F.col("n").desc(), F.col("value"))
    top = cnt.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.join(total, ["group", "feature"]).select(
        "group", "feature", "rank", "value", F.round(F.col("n") / F.col("_tot"), 4).alias("share"))
