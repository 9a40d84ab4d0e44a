"""Metric documents (A7): benchmark, ablation, drivers and error profiles.

Each is a one-row DataFrame of nested parts for `sinks.write_document`. Every part is
bounded by construction (candidates, feature groups, ranked lists of a fixed length, four
error groups by the focus features) and attached as a scalar subquery. The explanatory
texts a document carries are passed as `texts` {field: text}.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import FOCUS_CATEGORICAL, FOCUS_NUMERIC
from ..operators import errors

GROUPS = ("TP", "FP", "TN", "FN")


def header(version: str = "1.0.0") -> list[Column]:
    return [F.lit(version).alias("schema_version"),
            F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("generated_at_utc")]


def text_fields(texts: Mapping[str, str] | None) -> list[Column]:
    return [F.lit(v).alias(k) for k, v in (texts or {}).items()]


def rows_of(df: DataFrame, order: Sequence[Column] = ()) -> Column:
    """All rows of a bounded table as one array of structs, sorted by `order`."""
    if not order:
        return df.agg(F.collect_list(F.struct(*df.columns)).alias("r")).scalar()
    keyed = F.struct(F.struct(*[o.alias(f"k{i}") for i, o in enumerate(order)]).alias("k"), F.struct(*df.columns).alias("v"))
    return df.agg(F.transform(F.sort_array(F.collect_list(keyed)), lambda s: s["v"]).alias("r")).scalar()


def one_row(df: DataFrame) -> Column:
    return df.select(F.struct(*df.columns).alias("r")).scalar()


def benchmark_document(candidates: DataFrame, winner: DataFrame, winner_test: DataFrame,
                       texts: Mapping[str, str] | None = None) -> DataFrame:
    """Validation candidates in their order, the selected one and its single test evaluation."""
    return candidates.sparkSession.range(1).select(
        *header(), rows_of(candidates, [F.col("candidate_order")]).alias("validation_candidates"),
        one_row(winner).alias("selected_winner"), one_row(winner_test).alias("winner_test"), *text_fields(texts))


def ablation_document(baseline: DataFrame, experiments: DataFrame, texts: Mapping[str, str] | None = None) -> DataFrame:
    """Baseline metrics and the experiments, largest loss of ROC-AUC first."""
    order = [F.col("delta_roc_auc_vs_baseline"), F.col("removed_group")]
    return experiments.sparkSession.range(1).select(
        *header(), one_row(baseline).alias("baseline"), rows_of(experiments, order).alias("experiments"), *text_fields(texts))


def drivers_document(importance: DataFrame, coefficients: DataFrame, dropped_sparse: Sequence[str] = (),
                     texts: Mapping[str, str] | None = None) -> DataFrame:
    """Ranked lists of permutation importance and of encoded coefficients (both already cut to their length)."""
    return importance.sparkSession.range(1).select(
        *header(),
        rows_of(importance, [-F.col("roc_auc_drop_mean"), F.col("feature")]).alias("top_original_features_by_test_roc_auc_drop"),
        rows_of(coefficients, [-F.abs("coefficient"), F.col("encoded_feature")]).alias("top_encoded_logistic_terms_by_absolute_coefficient"),
        F.array(*[F.lit(c) for c in dropped_sparse]).cast("array<string>").alias("dropped_sparse_columns"), *text_fields(texts))


def error_profiles_document(grouped: DataFrame, threshold: Column, numeric: Sequence[str] = FOCUS_NUMERIC,
                            categorical: Sequence[str] = FOCUS_CATEGORICAL, texts: Mapping[str, str] | None = None) -> DataFrame:
    """Per error group: size, mean score, numeric summaries by feature and the most frequent values by feature.

    `grouped` comes from `errors.with_confusion_group`; it is read in three passes, so hand in a stored table."""
    sizes = errors.error_groups(grouped)
    num = errors.error_profile_numeric(grouped, numeric)
    cat = errors.error_profile_categorical(grouped, categorical)
    num_by = num.groupBy("group").agg(F.map_from_entries(F.collect_list(F.struct(
        "feature", F.struct("n_non_null", "mean", "median", "p25", "p75")))).alias("numeric"))
    lists = cat.groupBy("group", "feature").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("rank", "value", "share"))), lambda s: s.dropFields("rank")).alias("top"))
    cat_by = lists.groupBy("group").agg(F.map_from_entries(F.collect_list(F.struct("feature", "top"))).alias("categorical"))
    parts = sizes.join(num_by, "group", "left").join(cat_by, "group", "left").select(
        "group", F.struct("count", "mean_predicted_probability", "numeric", "categorical").alias("v"))
    # all four groups are named, also those without rows
    by_group = parts.agg(F.map_from_entries(F.collect_list(F.struct("group", "v"))).alias("m")).scalar()
    doc = grouped.sparkSession.range(1).select(*header(), threshold.alias("threshold"), by_group.alias("m"), *text_fields(texts))
    return doc.select(*[c for c in doc.columns if c != "m"], F.struct(*[
        F.struct(F.coalesce(F.col("m")[g]["count"], F.lit(0).cast("bigint")).alias("count"),
                 *[F.col("m")[g][c].alias(c) for c in ("mean_predicted_probability", "numeric", "categorical")]).alias(g)
        for g in GROUPS]).alias("groups"))
