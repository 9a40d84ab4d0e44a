"""Sinks: clean export (A5), summary document (A6), metric documents.

Documents are one-row DataFrames of nested structs. Their parts are bounded by
construction (one KPI row, at most one row per mapped condition), so they are
assembled with scalar subqueries and written as a single JSON file.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import PERSISTENT_MIN_CONDITIONS
from ..operators import audit, hospital
from ..operators.prepare import clean_export
from .documents import header, text_fields

# FIXED VALUES: document texts
DEFINITIONS = (
    ("err", "Predicted readmission rate divided by expected readmission rate under CMS HRRP methodology."),
    ("err_above_1_pct", "Share of records with a reportable ERR strictly greater than 1."),
    ("persistent_high_err", "Hospital with at least five reportable conditions and ERR > 1 for every reported condition."),
    ("persistent_low_err", "Hospital with at least five reportable conditions and ERR < 1 for every reported condition."),
)
GUARDRAILS = (
    "ERR is a hospital-level risk-adjusted performance signal, not a complete quality score.",
    "Missing or suppressed values are not converted to zero.",
    "This dataset cannot support individual patient readmission probabilities.",
)


def write_clean_export(df: DataFrame, path: str, fmt: str = "csv",
                       partition_by: Sequence[str] | None = None) -> None:
    """Write the 11-column export. `partition_by` lets readers prune but moves those columns from the files
    to the folder names, so CSV files hold all columns only without it."""
    out = clean_export(df)
    w = out.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def hrrp_summary_document(h: DataFrame, source_file: str, materialize: bool = False,
                          publisher: str | None = None, dataset: str | None = None) -> DataFrame:
    """Nested summary document (one row) from the typed hospital table.

    The document reads its input in several passes (KPIs, duplicates, hospital
    signals, condition rows). A stored table is simply scanned again; for an
    expensive derived input pass `materialize=True` to checkpoint it once to the
    shared checkpoint folder instead of recomputing it per pass."""
    if materialize:
        from ..operators.metrics import _materialize
        h = _materialize(h)
    e = F.col("`Excess Readmission Ratio`")
    n = F.col("`Number of Readmissions Numeric`")
    hs = hospital.hospital_summary(h)
    sig = hospital.signal_counts(hs, PERSISTENT_MIN_CONDITIONS)
    dup = audit.data_audit(h).select("duplicate_rows").scalar()
    conds = hospital.condition_payload(h)
    cond_array = conds.agg(F.transform(F.sort_array(F.collect_list(F.struct(
        "display_rank", "condition", "records", "valid_err", "mean_err", "median_err",
        "mean_predicted_rate", "mean_expected_rate", "err_above_1_pct"))),
        lambda s: s.dropFields("display_rank")).alias("c")).scalar()
    base = h.agg(
        F.count(F.lit(1)).alias("records"),
        F.count_distinct(F.col("`Facility ID`")).alias("hospitals"),
        F.count_distinct(F.col("State")).alias("states_territories"),
        F.count_distinct(F.col("Condition")).alias("conditions"),
        F.count(e).alias("valid_err_records"),
        F.round(F.avg(e), 3).alias("mean_err"),
        F.round(F.median(e), 3).alias("median_err"),
        F.round(F.avg(F.when(e.isNotNull(), (e > 1).cast("double"))) * 100, 1).alias("err_above_1_pct"),
        F.count(n).alias("numeric_readmission_records"),
        F.count_if(n.isNull()).alias("suppressed_or_non_numeric_readmission_records"),
        F.min(F.col("`Start Date`")).alias("start"),
        F.max(F.col("`End Date`")).alias("end"))
    kpis = F.struct(
        "records", "hospitals", "states_territories", "conditions", "valid_err_records",
        "mean_err", "median_err", "err_above_1_pct",
        dup.alias("duplicate_rows"),
        "numeric_readmission_records", "suppressed_or_non_numeric_readmission_records",
        sig.select("persistent_high").scalar().alias("persistent_high_err_hospitals"),
        sig.select("persistent_low").scalar().alias("persistent_low_err_hospitals"),
        F.lit(PERSISTENT_MIN_CONDITIONS).cast("bigint").alias("persistent_signal_min_conditions"))
    return base.select(
        *header("1.0.0"),
        F.struct(
            F.lit(publisher).cast("string").alias("publisher"),
            F.lit(dataset).cast("string").alias("dataset"),
            F.lit(source_file).alias("local_source_file"),
            F.struct(F.col("start").cast("string").alias("start"),
                     F.col("end").cast("string").alias("end")).alias("reporting_period"),
            F.lit("hospital-condition record").alias("unit_of_analysis")).alias("source"),
        kpis.alias("kpis"),
        cond_array.alias("conditions"),
        F.struct(*[F.lit(v).alias(k) for k, v in DEFINITIONS]).alias("definitions"),
        F.array(*[F.lit(g) for g in GUARDRAILS]).alias("guardrails"))


def write_document(doc: DataFrame, path: str) -> None:
    """A document is one bounded row: write it as a single JSON file."""
    doc.coalesce(1).write.mode("overwrite").json(path)


def metrics_document(scored: DataFrame, dropped_sparse: Sequence[str] = (), label: str = "y", score: str = "p",
                     split: str = "split", texts: Mapping[str, str] | None = None) -> DataFrame:
    """Training-run metrics document (A7): the caller's `texts` {field: text} (dataset, outcome, model,
    split, policies), split sizes, validation discrimination
    and the threshold chosen there, test discrimination, test metrics at that
    threshold and the test trade-off table. Every part is a bounded row set (one
    row, or one row per grid point) attached as a scalar subquery."""
    from ..operators import metrics
    from ..operators.metrics import _materialize
    # every part reads the same three columns: read the scored table once
    scored = _materialize(scored.select(label, score, split))
    s = F.col(split)
    val, test = scored.where(s == "validation"), scored.where(s == "test")

    disc_fields = ("roc_auc", "pr_auc", "brier_score", "prevalence")

    def disc(df):
        d = metrics.discrimination(df, label, score)
        return d.select(F.struct(*[F.round(c, 4).alias(c) for c in disc_fields]).alias("d")).scalar()

    best = metrics.best_threshold(val, metrics.grid(range(10, 91)), label, score)
    t = best.select("threshold").scalar()
    tm = metrics.threshold_metrics(test, t, label, score)
    table = metrics.threshold_table(test, metrics.grid(range(30, 81, 5)), label, score)
    sizes = scored.groupBy(s.alias("split")).agg(F.count(F.lit(1)).alias("n"))
    n_of = lambda name: sizes.where(F.col("split") == name).select("n").scalar()
    one = scored.sparkSession.range(1).select(disc(val).alias("v"), disc(test).alias("t"))
    flat = lambda d: [F.col(d)[c].alias(c) for c in disc_fields]
    return one.select(
        *header("1.2.0"),
        *text_fields(texts),
        F.struct(n_of("train").alias("train"), n_of("validation").alias("validation"),
                 n_of("test").alias("test")).alias("encounters"),
        F.struct(*flat("v"),
                 F.lit("maximum F1 on validation set").alias("threshold_selected_by"),
                 best.select(F.struct("*")).scalar().alias("selected_threshold")).alias("validation"),
        F.struct(*flat("t"),
                 tm.select(F.struct("*")).scalar().alias("threshold_metrics"),
                 table.agg(F.sort_array(F.collect_list(F.struct("*")))).scalar().alias("threshold_tradeoff_table")
                 ).alias("test"),
        F.array(*[F.lit(c) for c in dropped_sparse]).cast("array<string>").alias(
            "dropped_sparse_columns_gt_80pct_missing_train"))
