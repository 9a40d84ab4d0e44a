"""Typing, cleaning and projection operators."""
from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col_of, condition_name, null_tokens, numeric_coerce, parse_date
from ..functions.constants import (
    CLEAN_EXPORT_COLUMNS,
    DEFAULT_NULL_TOKENS,
    ENCOUNTER_EXTRA_NULL_TOKENS,
    HRRP_NUMERIC_COLUMNS,
    ID_COLUMNS,
    MEASURE_CONDITIONS,
    POSITIVE_TARGET,
    TARGET_COLUMN,
)

ERR = "Excess Readmission Ratio"
READM_NUM = "Number of Readmissions Numeric"


def apply_null_tokens(df: DataFrame, tokens: Iterable[str] = DEFAULT_NULL_TOKENS) -> DataFrame:
    """Every string column: a cell equal to a missing-value token becomes NULL."""
    tokens = list(tokens)
    return df.select([
        null_tokens(f.name, tokens).alias(f.name) if isinstance(f.dataType, T.StringType)
        else F.col(f"`{f.name}`") for f in df.schema.fields])


def prepare_hospital(raw: DataFrame) -> DataFrame:
    """Raw hospital-condition text table -> typed table.

    Raw values are kept; `Number of Readmissions Numeric` holds the parsed count
    (suppressed text becomes NULL, never zero), `Condition` the mapped name, dates
    are typed strictly. One narrow projection; no shuffle.
    """
    df = apply_null_tokens(raw)
    typed = []
    for name in df.columns:
        if name in HRRP_NUMERIC_COLUMNS:
            typed.append(numeric_coerce(name).alias(name))
        elif name in ("Start Date", "End Date"):
            typed.append(parse_date(name).alias(name))
        else:
            typed.append(col_of(name))
    typed.append(numeric_coerce("Number of Readmissions").alias(READM_NUM))
    typed.append(condition_name("Measure Name").alias("Condition"))
    return df.select(typed)


def valid_subset(df: DataFrame, column: str = ERR) -> DataFrame:
    """Rows whose measure is present (ERR, discharges or numeric readmissions)."""
    return df.where(col_of(column).isNotNull())


def valid_counts(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """(subset, rows): size of the valid subset of each column {subset name: column}, one pass."""
    return (df.agg(*[F.count(col_of(c)).alias(name) for name, c in columns.items()])
            .unpivot([], list(columns), "subset", "rows"))


def kpi_slice(df: DataFrame, states: Sequence[str] | None = None,
              conditions: Sequence[str] | None = None,
              facilities: Sequence[str] | None = None) -> DataFrame:
    """Dashboard slicers. Conditions are translated back to measure codes so the
    predicate is on a stored column. Apply it to the scanned table before
    `prepare_hospital` (as `hrrp_scan(..., conditions=...)` does): the typing
    projection rewrites every text column, after which no predicate can reach
    the Parquet scan."""
    out = df
    if states is not None:
        out = out.where(F.col("State").isin(list(states)))
    if conditions is not None:
        codes = [c for c, name in MEASURE_CONDITIONS if name in set(conditions)]
        out = out.where(F.col("`Measure Name`").isin(codes))
    if facilities is not None:
        out = out.where(F.col("`Facility Name`").isin(list(facilities)))
    return out


def clean_export(df: DataFrame) -> DataFrame:
    """11 analysis columns with export names, in order."""
    return df.select([col_of(src).alias(dst) for src, dst in CLEAN_EXPORT_COLUMNS])


# ---------------------------------------------------------------------------
# Encounters
# ---------------------------------------------------------------------------

def prepare_encounters(raw: DataFrame, numeric: Sequence[str] | None = None) -> DataFrame:
    """Apply encounter null tokens to text columns; optionally cast named columns
    to double with coercion (for text-typed sources such as CSV)."""
    df = apply_null_tokens(raw, list(DEFAULT_NULL_TOKENS) + list(ENCOUNTER_EXTRA_NULL_TOKENS))
    if numeric:
        num = set(numeric)
        df = df.select([numeric_coerce(c).alias(c) if c in num and
                        isinstance(df.schema[c].dataType, T.StringType) else col_of(c)
                        for c in df.columns])
    return df


def encounter_label(df: DataFrame, target: str = TARGET_COLUMN, label: str = "label") -> DataFrame:
    """Binary target: `<30` -> 1, anything else (NULL included) -> 0."""
    return df.withColumn(label, F.when(col_of(target) == POSITIVE_TARGET, 1).otherwise(0))


def feature_frame(df: DataFrame, drop: Sequence[str] = (TARGET_COLUMN, *ID_COLUMNS)) -> DataFrame:
    """Drop ids and target (leakage control)."""
    return df.drop(*[c for c in drop if c in df.columns])


def sparse_columns(df: DataFrame, features: Sequence[str], max_share: float = 0.80) -> DataFrame:
    """(column, missing_share, dropped) from ONE aggregation pass over `df`."""
    agg = df.agg(*[F.avg(col_of(c).isNull().cast("double")).alias(c) for c in features])
    long = agg.unpivot([], list(features), "column", "missing_share")
    return long.withColumn("dropped", F.col("missing_share") > F.lit(max_share))


def feature_types(df: DataFrame, features: Sequence[str] | None = None) -> dict[str, str]:
    """numeric / categorical decided from the schema (no job)."""
    feats = features or df.columns
    out = {}
    for c in feats:
        t = df.schema[c].dataType
        out[c] = "numeric" if isinstance(t, T.NumericType) else "categorical"
    return out


def align_columns(df: DataFrame, columns: Sequence[str], types: Mapping[str, str] | None = None) -> DataFrame:
    """Reorder to `columns`; absent columns become typed NULLs."""
    sel = []
    for c in columns:
        if c in df.columns:
            sel.append(col_of(c))
        else:
            t = "double" if types and types.get(c) == "numeric" else "string"
            sel.append(F.lit(None).cast(t).alias(c))
    extra = [col_of(c) for c in df.columns if c not in set(columns) and c.startswith("_")]
    return df.select(sel + extra)


def drop_features(df: DataFrame, drop: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Remove a named feature group; returns the frame and the columns removed."""
    present = [c for c in drop if c in df.columns]
    return df.drop(*present), present
