"""Data audit operators (D1-D7). Each is one aggregation pass."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col_of

ERR = "Excess Readmission Ratio"


def data_audit(df: DataFrame) -> DataFrame:
    """rows, columns, duplicate rows (rows minus distinct rows; NULL equals NULL).

    One grouping on all columns, so the input is derived and read once: copies of a row
    collapse in the map tasks before the shuffle, and a row that a third of the table
    repeats costs one row per map task."""
    copies = df.groupBy(*[col_of(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("_copies"))
    n = F.col("_copies")
    return copies.agg(F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias("rows"),
                      F.lit(len(df.columns)).cast("bigint").alias("columns"),
                      F.coalesce(F.sum(n - 1), F.lit(0)).cast("bigint").alias("duplicate_rows"))


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing cells per column, long form (column_name, missing, missing_share)."""
    cols = list(columns or df.columns)
    keys = [f"c{i}" for i in range(len(cols))]
    wide = df.agg(F.count(F.lit(1)).alias("_n"),
                  *[F.count_if(col_of(c).isNull()).alias(k) for c, k in zip(cols, keys)])
    names = F.create_map(*[x for k, c in zip(keys, cols) for x in (F.lit(k), F.lit(c))])
    long = wide.unpivot(["_n"], keys, "_key", "missing")
    return long.select(names[F.col("_key")].alias("column_name"),
                       F.col("missing").cast("bigint").alias("missing"),
                       (F.col("missing") / F.col("_n")).alias("missing_share"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Counts per value, NULL kept as its own group."""
    return df.groupBy(col_of(column).alias("value")).agg(F.count(F.lit(1)).alias("count"))


def value_counts_long(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(field, value, count) of several text columns in one pass, NULL kept as its own group."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), col_of(c).cast("string").alias("value")) for c in columns]))
    return (df.select(cells.alias("_c")).groupBy(F.col("_c.field").alias("field"), F.col("_c.value").alias("value"))
            .agg(F.count(F.lit(1)).alias("count")))


def footnote_missing(df: DataFrame, footnote: str = "Footnote") -> DataFrame:
    """Per footnote (NULL kept): rows and missing discharges / readmissions / ERR."""
    return df.groupBy(col_of(footnote).alias("footnote")).agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(col_of("Number of Discharges").isNull()).alias("missing_discharges"),
        F.count_if(col_of("Number of Readmissions Numeric").isNull()).alias("missing_readmissions"),
        F.count_if(col_of(ERR).isNull()).alias("missing_excess_ratio"))


def overall_kpis(df: DataFrame) -> DataFrame:
    """Global KPIs in one aggregation; ERR statistics skip missing values."""
    e = col_of(ERR)
    return df.agg(
        F.count(F.lit(1)).alias("records"),
        F.count_distinct(col_of("Facility ID")).alias("hospitals"),
        F.count_distinct(col_of("State")).alias("states_territories"),
        F.count_distinct(col_of("Condition")).alias("conditions"),
        F.count(e).alias("valid_err_records"),
        F.avg(e).alias("mean_err"),
        F.median(e).alias("median_err"),
        F.count_if(e > 1).alias("err_above_1"),
        F.count_if(e < 1).alias("err_below_1"),
        F.count_if(e == 1).alias("err_equal_1"),
        (F.avg(F.when(e.isNotNull(), (e > 1).cast("double"))) * 100).alias("err_above_1_pct"))


def suppression_counts(df: DataFrame, numeric: str = "Number of Readmissions Numeric") -> DataFrame:
    n = col_of(numeric)
    return df.agg(F.count(F.lit(1)).alias("records"),
                  F.count(n).alias("numeric_readmission_records"),
                  F.count_if(n.isNull()).alias("suppressed_or_non_numeric_readmission_records"),
                  F.count_if(col_of("Number of Readmissions") == "Too Few to Report").alias("too_few_to_report"))


def reporting_period(df: DataFrame) -> DataFrame:
    return df.agg(F.min(col_of("Start Date")).alias("period_start"),
                  F.max(col_of("End Date")).alias("period_end"))
