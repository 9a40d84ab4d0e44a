"""Hospital roll-ups and signals.

Each roll-up is a single `groupBy` with conditional aggregates: the share of
ERR > 1 is computed in the same pass as the means (no second group-by and join).
Partial aggregation runs before every shuffle, so a hot key costs one row per
map task."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col_of, err_class, signal_band
from ..functions.constants import PERSISTENT_MIN_CONDITIONS, STATE_MIN_RECORDS

ERR = "Excess Readmission Ratio"
PRED = "Predicted Readmission Rate"
EXP = "Expected Readmission Rate"
HOSPITAL_KEYS = ("Facility ID", "Facility Name", "State")


def _share_above_1() -> F.Column:
    e = col_of(ERR)
    # NULL when the group has no valid ERR
    return F.avg(F.when(e.isNotNull(), (e > 1).cast("double"))) * 100


def condition_summary(df: DataFrame) -> DataFrame:
    """Per condition (NULL condition dropped): valid count, mean / median ERR,
    mean predicted / expected rate over all rows, % ERR > 1 over valid rows.
    Highest mean ERR first, conditions without one last."""
    e = col_of(ERR)
    return (df.where(col_of("Condition").isNotNull())
            .groupBy(col_of("Condition").alias("condition"))
            .agg(F.count(F.lit(1)).alias("records"),
                 F.count(e).alias("valid_err"),
                 F.avg(e).alias("mean_err"),
                 F.median(e).alias("median_err"),
                 F.avg(col_of(PRED)).alias("mean_predicted_rate"),
                 F.avg(col_of(EXP)).alias("mean_expected_rate"),
                 _share_above_1().alias("err_above_1_pct"))
            .orderBy(F.col("mean_err").desc_nulls_last(), "condition"))


def condition_payload(df: DataFrame) -> DataFrame:
    """Condition rows of the summary document: rounded as published, ranked by
    mean predicted rate descending, missing rates last. At most one row per
    mapped condition, so the ranking window is bounded."""
    s = condition_summary(df)
    out = s.select(
        "condition", "records", "valid_err",
        F.round("mean_err", 4).alias("mean_err"),
        F.round("median_err", 4).alias("median_err"),
        F.round("mean_predicted_rate", 4).alias("mean_predicted_rate"),
        F.round("mean_expected_rate", 4).alias("mean_expected_rate"),
        F.round("err_above_1_pct", 1).alias("err_above_1_pct"))
    w = Window.orderBy(F.col("mean_predicted_rate").desc_nulls_last(), F.col("condition"))
    return out.withColumn("display_rank", F.row_number().over(w))


def state_summary(df: DataFrame) -> DataFrame:
    e = col_of(ERR)
    return (df.where(col_of("State").isNotNull())
            .groupBy(col_of("State").alias("state"))
            .agg(F.count_distinct(col_of("Facility ID")).alias("hospitals"),
                 F.count(e).alias("valid_err"),
                 F.avg(e).alias("mean_err"),
                 F.median(e).alias("median_err"),
                 F.avg(col_of(PRED)).alias("mean_predicted_rate"),
                 F.avg(col_of(EXP)).alias("mean_expected_rate"),
                 _share_above_1().alias("err_above_1_pct")))


def state_top(df: DataFrame, min_records: int = STATE_MIN_RECORDS, k: int = 10) -> DataFrame:
    """States with enough valid ERR, highest mean ERR first (top-k report)."""
    return (state_summary(df).where(F.col("valid_err") >= min_records)
            .orderBy(F.col("mean_err").desc(), F.col("state")).limit(k))


def state_extremes(df: DataFrame, min_records: int = STATE_MIN_RECORDS, k: int = 3) -> DataFrame:
    """Highest and lowest k states by mean ERR; two top-k reports unioned."""
    s = state_summary(df).where(F.col("valid_err") >= min_records)
    hi = s.orderBy(F.col("mean_err").desc(), F.col("state")).limit(k).withColumn("end", F.lit("highest"))
    lo = s.orderBy(F.col("mean_err").asc(), F.col("state")).limit(k).withColumn("end", F.lit("lowest"))
    return hi.unionByName(lo)


def hospital_summary(df: DataFrame) -> DataFrame:
    """Per hospital over valid-ERR rows; also carries the strict all-below-1 flag
    so high and low signals come from one group-by."""
    e = col_of(ERR)
    v = df.where(e.isNotNull())
    for k in HOSPITAL_KEYS:  # pandas drops NULL keys (S5)
        v = v.where(col_of(k).isNotNull())
    return v.groupBy(col_of("Facility ID").alias("facility_id"),
                     col_of("Facility Name").alias("facility_name"),
                     col_of("State").alias("state")).agg(
        F.count_distinct(col_of("Condition")).alias("conditions_reported"),
        F.avg(e).alias("mean_err"),
        F.median(e).alias("median_err"),
        F.count_if(e > 1).alias("conditions_err_above_1"),
        F.avg(col_of(PRED)).alias("mean_predicted_rate"),
        F.avg(col_of(EXP)).alias("mean_expected_rate"),
        F.bool_and(e < 1).alias("all_err_below_1"))


def persistent_high(hs: DataFrame, min_conditions: int = PERSISTENT_MIN_CONDITIONS) -> DataFrame:
    """Coverage >= min and (rows with ERR > 1) / (distinct conditions) == 100 %."""
    return (hs.where(F.col("conditions_reported") >= min_conditions)
            .withColumn("high_err_pct", F.col("conditions_err_above_1") / F.col("conditions_reported") * 100)
            .where(F.col("conditions_err_above_1") == F.col("conditions_reported")))


def persistent_low(hs: DataFrame, min_conditions: int = PERSISTENT_MIN_CONDITIONS) -> DataFrame:
    """Coverage >= min and every valid ERR strictly below 1."""
    return hs.where((F.col("conditions_reported") >= min_conditions) & F.col("all_err_below_1"))


def persistent_high_top(hs: DataFrame, k: int = 10) -> DataFrame:
    return persistent_high(hs).orderBy(F.col("mean_err").desc(), F.col("facility_id")).limit(k)


def persistent_low_top(hs: DataFrame, k: int = 10) -> DataFrame:
    return persistent_low(hs).orderBy(F.col("mean_err").asc(), F.col("facility_id")).limit(k)


def signal_counts(hs: DataFrame, min_conditions: int = PERSISTENT_MIN_CONDITIONS) -> DataFrame:
    robust = F.col("conditions_reported") >= min_conditions
    return hs.agg(
        F.count(F.lit(1)).alias("hospitals_with_err"),
        F.count_if(robust).alias("robust_hospitals"),
        F.count_if(robust & (F.col("conditions_err_above_1") == F.col("conditions_reported"))).alias("persistent_high"),
        F.count_if(robust & F.col("all_err_below_1")).alias("persistent_low"))


def with_signal_band(hs: DataFrame) -> DataFrame:
    return hs.withColumn("signal_band", signal_band("mean_err"))


def with_err_class(df: DataFrame) -> DataFrame:
    return df.withColumn("err_class", err_class(ERR))
