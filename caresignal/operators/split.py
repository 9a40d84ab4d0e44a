"""Patient-grouped split and split checks.

The split is a pure function of the patient id (salted md5 bucket), so it needs
no join, no shuffle and no driver-side list of patients, and every row of one
patient lands in the same split by construction."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col_of
from ..functions.constants import SPLIT_SEED, SPLIT_TRAIN_PCT, SPLIT_VALIDATION_PCT

TRAIN, VALIDATION, TEST = "train", "validation", "test"


def patient_bucket(patient: str | Column, seed: int = SPLIT_SEED) -> Column:
    """0..99 from the first 32 bits of md5('<seed>:<patient>')."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), col_of(patient).cast("string")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") % 100


def split_column(patient: str | Column = "patient_nbr", seed: int = SPLIT_SEED,
                 train_pct: int = SPLIT_TRAIN_PCT, validation_pct: int = SPLIT_VALIDATION_PCT) -> Column:
    b = patient_bucket(patient, seed)
    return (F.when(col_of(patient).isNull(), F.lit(None).cast("string"))
            .when(b < train_pct, F.lit(TRAIN))
            .when(b < train_pct + validation_pct, F.lit(VALIDATION))
            .otherwise(F.lit(TEST)))


def patient_split(df: DataFrame, patient: str = "patient_nbr", seed: int = SPLIT_SEED,
                  train_pct: int = SPLIT_TRAIN_PCT, validation_pct: int = SPLIT_VALIDATION_PCT,
                  name: str = "split") -> DataFrame:
    """Adds `split`; rows without a patient belong to no split and are dropped."""
    return (df.withColumn(name, split_column(patient, seed, train_pct, validation_pct))
            .where(F.col(name).isNotNull()))


def split_leakage(df: DataFrame, patient: str = "patient_nbr", split: str = "split") -> DataFrame:
    """Patients seen in more than one split (must be empty)."""
    return (df.groupBy(col_of(patient).alias("patient_nbr"))
            .agg(F.count_distinct(col_of(split)).alias("splits"))
            .where(F.col("splits") > 1))


def split_profile(df: DataFrame, label: str = "label", split: str = "split") -> DataFrame:
    return df.groupBy(col_of(split).alias("split")).agg(
        F.count(F.lit(1)).alias("encounters"),
        F.count_distinct(F.col("patient_nbr")).alias("patients") if "patient_nbr" in df.columns else F.lit(None),
        F.avg(col_of(label).cast("double")).alias("prevalence"))


def fit_frame(df: DataFrame, split: str = "split", splits=(TRAIN, VALIDATION)) -> DataFrame:
    """Train + validation rows for the final fit (row union without a union)."""
    return df.where(col_of(split).isin(list(splits)))
