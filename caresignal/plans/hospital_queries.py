"""Registered hospital-analytics queries."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import HRRP_COLUMNS, STATE_MIN_RECORDS
from ..operators import audit, hospital, prepare
from ..sources import fixtures
from ..sources.fixtures import HOSPITAL_FIXTURE_SQL
from .registry import R, finish, register, with_ctes

H = with_ctes(HOSPITAL_FIXTURE_SQL)


def hospital_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.prepare_hospital(fixtures.hospital_raw(spark, sf_dir))


def _hs(spark, sf_dir):
    return hospital.hospital_summary(hospital_table(spark, sf_dir))


# --- B1 / B2 / B3: typed projection -------------------------------------------------
@register("numeric_coerce", H(f"""
SELECT facility_id, measure_name, readmissions_raw AS readmissions_raw, readmissions AS readmissions_numeric,
       {R('discharges')} AS discharges, {R('err')} AS err
FROM hrrp"""))
def q_numeric_coerce(spark, sf_dir):
    h = hospital_table(spark, sf_dir)
    return finish(h.select(F.col("`Facility ID`").alias("facility_id"),
                           F.col("`Measure Name`").alias("measure_name"),
                           F.col("`Number of Readmissions`").alias("readmissions_raw"),
                           F.col("`Number of Readmissions Numeric`").alias("readmissions_numeric"),
                           F.col("`Number of Discharges`").alias("discharges"),
                           F.col("`Excess Readmission Ratio`").alias("err")))


@register("condition_map", H("""
SELECT measure_name, condition, CAST(count(*) AS BIGINT) AS records FROM hrrp GROUP BY ALL"""))
def q_condition_map(spark, sf_dir):
    h = hospital_table(spark, sf_dir)
    return h.groupBy(F.col("`Measure Name`").alias("measure_name"),
                     F.col("Condition").alias("condition")).agg(F.count(F.lit(1)).alias("records"))


@register("date_typing", H("""
SELECT facility_id, measure_name, start_date, end_date FROM hrrp"""))
def q_date_typing(spark, sf_dir):
    h = hospital_table(spark, sf_dir)
    return h.select(F.col("`Facility ID`").alias("facility_id"), F.col("`Measure Name`").alias("measure_name"),
                    F.col("`Start Date`").alias("start_date"), F.col("`End Date`").alias("end_date"))


# --- C1: valid subsets ---------------------------------------------------------------
@register("valid_subset", H("""
SELECT 'err' AS subset, CAST(count(*) FILTER (WHERE err IS NOT NULL) AS BIGINT) AS rows FROM hrrp
UNION ALL SELECT 'discharges', CAST(count(*) FILTER (WHERE discharges IS NOT NULL) AS BIGINT) FROM hrrp
UNION ALL SELECT 'readmissions', CAST(count(*) FILTER (WHERE readmissions IS NOT NULL) AS BIGINT) FROM hrrp"""))
def q_valid_subset(spark, sf_dir):
    h = hospital_table(spark, sf_dir)
    return prepare.valid_counts(h, {"err": "Excess Readmission Ratio", "discharges": "Number of Discharges",
                                    "readmissions": "Number of Readmissions Numeric"})


# --- C6: slicers ----------------------------------------------------------------------
SLICE_CONDITIONS = ("Heart Failure (HF)", "COPD", "Pneumonia")


@register("kpi_slice", H(f"""
SELECT state, CAST(count(*) AS BIGINT) AS records, CAST(count(err) AS BIGINT) AS valid_err,
       {R('avg(err)')} AS mean_err
FROM hrrp WHERE condition IN ('Heart Failure (HF)', 'COPD', 'Pneumonia') GROUP BY state"""))
def q_kpi_slice(spark, sf_dir):
    # slice the stored text columns, then type (see kpi_slice)
    h = prepare.prepare_hospital(prepare.kpi_slice(fixtures.hospital_raw(spark, sf_dir), conditions=SLICE_CONDITIONS))
    e = F.col("`Excess Readmission Ratio`")
    return finish(h.groupBy(F.col("State").alias("state")).agg(
        F.count(F.lit(1)).alias("records"), F.count(e).alias("valid_err"), F.avg(e).alias("mean_err")))


# --- A5 / B4: clean export ------------------------------------------------------------
@register("clean_export", H(f"""
SELECT facility_id AS Facility_ID, facility_name AS Facility_Name, state AS State, condition AS Condition,
       {R('discharges')} AS Number_of_Discharges, {R('readmissions')} AS Number_of_Readmissions,
       {R('err')} AS Excess_Readmission_Ratio, {R('predicted')} AS Predicted_Readmission_Rate,
       {R('expected')} AS Expected_Readmission_Rate, start_date AS Start_Date, end_date AS End_Date
FROM hrrp"""))
def q_clean_export(spark, sf_dir):
    return finish(prepare.clean_export(hospital_table(spark, sf_dir)))


# --- D1-D7: audit -----------------------------------------------------------------------
@register("data_audit", H("""
SELECT CAST(count(*) AS BIGINT) AS rows, CAST(14 AS BIGINT) AS columns,
       CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM hrrp)) AS BIGINT) AS duplicate_rows
FROM hrrp"""))
def q_data_audit(spark, sf_dir):
    return audit.data_audit(hospital_table(spark, sf_dir))


_NULL_PROFILE_COLS = (
    ("Facility Name", "facility_name"), ("Facility ID", "facility_id"), ("State", "state"),
    ("Measure Name", "measure_name"), ("Number of Discharges", "discharges"), ("Footnote", "footnote"),
    ("Excess Readmission Ratio", "err"), ("Predicted Readmission Rate", "predicted"),
    ("Expected Readmission Rate", "expected"), ("Number of Readmissions", "readmissions_raw"),
    ("Start Date", "start_date"), ("End Date", "end_date"),
    ("Number of Readmissions Numeric", "readmissions"), ("Condition", "condition"),
)
assert tuple(c for c, _ in _NULL_PROFILE_COLS[:12]) == HRRP_COLUMNS


@register("null_profile", H("\nUNION ALL\n".join(
    f"SELECT '{src}' AS column_name, CAST(count(*) FILTER (WHERE {col} IS NULL) AS BIGINT) AS missing, "
    f"{R(f'count(*) FILTER (WHERE {col} IS NULL) / count(*)')} AS missing_share FROM hrrp"
    for src, col in _NULL_PROFILE_COLS)))
def q_null_profile(spark, sf_dir):
    return finish(audit.null_profile(hospital_table(spark, sf_dir)))


@register("value_counts", H("""
SELECT 'Measure Name' AS field, measure_name AS value, CAST(count(*) AS BIGINT) AS count FROM hrrp GROUP BY measure_name
UNION ALL
SELECT 'Footnote', footnote, CAST(count(*) AS BIGINT) FROM hrrp GROUP BY footnote"""))
def q_value_counts(spark, sf_dir):
    h = hospital_table(spark, sf_dir)
    return audit.value_counts_long(h, ["Measure Name", "Footnote"])


@register("footnote_missing", H("""
SELECT footnote, CAST(count(*) AS BIGINT) AS total_rows,
       CAST(count(*) FILTER (WHERE discharges IS NULL) AS BIGINT) AS missing_discharges,
       CAST(count(*) FILTER (WHERE readmissions IS NULL) AS BIGINT) AS missing_readmissions,
       CAST(count(*) FILTER (WHERE err IS NULL) AS BIGINT) AS missing_excess_ratio
FROM hrrp GROUP BY footnote"""))
def q_footnote_missing(spark, sf_dir):
    return audit.footnote_missing(hospital_table(spark, sf_dir))


_OVERALL_SQL = f"""
SELECT CAST(count(*) AS BIGINT) AS records,
       CAST(count(DISTINCT facility_id) AS BIGINT) AS hospitals,
       CAST(count(DISTINCT state) AS BIGINT) AS states_territories,
       CAST(count(DISTINCT condition) AS BIGINT) AS conditions,
       CAST(count(err) AS BIGINT) AS valid_err_records,
       {R('avg(err)')} AS mean_err, {R('median(err)')} AS median_err,
       CAST(count(*) FILTER (WHERE err > 1) AS BIGINT) AS err_above_1,
       CAST(count(*) FILTER (WHERE err < 1) AS BIGINT) AS err_below_1,
       CAST(count(*) FILTER (WHERE err = 1) AS BIGINT) AS err_equal_1,
       {R('100.0 * count(*) FILTER (WHERE err > 1) / count(err)')} AS err_above_1_pct
FROM hrrp"""


@register("overall_kpis", H(_OVERALL_SQL))
def q_overall_kpis(spark, sf_dir):
    return finish(audit.overall_kpis(hospital_table(spark, sf_dir)))


@register("suppression_counts", H("""
SELECT CAST(count(*) AS BIGINT) AS records,
       CAST(count(readmissions) AS BIGINT) AS numeric_readmission_records,
       CAST(count(*) FILTER (WHERE readmissions IS NULL) AS BIGINT) AS suppressed_or_non_numeric_readmission_records,
       CAST(count(*) FILTER (WHERE readmissions_raw = 'Too Few to Report') AS BIGINT) AS too_few_to_report
FROM hrrp"""))
def q_suppression_counts(spark, sf_dir):
    return audit.suppression_counts(hospital_table(spark, sf_dir))


@register("reporting_period", H("""
SELECT min(start_date) AS period_start, max(end_date) AS period_end FROM hrrp"""))
def q_reporting_period(spark, sf_dir):
    return audit.reporting_period(hospital_table(spark, sf_dir))


# --- D8-D10: condition and state ------------------------------------------------------
_COND_RAW = """
SELECT condition, CAST(count(*) AS BIGINT) AS records, CAST(count(err) AS BIGINT) AS valid_err,
       avg(err) AS mean_err, median(err) AS median_err,
       avg(predicted) AS mean_predicted_rate, avg(expected) AS mean_expected_rate,
       100.0 * count(*) FILTER (WHERE err > 1) / nullif(count(err), 0) AS err_above_1_pct
FROM hrrp WHERE condition IS NOT NULL GROUP BY condition"""


@register("condition_summary", H(f"""
SELECT condition, records, valid_err, {R('mean_err')} AS mean_err, {R('median_err')} AS median_err,
       {R('mean_predicted_rate')} AS mean_predicted_rate, {R('mean_expected_rate')} AS mean_expected_rate,
       {R('err_above_1_pct')} AS err_above_1_pct
FROM ({_COND_RAW}) c"""))
def q_condition_summary(spark, sf_dir):
    return finish(hospital.condition_summary(hospital_table(spark, sf_dir)))


@register("condition_payload", H(f"""
SELECT condition, records, valid_err, {R('mean_err', 4)} AS mean_err, {R('median_err', 4)} AS median_err,
       {R('mean_predicted_rate', 4)} AS mean_predicted_rate, {R('mean_expected_rate', 4)} AS mean_expected_rate,
       {R('err_above_1_pct', 1)} AS err_above_1_pct,
       CAST(row_number() OVER (ORDER BY {R('mean_predicted_rate', 4)} DESC NULLS LAST, condition) AS INTEGER)
         AS display_rank
FROM ({_COND_RAW}) c"""))
def q_condition_payload(spark, sf_dir):
    return finish(hospital.condition_payload(hospital_table(spark, sf_dir)))


_STATE_SQL = """
SELECT state, CAST(count(DISTINCT facility_id) AS BIGINT) AS hospitals, CAST(count(err) AS BIGINT) AS valid_err,
       avg(err) AS mean_err, median(err) AS median_err, avg(predicted) AS mean_predicted_rate,
       avg(expected) AS mean_expected_rate,
       100.0 * count(*) FILTER (WHERE err > 1) / nullif(count(err), 0) AS err_above_1_pct
FROM hrrp WHERE state IS NOT NULL GROUP BY state"""
_STATE_COLS = (f"state, hospitals, valid_err, {R('mean_err')} AS mean_err, {R('median_err')} AS median_err, "
               f"{R('mean_predicted_rate')} AS mean_predicted_rate, {R('mean_expected_rate')} AS mean_expected_rate, "
               f"{R('err_above_1_pct')} AS err_above_1_pct")


@register("state_summary", H(f"SELECT {_STATE_COLS} FROM ({_STATE_SQL}) s"))
def q_state_summary(spark, sf_dir):
    return finish(hospital.state_summary(hospital_table(spark, sf_dir)))


@register("state_top", H(f"""
SELECT {_STATE_COLS} FROM ({_STATE_SQL}) s WHERE valid_err >= {STATE_MIN_RECORDS}
ORDER BY mean_err DESC, state LIMIT 10"""))
def q_state_top(spark, sf_dir):
    return finish(hospital.state_top(hospital_table(spark, sf_dir)))


@register("state_extremes", H(f"""
(SELECT {_STATE_COLS}, 'highest' AS "end" FROM ({_STATE_SQL}) s WHERE valid_err >= {STATE_MIN_RECORDS}
 ORDER BY mean_err DESC, state LIMIT 3)
UNION ALL
(SELECT {_STATE_COLS}, 'lowest' AS "end" FROM ({_STATE_SQL}) s WHERE valid_err >= {STATE_MIN_RECORDS}
 ORDER BY mean_err ASC, state LIMIT 3)"""))
def q_state_extremes(spark, sf_dir):
    return finish(hospital.state_extremes(hospital_table(spark, sf_dir)))


# --- D11-D14, E3, E4, B13 -----------------------------------------------------------------
_HS_SQL = """
SELECT facility_id, facility_name, state,
       CAST(count(DISTINCT condition) AS BIGINT) AS conditions_reported,
       avg(err) AS mean_err, median(err) AS median_err,
       CAST(count(*) FILTER (WHERE err > 1) AS BIGINT) AS conditions_err_above_1,
       avg(predicted) AS mean_predicted_rate, avg(expected) AS mean_expected_rate,
       bool_and(err < 1) AS all_err_below_1
FROM hrrp
WHERE err IS NOT NULL AND facility_id IS NOT NULL AND facility_name IS NOT NULL AND state IS NOT NULL
GROUP BY facility_id, facility_name, state"""
_HS_COLS = (f"facility_id, facility_name, state, conditions_reported, {R('mean_err')} AS mean_err, "
            f"{R('median_err')} AS median_err, conditions_err_above_1, "
            f"{R('mean_predicted_rate')} AS mean_predicted_rate, {R('mean_expected_rate')} AS mean_expected_rate, "
            f"all_err_below_1")
_HIGH_WHERE = "conditions_reported >= 5 AND conditions_err_above_1 = conditions_reported"
_LOW_WHERE = "conditions_reported >= 5 AND all_err_below_1"
_HIGH_PCT = f"{R('100.0 * conditions_err_above_1 / conditions_reported')} AS high_err_pct"


@register("hospital_summary", H(f"SELECT {_HS_COLS} FROM ({_HS_SQL}) h"))
def q_hospital_summary(spark, sf_dir):
    return finish(_hs(spark, sf_dir))


@register("persistent_high", H(f"SELECT {_HS_COLS}, {_HIGH_PCT} FROM ({_HS_SQL}) h WHERE {_HIGH_WHERE}"))
def q_persistent_high(spark, sf_dir):
    return finish(hospital.persistent_high(_hs(spark, sf_dir)))


@register("persistent_low", H(f"SELECT {_HS_COLS} FROM ({_HS_SQL}) h WHERE {_LOW_WHERE}"))
def q_persistent_low(spark, sf_dir):
    return finish(hospital.persistent_low(_hs(spark, sf_dir)))


@register("persistent_high_top", H(f"""
SELECT {_HS_COLS}, {_HIGH_PCT} FROM ({_HS_SQL}) h WHERE {_HIGH_WHERE}
ORDER BY mean_err DESC, facility_id LIMIT 10"""))
def q_persistent_high_top(spark, sf_dir):
    return finish(hospital.persistent_high_top(_hs(spark, sf_dir)))


@register("persistent_low_top", H(f"""
SELECT {_HS_COLS} FROM ({_HS_SQL}) h WHERE {_LOW_WHERE} ORDER BY mean_err ASC, facility_id LIMIT 10"""))
def q_persistent_low_top(spark, sf_dir):
    return finish(hospital.persistent_low_top(_hs(spark, sf_dir)))


@register("signal_counts", H(f"""
SELECT CAST(count(*) AS BIGINT) AS hospitals_with_err,
       CAST(count(*) FILTER (WHERE conditions_reported >= 5) AS BIGINT) AS robust_hospitals,
       CAST(count(*) FILTER (WHERE {_HIGH_WHERE}) AS BIGINT) AS persistent_high,
       CAST(count(*) FILTER (WHERE {_LOW_WHERE}) AS BIGINT) AS persistent_low
FROM ({_HS_SQL}) h"""))
def q_signal_counts(spark, sf_dir):
    return hospital.signal_counts(_hs(spark, sf_dir))


@register("signal_band", H(f"""
SELECT facility_id, {R('mean_err')} AS mean_err,
       CASE WHEN mean_err > 1.05 THEN 'Elevated readmission signal'
            WHEN mean_err < 0.98 THEN 'Lower readmission signal'
            WHEN mean_err IS NOT NULL THEN 'Near expected' END AS signal_band
FROM ({_HS_SQL}) h"""))
def q_signal_band(spark, sf_dir):
    return finish(hospital.with_signal_band(_hs(spark, sf_dir)).select("facility_id", "mean_err", "signal_band"))


@register("err_class", H("""
SELECT CASE WHEN err < 1 THEN 'below_expected' WHEN err = 1 THEN 'as_expected'
            WHEN err > 1 THEN 'above_expected' END AS err_class,
       CAST(count(*) AS BIGINT) AS records
FROM hrrp GROUP BY 1"""))
def q_err_class(spark, sf_dir):
    h = hospital.with_err_class(hospital_table(spark, sf_dir))
    return h.groupBy("err_class").agg(F.count(F.lit(1)).alias("records"))


# --- A6: hospital summary document (its KPI block, flat) --------------------------------------
@register("hrrp_summary_doc", H(f"""
SELECT k.records, k.hospitals, k.states_territories, k.conditions, k.valid_err_records,
       {R('k.mean_err', 3)} AS mean_err, {R('k.median_err', 3)} AS median_err,
       {R('k.err_above_1_pct', 1)} AS err_above_1_pct,
       CAST(k.records - (SELECT count(*) FROM (SELECT DISTINCT * FROM hrrp)) AS BIGINT) AS duplicate_rows,
       s.numeric_readmission_records, s.suppressed_or_non_numeric_readmission_records,
       c.persistent_high AS persistent_high_err_hospitals, c.persistent_low AS persistent_low_err_hospitals,
       CAST(5 AS BIGINT) AS persistent_signal_min_conditions,
       CAST(p.period_start AS VARCHAR) AS reporting_period_start, CAST(p.period_end AS VARCHAR) AS reporting_period_end
FROM (SELECT count(*) AS records, count(DISTINCT facility_id) AS hospitals, count(DISTINCT state) AS states_territories,
             count(DISTINCT condition) AS conditions, count(err) AS valid_err_records, avg(err) AS mean_err,
             median(err) AS median_err, 100.0 * count(*) FILTER (WHERE err > 1) / count(err) AS err_above_1_pct
      FROM hrrp) k0
CROSS JOIN LATERAL (SELECT CAST(k0.records AS BIGINT) AS records, CAST(k0.hospitals AS BIGINT) AS hospitals,
      CAST(k0.states_territories AS BIGINT) AS states_territories, CAST(k0.conditions AS BIGINT) AS conditions,
      CAST(k0.valid_err_records AS BIGINT) AS valid_err_records, k0.mean_err, k0.median_err, k0.err_above_1_pct) k
CROSS JOIN (SELECT CAST(count(readmissions) AS BIGINT) AS numeric_readmission_records,
                   CAST(count(*) FILTER (WHERE readmissions IS NULL) AS BIGINT) AS suppressed_or_non_numeric_readmission_records
            FROM hrrp) s
CROSS JOIN (SELECT CAST(count(*) FILTER (WHERE {_HIGH_WHERE}) AS BIGINT) AS persistent_high,
                   CAST(count(*) FILTER (WHERE {_LOW_WHERE}) AS BIGINT) AS persistent_low FROM ({_HS_SQL}) h) c
CROSS JOIN (SELECT min(start_date) AS period_start, max(end_date) AS period_end FROM hrrp) p"""))
def q_hrrp_summary_doc(spark, sf_dir):
    from ..sources.sinks import hrrp_summary_document
    # the input is derived from lineitem/part/supplier/nation: checkpoint it once
    doc = hrrp_summary_document(hospital_table(spark, sf_dir), source_file="driver-tables", materialize=True)
    return doc.select("kpis.*", F.col("source.reporting_period.start").alias("reporting_period_start"),
                      F.col("source.reporting_period.end").alias("reporting_period_end"))


@register("hrrp_summary_conditions", H(f"""
SELECT condition, records, valid_err, {R('mean_err', 4)} AS mean_err, {R('median_err', 4)} AS median_err,
       {R('mean_predicted_rate', 4)} AS mean_predicted_rate, {R('mean_expected_rate', 4)} AS mean_expected_rate,
       {R('err_above_1_pct', 1)} AS err_above_1_pct,
       CAST(row_number() OVER (ORDER BY {R('mean_predicted_rate', 4)} DESC NULLS LAST, condition) - 1 AS INTEGER) AS position
FROM ({_COND_RAW}) c"""))
def q_hrrp_summary_conditions(spark, sf_dir):
    """The condition rows nested in the summary document, in the document's order."""
    from ..sources.sinks import hrrp_summary_document
    doc = hrrp_summary_document(hospital_table(spark, sf_dir), source_file="driver-tables", materialize=True)
    return finish(doc.select(F.posexplode("conditions").alias("position", "c")).select("position", "c.*"))
