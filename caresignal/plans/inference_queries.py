"""Registered inference, routing and source queries."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.constants import (
    GLOBAL_DRIVER_FIELDS,
    NUMERIC_FIELDS,
    REGISTRY_MODELS,
    REQUIRED_RESEARCH_FIELDS,
    RESEARCH_THRESHOLD,
)
from ..operators import inference
from ..session import scratch_dir
from ..sources import readers, sinks
from .hospital_queries import H, hospital_table
from ..sources.fixtures import ENCOUNTER_FIXTURE_SQL
from .patient_queries import ENCOUNTER_SPLIT_SQL, E, encounter_table, scored_table
from .registry import R, finish, register, with_ctes

# request payload fields: the encounter features (sparse `weight` is not a model input)
PAYLOAD_FIELDS = ("age", "gender", "admission_type_id", "discharge_disposition_id", "admission_source_id",
                  "time_in_hospital", "medical_specialty", "num_lab_procedures", "num_procedures",
                  "num_medications", "number_outpatient", "number_emergency", "number_inpatient",
                  "diag_1", "diag_2", "diag_3", "number_diagnoses")
FEATURE_TYPES = {c: ("numeric" if c in NUMERIC_FIELDS else "categorical") for c in PAYLOAD_FIELDS}
# (task, unit) requested, by encounter_id % 6
ROUTE_CASES = (
    ("hospital_level_readmission_intelligence", "hospital-condition record"),
    ("patient_30_day_readmission_probability", "patient encounter"),
    ("patient_30_day_readmission_probability", "hospital-condition record"),
    ("external_validation_and_local_calibration", "authorized Dubai sandbox data"),
    ("patient_risk_score", "patient encounter"),
    ("patient_30_day_readmission_probability", "local calibrated encounter"),
)
# a registry row whose probabilities are released, beside the published ones
RELEASED_MODEL = ("local-calibrated-v1", "released", "patient_30_day_readmission_probability", "local encounters",
                  "local calibrated encounter", True, None)


_WRITTEN: dict = {}


def request_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests as they arrive: a stored table. The derived request rows are
    written once per session to the shared scratch folder and scanned back, which
    also cuts their lineage from the encounter derivation."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _WRITTEN:
        path = scratch_dir(spark, "requests")
        # written as derived: a file for each partition of the last join, whole payloads are never shuffled
        derive_requests(spark, sf_dir).write.parquet(path)
        _WRITTEN[key] = path
    return spark.read.parquet(_WRITTEN[key])


def validated_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation results are recorded once (a table in the shared scratch
    folder, as a service log would be); scoring reads the valid rows back with
    the status predicate pushed into the scan."""
    key = ("validated", spark.sparkContext.applicationId, sf_dir)
    if key not in _WRITTEN:
        path = scratch_dir(spark, "validated")
        inference.validate_requests(request_table(spark, sf_dir), PAYLOAD_FIELDS).write.parquet(path)
        _WRITTEN[key] = path
    return spark.read.parquet(_WRITTEN[key])


def derive_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per encounter; encounter_id % 7 plants the error cases:
    0 not acknowledged, 1 unknown field, 2 missing `age`, 3 non-numeric
    `number_inpatient`, 4 empty optional `diag_2`; others valid."""
    e = encounter_table(spark, sf_dir)
    case = F.col("encounter_id") % 7
    planted = {"age": (2, F.lit(None).cast("string")), "number_inpatient": (3, F.lit("two")),
               "diag_2": (4, F.lit(""))}
    keys = [*PAYLOAD_FIELDS, "favorite_color"]
    vals = [F.when(case == planted[c][0], planted[c][1]).otherwise(F.col(c).cast("string"))
            if c in planted else F.col(c).cast("string") for c in PAYLOAD_FIELDS]
    vals.append(F.when(case == 1, F.lit("blue")))
    # absent keys are the NULL entries
    payload = F.map_filter(F.map_from_arrays(F.array(*[F.lit(k) for k in keys]), F.array(*vals)),
                           lambda k, v: v.isNotNull())
    route = F.col("encounter_id") % len(ROUTE_CASES)
    task = F.element_at(F.array(*[F.lit(t) for t, _ in ROUTE_CASES]), (route + 1).cast("int"))
    unit = F.element_at(F.array(*[F.lit(u) for _, u in ROUTE_CASES]), (route + 1).cast("int"))
    return e.select(F.col("encounter_id").alias("request_id"), (case != 0).alias("research_acknowledged"),
                    payload.alias("payload"), task.alias("task"), unit.alias("unit"))


# ---- SQL twins: the same cases written directly on the encounter columns ----------------------
def _missing_list_sql() -> str:
    # required fields that are absent: 'age' is removed in case 2; others absent when NULL
    parts = []
    for f in REQUIRED_RESEARCH_FIELDS:
        cond = f"(k7 = 2 OR {f} IS NULL)" if f == "age" else f"{f} IS NULL"
        parts.append(f"CASE WHEN {cond} THEN '''{f}''' END")
    return f"list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL)"


_REQ_SQL = f"""
req AS (
  SELECT *, encounter_id AS request_id, encounter_id % 7 AS k7, encounter_id % 6 AS route_case,
         {_missing_list_sql()} AS missing_required
  FROM encs),
validated AS (
  SELECT *,
    CASE WHEN k7 = 0 THEN 'Research-only acknowledgement is required.'
         WHEN k7 = 1 THEN 'Unknown fields: [''favorite_color'']'
         WHEN len(missing_required) > 0 THEN 'Missing required research fields: [' || array_to_string(missing_required, ', ') || ']'
         WHEN k7 = 3 THEN 'Field number_inpatient must be numeric.'
    END AS error
  FROM req)
"""
V = with_ctes(ENCOUNTER_FIXTURE_SQL, ENCOUNTER_SPLIT_SQL, _REQ_SQL)


@register("validate_requests", V("""
SELECT request_id, CASE WHEN error IS NULL THEN 'valid' ELSE 'invalid' END AS status, error FROM validated"""))
def q_validate_requests(spark, sf_dir):
    v = inference.validate_requests(request_table(spark, sf_dir), PAYLOAD_FIELDS)
    return v.select("request_id", "status", "error")


def _norm_sql() -> str:
    cols = []
    for c in PAYLOAD_FIELDS:
        if c == "age":
            cols.append("age")
        elif c == "diag_2":
            cols.append("CASE WHEN k7 = 4 THEN NULL ELSE diag_2 END AS diag_2")
        elif FEATURE_TYPES[c] == "numeric":
            cols.append(f"CAST({c} AS DOUBLE) AS {c}")
        else:
            cols.append(c)
    return "SELECT request_id, " + ", ".join(cols) + " FROM validated WHERE error IS NULL"


@register("normalize_requests", V(_norm_sql()))
def q_normalize_requests(spark, sf_dir):
    v = validated_table(spark, sf_dir).where("status = 'valid'")
    return inference.normalize_requests(v, FEATURE_TYPES)


def _drivers_sql() -> str:
    parts = []
    for i, f in enumerate(GLOBAL_DRIVER_FIELDS):
        val = "CASE WHEN k7 = 4 THEN '' ELSE diag_2 END" if f == "diag_2" else f"CAST({f} AS VARCHAR)"
        parts.append(f"SELECT request_id, {i} AS field_order, '{f}' AS feature, {val} AS value "
                     f"FROM validated WHERE error IS NULL")
    u = "\nUNION ALL\n".join(parts)
    return f"""SELECT request_id, CAST(row_number() OVER (PARTITION BY request_id ORDER BY field_order) AS INTEGER)
  AS position, feature, value FROM ({u}) d WHERE value IS NOT NULL AND value <> ''"""


@register("entered_drivers", V(_drivers_sql()))
def q_entered_drivers(spark, sf_dir):
    v = validated_table(spark, sf_dir).where("status = 'valid'")
    d = inference.entered_drivers(v)
    return d.select("request_id", F.posexplode("entered_global_driver_fields").alias("pos", "d")).select(
        "request_id", (F.col("pos") + 1).alias("position"), "d.feature", "d.value")


def _registry_values_sql() -> str:
    rows = []
    for pos, (mid, status, task, src, unit, allowed, _rule) in enumerate((*REGISTRY_MODELS, RELEASED_MODEL)):
        rows.append(f"({pos}, '{mid}', '{task}', '{unit}', {str(allowed).upper()})")
    return "(VALUES " + ", ".join(rows) + ") r(position, id, task, unit_of_analysis, allowed)"


_ROUTE_CASES_SQL = "(VALUES " + ", ".join(f"({i}, '{t}', '{u}')" for i, (t, u) in enumerate(ROUTE_CASES)) + \
    ") c(route_case, task, unit)"


_ROUTED_SQL = f"""
SELECT x.*,
  CASE WHEN model_id IS NULL THEN 'NO VALID ROUTE'
       WHEN task = 'hospital_level_readmission_intelligence' THEN 'ANALYTICS READY'
       WHEN allowed THEN 'PROBABILITY ENABLED' ELSE 'OUTPUT LOCKED' END AS route_status
FROM (
  SELECT q.*, c.task, c.unit,
         (SELECT r.id FROM {_registry_values_sql()} WHERE r.task = c.task AND (r.unit_of_analysis = c.unit OR
             (r.id = 'dubai-nabidh-external-validation' AND c.unit = 'authorized Dubai sandbox data'))
          ORDER BY r.position LIMIT 1) AS model_id,
         (SELECT r.allowed FROM {_registry_values_sql()} WHERE r.task = c.task AND (r.unit_of_analysis = c.unit OR
             (r.id = 'dubai-nabidh-external-validation' AND c.unit = 'authorized Dubai sandbox data'))
          ORDER BY r.position LIMIT 1) AS allowed
  FROM validated q JOIN {_ROUTE_CASES_SQL} ON q.route_case = c.route_case) x"""


@register("route_requests", V(f"SELECT request_id, task, unit, model_id, route_status FROM ({_ROUTED_SQL}) routed"))
def q_route_requests(spark, sf_dir):
    path = scratch_dir(spark, "registry")
    write_registry(spark, path, extra=(RELEASED_MODEL,))
    reg = readers.registry_scan(spark, path)
    r = inference.route_requests(request_table(spark, sf_dir), reg)
    return r.select("request_id", "task", "unit", "model_id", "route_status")


def write_registry(spark: SparkSession, path: str, extra=()) -> None:
    """Registry document (one JSON object with a `models` array)."""
    models = [dict(id=m[0], status=m[1], task=m[2], data_source=m[3], unit_of_analysis=m[4],
                   patient_probability_allowed=m[5], unlock_rule=m[6]) for m in list(REGISTRY_MODELS) + list(extra)]
    schema = T.StructType([readers.REGISTRY_SCHEMA["schema_version"], readers.REGISTRY_SCHEMA["models"]])
    doc = spark.createDataFrame([("1.1.0", models)], schema)
    doc.coalesce(1).write.mode("overwrite").json(path)


# ---- B14: research threshold flag on the deterministic score -------------------------------
@register("research_signal", E(f"""
SELECT split, CASE WHEN p >= {RESEARCH_THRESHOLD}::DOUBLE THEN 'above' ELSE 'below' END AS threshold_signal,
       CAST(count(*) AS BIGINT) AS encounters, {R('avg(round(p, 4))')} AS mean_research_probability
FROM scored GROUP BY ALL"""))
def q_research_signal(spark, sf_dir):
    s = inference.response_rows(scored_table(spark, sf_dir), "fixture-score", "fixture")
    return finish(s.groupBy("split", "threshold_signal").agg(
        F.count(F.lit(1)).alias("encounters"), F.avg("research_probability").alias("mean_research_probability")))


# ---- B17: code tables --------------------------------------------------------------------
def _decode_sql() -> str:
    from ..functions.constants import DIMENSIONS
    parts = []
    for c, pairs in DIMENSIONS:
        if c not in PAYLOAD_FIELDS:
            continue
        case = "CASE CAST(" + c + " AS VARCHAR) " + " ".join(
            f"WHEN '{code}' THEN '{label}'" for code, label in pairs) + " END"
        parts.append(f"SELECT '{c}' AS dimension, CAST({c} AS VARCHAR) AS code, {case} AS label, "
                     f"CAST(count(*) AS BIGINT) AS encounters FROM encs GROUP BY ALL")
    return "\nUNION ALL\n".join(parts)


@register("decode_dims", E(_decode_sql()))
def q_decode_dims(spark, sf_dir):
    from ..functions.constants import DIMENSIONS
    e = inference.decode_dims(encounter_table(spark, sf_dir))
    return inference.dimension_counts(e, [c for c, _ in DIMENSIONS if c in PAYLOAD_FIELDS])


# ---- A1 / A3: CSV sources (fixture written to a scratch folder and read back) ---------------------
@register("hrrp_scan", H(f"""
SELECT facility_name, facility_id, state, measure_name, {R('discharges')} AS number_of_discharges, footnote,
       {R('err')} AS excess_readmission_ratio, {R('predicted')} AS predicted_readmission_rate,
       {R('expected')} AS expected_readmission_rate, readmissions_raw AS number_of_readmissions, start_date, end_date,
       readmissions AS number_of_readmissions_numeric, condition FROM hrrp"""))
def q_hrrp_scan(spark, sf_dir):
    from ..sources import fixtures
    path = scratch_dir(spark, "hrrp-csv")
    fixtures.hospital_raw(spark, sf_dir).write.option("header", True).csv(path)
    h = readers.hrrp_scan(spark, path)
    return finish(h.select([F.col(f"`{c}`").alias(c.lower().replace(" ", "_")) for c in h.columns]))


@register("encounter_scan", E(f"""
SELECT encounter_id, patient_nbr, readmitted, age, gender, medical_specialty, diag_1, diag_2, diag_3, weight,
       {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in NUMERIC_FIELDS)} FROM enc"""))
def q_encounter_scan(spark, sf_dir):
    from ..sources import fixtures
    path = scratch_dir(spark, "encounter-csv")
    fixtures.encounters(spark, sf_dir).write.option("header", True).csv(path)
    return readers.encounter_scan(spark, path)


# ---- A6 sink round trip: the clean export written partitioned and read back with pruning --------------
@register("clean_export_roundtrip", H(f"""
SELECT facility_id AS Facility_ID, facility_name AS Facility_Name, state AS State, condition AS Condition,
       {R('discharges')} AS Number_of_Discharges, {R('readmissions')} AS Number_of_Readmissions,
       {R('err')} AS Excess_Readmission_Ratio, {R('predicted')} AS Predicted_Readmission_Rate,
       {R('expected')} AS Expected_Readmission_Rate, start_date AS Start_Date, end_date AS End_Date
FROM hrrp WHERE condition = 'COPD'"""))
def q_clean_export_roundtrip(spark, sf_dir):
    path = scratch_dir(spark, "export")
    sinks.write_clean_export(hospital_table(spark, sf_dir), path, fmt="parquet", partition_by=("Condition",))
    return finish(spark.read.parquet(path).where(F.col("Condition") == "COPD"))  # partition pruning


# ---- I3 / I5: batch scoring of valid requests with the saved bundle -----------------------------
# `batch_responses` and `stream_response_rows` give full responses; the registered queries keep the
# columns SQL can state and check the probability: in [0, 1], and the signal follows it
def batch_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import models
    from .model_queries import bundle_path
    fm, manifest = models.load_bundle(spark, bundle_path(spark, sf_dir))
    types = manifest["feature_types"]
    expected = manifest["input_features"]
    v = inference.validate_requests(request_table(spark, sf_dir), expected).where("status = 'valid'")
    v = inference.entered_drivers(v)
    rows = inference.normalize_requests(v, {c: types[c] for c in expected}, keep=("request_id", "entered_global_driver_fields"))
    scored = fm.score(rows)
    out = inference.response_rows(scored, manifest["model_id"], manifest["clinical_status"])
    return out.select("request_id", "model_id", "research_probability", "research_threshold", "threshold_signal",
                      "clinical_status", "public_patient_probability_allowed", "entered_global_driver_fields", "interpretation")


def _checked() -> list:
    p = F.col("research_probability")
    above = F.col("threshold_signal") == "above"
    # the flag is set on the unrounded score, so a score that rounds to the threshold may carry either
    return [p.between(0, 1).alias("probability_in_range"),
            ((p == F.col("research_threshold")) | (above == (p > F.col("research_threshold")))).alias("signal_follows"),
            F.when(F.col("entered_global_driver_fields").isNotNull(), F.size("entered_global_driver_fields")).alias("drivers")]


def _driver_count_sql() -> str:
    terms = []
    for f in GLOBAL_DRIVER_FIELDS:
        val = "CASE WHEN k7 = 4 THEN '' ELSE diag_2 END" if f == "diag_2" else f"CAST({f} AS VARCHAR)"
        terms.append(f"CASE WHEN coalesce({val}, '') <> '' THEN 1 ELSE 0 END")
    return "CAST(" + " + ".join(terms) + " AS INTEGER)"


@register("batch_score", V(f"""
SELECT request_id, 'caresignal-gbt-research-v1' AS model_id, {RESEARCH_THRESHOLD}::DOUBLE AS research_threshold,
       false AS public_patient_probability_allowed, true AS probability_in_range, true AS signal_follows,
       {_driver_count_sql()} AS drivers FROM validated WHERE error IS NULL"""))
def q_batch_score(spark, sf_dir):
    return batch_responses(spark, sf_dir).select("request_id", "model_id", "research_threshold",
                                                 "public_patient_probability_allowed", *_checked())


# ---- streaming: the same responses produced by a Structured Streaming query -----------------------
def stream_response_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import models
    from ..streaming.requests import start_request_stream
    from .model_queries import bundle_path
    fm, manifest = models.load_bundle(spark, bundle_path(spark, sf_dir))
    request_table(spark, sf_dir)                       # makes sure the request files exist
    source = _WRITTEN[(spark.sparkContext.applicationId, sf_dir)]
    reg_path = scratch_dir(spark, "registry")
    write_registry(spark, reg_path, extra=(RELEASED_MODEL,))
    sink, ckpt = scratch_dir(spark, "responses"), scratch_dir(spark, "responses-ckpt")
    q = start_request_stream(spark, source, sink, ckpt, fm, manifest, readers.registry_scan(spark, reg_path),
                             available_now=True)
    q.awaitTermination()
    return spark.read.parquet(sink)


@register("stream_responses", V(f"""
SELECT request_id, route_status, CASE WHEN error IS NULL THEN 'valid' ELSE 'invalid' END AS status, error,
       CASE WHEN error IS NULL THEN true END AS probability_in_range, CASE WHEN error IS NULL THEN true END AS signal_follows,
       CASE WHEN error IS NULL THEN {_driver_count_sql()} END AS drivers FROM ({_ROUTED_SQL}) routed"""))
def q_stream_responses(spark, sf_dir):
    return stream_response_rows(spark, sf_dir).select("request_id", "route_status", "status", "error", *_checked())
