"""Request validation, normalisation, drivers and routing."""

from caresignal.functions.constants import REGISTRY_MODELS
from caresignal.operators import inference
from caresignal.sources import readers

EXPECTED = ["age", "gender", "number_inpatient", "number_emergency", "time_in_hospital", "num_medications",
            "number_diagnoses", "diag_1", "diag_2", "admission_type_id"]
FULL = {"age": "[60-70)", "gender": "Male", "number_inpatient": "2", "number_emergency": "1",
        "time_in_hospital": "4", "num_medications": "15", "number_diagnoses": "7", "diag_1": "428",
        "diag_2": "250.4", "admission_type_id": "1"}


def reqs(spark, rows):
    return spark.createDataFrame(rows, "request_id long, research_acknowledged boolean, payload map<string,string>")


def test_validation_order_and_messages(spark):
    rows = [
        (1, False, {**FULL, "zzz": "1"}),                               # acknowledgement first
        (2, True, {**FULL, "zzz": "1", "aaa": "2"}),                    # unknown fields, sorted
        (3, True, {k: v for k, v in FULL.items() if k not in ("age", "diag_1")}),
        (4, True, {**FULL, "gender": ""}),                               # empty required = missing
        (5, True, {**FULL, "admission_type_id": "x", "number_inpatient": "two"}),
        (6, True, {**FULL, "diag_2": ""}),                               # empty optional is fine
        (7, None, FULL),
        (8, True, {**FULL, "number_inpatient": " 3 "}),
    ]
    out = {r["request_id"]: (r["status"], r["error"]) for r in
           inference.validate_requests(reqs(spark, rows), EXPECTED).collect()}
    assert out[1] == ("invalid", "Research-only acknowledgement is required.")
    assert out[2] == ("invalid", "Unknown fields: ['aaa', 'zzz']")
    assert out[3] == ("invalid", "Missing required research fields: ['age', 'diag_1']")
    assert out[4] == ("invalid", "Missing required research fields: ['gender']")
    assert out[5] == ("invalid", "Field number_inpatient must be numeric.")   # first in expected order
    assert out[6] == ("valid", None)
    assert out[7][0] == "invalid"
    assert out[8] == ("valid", None)


def test_normalize_and_drivers(spark):
    df = reqs(spark, [(1, True, {**FULL, "diag_2": "", "number_inpatient": " 3 "})])
    types = {c: ("numeric" if c in ("number_inpatient", "admission_type_id") else "categorical") for c in EXPECTED}
    n = inference.normalize_requests(df, types).first()
    assert n["diag_2"] is None and n["number_inpatient"] == 3.0 and n["age"] == "[60-70)"
    d = inference.entered_drivers(df).first()["entered_global_driver_fields"]
    assert [x["feature"] for x in d] == ["number_inpatient", "diag_1", "number_emergency", "age"]


def _registry(spark, extra=()):
    rows = [(i, m[0], m[1], m[2], m[3], m[4], m[5], m[6]) for i, m in enumerate(list(REGISTRY_MODELS) + list(extra))]
    return spark.createDataFrame(rows, "position int, id string, status string, task string, data_source string, "
                                       "unit_of_analysis string, patient_probability_allowed boolean, "
                                       "unlock_rule string")


def test_routing_statuses_first_match_and_alias(spark):
    extra = [("local-test-open", "test", "patient_30_day_readmission_probability", "local", "patient encounter",
              True, None),
             ("local-test-second", "test", "patient_risk", "local", "patient encounter", True, None)]
    req = spark.createDataFrame([
        (1, "hospital_level_readmission_intelligence", "hospital-condition record"),
        (2, "patient_30_day_readmission_probability", "patient encounter"),
        (3, "patient_30_day_readmission_probability", "hospital-condition record"),
        (4, "external_validation_and_local_calibration", "authorized Dubai sandbox data"),
        (5, "patient_risk", "patient encounter"),
    ], "request_id long, task string, unit string")
    out = {r["request_id"]: (r["model_id"], r["route_status"]) for r in
           inference.route_requests(req, _registry(spark, extra)).collect()}
    assert out[1] == ("cms-hrrp-hospital-intelligence-v1", "ANALYTICS READY")
    assert out[2] == ("uci-diabetes-readmission-hgb-v2", "OUTPUT LOCKED")       # first registered wins
    assert out[3] == (None, "NO VALID ROUTE")
    assert out[4] == ("dubai-nabidh-external-validation", "OUTPUT LOCKED")
    assert out[5] == ("local-test-second", "PROBABILITY ENABLED")
    none = inference.route_requests(req, None).select("route_status").distinct().collect()
    assert [r[0] for r in none] == ["REGISTRY UNAVAILABLE"]


def test_registry_document_round_trip(spark, tmp_path):
    from caresignal.plans.inference_queries import write_registry
    p = str(tmp_path / "registry")
    write_registry(spark, p)
    reg = readers.registry_scan(spark, p).orderBy("position").collect()
    assert [r["id"] for r in reg] == [m[0] for m in REGISTRY_MODELS]
    assert reg[0]["position"] == 0 and reg[1]["patient_probability_allowed"] is False


def test_decode_dims(spark):
    df = spark.createDataFrame([(1, "428", "Ch"), (22, "999", "No")],
                               "discharge_disposition_id long, diag_1 string, change string")
    r = inference.decode_dims(df).orderBy("discharge_disposition_id").collect()
    assert r[0]["discharge_disposition_id_label"] == "Home / self care"
    assert r[0]["diag_1_label"] == "Heart failure" and r[0]["change_label"] == "Changed"
    assert r[1]["discharge_disposition_id_label"] == "Rehabilitation facility" and r[1]["diag_1_label"] is None
    assert r[1]["change_label"] == "No change"


def test_whole_payloads_are_not_shuffled(spark, monkeypatch):
    """Requests are stored as they are derived."""
    from conftest import SF001
    from caresignal.plans import inference_queries as q
    monkeypatch.setattr(q, "_WRITTEN", {})
    seen = []
    real = type(spark.range(1)).repartition
    monkeypatch.setattr(type(spark.range(1)), "repartition", lambda self, *a: seen.append(self.columns) or real(self, *a))
    assert q.request_table(spark, SF001).select("request_id").distinct().count() == q.encounter_table(spark, SF001).count()
    assert not any("payload" in c for c in seen)
