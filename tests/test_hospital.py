"""Hospital rules with hand-made rows."""
import datetime as dt

import pytest
from pyspark.sql import types as T

from caresignal.functions.constants import HRRP_COLUMNS
from caresignal.operators import audit, hospital, prepare

SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in HRRP_COLUMNS])
HF, AMI, COPD, PN, CABG, HK = ("READM-30-HF-HRRP", "READM-30-AMI-HRRP", "READM-30-COPD-HRRP",
                              "READM-30-PN-HRRP", "READM-30-CABG-HRRP", "READM-30-HIP-KNEE-HRRP")


def row(fid, measure, err, state="AL", name=None, readm="12", footnote=None, disch="100",
        start="07/01/2021", end="06/30/2024", pred="15.0", exp="14.0"):
    d = {"Facility Name": name or f"H{fid}", "Facility ID": fid, "State": state, "Measure Name": measure,
         "Number of Discharges": disch, "Footnote": footnote, "Excess Readmission Ratio": err,
         "Predicted Readmission Rate": pred, "Expected Readmission Rate": exp,
         "Number of Readmissions": readm, "Start Date": start, "End Date": end}
    return tuple(d[c] for c in HRRP_COLUMNS)


def typed(spark, rows):
    return prepare.prepare_hospital(spark.createDataFrame(rows, SCHEMA))


def test_suppressed_text_kept_and_not_zero(spark):
    h = typed(spark, [row("010001", HF, "1.01", readm="Too Few to Report", footnote="1"),
                      row("010002", HF, "N/A", readm="N/A", footnote="5"),
                      row("010003", HF, " 0.95 ", readm="7")])
    r = {x["Facility ID"]: x for x in h.collect()}
    assert r["010001"]["Number of Readmissions"] == "Too Few to Report"
    assert r["010001"]["Number of Readmissions Numeric"] is None
    assert r["010002"]["Number of Readmissions"] is None          # 'N/A' is a missing token
    assert r["010002"]["Excess Readmission Ratio"] is None
    assert r["010003"]["Excess Readmission Ratio"] == pytest.approx(0.95)
    assert r["010003"]["Number of Readmissions Numeric"] == 7.0
    assert r["010001"]["Facility ID"] == "010001"                 # leading zero kept
    assert r["010001"]["Condition"] == "Heart Failure (HF)"
    assert r["010001"]["Start Date"] == dt.date(2021, 7, 1)


def test_dates_two_formats_and_strict(spark):
    h = typed(spark, [row("1", HF, "1.0", start="2021-07-01", end="06/30/2024")])
    assert h.first()["Start Date"] == dt.date(2021, 7, 1)
    bad = typed(spark, [row("1", HF, "1.0", start="July 1st")])
    with pytest.raises(Exception):
        bad.collect()


def test_unmapped_measure_gives_null_condition_dropped_from_summary(spark):
    h = typed(spark, [row("1", "READM-30-XYZ", "1.2"), row("1", HF, "1.1"), row("2", HF, "0.9")])
    s = {r["condition"]: r for r in hospital.condition_summary(h).collect()}
    assert set(s) == {"Heart Failure (HF)"}
    assert s["Heart Failure (HF)"]["err_above_1_pct"] == pytest.approx(50.0)


def test_share_uses_valid_rows_and_null_without_valid(spark):
    h = typed(spark, [row("1", HF, "1.2"), row("2", HF, None), row("3", HF, "0.8"),
                      row("4", COPD, None, pred="10.0"), row("5", COPD, None, pred="20.0")])
    s = {r["condition"]: r for r in hospital.condition_summary(h).collect()}
    assert s["Heart Failure (HF)"]["valid_err"] == 2
    assert s["Heart Failure (HF)"]["err_above_1_pct"] == pytest.approx(50.0)
    assert s["COPD"]["err_above_1_pct"] is None                  # S9: no valid ERR -> NULL, not 0
    assert s["COPD"]["mean_predicted_rate"] == pytest.approx(15.0)  # rates use all rows


MEASURES = [AMI, HF, COPD, PN, CABG, HK]


def test_persistent_signals_coverage_ties_and_duplicates(spark):
    rows = []
    rows += [row("A", m, "1.10") for m in MEASURES[:5]]               # 5 conditions all > 1 -> high
    rows += [row("B", m, "1.10") for m in MEASURES[:4]]               # 4 conditions -> not robust
    rows += [row("C", m, "0.90") for m in MEASURES[:5]]               # all < 1 -> low
    rows += [row("D", m, "0.90") for m in MEASURES[:4]] + [row("D", CABG, "1.0")]  # ERR = 1 blocks low
    rows += [row("E", m, "1.20") for m in MEASURES[:5]] + [row("E", HF, "1.30")]   # duplicate: 6/5 != 100 %
    rows += [row("F", m, "1.0") for m in MEASURES[:5]]                # ERR = 1 blocks high too
    hs = hospital.hospital_summary(typed(spark, rows))
    high = {r["facility_id"] for r in hospital.persistent_high(hs).collect()}
    low = {r["facility_id"] for r in hospital.persistent_low(hs).collect()}
    assert high == {"A"}
    assert low == {"C"}
    sig = hospital.signal_counts(hs).first()
    assert (sig["hospitals_with_err"], sig["robust_hospitals"], sig["persistent_high"], sig["persistent_low"]) == \
        (6, 5, 1, 1)


def test_null_keys_dropped_for_hospital_kept_for_footnote(spark):
    h = typed(spark, [row("1", HF, "1.1", state=None), row("2", HF, "0.9", footnote="5"),
                      row("3", HF, "0.9")])
    assert {r["facility_id"] for r in hospital.hospital_summary(h).collect()} == {"2", "3"}
    f = {r["footnote"]: r["total_rows"] for r in audit.footnote_missing(h).collect()}
    assert f == {None: 2, "5": 1}


def test_duplicates_null_equals_null(spark):
    h = typed(spark, [row("1", HF, None), row("1", HF, None), row("2", HF, "1.0")])
    a = audit.data_audit(h).first()
    assert (a["rows"], a["duplicate_rows"], a["columns"]) == (3, 1, 14)


def test_overall_kpis_and_null_profile(spark):
    h = typed(spark, [row("1", HF, "1.2"), row("1", COPD, "0.8"), row("2", HF, "1.0", state="AK"),
                      row("3", HF, None, state="AK")])
    k = audit.overall_kpis(h).first()
    assert (k["hospitals"], k["states_territories"], k["conditions"], k["valid_err_records"]) == (3, 2, 2, 3)
    assert (k["err_above_1"], k["err_below_1"], k["err_equal_1"]) == (1, 1, 1)
    assert k["median_err"] == pytest.approx(1.0)
    assert k["err_above_1_pct"] == pytest.approx(100 / 3)
    n = {r["column_name"]: r["missing"] for r in audit.null_profile(h).collect()}
    assert n["Excess Readmission Ratio"] == 1 and n["Footnote"] == 4


def test_state_top_uses_min_records_and_tie_order(spark):
    rows = [row(str(i), HF, "1.1", state="AA") for i in range(3)] + \
           [row(str(10 + i), HF, "1.1", state="BB") for i in range(3)] + [row("99", HF, "2.0", state="CC")]
    top = [r["state"] for r in hospital.state_top(typed(spark, rows), min_records=3).collect()]
    assert top == ["AA", "BB"]


def test_summary_document_shape(spark):
    from caresignal.sources.sinks import hrrp_summary_document
    rows = [row("A", m, "1.10") for m in MEASURES[:5]] + [row("B", HF, "0.9", readm="Too Few to Report")]
    doc = hrrp_summary_document(typed(spark, rows), "x.csv").first()
    assert doc["kpis"]["persistent_high_err_hospitals"] == 1
    assert doc["kpis"]["suppressed_or_non_numeric_readmission_records"] == 1
    assert doc["kpis"]["duplicate_rows"] == 0
    assert doc["source"]["reporting_period"]["start"] == "2021-07-01"
    conds = [c["condition"] for c in doc["conditions"]]
    assert len(conds) == 5 and len(doc["guardrails"]) == 3


def test_condition_slicer_reaches_the_parquet_scan(spark, tmp_path):
    rows = [row("1", HF, "1.1"), row("2", COPD, "0.9"), row("3", AMI, "1.0")]
    path = str(tmp_path / "hrrp")
    spark.createDataFrame(rows, SCHEMA).write.parquet(path)
    from caresignal.sources.readers import hrrp_scan
    sliced = hrrp_scan(spark, path, conditions=["COPD"], states=["AL"], fmt="parquet")
    plan = sliced._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "Measure Name" in plan.split("PushedFilters")[1].split("]")[0]
    assert [r["Condition"] for r in sliced.collect()] == ["COPD"]


def test_conditions_are_ordered_by_mean_err(spark):
    from caresignal.plans.hospital_queries import q_condition_summary
    got = [r["mean_err"] for r in q_condition_summary(spark, "/root/testdata/sf0.001").collect()]
    known = [x for x in got if x is not None]
    assert known == sorted(known, reverse=True) and got[:len(known)] == known
