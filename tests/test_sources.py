"""CSV sources and sinks."""
import json
import os

import pytest

from caresignal.functions.constants import HRRP_COLUMNS
from caresignal.sources import readers, sinks


def _write(path, header, rows):
    with open(path, "w") as f:
        f.write(",".join(header) + "\n")
        for r in rows:
            f.write(",".join(r) + "\n")


def test_hrrp_csv_tokens_and_typing(spark, tmp_path):
    p = str(tmp_path / "hrrp.csv")
    base = {"Facility Name": "H", "Facility ID": "010001", "State": "AL", "Measure Name": "READM-30-HF-HRRP",
            "Number of Discharges": "", "Footnote": "", "Excess Readmission Ratio": "N/A",
            "Predicted Readmission Rate": "NaN", "Expected Readmission Rate": "15.1",
            "Number of Readmissions": "Too Few to Report", "Start Date": "07/01/2021", "End Date": "06/30/2024"}
    _write(p, HRRP_COLUMNS, [[base[c] for c in HRRP_COLUMNS]])
    r = readers.hrrp_scan(spark, p).first()
    assert r["Facility ID"] == "010001"
    assert r["Number of Discharges"] is None and r["Footnote"] is None
    assert r["Excess Readmission Ratio"] is None and r["Predicted Readmission Rate"] is None
    assert r["Expected Readmission Rate"] == 15.1
    assert r["Number of Readmissions"] == "Too Few to Report" and r["Number of Readmissions Numeric"] is None


def test_hrrp_missing_column_is_an_error(spark, tmp_path):
    p = str(tmp_path / "bad.csv")
    _write(p, ["Facility ID", "State"], [["1", "AL"]])
    with pytest.raises(ValueError):
        readers.hrrp_scan(spark, p)


def test_encounter_csv_tokens_and_required_columns(spark, tmp_path):
    p = str(tmp_path / "enc.csv")
    _write(p, ["encounter_id", "patient_nbr", "readmitted", "gender", "number_inpatient", "weight"],
           [["1", "10", "<30", "Unknown/Invalid", "2", "?"], ["2", "11", "NO", "Male", "None", "[50-75)"]])
    rows = readers.encounter_scan(spark, p).orderBy("encounter_id").collect()
    assert rows[0]["gender"] is None and rows[0]["weight"] is None and rows[0]["number_inpatient"] == 2.0
    assert rows[1]["number_inpatient"] is None and rows[1]["patient_nbr"] == 11
    q = str(tmp_path / "enc2.csv")
    _write(q, ["encounter_id", "readmitted"], [["1", "NO"]])
    with pytest.raises(ValueError):
        readers.encounter_scan(spark, q)


def test_resolve_input(spark, tmp_path):
    p = str(tmp_path / "x.csv")
    _write(p, ["a"], [["1"]])
    assert readers.resolve_input(spark, [str(tmp_path / "nope.csv"), p]) == p
    with pytest.raises(FileNotFoundError):
        readers.resolve_input(spark, [str(tmp_path / "nope.csv")])


def test_clean_export_and_document_sinks(spark, tmp_path):
    from caresignal.plans.hospital_queries import hospital_table
    h = hospital_table(spark, "/root/testdata/sf0.001")
    out = str(tmp_path / "export")
    sinks.write_clean_export(h, out)
    back = spark.read.option("header", True).csv(out)
    assert back.count() == h.count()
    assert set(back.columns) == {d for _, d in __import__("caresignal.functions.constants", fromlist=["x"])
                                 .CLEAN_EXPORT_COLUMNS}
    doc_path = str(tmp_path / "doc")
    sinks.write_document(sinks.hrrp_summary_document(h, "fixture"), doc_path)
    files = [f for f in os.listdir(doc_path) if f.endswith(".json")]
    assert len(files) == 1
    doc = json.loads(open(os.path.join(doc_path, files[0])).read())
    import duckdb

    from caresignal.plans import ORACLE
    con = duckdb.connect()
    for t in ("lineitem", "part", "supplier", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    rows, _, dups = con.execute(ORACLE["data_audit"]).fetchone()
    _, _, high, low = con.execute(ORACLE["signal_counts"]).fetchone()
    k = doc["kpis"]
    assert (k["records"], k["duplicate_rows"]) == (rows, dups) and dups > 0
    assert (k["persistent_high_err_hospitals"], k["persistent_low_err_hospitals"]) == (high, low)


def test_scans_hand_multi_line_on(spark, tmp_path, monkeypatch):
    from caresignal.sources import readers
    seen, read = [], readers.read_text_csv
    monkeypatch.setattr(readers, "read_text_csv", lambda *a: seen.append(a[3]) or read(*a))
    hospital, encounter = tmp_path / "h.csv", tmp_path / "e.csv"
    hospital.write_text(",".join(readers.HRRP_COLUMNS) + "\n")
    encounter.write_text(f"patient_nbr,{readers.TARGET_COLUMN}\n1,NO\n")
    for lines in (False, True):
        readers.hrrp_scan(spark, str(hospital), multi_line=lines)
        assert readers.encounter_scan(spark, str(encounter), numeric=[], multi_line=lines).count() == 1
    assert seen == [False, False, True, True]


CELLS = ["", "plain", "a,b", 'say "hi"', '"', '""', "two\nlines", "x\n\"y\",z\n", " lead", "5 inch"]


@pytest.mark.parametrize("seed", range(3))
def test_csv_files_are_split_unless_a_cell_holds_a_line_feed(spark, tmp_path, seed):
    import csv
    import random
    rng, want = random.Random(seed), []
    for k, cells in enumerate((CELLS, [c for c in CELLS if "\n" not in c], ["plain", "5 inch"])):
        with open(tmp_path / f"part [{k}] +%20.csv", "w", newline="") as f:
            w = csv.writer(f, lineterminator="\n")
            w.writerow(["id", "a", "b"])
            for i in range(300):
                w.writerow([f"{k}-{i}", rng.choice(cells), rng.choice(cells)])
                want.append(f"{k}-{i}")
    plain, opened = readers.files_by_lines(spark, str(tmp_path))
    assert len(plain) == 2 and len(opened) == 1 and "%5B0%5D" in opened[0]
    got = sorted(map(tuple, readers.read_text_csv(spark, str(tmp_path)).collect()))
    assert got == sorted(map(tuple, readers.read_text_csv(spark, str(tmp_path), multi_line=True).collect()))
    assert sorted(r[0] for r in got) == sorted(want)


@pytest.mark.parametrize("text", ['5" pipe,"first\nsecond",6" x\n', 'a,"b\nc"\n', 'x"y"z,1\n', 'a,\x01\n'])
def test_doubtful_lines_are_read_whole(spark, tmp_path, text):
    (tmp_path / "f.csv").write_text("a,b\n" + text)
    assert readers.files_by_lines(spark, str(tmp_path))[0] == []


def test_a_large_plain_file_takes_many_tasks(spark, tmp_path):
    with open(tmp_path / "f.csv", "w") as f:
        f.write("id,a\n" + "".join(f'{i},"x, ""{i}"""\n' for i in range(20_000)))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        df = readers.read_text_csv(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 4
        assert df.where(f"a = concat('x, \"', id, '\"')").count() == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
