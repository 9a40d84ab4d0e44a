"""Ordinary but awkward input: CSV dialect, number texts, acknowledgement, empty slicers, missing labels."""
import pytest
from pyspark.sql import functions as F

from caresignal.functions.columns import confusion_label, numeric_coerce
from caresignal.functions.constants import CLEAN_EXPORT_COLUMNS, REQUIRED_RESEARCH_FIELDS
from caresignal.operators import inference, prepare
from caresignal.sources import readers, sinks


def _file(path, text):
    path.write_text(text)
    return str(path)


def test_quotes_and_line_feeds_in_cells(spark, tmp_path):
    p = _file(tmp_path / "a.csv", 'name,city\n"ST ""MARY"", INC","A\nB"\nplain,C\n')
    assert {tuple(r) for r in readers.read_text_csv(spark, p).collect()} == {('ST "MARY", INC', "A\nB"), ("plain", "C")}


def test_long_rows_stop_the_job(spark, tmp_path):
    p = _file(tmp_path / "a.csv", "a,b\n1,2\n3,4,5\n")
    with pytest.raises(Exception):
        readers.read_text_csv(spark, p).select("a").collect()


def test_files_with_another_column_order_stop_the_job(spark, tmp_path):
    _file(tmp_path / "a.csv", "a,b\n1,2\n")
    _file(tmp_path / "b.csv", "b,a\n2,1\n")
    with pytest.raises(Exception):
        readers.read_text_csv(spark, str(tmp_path), ["a", "b"]).collect()


@pytest.mark.parametrize("text,value", [("1d", None), ("2.5f", None), ("0x10", None), ("nan", None), (" 3.5 ", 3.5), ("-1e3", -1000.0), (".5", 0.5), ("7.", 7.0), ("", None), ("1_0", None)])
def test_number_texts(spark, text, value):
    assert spark.range(1).select(numeric_coerce(F.lit(text)).alias("x")).first()["x"] == value


def test_missing_score_or_label_has_no_confusion_class(spark):
    df = spark.createDataFrame([(None, 1), (1, None), (1, 0), (0, 1)], "y int, p int")
    assert [r["c"] for r in df.select(confusion_label("y", "p").alias("c")).collect()] == [None, None, "FN", "FP"]


def test_acknowledgement_in_the_payload_and_nan_values(spark):
    fields = list(REQUIRED_RESEARCH_FIELDS)
    full = {f: "1" for f in fields}
    rows = [(1, None, full | {"research_acknowledged": "true"}), (2, True, full), (3, None, full), (4, False, full | {"research_acknowledged": "false"}),
            (5, True, full | {fields[0]: "nan"}), (6, True, full | {fields[0]: "1d"}), (7, True, full | {"other": "1"})]
    df = spark.createDataFrame(rows, "request_id int, research_acknowledged boolean, payload map<string,string>")
    out = {r["request_id"]: r["status"] for r in inference.validate_requests(df, fields, numeric=fields).collect()}
    assert out == {1: "valid", 2: "valid", 3: "invalid", 4: "invalid", 5: "valid", 6: "invalid", 7: "invalid"}
    typed = inference.normalize_requests(df.filter("request_id = 5"), {fields[0]: "numeric"}).first()
    assert typed[fields[0]] is None


def test_empty_slicer_keeps_nothing(spark):
    df = spark.createDataFrame([("TX", "m", "f")], "State string, `Measure Name` string, `Facility Name` string")
    assert prepare.kpi_slice(df, states=[]).count() == 0 and prepare.kpi_slice(df).count() == 1


def test_csv_export_holds_all_columns_in_order(spark, tmp_path):
    from caresignal.plans.hospital_queries import hospital_table
    out = tmp_path / "export"
    sinks.write_clean_export(hospital_table(spark, "/root/testdata/sf0.001"), str(out))
    header = next(p for p in out.iterdir() if p.suffix == ".csv").read_text().split("\n")[0]
    assert len(header.split(",")) == len(CLEAN_EXPORT_COLUMNS) == 11
