"""Metric documents on small hand-made parts."""
import json

from pyspark.sql import functions as F

from caresignal.operators import errors
from caresignal.sources import documents, sinks


def test_ablation_document_sorts_experiments(spark):
    base = spark.createDataFrame([(0.7, 0.2, 0.1)], "roc_auc double, pr_auc double, brier_score double")
    exp = spark.createDataFrame([("a", 0.01), ("b", -0.2), ("c", -0.2)], "removed_group string, delta_roc_auc_vs_baseline double")
    doc = documents.ablation_document(base, exp, {"interpretation": "not causal"}).first()
    assert [e["removed_group"] for e in doc["experiments"]] == ["b", "c", "a"]
    assert doc["baseline"]["roc_auc"] == 0.7 and doc["interpretation"] == "not causal" and doc["schema_version"] == "1.0.0"


def test_benchmark_document_keeps_candidate_order(spark):
    cand = spark.createDataFrame([("y", 1, 0.6), ("x", 0, 0.5)], "model string, candidate_order int, roc_auc double")
    doc = documents.benchmark_document(cand, cand.where("model = 'y'"), cand.where("model = 'y'").select("roc_auc")).first()
    assert [c["model"] for c in doc["validation_candidates"]] == ["x", "y"]
    assert doc["selected_winner"]["model"] == "y" and doc["winner_test"]["roc_auc"] == 0.6


def test_drivers_document_ranks_both_lists(spark):
    imp = spark.createDataFrame([("a", 0.1, 0.0), ("b", 0.3, 0.1)], "feature string, roc_auc_drop_mean double, roc_auc_drop_std double")
    coef = spark.createDataFrame([("t1", 0.5, 1.6), ("t2", -2.0, 0.1)], "encoded_feature string, coefficient double, odds_ratio double")
    doc = documents.drivers_document(imp, coef, ["weight"]).first()
    assert [r["feature"] for r in doc["top_original_features_by_test_roc_auc_drop"]] == ["b", "a"]
    assert [r["encoded_feature"] for r in doc["top_encoded_logistic_terms_by_absolute_coefficient"]] == ["t2", "t1"]
    assert doc["dropped_sparse_columns"] == ["weight"]


def test_error_profiles_document_names_empty_groups(spark, tmp_path):
    rows = [(1, 0.9, 1.0, "x"), (1, 0.8, 3.0, "x"), (0, 0.1, 5.0, None)]
    df = errors.with_confusion_group(spark.createDataFrame(rows, "y int, p double, num double, cat string"), 0.5)
    path = str(tmp_path / "doc")
    sinks.write_document(documents.error_profiles_document(df, F.lit(0.5), ["num"], ["cat"]), path)
    g = json.loads(spark.read.text(path).first()[0])["groups"]
    assert {k: v["count"] for k, v in g.items()} == {"TP": 2, "FP": 0, "TN": 1, "FN": 0}
    assert g["TP"]["numeric"]["num"]["median"] == 2.0 and g["TP"]["categorical"]["cat"] == [{"value": "x", "share": 1.0}]
    assert g["TN"]["categorical"]["cat"] == [{"value": "MISSING", "share": 1.0}]


def test_value_and_subset_counts_in_one_pass(spark):
    from caresignal.operators import audit, prepare
    df = spark.createDataFrame([("a", None, 1.0), ("a", "z", None), (None, "z", 2.0)], "f string, g string, v double")
    got = {(r["field"], r["value"]): r["count"] for r in audit.value_counts_long(df, ["f", "g"]).collect()}
    assert got == {("f", "a"): 2, ("f", None): 1, ("g", "z"): 2, ("g", None): 1}
    assert {r["subset"]: r["rows"] for r in prepare.valid_counts(df, {"v": "v", "g": "g"}).collect()} == {"v": 2, "g": 2}
    assert audit.data_audit(df.union(df.limit(1))).first()["duplicate_rows"] == 1
    assert audit.data_audit(df.where("false")).first().asDict() == {"rows": 0, "columns": 3, "duplicate_rows": 0}


def test_scratch_folders_are_deleted_with_the_process(spark, tmp_path):
    import os

    from caresignal import session
    path = session.scratch_dir(spark, "probe")
    spark.range(3).write.parquet(path)
    assert os.path.isdir(path.removeprefix("file:"))
    held, session._SCRATCH[:] = list(session._SCRATCH), [(spark, path)]
    try:
        session._delete_scratch()
    finally:
        session._SCRATCH[:] = [h for h in held if h[1] != path]
    assert not os.path.isdir(path.removeprefix("file:"))
