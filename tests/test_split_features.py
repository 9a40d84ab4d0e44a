"""Patient split, preparation statistics."""
import pytest

from pyspark.ml import Pipeline, PipelineModel

from caresignal.operators import features, prepare, split, stages
from caresignal.plans.patient_queries import encounter_table

from conftest import SF01


def test_split_partition_disjoint_and_sizes(spark):
    e = encounter_table(spark, SF01)
    sizes = {r["split"]: r["count"] for r in e.groupBy("split").count().collect()}
    assert sizes == {"train": 9449, "validation": 2323, "test": 3228}
    assert split.split_leakage(e).count() == 0


def test_null_patient_in_no_split(spark):
    df = spark.createDataFrame([(1, 10), (2, None)], "encounter_id int, patient_nbr long")
    assert [r["encounter_id"] for r in split.patient_split(df).collect()] == [1]


def test_label_null_is_negative_and_tokens(spark):
    df = spark.createDataFrame([("<30", "?"), (">30", "Male"), (None, "Unknown/Invalid"), ("NO", "None")],
                               "readmitted string, gender string")
    out = prepare.encounter_label(prepare.prepare_encounters(df), label="y").collect()
    assert [r["y"] for r in out] == [1, 0, 0, 0]
    assert [r["gender"] for r in out] == [None, "Male", None, None]


def test_sparse_columns_strictly_above_share(spark):
    df = spark.createDataFrame([(None, 1), (None, None), (None, 2), (None, 3), ("x", 4)] * 2, "a string, b int")
    s = {r["column"]: r for r in prepare.sparse_columns(df, ["a", "b"]).collect()}
    assert s["a"]["missing_share"] == pytest.approx(0.8) and not s["a"]["dropped"]   # > 0.80 only
    assert not s["b"]["dropped"]


def test_mode_tie_smallest_and_pooling(spark):
    rows = [("b",)] * 3 + [("a",)] * 3 + [("c",)] * 1 + [(None,)] * 2
    df = spark.createDataFrame(rows, "c string")
    m = features.categorical_modes(features.category_counts(df, ["c"])).first()
    assert m["mode"] == "a"
    pool = {r["value"]: (r["n"], r["kept"]) for r in features.category_pooling(df, ["c"], 4).collect()}
    assert pool == {"a": (5, True), "b": (3, False), "c": (1, False)}   # missing imputed to the mode first


def test_medians_std_and_class_weights(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 0), (None, 0), (10.0, 0)], "x double, y int")
    med = {r["feature"]: r["median"] for r in features.numeric_medians(df, ["x"]).collect()}
    assert med == {"x": 2.0}
    st = features.standardize_stats(df, ["x"], med).first()
    assert st["mean"] == pytest.approx(15 / 4)
    assert st["std"] == pytest.approx((((1 - 3.75) ** 2 + 2 * (2 - 3.75) ** 2 + (10 - 3.75) ** 2) / 4) ** 0.5)
    w = {r["label"]: r["weight"] for r in features.class_weights(df, "y").collect()}
    assert w == {1: pytest.approx(2.0), 0: pytest.approx(4 / 6)}


def test_preparation_is_one_saved_pipeline(spark, tmp_path, monkeypatch):
    train = spark.createDataFrame([("a", 1.0)] * 12 + [("b", 2.0)] * 12 + [("rare", 3.0)], "c string, x double")
    prep = Pipeline(stages=[stages.NumericPrep(inputCols=["x"], scale=False), stages.CategoryIndexer(inputCols=["c"], minFrequency=10),
                            *stages.encoder_stages(["x"], ["c"])])
    test = spark.createDataFrame([("zzz", 1.0), ("a", 1.0), ("rare", 1.0), (None, None)], "c string, x double")
    path = str(tmp_path / "prep")
    model = prep.fit(train)
    model.write().save(path)
    for limit in (200_000, 0):  # broadcast and shuffle join of the level table
        monkeypatch.setattr(stages, "MAX_BROADCAST_LEVELS", limit)
        for m in (model, PipelineModel.load(path)):
            v = {r["c"]: [float(x) for x in r["features"].toArray()] for r in m.transform(test).collect()}
            # labels: __infrequent__, a, b (alphabetical); unseen -> all zeros, rare -> pooled, missing -> mode
            assert v == {"zzz": [1.0, 0, 0, 0], "a": [1.0, 0, 1, 0], "rare": [1.0, 1, 0, 0], None: [2.0, 0, 1, 0]}
            assert m.stages[1].label_counts() == {"c": 3}
    pool = {r["value"]: r["label"] for r in model.stages[1].levels.collect()}
    assert pool == {"a": "a", "b": "b", "rare": "__infrequent__"}


def test_columns_without_values_and_without_categories(spark):
    train = spark.createDataFrame([(None, None, 1.0)] * 3, "c string, x double, z double")
    prep = Pipeline(stages=[stages.NumericPrep(inputCols=["x", "z"], scale=True), stages.CategoryIndexer(inputCols=["c"], minFrequency=1),
                            *stages.encoder_stages(["x", "z"], [])])
    rows = prep.fit(train).transform(spark.createDataFrame([("new", 5.0, None)], "c string, x double, z double")).collect()
    assert rows[0]["_i_c"] == 0.0 and list(rows[0]["features"].toArray()) == [5.0, 0.0]
    assert stages.CategoryIndexer(inputCols=[], minFrequency=1).fit(train).transform(train).columns == train.columns


def test_align_columns_adds_typed_nulls(spark):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    out = prepare.align_columns(df, ["b", "missing_num", "a"], {"missing_num": "numeric"})
    assert out.columns == ["b", "missing_num", "a"]
    assert dict(out.dtypes)["missing_num"] == "double"
