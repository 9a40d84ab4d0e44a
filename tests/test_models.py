"""Planted-signal model tests (G1, G7, G8, G9, A9): the label follows prior use."""
import pytest
from pyspark.sql import functions as F

from caresignal.operators import metrics, models
from caresignal.plans.patient_queries import CATEGORICAL, NUMERIC, encounter_table

from conftest import SF01


@pytest.fixture(scope="module")
def planted(spark):
    e = encounter_table(spark, SF01)
    k = F.col("encounter_id")
    # the label is driven by prior inpatient use, with 10 % label noise
    y = F.when(k % 10 == 0, 1 - (F.col("number_inpatient") >= 2).cast("int")) \
        .otherwise((F.col("number_inpatient") >= 2).cast("int"))
    return e.withColumn("y", y).persist()


@pytest.fixture(scope="module")
def lr(planted):
    return models.fit(planted.where("split = 'train'"), NUMERIC, CATEGORICAL, models.baseline_spec(200))


def test_planted_signal_is_learned(lr, planted):
    test = planted.where("split = 'test'")
    auc = metrics.roc_auc(lr.score(test)).first()["roc_auc"]
    assert auc > 0.8


def test_permutation_importance_ranks_the_driver_first(lr, planted):
    test = planted.where("split = 'test'")
    imp = models.permutation_importance(lr, test, ["number_inpatient", "age", "diag_1"], repeats=2).collect()
    assert imp[0]["feature"] == "number_inpatient" and imp[0]["roc_auc_drop_mean"] > 0.1


def test_permutation_is_a_permutation(spark, planted):
    test = planted.where("split = 'test'").select("encounter_id", "number_inpatient", "age")
    long = models.permuted_long(test, ["number_inpatient", "age"], repeats=2).persist()
    rows = {r["encounter_id"]: r for r in test.collect()}
    for f, other in (("number_inpatient", "age"), ("age", "number_inpatient")):
        for rep in (0, 1):
            part = long.where((F.col("feature") == f) & (F.col("repeat") == rep)).collect()
            assert sorted(r["encounter_id"] for r in part) == sorted(rows)
            assert sorted(str(r[f]) for r in part) == sorted(str(r[f]) for r in rows.values())
            assert all(r[other] == rows[r["encounter_id"]][other] for r in part)


def test_permutation_covers_the_whole_table(spark, monkeypatch):
    """A uniform permutation of all rows, whatever the number of ranges: about one fixed point, displacements spread."""
    n, seen = 3000, []
    df = spark.range(n).selectExpr("id AS encounter_id", "id AS v", "cast(id AS double) / 7 AS d", "cast(id % 2 = 0 AS boolean) AS b", "cast(null AS string) AS s")
    for size in (100_000, 100):  # one range and 32
        monkeypatch.setattr(models, "RANK_ROWS", size)
        long = models.permuted_long(df.repartition(5), ["v", "d", "b", "s"], repeats=3)
        assert [f.dataType for f in long.schema.fields[2:]] == [f.dataType for f in df.schema.fields]
        got = {}
        for r in long.where("feature IN ('v', 'd')").collect():
            got[r["feature"], r["repeat"], r["encounter_id"]] = r["v"] if r["feature"] == "v" else round(r["d"] * 7)
        seen.append(got)
    assert seen[0] == seen[1] and len(seen[0]) == 6 * n
    for f in ("v", "d"):
        for rep in range(3):
            to = [seen[0][f, rep, k] for k in range(n)]
            assert sorted(to) == list(range(n)) and sum(x == k for k, x in enumerate(to)) <= 8
            moved = sum(abs(x - k) for k, x in enumerate(to)) / n
            assert abs(moved - n / 3) < n / 30  # the mean distance of a uniform permutation
            assert abs(sum((x < n / 2) != (k < n / 2) for k, x in enumerate(to)) / n - 0.5) < 0.05
    assert len({tuple(seen[0][f, rep, k] for k in range(50)) for f in ("v", "d") for rep in range(3)}) == 6


def test_ablation_of_the_driver_group_lowers_auc(planted):
    train, test = planted.where("split = 'train'"), planted.where("split = 'test'")
    drop = ["number_inpatient", "number_emergency", "number_outpatient"]
    fm = models.fit(train, [c for c in NUMERIC if c not in drop], CATEGORICAL, models.baseline_spec(200))
    full = models.fit(train, NUMERIC, CATEGORICAL, models.baseline_spec(200))
    a = metrics.roc_auc(fm.score(test)).first()["roc_auc"]
    b = metrics.roc_auc(full.score(test)).first()["roc_auc"]
    assert a < b - 0.2


def test_coefficients_and_bundle_round_trip(spark, lr, planted, tmp_path):
    c = models.coefficients(lr, spark).collect()
    assert len(c) == 40 and c[0]["odds_ratio"] == pytest.approx(2.718281828 ** c[0]["coefficient"], rel=1e-5)
    path = str(tmp_path / "bundle")
    models.save_bundle(spark, lr, path, {"model_id": "m1"})
    fm, manifest = models.load_bundle(spark, path)
    test = planted.where("split = 'test'")
    a = [r["p"] for r in lr.score(test).orderBy("encounter_id").collect()]
    b = [r["p"] for r in fm.score(test).orderBy("encounter_id").collect()]
    assert manifest["model_id"] == "m1" and a == pytest.approx(b)


def test_tree_models_fit(planted):
    train, test = planted.where("split = 'train'"), planted.where("split = 'test'")
    for spec in models.benchmark_specs(gbt_iter=5, forest_trees=5)[1:]:
        fm = models.fit(train, NUMERIC, CATEGORICAL, spec)
        assert metrics.roc_auc(fm.score(test)).first()["roc_auc"] > 0.8


def test_winner_order_roc_then_pr_then_brier_then_position(spark):
    rows = [("a", 0, 0.70, 0.20, 0.10), ("b", 1, 0.71, 0.10, 0.30), ("c", 2, 0.71, 0.15, 0.30),
            ("d", 3, 0.71, 0.15, 0.20), ("e", 4, 0.71, 0.15, 0.20)]
    g = spark.createDataFrame(rows, "model string, candidate_order int, roc_auc double, pr_auc double, "
                                    "brier_score double")
    assert models.pick_winner(g).first()["model"] == "d"


def _newton(x, y, w):
    """Optimum of sum(w * loss) + |b|^2 / 2 with a constant as the last column."""
    import numpy as np
    x = np.hstack([x, np.ones((len(x), 1))])
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ b))
        g = x.T @ (w * (p - y)) + b
        b -= np.linalg.solve(x.T @ (x * (w * p * (1 - p))[:, None]) + np.eye(len(b)), g)
    return b


@pytest.mark.parametrize("numeric,categorical", [(["a", "flat"], ["c"]), (["flat"], ["c"]), (["a"], [])])
def test_logistic_penalises_the_intercept(spark, numeric, categorical):
    import numpy as np
    rng = np.random.default_rng(5)
    a, c = rng.normal(size=60), rng.integers(0, 3, 60)
    y = (rng.random(60) < 1 / (1 + np.exp(-(a + c)))).astype(int)
    df = spark.createDataFrame([(float(p), 4.0, f"l{q}", int(r)) for p, q, r in zip(a, c, y)], "a double, flat double, c string, y int")
    spec = models.ModelSpec("m", models.LOGISTIC, {"maxIter": 500, "tol": 1e-14}, min_frequency=1)
    fm = models.fit(df, numeric, categorical, spec)
    columns = {"a": (a - a.mean()) / a.std(), "flat": np.zeros(60)}
    x = np.stack([*[columns[n] for n in numeric], *[(c == k).astype(float) for k in range(3) if categorical]], 1)
    w = np.where(y == 1, 60 / (2 * y.sum()), 60 / (2 * (60 - y.sum())))
    want, lr = _newton(x, y, w), fm.model.stages[-1]
    assert np.allclose([*lr.coefficients.toArray(), lr.intercept], want, atol=1e-4)
    cert = {r["feature"]: r for r in models.optimality(fm, df).collect()}
    assert set(cert) == {*numeric, *categorical, "intercept"} and all(r["gradient_norm"] < 1e-3 for r in cert.values())
    # the certificate is the gradient at any coefficients, not at the optimum only
    rough = models.fit(df, numeric, categorical, models.ModelSpec("m", models.LOGISTIC, {"maxIter": 1}, min_frequency=1))
    lr = rough.model.stages[-1]
    b = np.append(lr.coefficients.toArray(), lr.intercept)
    ones = np.hstack([x, np.ones((60, 1))])
    g = ones.T @ (w * (1 / (1 + np.exp(-ones @ b)) - y)) + b
    norm = sum(r["gradient_norm"] ** 2 for r in models.optimality(rough, df).collect()) ** 0.5
    assert abs(norm - np.linalg.norm(g)) < 1e-6


def test_tasks_of_a_logistic_fit_do_not_grow_with_the_rows():
    """35 million rows took 2,304 tasks in each of hundreds of jobs, all reporting to the driver."""
    assert [models._logistic_tasks(n, 12) for n in (0, 9_000, 40_000, 576_000, 5_760_000, 34_560_000)] == [1, 1, 3, 24, 24, 35]


def test_permuted_rows_are_derived_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for b in batches:
            seen.add(len(b))
            yield b
    df = spark.createDataFrame([(k, k % 7, str(k % 3)) for k in range(60)], "encounter_id int, a int, b string")
    long = models.permuted_long(df.mapInPandas(look, df.schema), ["a", "b"], repeats=2)
    assert long.count() == 60 * 2 * 2 and seen.value == 60
