"""Metrics: brute force, golden arithmetic and properties."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from caresignal.operators import metrics


def brute_auc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    gt = (pos[:, None] > neg[None, :]).sum()
    eq = (pos[:, None] == neg[None, :]).sum()
    return (gt + 0.5 * eq) / (len(pos) * len(neg))


def brute_ap(y, p):
    ap = 0.0
    for s in np.unique(p):
        sel = p >= s
        tp, fp = (y[sel] == 1).sum(), (y[sel] == 0).sum()
        ap += (y[p == s] == 1).sum() / (y == 1).sum() * tp / (tp + fp)
    return ap


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(7)
    n = 3000
    g = rng.integers(0, 3, n)
    y = rng.integers(0, 2, n)
    p = np.round(np.clip(rng.normal(0.4 + 0.2 * y, 0.2), 0, 1), 2)    # many ties
    rows = [(int(a), int(b), float(c)) for a, b, c in zip(g, y, p)]
    return spark.createDataFrame(rows, "g int, y int, p double"), g, y, p


@pytest.mark.parametrize("buckets", [1, 4, 64])
def test_auc_and_ap_match_brute_force_per_group(data, buckets):
    df, g, y, p = data
    auc = {r["g"]: r["roc_auc"] for r in metrics.roc_auc(df, keys=["g"], buckets=buckets).collect()}
    ap = {r["g"]: r["average_precision"] for r in
          metrics.average_precision(df, keys=["g"], buckets=buckets).collect()}
    for k in range(3):
        m = g == k
        assert auc[k] == pytest.approx(brute_auc(y[m], p[m]), abs=1e-12)
        assert ap[k] == pytest.approx(brute_ap(y[m], p[m]), abs=1e-12)


def test_auc_symmetry_and_global(data):
    df, g, y, p = data
    a = metrics.roc_auc(df).first()["roc_auc"]
    b = metrics.roc_auc(df.withColumn("p", 1 - F.col("p"))).first()["roc_auc"]
    assert a + b == pytest.approx(1.0, abs=1e-12)
    assert a == pytest.approx(brute_auc(y, p), abs=1e-12)


def test_auc_null_when_one_class(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.3)], "y int, p double")
    assert metrics.roc_auc(df).first()["roc_auc"] is None


def test_golden_threshold_arithmetic(spark):
    # published test confusion counts -> published rates
    c = spark.createDataFrame([(0.13, 1109, 4762, 13358, 1060)], "threshold double, tp long, fp long, tn long, fn long")
    r = metrics.confusion_metrics(c).first()
    assert (r["sensitivity_recall"], r["specificity"], r["precision"], r["f1"]) == (0.5113, 0.7372, 0.1889, 0.2759)
    assert (r["false_positive_rate"], r["false_discovery_rate"]) == (0.2628, 0.8111)
    assert (r["alerts_per_100_encounters"], r["false_positive_alerts_per_100_encounters"],
            r["missed_readmissions_per_100_encounters"]) == (28.94, 23.47, 5.22)


def test_zero_denominators_are_zero(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.2)], "y int, p double")
    r = metrics.threshold_metrics(df, 0.5).first()
    assert (r["sensitivity_recall"], r["precision"], r["f1"], r["false_discovery_rate"]) == (0.0, 0.0, 0.0, 0.0)
    assert r["specificity"] == 1.0


def test_threshold_table_properties_and_inclusive_threshold(data, spark):
    df, g, y, p = data
    t = metrics.threshold_table(df, metrics.grid(range(10, 91)), keys=["g"]).orderBy("g", "threshold").collect()
    n = {k: int((g == k).sum()) for k in range(3)}
    for k in range(3):
        rows = [r for r in t if r["g"] == k]
        assert len(rows) == 81
        assert all(r["tp"] + r["fp"] + r["tn"] + r["fn"] == n[k] for r in rows)
        sens = [r["sensitivity_recall"] for r in rows]
        assert all(a >= b for a, b in zip(sens, sens[1:]))
        for r in rows[::10]:
            m = g == k
            assert r["tp"] == int(((p[m] >= r["threshold"]) & (y[m] == 1)).sum())   # p >= t is positive
    exact = spark.createDataFrame([(1, 0.3), (0, 0.3)], "y int, p double")
    assert metrics.threshold_metrics(exact, 0.3).first()["tp"] == 1


def test_best_threshold_lowest_on_ties(spark):
    # every threshold in (0.2, 0.8] gives the same F1 -> the lowest grid point wins
    df = spark.createDataFrame([(1, 0.9), (0, 0.1), (1, 0.95), (0, 0.15)], "y int, p double")
    b = metrics.best_threshold(df, metrics.grid(range(10, 91))).first()
    assert b["f1"] == 1.0 and b["threshold"] == 0.16


def test_brier_and_prevalence(data):
    df, g, y, p = data
    r = metrics.brier_prevalence(df).first()
    assert r["brier_score"] == pytest.approx(float(np.mean((p - y) ** 2)))
    assert r["prevalence"] == pytest.approx(float(y.mean()))


def test_many_groups_shuffle_path_matches_broadcast_path(spark, monkeypatch):
    rng = np.random.default_rng(3)
    n = 4000
    g, y, p = rng.integers(0, 50, n), rng.integers(0, 2, n), np.round(rng.random(n), 3)
    df = spark.createDataFrame([(int(a), int(b), float(c)) for a, b, c in zip(g, y, p)], "g int, y int, p double")
    a = {r["g"]: r["roc_auc"] for r in metrics.roc_auc(df, keys=["g"], buckets=8).collect()}
    monkeypatch.setattr(metrics, "MAX_BROADCAST_CELLS", 10)     # force the shuffle-join path
    b = {r["g"]: (r["roc_auc"], r["n_pos"]) for r in metrics.roc_auc(df, keys=["g"], buckets=8).collect()}
    for k in range(50):
        m = g == k
        assert b[k][0] == pytest.approx(brute_auc(y[m], p[m]), abs=1e-12)
        assert a[k] == pytest.approx(b[k][0], abs=1e-12)
