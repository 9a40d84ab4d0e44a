"""Second-order leaf-wise boosting (G2) against plain loops over rows; the candidate grid's one counted table."""
import math
import random

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from caresignal.operators import boosting, metrics, models

LEVELS = 3


def rows(n=400, seed=4):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        x, z, c = rng.choice([0.0, 1.0, 2.0, 5.0, 9.0]), round(rng.gauss(0, 1), 3), rng.randrange(LEVELS + 1)
        p = 1 / (1 + math.exp(-(x - 3 + z + (2 if c == 1 else 0))))
        out.append((k, x, z, float(c), int(rng.random() < p)))
    return out


def brute_scores(data, lay, p, scale=2.0 ** 30):
    """Scores of all rows after p.rounds trees: every leaf, feature and cut tried by summing rows."""
    y = [r[4] for r in data]
    f = [math.log(sum(y) / (len(y) - sum(y)))] * len(y)
    goes_left = [(lambda r, c=c, j=j: r[1 + j] <= c) for j, cuts in enumerate(lay.cuts) for c in cuts]
    goes_left += [(lambda r, v=v: r[3] != v) for v in range(LEVELS)]
    for _ in range(p.rounds):
        prob = [1 / (1 + math.exp(-s)) for s in f]
        g = [float(round((a - b) * scale)) for a, b in zip(prob, y, strict=True)]
        h = [float(round(a * (1 - a) * scale)) for a in prob]

        def sums(leaf, g=g, h=h):
            return sum(g[i] for i in leaf) / scale, sum(h[i] for i in leaf) / scale, len(leaf)

        def best(leaf):
            gain, cut = 0.0, None
            G, H, n = sums(leaf)
            for k, left in enumerate(goes_left):
                mine = [i for i in leaf if left(data[i])]
                a, b, m = sums(mine)
                if min(m, n - m) < p.min_leaf or min(b, H - b) < p.min_hessian:
                    continue
                x = a * a / (b + p.l2) + (G - a) ** 2 / (H - b + p.l2) - G * G / (H + p.l2)
                if x > gain:
                    gain, cut = x, k
            return gain, cut
        leaves = {(): list(range(len(data)))}
        open_ = {(): best(leaves[()])}
        while len(leaves) < p.max_leaves:
            able = [(-gain, path) for path, (gain, cut) in open_.items() if cut is not None]
            if not able:
                break
            _, path = min(able)
            left = goes_left[open_.pop(path)[1]]
            leaf = leaves.pop(path)
            for side, mine in ((0, [i for i in leaf if left(data[i])]), (1, [i for i in leaf if not left(data[i])])):
                leaves[(*path, side)] = mine
                open_[(*path, side)] = best(mine)
        for leaf in leaves.values():
            G, H, _ = sums(leaf)
            for i in leaf:
                f[i] -= p.learning_rate * G / (H + p.l2)
    return f


def fitted(spark, data, p, parts):
    df = spark.createDataFrame(data, "id int, x double, z double, c double, y int").repartition(parts)
    return df, boosting.fit(df, ["x", "z"], ["c"], [LEVELS], "y", p)


def test_equals_brute_force_for_any_partitions(spark, monkeypatch):
    data = rows()
    p = boosting.BoostingParams(rounds=5, learning_rate=0.3, max_leaves=7, min_leaf=8, max_bins=20, refresh=2)
    seen = []
    for parts, task_rows, block in ((1, 100_000, 1 << 18), (5, 50, 30)):
        monkeypatch.setattr(boosting, "TASK_ROWS", task_rows)
        monkeypatch.setattr(boosting, "BLOCK_ROWS", block)
        df, (trees, lay, start) = fitted(spark, data, p, parts)
        seen.append([(t.splits, t.values) for t in trees])
        assert [len(t.splits) for t in trees] == [6] * 5
    assert seen[0] == seen[1]
    assert len(lay.cuts[0]) == 4 and len(lay.cuts[1]) <= 19  # five values; quantiles of many
    want = brute_scores(data, lay, p)
    onehot = [F.when(F.col("c") == v, 1.0).otherwise(0.0).alias(f"c{v}") for v in range(LEVELS)]
    vec = VectorAssembler(inputCols=["x", "z", *[f"c{v}" for v in range(LEVELS)]], outputCol="features").transform(df.select("id", "x", "z", *onehot))
    out = boosting.as_mllib(spark, trees, lay, start).transform(vec).select("id", vector_to_array("probability")[1].alias("p")).collect()
    assert len(out) == len(data)
    for r in out:
        assert r["p"] == pytest.approx(1 / (1 + math.exp(-want[r["id"]])), abs=1e-9)


def test_more_rows_than_before_are_grown_in_one_task(spark, monkeypatch):
    """576,000 rows (0.1 GB of tables) took thousands of jobs in tasks of 100,000 rows."""
    monkeypatch.setattr(boosting, "_fit_by_jobs", lambda *a: pytest.fail("a job for each step"))
    df = spark.range(0, 150_000, 1, 3).selectExpr("double(id % 7) x", "double(id % 11) z", "double(id % 3) c", "int(id % 7 > 3) y")
    trees, _, _ = boosting.fit(df, ["x", "z"], ["c"], [LEVELS], "y", boosting.BoostingParams(rounds=3, max_leaves=4))
    assert [t.splits[0][1] for t in trees] == [0, 0, 0]


def test_rows_of_1_gb_of_tables_are_grown_in_one_task(spark, monkeypatch):
    """7,200,000 rows took about 20 jobs a tree, 5,000 for a model; the trees are those of the jobs."""
    df = spark.range(0, 1_100_000, 1, 4).selectExpr("double(id % 7) x", "double(hash(id) % 41) z", "double(id % 4) c", "int(id % 7 + hash(id) % 5 > 3) y")
    fit = lambda: boosting.fit(df, ["x", "z"], ["c"], [LEVELS], "y", boosting.BoostingParams(rounds=2, max_leaves=6))[0]
    with monkeypatch.context() as m:
        m.setattr(boosting, "_fit_by_jobs", lambda *a: pytest.fail("a job for each step"))
        whole = fit()
    monkeypatch.setattr(boosting, "TASK_ROWS", 300_000)
    assert [(t.splits, t.values) for t in whole] == [(t.splits, t.values) for t in fit()]


def test_columns_that_share_a_code_have_their_own_sums():
    rng = np.random.default_rng(3)
    n, widths = 20_000, [5, 90, 3, 4, 300]
    codes, y = np.array([rng.integers(0, w, n) for w in widths], np.uint32), rng.integers(0, 2, n)
    held = boosting.Held(((codes[:, a:b], y[a:b]) for a, b in ((0, 7), (7, 15_000), (15_000, n))), n, 3, widths)
    assert sorted(c for g in held.groups for c in g) == list(range(5)) and len(held.groups) < 5 and (held.y == y).all()
    weight, rows = rng.integers(-1 << 30, 1 << 30, n), np.flatnonzero(rng.integers(0, 3, n) == 0)
    for some in (rows, slice(None), rows[:0]):
        got, at = held.sums(some, (weight.astype(float),)), 0
        for c, w in enumerate(widths):
            for v in range(w):
                mine = codes[c][some] == v
                assert got[:, at + v].tolist() == [weight[some][mine].sum(), mine.sum()]
            at += w
    for c in range(5):
        assert (held.left(rows, c, 2) == (codes[c][rows] <= 2 if c < 3 else codes[c][rows] != 2)).all()


def test_limits_of_leaves(spark):
    data = rows(300, 9)
    for p in (boosting.BoostingParams(rounds=2, max_leaves=4, min_leaf=40), boosting.BoostingParams(rounds=1, max_leaves=31, min_leaf=151), boosting.BoostingParams(rounds=1, max_leaves=2)):
        df, (trees, lay, _) = fitted(spark, data, p, 2)
        for t in trees:
            assert len(t.splits) <= p.max_leaves - 1
            leaves = set(t.values) - {s[0] for s in t.splits}
            codes = boosting.pack(df, ["x", "z"], ["c"], "y", lay).collect()
            at = [n for b in codes for n in boosting._route(b[0], 2, t.splits)]
            assert set(at) <= leaves | {0} and (not t.splits or min(at.count(n) for n in leaves - {0}) >= p.min_leaf)


def test_missing_values_and_one_class(spark):
    data = [(k, None if k % 5 == 0 else float(k % 7), None, None if k % 3 else 1.0, k % 2) for k in range(120)] + [(999, 1.0, 1.0, 1.0, None)]
    df = spark.createDataFrame(data, "id int, x double, z double, c double, y int")
    trees, lay, start = boosting.fit(df, ["x", "z"], ["c"], [LEVELS], "y", boosting.BoostingParams(rounds=2, min_leaf=5))
    assert len(trees) == 2 and start == 0.0 and lay.cuts[1] in ((), (1.0,))
    with pytest.raises(ValueError):
        boosting.fit(df.where("y = 1"), ["x"], [], [], "y")
    with pytest.raises(ValueError):
        boosting.fit(df.limit(0), ["x"], [], [], "y")


def test_first_order_trees_are_those_of_mllib(spark, monkeypatch):
    """250 trees took more than 1,000 jobs. A parameter that only MLlib knows asks for its estimator."""
    rng = random.Random(8)
    data = [(k, None if k % 17 == 0 else float(rng.randrange(12)), round(rng.gauss(0, 1), 1), rng.choice("abcd"), rng.choice(["u", "v", None])) for k in range(900)]
    data = [(*r, int(rng.random() < 1 / (1 + math.exp(3 - (r[1] or 4) / 2 - r[2] + (r[3] == "b"))))) for r in data]
    train = spark.createDataFrame(data, "encounter_id int, n double, z double, c string, d string, y int").repartition(3).cache()
    params = models.mllib_gbt_spec(12).params

    def probabilities(more):
        fm = models.fit(train, ["n", "z"], ["c", "d"], models.ModelSpec("g", models.GBT, {**params, **more}, min_frequency=5, balanced=False))
        assert len(fm.model.stages[-1].trees) == 12 and fm.model.stages[-1].treeWeights == [1.0] + [0.06] * 11
        return [r["p"] for r in fm.score(train).orderBy("encounter_id").collect()]
    want = probabilities({"subsamplingRate": 1.0})
    monkeypatch.setattr(models, "GBTClassifier", lambda *a, **k: pytest.fail("MLlib's jobs"))
    got = probabilities({})
    assert len(set(got)) > 100 and got == pytest.approx(want, abs=1e-6)
    train.unpersist()


def test_l2_shrinks_leaf_values(spark):
    data = rows(300, 2)
    low, high = (max(abs(v) for t in fitted(spark, data, boosting.BoostingParams(rounds=1, l2=x), 1)[1][0] for v in t.values.values()) for x in (0.0, 50.0))
    assert high < low


def test_evaluation_equals_the_separate_functions(spark):
    rng = random.Random(1)
    data = [(g, int(rng.random() < 0.3), round(rng.random(), 2)) for g in ("a", "b", None) for _ in range(400)] + [("one", 1, 0.5)] * 3
    df = spark.createDataFrame(data, "g string, y int, p double")
    got = {r["g"]: r for r in metrics.evaluation(df, keys=["g"]).collect()}
    curve = {r["g"]: r for r in metrics.curve_metrics(df, keys=["g"], buckets=7).collect()}
    brier = {r["g"]: r for r in metrics.brier_prevalence(df, keys=["g"]).collect()}
    best = {r["g"]: r for r in metrics.best_threshold(df, keys=["g"]).collect()}
    assert set(got) == set(curve) == set(brier) == set(best) == {"a", "b", None, "one"}  # a null group is a group
    for g, r in got.items():
        assert r["roc_auc"] == pytest.approx(curve[g]["roc_auc"]) if g != "one" else r["roc_auc"] is None
        assert r["pr_auc"] == pytest.approx(curve[g]["average_precision"])
        assert (r["brier_score"], r["prevalence"]) == pytest.approx((brier[g]["brier_score"], brier[g]["prevalence"]))
        assert (r["validation_threshold"], r["validation_f1"]) == (best[g]["threshold"], best[g]["f1"])
    whole = metrics.evaluation(df).collect()
    assert len(whole) == 1 and whole[0]["brier_score"] == pytest.approx(metrics.brier_prevalence(df).first()["brier_score"])
    assert whole[0]["roc_auc"] == pytest.approx(metrics.roc_auc(df).first()["roc_auc"])


def test_concurrent_fits_equal_single_ones(spark):
    data = [(k, float(k % 11), "abc"[k % 3], int((k * 7919) % 13 < (k % 11))) for k in range(600)]
    train = spark.createDataFrame(data, "encounter_id int, n double, c string, y int")
    specs = [models.ModelSpec("lr", models.LOGISTIC, {"maxIter": 50}), models.ModelSpec("b", models.BOOSTING, {"rounds": 3, "min_leaf": 10}, balanced=False)]
    cands = [(["n"], cat, s) for s in specs for cat in (["c"], [])]
    together = models.fit_all(train, cands, parallelism=4)
    for (num, cat, spec), fm in zip(cands, together, strict=True):
        alone = models.fit(train, num, cat, spec)
        a, b = ([r["p"] for r in m.score(train).orderBy("encounter_id").collect()] for m in (fm, alone))
        assert a == pytest.approx(b, abs=1e-9) and fm.spec is spec
