"""Exact quantiles from counts against numpy."""
import numpy as np
import pytest

from caresignal.operators.quantiles import exact_quantiles


@pytest.mark.parametrize("buckets", [1, 4, 64])
def test_matches_numpy_with_ties_gaps_and_single_values(spark, buckets):
    rng = np.random.default_rng(3)
    data = {"ties": rng.integers(0, 5, 101).astype(float).tolist(), "even": rng.normal(size=200).tolist(), "one": [7.5]}
    rows = [(k, v) for k, vs in data.items() for v in vs] + [("ties", None), ("none", None)]
    points = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = {r["k"]: r["quantiles"] for r in
           exact_quantiles(spark.createDataFrame(rows, "k string, value double"), ["k"], points, buckets=buckets).collect()}
    assert set(got) == set(data)
    for k, vs in data.items():
        assert got[k] == pytest.approx(np.quantile(vs, points).tolist())
