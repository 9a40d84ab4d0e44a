"""Exact quantiles from counted values.

`percentile` and `median` keep a value-to-count map per group in one task, which grows
with the distinct values of a column. Here values are counted first (partially aggregated
before the shuffle), running sums over the counts give every value's ranks, spread over
many tasks, and each quantile picks the one or two values at its rank."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import _materialize, running_totals


def exact_quantiles(long: DataFrame, keys: Sequence[str], points: Sequence[float], value: str = "value",
                    buckets: int = 64) -> DataFrame:
    """(keys, quantiles): linear quantiles of the non-null values of `long` at `points`, one array per group.

    Groups without a value give no row. `keys` may not be empty or NULL."""
    keys = list(keys)
    counts = _materialize(long.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_value"))
                          .agg(F.count(F.lit(1)).alias("_n")))
    ranked = running_totals(counts, "_value", ["_n"], keys, buckets=buckets)
    total = counts.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    ranked = ranked.join(total, keys)
    first_above = lambda rank: F.min(F.when(F.col("_n_cum") > rank, F.col("_value")))
    ranks = [F.lit(float(q)) * (F.col("_total") - 1) for q in points]
    picked = ranked.groupBy(*keys, "_total").agg(*[x for i, r in enumerate(ranks) for x in (
        first_above(F.floor(r)).alias(f"_lo{i}"), first_above(F.ceil(r)).alias(f"_hi{i}"))])
    return picked.select(*keys, F.array(*[
        F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (r - F.floor(r)) for i, r in enumerate(ranks)]).alias("quantiles"))
