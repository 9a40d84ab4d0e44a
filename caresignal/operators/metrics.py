"""Evaluation metrics on (label, score[, group keys]) tables (H1-H6).

Everything starts from `score_counts`: one row per distinct score (and group),
built with partial aggregation. Curve metrics need running sums over scores; they
use `running_totals`, which splits the score range into quantile buckets so the
sort and the running sum are spread over many tasks instead of one global window.
Threshold grids are bounded (at most a few hundred points), so per-group work on
the grid is done with array functions over a bounded list.
"""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col_of, count_sorted_below, safe_ratio
from ..functions.constants import REPORT_GRID_PCT, SELECTION_GRID_PCT


def grid(points_pct: Sequence[int]) -> list[float]:
    """Exact grid values i/100 (no float drift from repeated addition)."""
    return [i / 100 for i in points_pct]


def score_counts(df: DataFrame, label: str = "y", score: str = "p",
                 keys: Sequence[str] = ()) -> DataFrame:
    """(keys, score) -> positives, negatives."""
    y = col_of(label).cast("bigint")
    return df.groupBy(*[col_of(k) for k in keys], col_of(score).alias("s")).agg(
        F.sum(y).alias("pos"), F.sum(F.lit(1) - y).alias("neg"))


# group tables (one row per group, `buckets` values each) are broadcast up to this size
MAX_BROADCAST_CELLS = 2_000_000


def _small_groups(df: DataFrame, keys: Sequence[str], buckets: int) -> bool:
    """Size check behind every broadcast of a per-group table: the number of
    groups times the bucket count must stay under MAX_BROADCAST_CELLS."""
    if not keys:
        return True
    return df.select(*keys).distinct().count() * max(buckets, 1) <= MAX_BROADCAST_CELLS


def _join_groups(left: DataFrame, right: DataFrame, keys: Sequence[str], small: bool) -> DataFrame:
    """`left` with the columns of the group table `right` (broadcast if `small`, which the caller has checked);
    a group whose key is null joins its own row."""
    own = right.select(*[F.col(k).alias(f"_g_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_g_{k}")) for k in keys]
    return left.join(F.broadcast(own) if small else own, reduce(Column.__and__, same)).drop(*[f"_g_{k}" for k in keys])


def running_totals(df: DataFrame, order: str, values: Sequence[str], keys: Sequence[str] = (),
                   descending: bool = False, buckets: int = 256, suffix: str = "_cum",
                   broadcast_groups: bool | None = None) -> DataFrame:
    """Inclusive running sums of `values` ordered by `order` within `keys`.

    `order` must be unique within `keys` (true after `score_counts`). Exact:
    1) per group, approximate quantiles of `order` cut the range into buckets;
    2) a window partitioned by (keys, bucket) gives the running sum inside a bucket;
    3) bucket totals (at most `buckets` rows per group) give each bucket's offset.
    """
    keys = list(keys)
    if broadcast_groups is None:
        broadcast_groups = _small_groups(df, keys, buckets)
    o = -F.col(order) if descending else F.col(order)
    if buckets > 1:
        qs = [i / buckets for i in range(1, buckets)]
        bounds = df.groupBy(*keys).agg(F.percentile_approx(o, qs, 10000).alias("_bounds"))
        # a sketch merged in another order could move a boundary if it were computed twice
        # (two branches read it) or a lost shuffle block were recomputed; fix the boundaries once
        bounds = _materialize(bounds)
        if keys:
            x = _join_groups(df, bounds, keys, broadcast_groups)
        else:
            x = df.withColumn("_bounds", bounds.select("_bounds").scalar())
        x = x.withColumn("_bk", count_sorted_below(F.col("_bounds"), o, len(qs))).drop("_bounds")
    else:
        x = df.withColumn("_bk", F.lit(0))
    x = x.withColumn("_o", o)
    inner = Window.partitionBy(*keys, "_bk").orderBy("_o").rowsBetween(Window.unboundedPreceding, 0)
    x = x.select("*", *[F.sum(v).over(inner).alias(f"_in_{v}") for v in values])
    tot = x.groupBy(*keys, "_bk").agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    before = Window.partitionBy(*keys).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select(*keys, "_bk", *[F.coalesce(F.sum(f"_t_{v}").over(before), F.lit(0)).alias(f"_off_{v}")
                                     for v in values])
    x = _join_groups(x, off, [*keys, "_bk"], broadcast_groups)
    return x.select(*[c for c in df.columns],
                    *[(F.col(f"_in_{v}") + F.col(f"_off_{v}")).alias(f"{v}{suffix}") for v in values])


def _materialize(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the session's shared checkpoint folder: the score
    table feeds several passes (quantiles, windows, totals) and must not send
    each of them back to recompute the scored input."""
    from ..session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def curve_metrics(df: DataFrame, label: str = "y", score: str = "p", keys: Sequence[str] = (),
                  buckets: int = 256, materialize: bool = True) -> DataFrame:
    """Exact ROC-AUC (ties count one half) and average precision (step sum over
    distinct thresholds, no interpolation) per group, from ONE running sum."""
    sc = score_counts(df, label, score, keys)
    return curve_of_counts(_materialize(sc) if materialize else sc, keys, buckets)


def curve_of_counts(sc: DataFrame, keys: Sequence[str] = (), buckets: int = 256) -> DataFrame:
    """`curve_metrics` of a table of `score_counts`, which several passes read.

    Ascending inclusive sums give the negatives below each score; the counts at
    or above a score (for precision) are totals minus the ascending sums."""
    keys = list(keys)
    small = _small_groups(sc, keys, buckets)
    c = running_totals(sc, "s", ["pos", "neg"], keys, buckets=buckets, broadcast_groups=small)
    tot = sc.groupBy(*keys).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    c = _join_groups(c, tot, keys, small) if keys else c.select(
        "*", tot.select("n_pos").scalar().alias("n_pos"), tot.select("n_neg").scalar().alias("n_neg"))
    # positives x (negatives strictly below + half the tied negatives), kept in integers
    auc_term = (F.col("pos").cast("decimal(38,0)") *
                (2 * (F.col("neg_cum") - F.col("neg")) + F.col("neg")).cast("decimal(38,0)"))
    tp_at = F.col("n_pos") - F.col("pos_cum") + F.col("pos")     # scores >= s
    fp_at = F.col("n_neg") - F.col("neg_cum") + F.col("neg")
    g = c.groupBy(*keys).agg(F.sum(auc_term).alias("_auc"),
                             F.sum(F.col("pos") * (tp_at / (tp_at + fp_at))).alias("_ap"),
                             F.first("n_pos").alias("n_pos"), F.first("n_neg").alias("n_neg"))
    den = F.col("n_pos").cast("double") * F.col("n_neg").cast("double") * 2
    return g.select(*keys,
                    F.when(den > 0, F.col("_auc").cast("double") / den).alias("roc_auc"),
                    F.when(F.col("n_pos") > 0, F.col("_ap") / F.col("n_pos")).alias("average_precision"),
                    F.col("n_pos").cast("bigint").alias("n_pos"), F.col("n_neg").cast("bigint").alias("n_neg"))


def roc_auc(df: DataFrame, label: str = "y", score: str = "p", keys: Sequence[str] = (),
            buckets: int = 256) -> DataFrame:
    """Exact ROC-AUC per group (H4). NULL if a class is absent."""
    return curve_metrics(df, label, score, keys, buckets).select(*keys, "roc_auc", "n_pos", "n_neg")


def average_precision(df: DataFrame, label: str = "y", score: str = "p", keys: Sequence[str] = (),
                      buckets: int = 256) -> DataFrame:
    """Average precision per group (H5); not the trapezoid area."""
    return curve_metrics(df, label, score, keys, buckets).select(*keys, "average_precision")


def brier_prevalence(df: DataFrame, label: str = "y", score: str = "p", keys: Sequence[str] = ()) -> DataFrame:
    y, p = col_of(label).cast("double"), col_of(score).cast("double")
    return df.groupBy(*[col_of(k) for k in keys]).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((p - y) * (p - y)).alias("brier_score"),
        F.avg(y).alias("prevalence"))


def brier_of_counts(sc: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """`brier_prevalence` of a table of `score_counts`."""
    s, n = F.col("s").cast("double"), F.col("pos") + F.col("neg")
    # a row without a score has no error, as avg() skips it
    scored = F.sum(F.when(s.isNotNull(), n))
    return sc.groupBy(*keys).agg(
        F.sum(n).alias("n"),
        (F.sum(F.col("pos") * (s - 1) * (s - 1) + F.col("neg") * s * s) / scored).alias("brier_score"),
        (F.sum("pos") / F.sum(n)).alias("prevalence"))


def discrimination(df: DataFrame, label: str = "y", score: str = "p", keys: Sequence[str] = ()) -> DataFrame:
    """roc_auc, pr_auc, brier_score, prevalence per group, all from one counted table."""
    return discrimination_of_counts(_materialize(score_counts(df, label, score, keys)), keys)


def discrimination_of_counts(sc: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    keys = list(keys)
    a = curve_of_counts(sc, keys).withColumnRenamed("average_precision", "pr_auc")
    c = brier_of_counts(sc, keys).select(*keys, "brier_score", "prevalence")
    if keys:
        return _join_groups(a, c, keys, False).select(*keys, "roc_auc", "pr_auc", "brier_score", "prevalence")
    return a.select("roc_auc", "pr_auc", c.select("brier_score").scalar().alias("brier_score"),
                    c.select("prevalence").scalar().alias("prevalence"))


def evaluation(df: DataFrame, thresholds: Sequence[float] = tuple(grid(SELECTION_GRID_PCT)), label: str = "y",
               score: str = "p", keys: Sequence[str] = ()) -> DataFrame:
    """Discrimination and the best threshold (`best_threshold`) per group. The scored table is read once, into
    counts of distinct scores that merge by addition; every figure is folded from those."""
    keys = list(keys)
    sc = _materialize(score_counts(df, label, score, keys))
    d, best = discrimination_of_counts(sc, keys), best_of_counts(sc, thresholds, keys)
    best = best.select(*keys, F.col("threshold").alias("validation_threshold"), F.col("f1").alias("validation_f1"))
    return _join_groups(d, best, keys, False) if keys else d.crossJoin(best)  # one row each


# ---------------------------------------------------------------------------
# Threshold metrics
# ---------------------------------------------------------------------------

def confusion_metrics(c: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """From (keys, threshold, tp, fp, tn, fn) to the published metric row, rounded
    as published (threshold 3, rates 4, per-100 figures 2); zero denominators -> 0.0."""
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    neg, pos, pp = tn + fp, tp + fn, tp + fp
    n = tp + fp + tn + fn
    per100 = lambda x: F.when(n > 0, F.round(100 * x / n, 2)).otherwise(F.lit(0.0))
    return c.select(
        *keys,
        F.round("threshold", 3).alias("threshold"),
        F.round(safe_ratio(tp, pos), 4).alias("sensitivity_recall"),
        F.round(safe_ratio(tn, neg), 4).alias("specificity"),
        F.round(safe_ratio(tp, pp), 4).alias("precision"),
        F.round(safe_ratio(2 * tp, 2 * tp + fp + fn), 4).alias("f1"),
        F.round(safe_ratio(fp, neg), 4).alias("false_positive_rate"),
        F.round(safe_ratio(fp, pp), 4).alias("false_discovery_rate"),
        per100(pp).alias("alerts_per_100_encounters"),
        per100(fp).alias("false_positive_alerts_per_100_encounters"),
        per100(fn).alias("missed_readmissions_per_100_encounters"),
        tp.cast("bigint").alias("tp"), fp.cast("bigint").alias("fp"),
        tn.cast("bigint").alias("tn"), fn.cast("bigint").alias("fn"))


def threshold_metrics(df: DataFrame, threshold: float | Column, label: str = "y", score: str = "p",
                      keys: Sequence[str] = ()) -> DataFrame:
    """H1: metrics at one threshold (`p >= t` is positive). `threshold` may be a
    scalar-subquery column (e.g. chosen on validation)."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    y, p = col_of(label), col_of(score)
    hit = p >= t
    c = df.groupBy(*[col_of(k) for k in keys]).agg(
        F.count_if((y == 1) & hit).alias("tp"), F.count_if((y == 0) & hit).alias("fp"),
        F.count_if((y == 0) & ~hit).alias("tn"), F.count_if((y == 1) & ~hit).alias("fn"),
        F.first(t).alias("threshold"))
    return confusion_metrics(c, keys)


def threshold_table(df: DataFrame, thresholds: Sequence[float] = tuple(grid(REPORT_GRID_PCT)),
                    label: str = "y", score: str = "p", keys: Sequence[str] = ()) -> DataFrame:
    """H2: metrics at every grid threshold in one pass over the data.

    Each distinct score is assigned to its grid cell (number of thresholds <= s);
    per group the cells (at most len(grid)+1) are gathered and the counts at each
    threshold are suffix sums over that bounded list."""
    return table_of_counts(score_counts(df, label, score, keys), thresholds, keys)


def table_of_counts(sc: DataFrame, thresholds: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """`threshold_table` of a table of `score_counts`."""
    ts = sorted(float(t) for t in thresholds)
    g = F.array(*[F.lit(t) for t in ts])
    cell = sc.withColumn("_cell", count_sorted_below(g, F.col("s"), len(ts), inclusive=True))
    per = cell.groupBy(*keys, "_cell").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    lists = per.groupBy(*keys).agg(F.collect_list(F.struct("_cell", "pos", "neg")).alias("_cells"),
                                   F.sum("pos").alias("_P"), F.sum("neg").alias("_N"))

    def at(i):  # counts over cells >= i, i.e. scores >= threshold i (1-based)
        sel = F.filter("_cells", lambda x: x["_cell"] >= i)
        tp = F.aggregate(sel, F.lit(0).cast("bigint"), lambda acc, x: acc + x["pos"])
        fp = F.aggregate(sel, F.lit(0).cast("bigint"), lambda acc, x: acc + x["neg"])
        return F.struct(F.element_at(g, i).alias("threshold"), tp.alias("tp"), fp.alias("fp"))

    rows = lists.select(*keys, "_P", "_N",
                        F.inline(F.transform(F.sequence(F.lit(1), F.lit(len(ts))), at)))
    c = rows.select(*keys, "threshold", "tp", "fp",
                    (F.col("_N") - F.col("fp")).alias("tn"), (F.col("_P") - F.col("tp")).alias("fn"))
    return confusion_metrics(c, keys)


def best_threshold(df: DataFrame, thresholds: Sequence[float] = tuple(grid(SELECTION_GRID_PCT)),
                   label: str = "y", score: str = "p", keys: Sequence[str] = ()) -> DataFrame:
    """H3: grid point with the highest F1 (already rounded to 4); lowest threshold wins ties."""
    return best_of_counts(score_counts(df, label, score, keys), thresholds, keys)


def best_of_counts(sc: DataFrame, thresholds: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """`best_threshold` of a table of `score_counts`."""
    t = table_of_counts(sc, thresholds, keys)
    w = Window.partitionBy(*keys).orderBy(F.col("f1").desc(), F.col("threshold").asc())
    return t.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
