"""Registered model queries (G1-G9, A9, I3, I5). Fitted models have no SQL twin;
the driver checks their rows, and the tests check planted-signal behaviour."""
from __future__ import annotations

from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import DIAGNOSIS_REDUCED_DROP, FEATURE_GROUPS, SELECTION_GRID_PCT
from ..operators import metrics, models, prepare
from ..session import scratch_dir
from ..sources import documents
from ..sources.sinks import write_document
from .patient_queries import ALL_FEATURES, CATEGORICAL, NUMERIC, E, pool_sql
from .patient_queries import encounter_table as _encounter_table
from .registry import R, register

MODEL_ID = "caresignal-gbt-research-v1"
CLINICAL_STATUS = "research MVP only; not clinically validated or deployment-ready"
OUTCOME = "readmitted within 30 days against all other outcomes"
FIT_DATA = "patients of the training and validation splits; the test split is held out"
INTENDED_USE = "demonstration, reproducible inference tests and preparation of an external validation"

#: Fitted models and bundles of this session, by folder of the tables; `forget_session` empties it.
_FIT_CACHE: dict = {}


def forget_session() -> None:
    """Forget fitted models, bundles and written request tables: the next query derives and fits anew.
    Call it when the tables of a folder have changed (and before timing a cold run)."""
    from .inference_queries import _WRITTEN
    for v in _FIT_CACHE.values():
        if isinstance(v, DataFrame):
            v.unpersist()
    _FIT_CACHE.clear()
    _WRITTEN.clear()


def encounter_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prepared encounters, persisted once per session: every fit, score and
    evaluation of the model queries reads the same frame (as ML training does)."""
    key = ("encounters", spark.sparkContext.applicationId, sf_dir)
    if key not in _FIT_CACHE:
        _FIT_CACHE[key] = _encounter_table(spark, sf_dir).persist()
    return _FIT_CACHE[key]


def model_features(train: DataFrame) -> tuple[list[str], list[str], list[str]]:
    """Numeric / categorical features after dropping columns > 80 % missing in train."""
    sp = prepare.sparse_columns(train, ALL_FEATURES)
    dropped = sorted(r["column"] for r in sp.where("dropped").select("column").collect())
    num = [c for c in NUMERIC if c not in dropped]
    cat = [c for c in CATEGORICAL if c not in dropped]
    return num, cat, dropped


def _fit_cached(spark, sf_dir, spec: models.ModelSpec, drop=(), on=("train",)) -> models.FittedModel:
    key = (spark.sparkContext.applicationId, sf_dir, repr(spec), tuple(drop), tuple(on))
    if key not in _FIT_CACHE:
        e = encounter_table(spark, sf_dir)
        train = e.where(F.col("split").isin(list(on)))
        num, cat, _ = model_features(e.where("split = 'train'"))
        num = [c for c in num if c not in drop]
        cat = [c for c in cat if c not in drop]
        _FIT_CACHE[key] = models.fit(train, num, cat, spec)
    return _FIT_CACHE[key]


def _fit_many(spark, sf_dir, wanted: list[tuple[models.ModelSpec, tuple]]) -> list[models.FittedModel]:
    """Models of (spec, dropped features) on the training split; those not fitted yet run concurrently."""
    keys = [(spark.sparkContext.applicationId, sf_dir, repr(spec), tuple(drop), ("train",)) for spec, drop in wanted]
    todo = [k for k, key in enumerate(keys) if key not in _FIT_CACHE]
    if todo:
        train = encounter_table(spark, sf_dir).where("split = 'train'")
        num, cat, _ = model_features(train)
        left = lambda cols, drop: [c for c in cols if c not in drop]
        fitted = models.fit_all(train, [(left(num, wanted[k][1]), left(cat, wanted[k][1]), wanted[k][0]) for k in todo])
        _FIT_CACHE.update({keys[k]: fm for k, fm in zip(todo, fitted, strict=True)})
    return [_FIT_CACHE[k] for k in keys]


def _eval_splits(fm: models.FittedModel, df: DataFrame) -> DataFrame:
    return models.evaluate(fm.score(df), keys=["split"])


# --- G1 / G9 ---------------------------------------------------------------------------
@register("baseline_lr")
def q_baseline_lr(spark, sf_dir):
    fm = _fit_cached(spark, sf_dir, models.baseline_spec())
    e = encounter_table(spark, sf_dir).where("split IN ('validation', 'test')")
    return _eval_splits(fm, e)


#: A part of the mean penalised loss's gradient below this counts as zero.
MAX_GRADIENT = 1e-5


@register("logistic_optimality", E(
    "SELECT feature, CAST(count(*) FILTER (WHERE kept) + max(CASE WHEN kept THEN 0 ELSE 1 END) AS BIGINT) AS terms, true AS optimal\n"
    f"FROM ({pool_sql(10)}) GROUP BY feature\n"
    + "\n".join(f"UNION ALL SELECT '{c}', CAST(1 AS BIGINT), true" for c in (*NUMERIC, "intercept"))))
def q_logistic_optimality(spark, sf_dir):
    """Terms of each feature of the baseline, and whether its part of the penalised loss's gradient is near zero."""
    fm = _fit_cached(spark, sf_dir, models.baseline_spec())
    train = encounter_table(spark, sf_dir).where("split = 'train'")
    return models.optimality(fm, train).select("feature", "terms", (F.col("gradient_norm") < MAX_GRADIENT * train.count()).alias("optimal"))


@register("coefficients")
def q_coefficients(spark, sf_dir):
    fm = _fit_cached(spark, sf_dir, models.baseline_spec())
    return models.coefficients(fm, spark)


# --- G2 / G3 ------------------------------------------------------------------------------
@register("gbt_model")
def q_gbt_model(spark, sf_dir):
    """Leaf-wise second-order boosting, and MLlib's boosted trees beside it."""
    specs = (models.benchmark_specs()[1], models.mllib_gbt_spec())
    rows = encounter_table(spark, sf_dir).where("split IN ('validation', 'test')")
    long = [fm.score(rows).select(F.lit(fm.spec.kind).alias("estimator"), "split", "y", "p") for fm in _fit_many(spark, sf_dir, [(s, ()) for s in specs])]
    return models.evaluate(long[0].unionAll(long[1]), keys=["estimator", "split"])


@register("rf_model")
def q_rf_model(spark, sf_dir):
    spec = models.benchmark_specs()[2]
    fm = _fit_cached(spark, sf_dir, spec)
    e = encounter_table(spark, sf_dir).where("split IN ('validation', 'test')")
    return _eval_splits(fm, e)


# --- G4 / G5: candidate grid on validation, winner tested once ------------------------------
VARIANTS = (("full", ()), ("diagnosis_reduced", DIAGNOSIS_REDUCED_DROP))


def grid_candidates() -> list[tuple[str, tuple, models.ModelSpec]]:
    return [(variant, drop, spec) for variant, drop in VARIANTS for spec in models.benchmark_specs()]


def model_grid(spark, sf_dir) -> DataFrame:
    """Six candidates, fitted concurrently; their scores of the validation rows are one long table that is counted
    once, and all figures are folded from the counts."""
    cands = grid_candidates()
    fitted = _fit_many(spark, sf_dir, [(spec, drop) for _, drop, spec in cands])
    val = encounter_table(spark, sf_dir).where("split = 'validation'")
    long = reduce(DataFrame.unionAll, [fm.score(val).select(F.lit(k).alias("candidate_order"), "y", "p") for k, fm in enumerate(fitted)])
    ev = metrics.evaluation(long, metrics.grid(SELECTION_GRID_PCT), keys=["candidate_order"])
    name = lambda x: F.element_at(F.array(*[F.lit(v) for v in x]), F.col("candidate_order") + 1)
    return ev.select(name([s.name for _, _, s in cands]).alias("model"), name([v for v, _, _ in cands]).alias("feature_variant"), "candidate_order",
                     *[F.round(c, 4).alias(c) for c in ("roc_auc", "pr_auc", "brier_score")], "validation_threshold", "validation_f1")


@register("model_grid")
def q_model_grid(spark, sf_dir):
    return model_grid(spark, sf_dir)


@register("select_winner")
def q_select_winner(spark, sf_dir):
    w = models.pick_winner(model_grid(spark, sf_dir)).first()
    _, drop, spec = grid_candidates()[w["candidate_order"]]
    fm = _fit_many(spark, sf_dir, [(spec, drop)])[0]
    test = fm.score(encounter_table(spark, sf_dir).where("split = 'test'"))
    ev = models.evaluate(test).select("roc_auc", "pr_auc", "brier_score")
    tm = metrics.threshold_metrics(test, float(w["validation_threshold"]))
    return tm.select(F.lit(w["model"]).alias("model"), F.lit(w["feature_variant"]).alias("feature_variant"),
                     ev.select("roc_auc").scalar().alias("roc_auc"), ev.select("pr_auc").scalar().alias("pr_auc"),
                     ev.select("brier_score").scalar().alias("brier_score"), "*")


# --- G6 / A9: final fit on train + validation, saved and reloaded ---------------------------------
def bundle_path(spark: SparkSession, sf_dir: str) -> str:
    key = ("bundle", spark.sparkContext.applicationId, sf_dir)
    if key not in _FIT_CACHE:
        spec = models.benchmark_specs()[1]
        fm = _fit_cached(spark, sf_dir, spec, on=("train", "validation"))
        path = scratch_dir(spark, "bundle")
        types = {c: "numeric" for c in fm.numeric} | {c: "categorical" for c in fm.categorical}
        sparse = prepare.sparse_columns(encounter_table(spark, sf_dir).where("split = 'train'"), ALL_FEATURES)
        dropped = sorted(r["column"] for r in sparse.where("dropped").select("column").collect())
        manifest = {"schema_version": "1.1.0", "generated_at_utc": datetime.now(timezone.utc).isoformat(),
                    "model_id": MODEL_ID, "architecture": "leaf-wise histogram boosting, stored as GBTClassificationModel", "feature_variant": "full",
                    "input_features": [c for c in ALL_FEATURES if c in types], "feature_types": types,
                    "dropped_sparse_columns": dropped, "outcome": OUTCOME, "fit_data": FIT_DATA,
                    "clinical_status": CLINICAL_STATUS, "public_patient_probability_allowed": False,
                    "intended_use": INTENDED_USE}
        models.save_bundle(spark, fm, path, manifest)
        _FIT_CACHE[key] = path
    return _FIT_CACHE[key]


def _bundle_sql() -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{MODEL_ID}' AS model_id, '{c}' AS feature, '{'numeric' if c in NUMERIC else 'categorical'}' AS feature_type, "
        f"CAST(count({c}) AS BIGINT) AS fit_values FROM encs WHERE split <> 'test' "
        f"HAVING avg(CASE WHEN split = 'train' THEN CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END END) <= 0.8" for c in ALL_FEATURES)


@register("model_bundle", E(_bundle_sql()))
def q_model_bundle(spark, sf_dir):
    """Input features of the reloaded manifest with their types and the values they were fitted on
    (`bundle_roundtrip` compares the reloaded scores)."""
    fm, manifest = models.load_bundle(spark, bundle_path(spark, sf_dir))
    feats = manifest["input_features"]
    rows = encounter_table(spark, sf_dir).where("split <> 'test'")
    counts = rows.agg(*[F.count(c).alias(c) for c in feats]).unpivot([], feats, "feature", "fit_values")
    kind = F.create_map(*[F.lit(x) for c in feats for x in (c, manifest["feature_types"][c])])
    return counts.select(F.lit(manifest["model_id"]).alias("model_id"), "feature", kind[F.col("feature")].alias("feature_type"), "fit_values")


# --- G7: feature-group ablation -------------------------------------------------------------------
@register("ablation")
def q_ablation(spark, sf_dir):
    """Baseline and one model without each feature group, fitted concurrently; all test scores are counted once."""
    test = encounter_table(spark, sf_dir).where("split = 'test'")
    groups = [(name, [c for c in cols if c in (*NUMERIC, *CATEGORICAL)]) for name, cols in FEATURE_GROUPS]
    groups = [("", []), *[(name, cols) for name, cols in groups if cols]]
    fitted = _fit_many(spark, sf_dir, [(models.baseline_spec(), tuple(cols)) for _, cols in groups])
    long = reduce(DataFrame.unionAll, [fm.score(test).select(F.lit(name).alias("removed_group"), "y", "p") for (name, _), fm in zip(groups, fitted, strict=True)])
    figures = {"roc_auc": "roc_auc", "pr_auc": "pr_auc", "brier_score": "brier"}
    ev = metrics._materialize(models.evaluate(long, keys=["removed_group"]))
    base = ev.where("removed_group = ''")
    removed = F.create_map(*[F.lit(x) for name, cols in groups for x in (name, ",".join(cols))])
    out = ev.where("removed_group <> ''").select(
        "removed_group", removed[F.col("removed_group")].alias("removed_features"), *figures,
        *[F.round(F.col(c) - base.select(c).scalar(), 4).alias(f"delta_{short}_vs_baseline") for c, short in figures.items()])
    return out.orderBy("delta_roc_auc_vs_baseline", "removed_group")


# --- B11: features left by each group drop, with their non-missing training values -----------------
DROPS = (*FEATURE_GROUPS, ("diagnosis_reduced", DIAGNOSIS_REDUCED_DROP))


@register("feature_variants", E("\nUNION ALL\n".join(
    f"SELECT '{name}' AS removed_group, '{c}' AS feature, CAST(count({c}) AS BIGINT) AS non_missing FROM encs WHERE split = 'train'"
    for name, drop in DROPS for c in ALL_FEATURES if c not in drop)))
def q_feature_variants(spark, sf_dir):
    train = _encounter_table(spark, sf_dir).where("split = 'train'").select(*ALL_FEATURES)
    counts = train.agg(*[F.count(c).alias(c) for c in ALL_FEATURES]).unpivot([], list(ALL_FEATURES), "feature", "non_missing")
    kept = F.create_map(*[x for name, drop in DROPS for x in (
        F.lit(name), F.array(*[F.lit(c) for c in prepare.drop_features(train, drop)[0].columns]))])
    groups = F.explode(kept).alias("removed_group", "features")
    return counts.select("feature", "non_missing", groups).where(F.array_contains("features", F.col("feature"))) \
        .select("removed_group", "feature", "non_missing")


# --- A9: scores of the reloaded bundle against the fitted model --------------------------------------
@register("bundle_roundtrip", E("SELECT split, CAST(count(*) AS BIGINT) AS encounters, CAST(0 AS BIGINT) AS different, "
                                "CAST(0 AS BIGINT) AS outside_0_1 FROM encs WHERE split <> 'train' GROUP BY split"))
def q_bundle_roundtrip(spark, sf_dir):
    fm = _fit_cached(spark, sf_dir, models.benchmark_specs()[1], on=("train", "validation"))
    back, _ = models.load_bundle(spark, bundle_path(spark, sf_dir))
    rows = encounter_table(spark, sf_dir).where("split <> 'train'")
    both = back.score(fm.score(rows, "p_fit").select(*rows.columns, "p_fit"), "p_back")
    return both.groupBy("split").agg(F.count(F.lit(1)).alias("encounters"), F.count_if(~F.col("p_fit").eqNullSafe(F.col("p_back"))).alias("different"),
                                     F.count_if(~F.col("p_back").between(0, 1)).alias("outside_0_1"))


# --- G8: permutation importance --------------------------------------------------------------------
@register("permutation_importance")
def q_permutation_importance(spark, sf_dir):
    fm = _fit_cached(spark, sf_dir, models.baseline_spec())
    test = encounter_table(spark, sf_dir).where("split = 'test'")
    return models.permutation_importance(fm, test, fm.features)


# --- G8: what a permutation keeps, and G5: the winner's order, on rows that need no model -------------
PERMUTED = ("number_inpatient", "num_medications")


@register("permutation_values", E("\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, CAST(r AS INTEGER) AS repeat, CAST({c} AS BIGINT) AS value, CAST(count(*) AS BIGINT) AS n "
    f"FROM encs, range(3) t(r) WHERE split = 'test' GROUP BY r, {c}" for c in PERMUTED)))
def q_permutation_values(spark, sf_dir):
    """Values of each permuted column with their counts: the same as before the permutation."""
    test = _encounter_table(spark, sf_dir).where("split = 'test'").select("encounter_id", *PERMUTED)
    long = models.permuted_long(test, PERMUTED, repeats=3)
    value = F.when(F.col("feature") == PERMUTED[0], F.col(PERMUTED[0])).otherwise(F.col(PERMUTED[1]))
    return long.groupBy("feature", "repeat", value.cast("bigint").alias("value")).agg(F.count(F.lit(1)).alias("n"))


_CANDIDATES_SQL = """
, cands AS (
  SELECT 'as_is' AS model, 0 AS candidate_order, y, p FROM scored WHERE split = 'validation' UNION ALL
  SELECT 'reversed', 1, y, 1 - p FROM scored WHERE split = 'validation' UNION ALL
  SELECT 'coarse', 2, y, floor(p * 10) / 10 FROM scored WHERE split = 'validation')
, counts AS (SELECT model, candidate_order, p AS s, sum(y) AS pos, count(*) - sum(y) AS neg FROM cands GROUP BY ALL)
, sums AS (
  SELECT *, sum(neg) OVER (PARTITION BY model ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS neg_below,
         sum(pos) OVER (PARTITION BY model ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS tp,
         sum(neg) OVER (PARTITION BY model ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS fp FROM counts)
, curves AS (
  SELECT model, candidate_order, sum(pos * (coalesce(neg_below, 0) + 0.5 * neg)) / (sum(pos) * sum(neg)) AS roc_auc,
         sum(pos * tp / (tp + fp)) / sum(pos) AS pr_auc FROM sums GROUP BY ALL)
, brier AS (SELECT model, avg((p - y) * (p - y)) AS brier_score FROM cands GROUP BY model)
"""


@register("winner_on_scores", E("").rstrip() + _CANDIDATES_SQL + f"""
SELECT model, CAST(candidate_order AS INTEGER) AS candidate_order, {R('roc_auc', 4)} AS roc_auc, {R('pr_auc', 4)} AS pr_auc,
       {R('brier_score', 4)} AS brier_score FROM curves JOIN brier USING (model)
ORDER BY roc_auc DESC, pr_auc DESC, brier_score ASC, candidate_order LIMIT 1""")
def q_winner_on_scores(spark, sf_dir):
    """The winner among three deterministic scores of the validation rows, all evaluated in one pass."""
    from .patient_queries import scored_table
    p = F.col("p")
    cands = F.explode(F.array(*[F.struct(F.lit(n).alias("model"), F.lit(i).alias("candidate_order"), s.cast("double").alias("p"))
                                for i, (n, s) in enumerate((("as_is", p), ("reversed", 1 - p), ("coarse", F.floor(p * 10) / 10)))]))
    long = scored_table(spark, sf_dir).where("split = 'validation'").select("y", cands.alias("c")).select("y", "c.*")
    return models.pick_winner(models.evaluate(long, keys=["model", "candidate_order"])).drop("prevalence")


# --- A7: benchmark and ablation documents on scores that need no model, as written and read back ---------
_SPLIT_CURVES_SQL = """
, cands AS (
  SELECT split, 'as_is' AS model, 0 AS candidate_order, y, p FROM scored WHERE split IN ('validation', 'test') UNION ALL
  SELECT split, 'reversed', 1, y, 1 - p FROM scored WHERE split IN ('validation', 'test') UNION ALL
  SELECT split, 'coarse', 2, y, floor(p * 10) / 10 FROM scored WHERE split IN ('validation', 'test'))
, counts AS (SELECT split, model, p AS s, sum(y) AS pos, count(*) - sum(y) AS neg FROM cands GROUP BY ALL)
, sums AS (
  SELECT *, sum(neg) OVER (PARTITION BY split, model ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS neg_below,
         sum(pos) OVER (PARTITION BY split, model ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS tp,
         sum(neg) OVER (PARTITION BY split, model ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS fp FROM counts)
, curves AS (
  SELECT split, model, sum(pos * (coalesce(neg_below, 0) + 0.5 * neg)) / (sum(pos) * sum(neg)) AS roc_auc,
         sum(pos * tp / (tp + fp)) / sum(pos) AS pr_auc FROM sums GROUP BY ALL)
, shares AS (SELECT split, model, candidate_order, avg((p - y) * (p - y)) AS brier_score, avg(y) AS prevalence FROM cands GROUP BY ALL)
, grid AS (
  SELECT split, model, candidate_order, """ + ", ".join(f"{R(c, 4)} AS {c}" for c in ("roc_auc", "pr_auc", "brier_score", "prevalence")) + """
  FROM curves JOIN shares USING (split, model))
, winner AS (SELECT model FROM grid WHERE split = 'validation' ORDER BY roc_auc DESC, pr_auc DESC, brier_score ASC, candidate_order LIMIT 1)
"""
_FIGURES = ("roc_auc", "pr_auc", "brier_score", "prevalence")


def _score_grid(spark, sf_dir) -> DataFrame:
    """Figures of three deterministic scores on the validation and test rows, stored: documents read them several times."""
    from .patient_queries import scored_table
    p = F.col("p")
    cands = F.explode(F.array(*[F.struct(F.lit(n).alias("model"), F.lit(i).alias("candidate_order"), s.cast("double").alias("p"))
                                for i, (n, s) in enumerate((("as_is", p), ("reversed", 1 - p), ("coarse", F.floor(p * 10) / 10)))]))
    rows = scored_table(spark, sf_dir).where("split IN ('validation', 'test')").select("split", "y", cands.alias("c")).select("split", "y", "c.*")
    return metrics._materialize(models.evaluate(rows, keys=["split", "model", "candidate_order"]))


def _read_back(spark, doc: DataFrame, name: str) -> DataFrame:
    path = scratch_dir(spark, name)
    write_document(doc, path)
    return spark.read.schema(doc.schema).json(path)


@register("benchmark_doc", E("").rstrip() + _SPLIT_CURVES_SQL + f"""
SELECT 'candidate' AS part, CAST(candidate_order AS INTEGER) AS position, model, {', '.join(_FIGURES)} FROM grid WHERE split = 'validation'
UNION ALL SELECT 'winner', CAST(0 AS INTEGER), model, {', '.join(_FIGURES)} FROM grid JOIN winner USING (model) WHERE split = 'validation'
UNION ALL SELECT 'winner_test', CAST(0 AS INTEGER), model, {', '.join(_FIGURES)} FROM grid JOIN winner USING (model) WHERE split = 'test'""")
def q_benchmark_doc(spark, sf_dir):
    """The written benchmark document's candidates by position, its winner and the winner's test figures."""
    grid = _score_grid(spark, sf_dir)
    candidates = grid.where("split = 'validation'").drop("split")
    winner = models.pick_winner(candidates)
    tested = grid.where("split = 'test'").drop("split").join(F.broadcast(winner.select("model")), "model")
    doc = _read_back(spark, documents.benchmark_document(candidates, winner, tested), "benchmark-doc")
    listed = doc.select(F.posexplode("validation_candidates").alias("position", "c")).select(
        F.lit("candidate").alias("part"), "position", "c.model", *[f"c.{x}" for x in _FIGURES])
    parts = []
    for name, column in (("winner", "selected_winner"), ("winner_test", "winner_test")):
        parts.append(doc.select(F.col(column).alias("c")).select(
            F.lit(name).alias("part"), F.lit(0).alias("position"), "c.model", *[f"c.{x}" for x in _FIGURES]))
    return listed.unionByName(parts[0]).unionByName(parts[1])


@register("ablation_doc", E("").rstrip() + _SPLIT_CURVES_SQL + f"""
, losses AS (
  SELECT g.model, g.roc_auc, {R('g.roc_auc - b.roc_auc', 4)} AS delta FROM grid g, (SELECT roc_auc FROM grid WHERE split = 'validation' AND model = 'as_is') b
  WHERE split = 'validation' AND model <> 'as_is')
SELECT CAST(row_number() OVER (ORDER BY delta, model) - 1 AS INTEGER) AS position, model AS removed_group, roc_auc, delta AS delta_roc_auc_vs_baseline,
       (SELECT roc_auc FROM grid WHERE split = 'validation' AND model = 'as_is') AS baseline_roc_auc FROM losses""")
def q_ablation_doc(spark, sf_dir):
    """The written ablation document's experiments by position (largest loss first) and its baseline."""
    grid = _score_grid(spark, sf_dir).where("split = 'validation'").drop("split")
    baseline = grid.where("model = 'as_is'")
    others = grid.where("model <> 'as_is'").withColumnRenamed("model", "removed_group")
    delta = F.round(F.col("roc_auc") - baseline.select("roc_auc").scalar(), 4)
    doc = documents.ablation_document(baseline, others.withColumn("delta_roc_auc_vs_baseline", delta))
    read = _read_back(spark, doc, "ablation-doc")
    return read.select(F.col("baseline.roc_auc").alias("baseline_roc_auc"), F.posexplode("experiments").alias("position", "c")).select(
        "position", "c.removed_group", "c.roc_auc", "c.delta_roc_auc_vs_baseline", "baseline_roc_auc")
