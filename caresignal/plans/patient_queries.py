"""Registered encounter queries: split, preparation statistics, metrics, error
profiles (B6-B12, D15-D18, F1-F7, H1-H6, J1, J5)."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import (
    FOCUS_CATEGORICAL,
    FOCUS_NUMERIC,
    REPORT_GRID_PCT,
    RESEARCH_THRESHOLD,
    SELECTION_GRID_PCT,
)
from ..operators import errors, features, metrics, prepare, split
from ..sources import fixtures
from ..sources.fixtures import ENCOUNTER_FIXTURE_SQL
from .registry import R, finish, register, with_ctes

ENCOUNTER_SPLIT_SQL = """
encs AS (
  SELECT e.*, CASE WHEN readmitted = '<30' THEN 1 ELSE 0 END AS y,
         CASE WHEN b < 64 THEN 'train' WHEN b < 80 THEN 'validation' ELSE 'test' END AS split
  FROM (SELECT *, ('0x' || substr(md5('42:' || CAST(patient_nbr AS VARCHAR)), 1, 8))::BIGINT % 100 AS b
        FROM enc) e
  WHERE patient_nbr IS NOT NULL),
scored AS (
  SELECT *, ((encounter_id * 7919) % 650 + CASE WHEN (y = 1 AND encounter_id % 3 <> 0) OR (y = 0 AND encounter_id % 10 = 0)
         THEN 350 ELSE 0 END) / 1000.0::DOUBLE AS p FROM encs)
"""
E = with_ctes(ENCOUNTER_FIXTURE_SQL, ENCOUNTER_SPLIT_SQL)

NUMERIC = ("admission_type_id", "discharge_disposition_id", "admission_source_id", "time_in_hospital",
           "num_lab_procedures", "num_procedures", "num_medications", "number_outpatient",
           "number_emergency", "number_inpatient", "number_diagnoses")
CATEGORICAL = ("age", "gender", "medical_specialty", "diag_1", "diag_2", "diag_3")
ALL_FEATURES = ("age", "gender", "admission_type_id", "discharge_disposition_id", "admission_source_id",
                "time_in_hospital", "medical_specialty", "num_lab_procedures", "num_procedures",
                "num_medications", "number_outpatient", "number_emergency", "number_inpatient",
                "diag_1", "diag_2", "diag_3", "number_diagnoses", "weight")


def encounter_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prepared encounters with binary label `y` and patient split."""
    e = prepare.prepare_encounters(fixtures.encounters(spark, sf_dir))
    e = prepare.encounter_label(e, label="y")
    return split.patient_split(e)


def scored_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic score that needs no model (FIXTURES.md section 3)."""
    e = encounter_table(spark, sf_dir)
    k, y = F.col("encounter_id"), F.col("y")
    # two thirds of the positives and a tenth of the negatives score high: all four error groups occur
    high = ((y == 1) & (k % 3 != 0)) | ((y == 0) & (k % 10 == 0))
    return e.withColumn("p", ((k * 7919) % 650 + F.when(high, F.lit(350)).otherwise(F.lit(0))) / F.lit(1000.0))


# --- B6, F1, F2, D18, J5 --------------------------------------------------------------
@register("encounter_label", E("""
SELECT readmitted, y, CAST(count(*) AS BIGINT) AS encounters FROM encs GROUP BY readmitted, y"""))
def q_encounter_label(spark, sf_dir):
    e = encounter_table(spark, sf_dir)
    return e.groupBy("readmitted", "y").agg(F.count(F.lit(1)).alias("encounters"))


@register("patient_split", E("""
SELECT split, CAST(count(*) AS BIGINT) AS encounters, CAST(count(DISTINCT patient_nbr) AS BIGINT) AS patients
FROM encs GROUP BY split"""))
def q_patient_split(spark, sf_dir):
    e = encounter_table(spark, sf_dir)
    return e.groupBy("split").agg(F.count(F.lit(1)).alias("encounters"),
                                  F.count_distinct("patient_nbr").alias("patients"))


@register("split_leakage", E("""
SELECT patient_nbr, CAST(count(DISTINCT split) AS BIGINT) AS splits FROM encs GROUP BY patient_nbr
HAVING count(DISTINCT split) > 1"""))
def q_split_leakage(spark, sf_dir):
    return split.split_leakage(encounter_table(spark, sf_dir))


@register("split_leakage_found", E("""
SELECT patient_nbr, CAST(count(DISTINCT split) AS BIGINT) AS splits
FROM (SELECT patient_nbr, CASE WHEN b < 64 THEN 'train' WHEN b < 80 THEN 'validation' ELSE 'test' END AS split
      FROM (SELECT patient_nbr, ('0x' || substr(md5('42:' || CAST(encounter_id AS VARCHAR)), 1, 8))::BIGINT % 100 AS b FROM encs))
GROUP BY patient_nbr HAVING count(DISTINCT split) > 1"""))
def q_split_leakage_found(spark, sf_dir):
    """The check on a split that leaks: encounters are dealt, not patients."""
    e = encounter_table(spark, sf_dir).select("patient_nbr", split.split_column("encounter_id").alias("split"))
    return split.split_leakage(e)


@register("split_profile", E(f"""
SELECT split, CAST(count(*) AS BIGINT) AS encounters, CAST(count(DISTINCT patient_nbr) AS BIGINT) AS patients,
       {R('avg(y)')} AS prevalence
FROM encs GROUP BY split"""))
def q_split_profile(spark, sf_dir):
    return finish(split.split_profile(encounter_table(spark, sf_dir), label="y"))


@register("fit_frame", E("""
SELECT split, CAST(count(*) AS BIGINT) AS encounters FROM encs WHERE split IN ('train', 'validation') GROUP BY split"""))
def q_fit_frame(spark, sf_dir):
    f = split.fit_frame(encounter_table(spark, sf_dir))
    return f.groupBy("split").agg(F.count(F.lit(1)).alias("encounters"))


# --- B7-B10: feature frame, sparse columns, types, alignment ------------------------------
@register("feature_frame", E("""
SELECT split, CAST(count(*) AS BIGINT) AS rows,
       CAST(count(*) FILTER (WHERE diag_1 IS NULL) AS BIGINT) AS diag_1_missing,
       CAST(sum(number_inpatient) AS BIGINT) AS number_inpatient_total
FROM encs GROUP BY split"""))
def q_feature_frame(spark, sf_dir):
    e = encounter_table(spark, sf_dir)
    f = prepare.feature_frame(e, drop=("readmitted", "encounter_id", "patient_nbr", "y"))
    assert "readmitted" not in f.columns and "patient_nbr" not in f.columns
    return f.groupBy("split").agg(F.count(F.lit(1)).alias("rows"),
                                  F.count_if(F.col("diag_1").isNull()).alias("diag_1_missing"),
                                  F.sum("number_inpatient").cast("bigint").alias("number_inpatient_total"))


def _sparse_sql():
    parts = []
    for c in ALL_FEATURES:
        t = "numeric" if c in NUMERIC else "categorical"
        parts.append(f"SELECT '{c}' AS column_name, '{t}' AS feature_type, "
                     f"{R(f'avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END)')} AS missing_share, "
                     f"avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) > 0.8 AS dropped "
                     f"FROM encs WHERE split = 'train'")
    return "\nUNION ALL\n".join(parts)


@register("sparse_columns", E(_sparse_sql()))
def q_sparse_columns(spark, sf_dir):
    e = encounter_table(spark, sf_dir)
    train = e.where("split = 'train'")
    types = prepare.feature_types(e, ALL_FEATURES)
    s = prepare.sparse_columns(train, ALL_FEATURES)
    tmap = F.create_map(*[x for k, v in types.items() for x in (F.lit(k), F.lit(v))])
    return finish(s.select(F.col("column").alias("column_name"), tmap[F.col("column")].alias("feature_type"),
                           "missing_share", "dropped"))


@register("align_columns", E("""
SELECT encounter_id, CAST(NULL AS VARCHAR) AS race, age, gender, number_inpatient, diag_1
FROM encs WHERE split = 'validation'"""))
def q_align_columns(spark, sf_dir):
    e = encounter_table(spark, sf_dir).where("split = 'validation'")
    a = prepare.align_columns(e, ["encounter_id", "race", "age", "gender", "number_inpatient", "diag_1"],
                              {"race": "categorical"})
    return a


# --- F3-F7: preparation statistics on train ------------------------------------------------
@register("impute_numeric", E("\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, {R(f'median({c})')} AS median FROM encs WHERE split = 'train'" for c in NUMERIC)))
def q_impute_numeric(spark, sf_dir):
    train = encounter_table(spark, sf_dir).where("split = 'train'")
    return finish(features.numeric_medians(train, NUMERIC))


@register("impute_categorical", E("\nUNION ALL\n".join(
    f"(SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS mode, CAST(count(*) AS BIGINT) AS n FROM encs "
    f"WHERE split = 'train' AND {c} IS NOT NULL GROUP BY {c} ORDER BY n DESC, mode ASC LIMIT 1)"
    for c in CATEGORICAL)))
def q_impute_categorical(spark, sf_dir):
    train = encounter_table(spark, sf_dir).where("split = 'train'")
    return features.categorical_modes(features.category_counts(train, CATEGORICAL))


@register("standardize", E("\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, {R(f'avg(coalesce({c}, m))')} AS mean, {R(f'stddev_pop(coalesce({c}, m))')} AS std "
    f"FROM encs, (SELECT median({c}) AS m FROM encs WHERE split = 'train') WHERE split = 'train'"
    for c in NUMERIC)))
def q_standardize(spark, sf_dir):
    train = encounter_table(spark, sf_dir).where("split = 'train'")
    return finish(features.standardize_stats(train, NUMERIC, features.numeric_medians(train, NUMERIC)))


def pool_sql(min_freq: int) -> str:
    parts = []
    for c in CATEGORICAL:
        parts.append(f"""
SELECT '{c}' AS feature, v.value,
       CAST(v.n + CASE WHEN v.value = m.mode THEN m.n_missing ELSE 0 END AS BIGINT) AS n,
       v.n + CASE WHEN v.value = m.mode THEN m.n_missing ELSE 0 END >= {min_freq} AS kept
FROM (SELECT CAST({c} AS VARCHAR) AS value, count(*) AS n FROM encs WHERE split = 'train' AND {c} IS NOT NULL
      GROUP BY 1) v,
     (SELECT (SELECT CAST({c} AS VARCHAR) FROM encs WHERE split = 'train' AND {c} IS NOT NULL GROUP BY {c}
              ORDER BY count(*) DESC, CAST({c} AS VARCHAR) ASC LIMIT 1) AS mode,
             count(*) FILTER (WHERE {c} IS NULL) AS n_missing FROM encs WHERE split = 'train') m""")
    return "\nUNION ALL\n".join(parts)


@register("category_pooling", E(pool_sql(20)))
def q_category_pooling(spark, sf_dir):
    train = encounter_table(spark, sf_dir).where("split = 'train'")
    return features.category_pooling(train, CATEGORICAL, min_frequency=20)


@register("class_weights", E(f"""
SELECT y AS label, CAST(count(*) AS BIGINT) AS n,
       {R('(SELECT count(*) FROM encs WHERE split = ' + "'train'" + ') / (2.0 * count(*))')} AS weight
FROM encs WHERE split = 'train' GROUP BY y"""))
def q_class_weights(spark, sf_dir):
    train = encounter_table(spark, sf_dir).where("split = 'train'")
    return finish(features.class_weights(train, label="y"))


# --- H1-H6 on the scored table ----------------------------------------------------------------
@register("roc_auc", E(f"""
SELECT split, {R('sum(pos * (coalesce(neg_below, 0) + 0.5 * neg)) / (sum(pos) * sum(neg))')} AS roc_auc,
       CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg
FROM (SELECT *, sum(neg) OVER (PARTITION BY split ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
             AS neg_below
      FROM (SELECT split, p AS s, sum(y) AS pos, count(*) - sum(y) AS neg FROM scored GROUP BY split, p) sc) c
GROUP BY split"""))
def q_roc_auc(spark, sf_dir):
    return finish(metrics.roc_auc(scored_table(spark, sf_dir), keys=["split"]))


@register("average_precision", E(f"""
SELECT split, {R('sum(pos * tp / (tp + fp)) / sum(pos)')} AS average_precision
FROM (SELECT *, sum(pos) OVER (PARTITION BY split ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS tp,
             sum(neg) OVER (PARTITION BY split ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS fp
      FROM (SELECT split, p AS s, sum(y) AS pos, count(*) - sum(y) AS neg FROM scored GROUP BY split, p) sc) c
GROUP BY split"""))
def q_average_precision(spark, sf_dir):
    return finish(metrics.average_precision(scored_table(spark, sf_dir), keys=["split"]))


@register("brier_prevalence", E(f"""
SELECT split, CAST(count(*) AS BIGINT) AS n, {R('avg((p - y) * (p - y))')} AS brier_score,
       {R('avg(y)')} AS prevalence
FROM scored GROUP BY split"""))
def q_brier_prevalence(spark, sf_dir):
    return finish(metrics.brier_prevalence(scored_table(spark, sf_dir), keys=["split"]))


def confusion_sql(src: str, keys: str = "") -> str:
    k = f"{keys}, " if keys else ""

    def ratio(num, den):
        return f"CASE WHEN {den} > 0 THEN {R(f'({num})::DOUBLE / ({den})', 4)} ELSE 0.0 END"

    def per100(x):
        return f"CASE WHEN (tp + fp + tn + fn) > 0 THEN {R(f'100.0 * ({x}) / (tp + fp + tn + fn)', 2)} ELSE 0.0 END"
    return f"""
SELECT {k}{R('threshold', 3)} AS threshold,
  {ratio('tp', 'tp + fn')} AS sensitivity_recall,
  {ratio('tn', 'tn + fp')} AS specificity,
  {ratio('tp', 'tp + fp')} AS precision,
  {ratio('2 * tp', '2 * tp + fp + fn')} AS f1,
  {ratio('fp', 'tn + fp')} AS false_positive_rate,
  {ratio('fp', 'tp + fp')} AS false_discovery_rate,
  {per100('tp + fp')} AS alerts_per_100_encounters,
  {per100('fp')} AS false_positive_alerts_per_100_encounters,
  {per100('fn')} AS missed_readmissions_per_100_encounters,
  CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(tn AS BIGINT) AS tn, CAST(fn AS BIGINT) AS fn
FROM ({src}) conf"""


def _conf_at(t_expr: str, where: str, keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    g = f"GROUP BY {keys}" if keys else ""
    return f"""SELECT {k}{t_expr} AS threshold,
  count(*) FILTER (WHERE y = 1 AND p >= {t_expr}) AS tp, count(*) FILTER (WHERE y = 0 AND p >= {t_expr}) AS fp,
  count(*) FILTER (WHERE y = 0 AND p < {t_expr}) AS tn, count(*) FILTER (WHERE y = 1 AND p < {t_expr}) AS fn
  FROM scored {where} {g}"""


def _grid_conf(pcts, split_name: str) -> str:
    lo, hi = min(pcts), max(pcts)
    step = pcts[1] - pcts[0]
    return f"""SELECT g.t AS threshold,
  count(*) FILTER (WHERE y = 1 AND p >= g.t) AS tp, count(*) FILTER (WHERE y = 0 AND p >= g.t) AS fp,
  count(*) FILTER (WHERE y = 0 AND p < g.t) AS tn, count(*) FILTER (WHERE y = 1 AND p < g.t) AS fn
  FROM scored, (SELECT CAST(i AS DOUBLE) / 100 AS t FROM range({lo}, {hi + 1}, {step}) r(i)) g
  WHERE split = '{split_name}' GROUP BY g.t"""


@register("threshold_metrics", E(confusion_sql(
    _conf_at(f"{RESEARCH_THRESHOLD}::DOUBLE", "", "split"), "split")))
def q_threshold_metrics(spark, sf_dir):
    return finish(metrics.threshold_metrics(scored_table(spark, sf_dir), RESEARCH_THRESHOLD, keys=["split"]))


@register("threshold_table", E(confusion_sql(_grid_conf(REPORT_GRID_PCT, "test"))))
def q_threshold_table(spark, sf_dir):
    s = scored_table(spark, sf_dir).where("split = 'test'")
    return finish(metrics.threshold_table(s, metrics.grid(REPORT_GRID_PCT)))


_BEST_SQL = f"""
SELECT * FROM ({confusion_sql(_grid_conf(SELECTION_GRID_PCT, 'validation'))}) t
ORDER BY f1 DESC, threshold ASC LIMIT 1"""


@register("best_threshold", E(_BEST_SQL))
def q_best_threshold(spark, sf_dir):
    s = scored_table(spark, sf_dir).where("split = 'validation'")
    return finish(metrics.best_threshold(s, metrics.grid(SELECTION_GRID_PCT)))


# --- B12, D15-D17: error profiles on test at the validation-chosen threshold ------------------
def _profiled(spark, sf_dir) -> DataFrame:
    # the scored rows feed two passes (threshold choice, profile): read them once
    s = metrics._materialize(scored_table(spark, sf_dir).where("split IN ('validation', 'test')"))
    best = metrics.best_threshold(s.where("split = 'validation'"), metrics.grid(SELECTION_GRID_PCT))
    t = best.select("threshold").scalar()
    return errors.with_confusion_group(s.where("split = 'test'"), t)


_GROUPED_SQL = f"""
grouped AS (
  SELECT s.*, CASE WHEN y = 1 AND p >= b.threshold THEN 'TP' WHEN y = 0 AND p >= b.threshold THEN 'FP'
                   WHEN y = 0 THEN 'TN' ELSE 'FN' END AS "group"
  FROM scored s, ({_BEST_SQL}) b WHERE s.split = 'test')
"""
G = with_ctes(ENCOUNTER_FIXTURE_SQL, ENCOUNTER_SPLIT_SQL, _GROUPED_SQL)


@register("confusion_label", G("""
SELECT "group", CAST(count(*) AS BIGINT) AS encounters FROM grouped GROUP BY "group" """))
def q_confusion_label(spark, sf_dir):
    return _profiled(spark, sf_dir).groupBy("group").agg(F.count(F.lit(1)).alias("encounters"))


@register("error_groups", G(f"""
SELECT "group", CAST(count(*) AS BIGINT) AS count, {R('avg(p)', 4)} AS mean_predicted_probability
FROM grouped GROUP BY "group" """))
def q_error_groups(spark, sf_dir):
    return finish(errors.error_groups(_profiled(spark, sf_dir)))


@register("error_profile_numeric", G("\nUNION ALL\n".join(
    f"""SELECT "group", '{c}' AS feature, CAST(count({c}) AS BIGINT) AS n_non_null, {R(f'avg({c})', 4)} AS mean,
       {R(f'median({c})', 4)} AS median, {R(f'quantile_cont({c}, 0.25)', 4)} AS p25,
       {R(f'quantile_cont({c}, 0.75)', 4)} AS p75 FROM grouped GROUP BY "group" """ for c in FOCUS_NUMERIC)))
def q_error_profile_numeric(spark, sf_dir):
    return finish(errors.error_profile_numeric(_profiled(spark, sf_dir)))


_CAT_LONG = "\nUNION ALL\n".join(
    f"""SELECT "group", '{c}' AS feature, coalesce(CAST({c} AS VARCHAR), 'MISSING') AS value FROM grouped"""
    for c in FOCUS_CATEGORICAL)


@register("error_profile_categorical", G(f"""
SELECT "group", feature, CAST(rank AS INTEGER) AS rank, value, {R('n / tot', 4)} AS share FROM (
  SELECT *, sum(n) OVER (PARTITION BY "group", feature) AS tot,
         row_number() OVER (PARTITION BY "group", feature ORDER BY n DESC, value) AS rank
  FROM (SELECT "group", feature, value, count(*) AS n FROM ({_CAT_LONG}) l GROUP BY ALL) c) r
WHERE rank <= 10"""))
def q_error_profile_categorical(spark, sf_dir):
    return finish(errors.error_profile_categorical(_profiled(spark, sf_dir)))


# --- A7: metrics document (its scalar part, flat) ------------------------------------------------
def _metrics_doc_sql() -> str:
    disc = f"""
SELECT a.split, a.roc_auc, p.average_precision AS pr_auc, b.brier_score, b.prevalence FROM
 (SELECT split, sum(pos * (coalesce(neg_below, 0) + 0.5 * neg)) / (sum(pos) * sum(neg)) AS roc_auc
  FROM (SELECT *, sum(neg) OVER (PARTITION BY split ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
               AS neg_below
        FROM (SELECT split, p AS s, sum(y) AS pos, count(*) - sum(y) AS neg FROM scored GROUP BY split, p) sc) c
  GROUP BY split) a
 JOIN (SELECT split, sum(pos * tp / (tp + fp)) / sum(pos) AS average_precision
  FROM (SELECT *, sum(pos) OVER (PARTITION BY split ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS tp,
               sum(neg) OVER (PARTITION BY split ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS fp
        FROM (SELECT split, p AS s, sum(y) AS pos, count(*) - sum(y) AS neg FROM scored GROUP BY split, p) sc) c
  GROUP BY split) p USING (split)
 JOIN (SELECT split, avg((p - y) * (p - y)) AS brier_score, avg(y) AS prevalence FROM scored GROUP BY split) b
 USING (split)"""
    test_at = confusion_sql(_conf_at("(SELECT threshold FROM best)", "WHERE split = 'test'"))
    cols = []
    for sp in ("validation", "test"):
        for m in ("roc_auc", "pr_auc", "brier_score", "prevalence"):
            cols.append(f"{R(f'(SELECT {m} FROM disc WHERE split = {chr(39)}{sp}{chr(39)})', 4)} AS {sp}_{m}")
    return f"""
, disc AS ({disc})
, best AS ({_BEST_SQL})
, test_at AS ({test_at})
SELECT (SELECT CAST(count(*) AS BIGINT) FROM scored WHERE split = 'train') AS encounters_train,
       (SELECT CAST(count(*) AS BIGINT) FROM scored WHERE split = 'validation') AS encounters_validation,
       (SELECT CAST(count(*) AS BIGINT) FROM scored WHERE split = 'test') AS encounters_test,
       {", ".join(cols)},
       (SELECT threshold FROM best) AS selected_threshold, (SELECT f1 FROM best) AS selected_f1,
       t.sensitivity_recall AS test_sensitivity_recall, t.specificity AS test_specificity,
       t.precision AS test_precision, t.f1 AS test_f1, t.tp AS test_tp, t.fp AS test_fp, t.tn AS test_tn,
       t.fn AS test_fn
FROM test_at t"""


def _metrics_doc_flat(doc):
    cols = [F.col("encounters.train").alias("encounters_train"),
            F.col("encounters.validation").alias("encounters_validation"),
            F.col("encounters.test").alias("encounters_test")]
    for sp in ("validation", "test"):
        for m in ("roc_auc", "pr_auc", "brier_score", "prevalence"):
            cols.append(F.col(f"{sp}.{m}").alias(f"{sp}_{m}"))
    cols += [F.col("validation.selected_threshold.threshold").alias("selected_threshold"),
             F.col("validation.selected_threshold.f1").alias("selected_f1")]
    for m in ("sensitivity_recall", "specificity", "precision", "f1", "tp", "fp", "tn", "fn"):
        cols.append(F.col(f"test.threshold_metrics.{m}").alias(f"test_{m}"))
    return doc.select(cols)


DOCUMENT_TEXTS = {"outcome": "readmitted within 30 days against all other outcomes", "model": "deterministic score",
                  "split": "patients are split; no patient is in two splits"}


def _metrics_document(spark, sf_dir) -> DataFrame:
    from ..sources.sinks import metrics_document
    train = encounter_table(spark, sf_dir).where("split = 'train'")
    dropped = [r["column"] for r in prepare.sparse_columns(train, ALL_FEATURES).where("dropped").orderBy("column").collect()]
    return metrics_document(scored_table(spark, sf_dir), dropped, texts=DOCUMENT_TEXTS)


@register("metrics_doc", with_ctes(ENCOUNTER_FIXTURE_SQL, ENCOUNTER_SPLIT_SQL)("").rstrip() + _metrics_doc_sql())
def q_metrics_doc(spark, sf_dir):
    return finish(_metrics_doc_flat(_metrics_document(spark, sf_dir)))


@register("metrics_doc_tradeoff", E(confusion_sql(_grid_conf(REPORT_GRID_PCT, "test"))))
def q_metrics_doc_tradeoff(spark, sf_dir):
    """The trade-off table nested in the metrics document, as rows."""
    return finish(_metrics_document(spark, sf_dir).select(F.inline("test.threshold_tradeoff_table")))


# --- A7: error-profile document, its nested parts as rows --------------------------------------------
def _error_document(spark, sf_dir) -> DataFrame:
    from ..sources.documents import error_profiles_document
    # one pass over the derived input: threshold choice and all parts read the stored rows
    s = metrics._materialize(scored_table(spark, sf_dir).where("split IN ('validation', 'test')"))
    t = metrics.best_threshold(s.where("split = 'validation'"), metrics.grid(SELECTION_GRID_PCT)).select("threshold").scalar()
    grouped = metrics._materialize(errors.with_confusion_group(s.where("split = 'test'"), t))
    return error_profiles_document(grouped, t)


@register("error_profiles_doc", G("\nUNION ALL\n".join([
    f"""SELECT (SELECT threshold FROM ({_BEST_SQL}) b) AS threshold, "group", '{c}' AS feature, CAST(NULL AS VARCHAR) AS value,
       {R(f'median({c})', 4)} AS number FROM grouped GROUP BY "group" """ for c in FOCUS_NUMERIC] + [
    f"""SELECT (SELECT threshold FROM ({_BEST_SQL}) b), "group", feature, value, {R('n / tot', 4)} FROM (
  SELECT *, sum(n) OVER (PARTITION BY "group", feature) AS tot,
         row_number() OVER (PARTITION BY "group", feature ORDER BY n DESC, value) AS rank
  FROM (SELECT "group", feature, value, count(*) AS n FROM ({_CAT_LONG}) l GROUP BY ALL) c) r
WHERE rank <= 10"""])))
def q_error_profiles_doc(spark, sf_dir):
    from ..sources.documents import GROUPS
    doc = _error_document(spark, sf_dir)
    g = doc.select("threshold", F.explode(F.create_map(*[x for n in GROUPS for x in (F.lit(n), F.col(f"groups.{n}"))])).alias("group", "g"))
    num = F.transform(F.map_entries("g.numeric"), lambda e: F.struct(
        e["key"].alias("feature"), F.lit(None).cast("string").alias("value"), e["value"]["median"].alias("number")))
    cat = F.flatten(F.transform(F.map_entries("g.categorical"), lambda e: F.transform(e["value"], lambda v: F.struct(
        e["key"].alias("feature"), v["value"].alias("value"), v["share"].alias("number")))))
    return finish(g.select("threshold", "group", F.inline(F.concat(num, cat))))


# --- B9: feature typing from the schema, with non-missing counts ------------------------------------
@register("feature_types", E("\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, '{'numeric' if c in NUMERIC else 'categorical'}' AS feature_type, "
    f"CAST(count({c}) AS BIGINT) AS non_missing FROM encs WHERE split = 'train'" for c in ALL_FEATURES)))
def q_feature_types(spark, sf_dir):
    train = encounter_table(spark, sf_dir).where("split = 'train'")
    types = prepare.feature_types(train, ALL_FEATURES)
    counts = train.agg(*[F.count(c).alias(c) for c in ALL_FEATURES]).unpivot([], list(ALL_FEATURES),
                                                                             "feature", "non_missing")
    tmap = F.create_map(*[x for k, v in types.items() for x in (F.lit(k), F.lit(v))])
    return counts.select("feature", tmap[F.col("feature")].alias("feature_type"), "non_missing")
