"""Models and experiments.

Fits are MLlib estimators, or the trees of operators.boosting and operators.forest, on one
cached training frame: tasks compute gradients or tree histograms, the driver only combines
them. Independent candidates (grid, ablation) are fitted as concurrent jobs.
Scoring is a narrow `transform`."""
from __future__ import annotations

import json
import math
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, LogisticRegressionModel
from pyspark.ml.common import _py2java
from pyspark.ml.feature import VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import boosting, forest, metrics, stages

LOGISTIC, GBT, FOREST = "logistic", "gradient_boosted_trees", "random_forest"
#: boosted trees of operators.boosting: second order, leaf-wise, l2
BOOSTING = "histogram_boosting"
#: Parameters of MLlib's boosted trees that say how it uses memory, and all that `boosting.fit_means` knows.
GBT_MEMORY = {"cacheNodeIds", "maxMemoryInMB"}
GBT_PARAMS = GBT_MEMORY | {"maxIter", "stepSize", "maxDepth", "minInstancesPerNode", "maxBins"}
#: Rows a task of a logistic fit should have at least: each iteration is a job of its own.
TASK_ROWS = 15_000
#: Rows a task of a logistic fit has at most, as far as the frame's partitions allow.
MAX_TASK_ROWS = 1_000_000


@dataclass
class ModelSpec:
    name: str
    kind: str
    params: dict = field(default_factory=dict)
    min_frequency: int = 10
    scale: bool = True
    balanced: bool = True


def baseline_spec(max_iter: int = 2000) -> ModelSpec:
    """Class-weighted logistic regression (scaled numeric, pooled one-hot)."""
    return ModelSpec("logistic", LOGISTIC, {"maxIter": max_iter}, min_frequency=10, scale=True, balanced=True)


def benchmark_specs(gbt_iter: int = 250, forest_trees: int = 350) -> list[ModelSpec]:
    return [
        ModelSpec("logistic", LOGISTIC, {"maxIter": 2000}, min_frequency=20, scale=True, balanced=True),
        ModelSpec("gradient_boosted_trees", BOOSTING,
                  {"rounds": gbt_iter, "learning_rate": 0.06, "max_leaves": 31, "l2": 1.0, "min_leaf": 20, "max_bins": 255},
                  min_frequency=20, scale=True, balanced=False),
        ModelSpec("random_forest", FOREST,
                  {"trees": forest_trees, "min_leaf": 10, "max_depth": 15, "max_bins": 32, "seed": 42},
                  min_frequency=20, scale=False, balanced=True),
    ]


def mllib_gbt_spec(gbt_iter: int = 250) -> ModelSpec:
    """MLlib's boosted trees: level by level to depth 5, no l2."""
    return ModelSpec("mllib_gbt", GBT, {"maxIter": gbt_iter, "stepSize": 0.06, "maxDepth": 5, "minInstancesPerNode": 20, "maxBins": 255,
                                        "cacheNodeIds": True, "maxMemoryInMB": 1024}, min_frequency=20, scale=True, balanced=False)


@dataclass
class FittedModel:
    spec: ModelSpec
    model: PipelineModel          # preparation, encoding and estimator
    numeric: list[str]
    categorical: list[str]

    @property
    def features(self) -> list[str]:
        return [*self.numeric, *self.categorical]

    def score(self, df: DataFrame, out: str = "p") -> DataFrame:
        s = self.model.transform(df)
        return s.select(*[F.col(f"`{c}`") for c in df.columns], vector_to_array("probability")[1].alias(out))


Prep = tuple[stages.NumericPrepModel, stages.CategoryIndexerModel]


def fit_prep(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str], spec: ModelSpec) -> Prep:
    return (stages.NumericPrep(inputCols=list(numeric), scale=spec.scale).fit(train),
            stages.CategoryIndexer(inputCols=list(categorical), minFrequency=spec.min_frequency).fit(train))


def _weights(train: DataFrame, label: str) -> DataFrame:
    """Balanced weights as a column; the two class counts are the only values
    that reach the driver."""
    counts = {r[0]: r[1] for r in train.groupBy(label).count().collect()}
    n = sum(counts.values())
    k = len(counts)
    w = {c: n / (k * m) for c, m in counts.items()}
    expr = F.lit(1.0)
    for c, v in w.items():
        expr = F.when(F.col(label) == c, F.lit(v)).otherwise(expr)
    return train.withColumn("_w", expr)


def fit(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str], spec: ModelSpec,
        label: str = "y") -> FittedModel:
    """Fit prep statistics on `train`, then the estimator on the encoded rows."""
    train = train.persist()
    try:
        return _fit(train, numeric, categorical, spec, label)
    finally:
        train.unpersist()


def fit_all(train: DataFrame, candidates: Sequence[tuple[Sequence[str], Sequence[str], ModelSpec]], label: str = "y",
            parallelism: int = 4) -> list[FittedModel]:
    """Models of (numeric, categorical, spec) candidates, in order. The fits share one persisted training frame and
    the preparation of equal features, and `parallelism` of them run as concurrent jobs."""
    train = train.persist()
    try:
        preps: dict[tuple, Prep] = {}
        for num, cat, spec in candidates:
            key = (tuple(num), tuple(cat), spec.min_frequency, spec.scale)
            if key not in preps:
                preps[key] = fit_prep(train, num, cat, spec)

        def one(c: tuple) -> FittedModel:
            num, cat, spec = c
            return _fit(train, num, cat, spec, label, preps[tuple(num), tuple(cat), spec.min_frequency, spec.scale])
        with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
            waiting = [pool.submit(inheritable_thread_target(train.sparkSession)(one), c) for c in candidates]
            return [w.result() for w in waiting]
    finally:
        train.unpersist()


def _fit(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str], spec: ModelSpec,
         label: str, prep: Prep | None = None) -> FittedModel:
    prep = prep or fit_prep(train, numeric, categorical, spec)
    x = prep[1].transform(prep[0].transform(train))
    if spec.balanced and spec.kind != FOREST:  # the forest weights classes itself
        x = _weights(x, label)
    x = x.withColumn("_label", F.col(label).cast("double"))
    encoder = stages.encoder_stages(numeric, categorical)
    fitted = lambda rest: FittedModel(spec, PipelineModel(stages=[*prep, *rest]), list(numeric), list(categorical))
    p = dict(spec.params)
    if spec.kind == BOOSTING:
        return fitted(_binned(x, prep, encoder, lambda *rows: boosting.as_mllib(x.sparkSession, *boosting.fit(*rows, boosting.BoostingParams(**p)))))
    if spec.kind == FOREST:
        return fitted(_binned(x, prep, encoder, lambda *rows: forest.fit(*rows, forest.ForestParams(**p), spec.balanced)))
    if spec.kind == LOGISTIC:
        wsum = train.count()  # balanced weights sum to the row count
        x = x.coalesce(_logistic_tasks(wsum, train.sparkSession.sparkContext.defaultParallelism))
        est = LogisticRegression(featuresCol="features", labelCol="_label", maxIter=p.get("maxIter", 100),
                                 regParam=1.0 / max(1.0, float(wsum)), elasticNetParam=0.0, standardization=False,
                                 tol=p.get("tol", 1e-9), weightCol="_w" if spec.balanced else None)
        encoded = Pipeline(stages=encoder).fit(x)
        return fitted([*encoded.stages, _penalised(encoded.transform(x), est)])
    elif spec.kind == GBT:
        if set(p) <= GBT_PARAMS and train.count() <= boosting.TASK_ROWS:
            means = boosting.MeansParams(**{k: v for k, v in p.items() if k not in GBT_MEMORY})
            return fitted(_binned(x, prep, encoder, lambda *rows: boosting.fit_means(*rows, means)))
        # early stopping is asked for, never switched on by the table's size
        share = p.pop("holdout_share", 0.1)
        if p.pop("early_stopping", False):
            h = F.xxhash64(*[F.col(f"`{c}`") for c in train.columns])
            x = x.withColumn("_holdout", F.pmod(h, F.lit(10_000)) < F.lit(int(10_000 * share)))
            p.setdefault("validationIndicatorCol", "_holdout")
            p.setdefault("validationTol", 1e-7)
        est = GBTClassifier(featuresCol="features", labelCol="_label", seed=42, **p)
    else:
        raise ValueError(spec.kind)
    x = x.persist()
    try:
        return fitted(Pipeline(stages=[*encoder, est]).fit(x).stages)
    finally:
        x.unpersist()


def _logistic_tasks(rows: int, cores: int) -> int:
    """Tasks of each iteration's job. Every one reports to the driver, so beyond two a core they only grow with
    MAX_TASK_ROWS."""
    return max(1, min(-(-rows // TASK_ROWS), 2 * cores), -(-rows // MAX_TASK_ROWS))


def _penalised(x: DataFrame, est: LogisticRegression) -> LogisticRegressionModel:
    """Logistic regression whose intercept is penalised like every coefficient: it is the coefficient of a constant 1.

    MLlib gives constant columns no coefficient, so the constant is turned with one varying feature z into (1 + z) /
    sqrt 2 and (1 - z) / sqrt 2. Turning keeps every inner product and the squared norm, so the penalised optimum is
    the same; the coefficients are turned back into a plain model. Without a varying feature the intercept is free."""
    x = x.select("features", "_label", "_w") if est.isSet(est.weightCol) else x.select("features", "_label")
    x = x.persist()
    try:
        variance = x.agg(Summarizer.variance(F.col("features")).alias("v")).first()["v"]
        moving = [] if variance is None else [j for j, v in enumerate(variance.toArray()) if v > 0]
        if not moving:
            return est.fit(x)
        z, rest = moving[0], [j for j in range(len(variance)) if j != moving[0]]
        turned = VectorSlicer(inputCol="features", outputCol="_z", indices=[z]).transform(x)
        value = vector_to_array("_z")[0]
        turned = turned.withColumn("_u", (1 + value) / math.sqrt(2)).withColumn("_v", (1 - value) / math.sqrt(2))
        parts = ["_u", "_v"]
        if rest:
            turned = VectorSlicer(inputCol="features", outputCol="_rest", indices=rest).transform(turned)
            parts.append("_rest")
        turned = VectorAssembler(inputCols=parts, outputCol="_turned").transform(turned).drop("features", "_z", "_rest", "_u", "_v")
        turned = turned.persist()
        try:
            got = est.copy({est.featuresCol: "_turned", est.fitIntercept: False}).fit(turned).coefficients.toArray()
        finally:
            turned.unpersist()
    finally:
        x.unpersist()
    coef = np.zeros(len(variance))
    coef[z], intercept, coef[rest] = (got[0] - got[1]) / math.sqrt(2), (got[0] + got[1]) / math.sqrt(2), got[2:]
    java = x.sparkSession._jvm.org.apache.spark.ml.classification.LogisticRegressionModel
    return LogisticRegressionModel(java(est.uid, _py2java(x.sparkSession.sparkContext, Vectors.dense(coef)), float(intercept)))


def optimality(fm: FittedModel, train: DataFrame, label: str = "y") -> DataFrame:
    """Certificate of a fitted logistic model: (feature, terms, gradient_norm), the intercept as a feature of one term.

    The gradient of sum(w * loss) + |b|^2 / 2 at the returned coefficients b, from one pass over the training rows.
    The penalised loss is 1-strongly convex, so b is no further from the optimum than the norm of the whole gradient."""
    x = fm.score(train.select(*dict.fromkeys([*fm.features, label])), "_p")
    x = fm.model.transform(_weights(x, label) if fm.spec.balanced else x.withColumn("_w", F.lit(1.0)))
    x = x.select("features", (F.col("_w") * (F.col("_p") - F.col(label))).alias("_r"))
    side = lambda c: Summarizer.metrics("sum").summary(F.col("features"), c)["sum"]
    over, under = F.greatest(F.col("_r"), F.lit(0.0)), F.greatest(-F.col("_r"), F.lit(0.0))  # weights may not be negative
    row = x.agg(side(over).alias("over"), side(under).alias("under"), F.sum("_r").alias("one")).first()
    lr, sizes = fm.model.stages[-1], [(c, 1) for c in fm.numeric] + list(fm.model.stages[1].label_counts().items())
    grad = row["over"].toArray() - row["under"].toArray() + lr.coefficients.toArray()
    ends = np.cumsum([n for _, n in sizes])
    rows = [(c, n, float(np.linalg.norm(grad[e - n:e]))) for (c, n), e in zip(sizes, ends, strict=True)]
    return train.sparkSession.createDataFrame([*rows, ("intercept", 1, abs(float(row["one"] + lr.intercept)))], "feature string, terms bigint, gradient_norm double")


def _binned(x: DataFrame, prep: Prep, encoder: list, grow: Callable[..., Model]) -> list:
    """Encoder stages and trees that `grow` fits on numbers and level numbers."""
    numeric, levels = [f"_n_{c}" for c in prep[0].getInputCols()], {f"_i_{c}": n for c, n in prep[1].label_counts().items()}
    rows = x.select(*numeric, *levels, "_label").persist()
    try:
        model = grow(rows, numeric, list(levels), list(levels.values()), "_label")
    finally:
        rows.unpersist()
    return [*Pipeline(stages=encoder).fit(x).stages, model]


def evaluate(scored: DataFrame, label: str = "y", keys: Sequence[str] = ()) -> DataFrame:
    """roc_auc / pr_auc / brier_score rounded to 4 (as published)."""
    d = metrics.discrimination(scored, label, "p", keys)
    return d.select(*keys, *[F.round(c, 4).alias(c) for c in ("roc_auc", "pr_auc", "brier_score", "prevalence")])


def pick_winner(grid: DataFrame) -> DataFrame:
    """Candidate with the best validation ROC-AUC, then PR-AUC, then lowest Brier
    (all already rounded to 4); earlier candidate wins a full tie (G5)."""
    return grid.orderBy(F.col("roc_auc").desc(), F.col("pr_auc").desc(), F.col("brier_score").asc(),
                        F.col("candidate_order").asc()).limit(1)


def coefficients(fm: FittedModel, spark: SparkSession, k: int = 40) -> DataFrame:
    """Encoded term, coefficient, odds ratio; largest |coefficient| first."""
    _, indexer, *_, lr = fm.model.stages
    terms = [(c, None) for c in fm.numeric] + [(c, float(k)) for c, n in indexer.label_counts().items() for k in range(n)]
    rows = [(c, k, float(x)) for (c, k), x in zip(terms, lr.coefficients.toArray(), strict=True)]
    df = spark.createDataFrame(rows, "feature string, index double, coefficient double")
    if fm.categorical:
        labels = indexer.levels.select("feature", "index", "label").distinct()
        df = df.join(labels, ["feature", "index"], "left")
        name = F.when(F.col("index").isNull(), F.concat(F.lit("numeric__"), "feature")).otherwise(F.concat(F.lit("categorical__"), "feature", F.lit("_"), "label"))
    else:
        name = F.concat(F.lit("numeric__"), "feature")
    df = df.withColumn("encoded_feature", name)
    return (df.select("encoded_feature", F.round("coefficient", 6).alias("coefficient"),
                      F.round(F.exp("coefficient"), 6).alias("odds_ratio"))
            .orderBy(F.abs("coefficient").desc(), "encoded_feature").limit(k))


#: Rows that share one sort of a global rank.
RANK_ROWS = 100_000
#: Features whose permuted values travel together: (features x repeats) values a row.
FEATURE_BATCH = 8


def _ranked(df: DataFrame, keys: Sequence[str], seed: Sequence[Column], n: int, name: str) -> DataFrame:
    """`df` with a rank 1 .. n per `keys` in a random order that `seed` fixes (hash of `_id` and the seed).

    A hash is uniform, so its leading bits cut the order into ranges of about RANK_ROWS rows without sampling: a row's
    rank is its position in its range plus the rows of the ranges before it. The order is that of the unsigned hash,
    whatever the number of ranges."""
    bits = max(0, math.ceil(math.log2(max(1.0, n / RANK_ROWS))))
    x = df.withColumn("_h", F.xxhash64("_id", *seed))
    x = x.withColumn("_part", F.shiftrightunsigned("_h", 64 - bits) if bits else F.lit(0).cast("bigint"))
    inside = Window.partitionBy(*keys, "_part").orderBy(F.col("_h").bitwiseXOR(F.lit(-1 << 63)), "_id")
    x = x.withColumn("_in", F.row_number().over(inside))
    if bits:
        before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        sizes = x.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_size"))
        x = x.join(sizes.select(*keys, "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before")), [*keys, "_part"])
        x = x.withColumn("_in", F.col("_in") + F.col("_before"))
    return x.withColumn(name, F.col("_in").cast("bigint")).drop("_h", "_part", "_in", "_before")


def permuted_long(test: DataFrame, columns: Sequence[str], repeats: int = 5, seed: int = 42,
                  id_col: str = "encounter_id") -> DataFrame:
    """Long table (feature, repeat, row) where, for each (feature, repeat), the values of that feature are randomly
    permuted over all rows: one uniform permutation of the whole table at any size.

    Every row has a rank, and every value a rank in a random order of its (feature, repeat); a value moves to the row
    of its rank. Only (id, value) pairs are ranked and moved; the values of a rank are gathered (at most
    FEATURE_BATCH x repeats) and whole rows are shuffled once per batch of features. `id_col` identifies a row."""
    test = metrics._materialize(test)  # counted, ranked as rows and as values: derived once
    n = test.count()
    rows = _ranked(test.withColumn("_id", F.col(id_col)), [], [F.lit(f"rows:{seed}")], n, "_r").drop("_id")
    types = {f.name: f.dataType for f in test.schema.fields}
    out = []
    for at in range(0, len(columns), FEATURE_BATCH):
        some = list(columns[at:at + FEATURE_BATCH])
        slot = lambda c, kinds: F.col(f"`{c}`").cast(kinds[1]) if isinstance(types[c], kinds[0]) else F.lit(None).cast(kinds[1])
        kinds = {"i": (T.IntegralType, "bigint"), "d": (T.FractionalType, "double")}
        other = lambda c: F.lit(None).cast("string") if isinstance(types[c], (T.IntegralType, T.FractionalType)) else F.col(f"`{c}`").cast("string")
        value = lambda c: F.struct(F.lit(c).alias("feature"), *[slot(c, k).alias(n) for n, k in kinds.items()], other(c).alias("t"))
        pairs = (test.select(F.col(id_col).alias("_id"), F.explode(F.array(*[value(c) for c in some])).alias("v"))
                 .select("_id", "v.*", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat")))
        ranked = _ranked(pairs, ["feature", "repeat"], [F.col("feature"), F.col("repeat"), F.lit(seed)], n, "_r")
        moved = ranked.groupBy("_r").agg(F.collect_list(F.struct("feature", "repeat", "i", "d", "t")).alias("_new"))
        j = rows.join(moved, "_r").withColumn("_v", F.explode("_new"))
        back = lambda c: F.when(F.col("_v.feature") == c, F.col("_v.i" if isinstance(types[c], T.IntegralType) else
                                "_v.d" if isinstance(types[c], T.FractionalType) else "_v.t").cast(types[c])).otherwise(F.col(f"`{c}`")).alias(c)
        out.append(j.select(F.col("_v.feature").alias("feature"), F.col("_v.repeat").alias("repeat"),
                            *[back(c) if c in some else F.col(f"`{c}`") for c in test.columns]))
    return reduce(DataFrame.unionAll, out)


def permutation_importance(fm: FittedModel, test: DataFrame, columns: Sequence[str], label: str = "y",
                           repeats: int = 5, seed: int = 42, k: int = 25) -> DataFrame:
    """Mean and population std of the ROC-AUC drop over repeats."""
    test = test.select(*dict.fromkeys(["encounter_id", label, *fm.features, *columns]))
    base_auc = metrics.roc_auc(fm.score(test), label).select("roc_auc").scalar()
    long = permuted_long(test, columns, repeats, seed)
    auc = metrics.roc_auc(fm.score(long), label, keys=["feature", "repeat"])
    drop = auc.select("feature", "repeat", (base_auc - F.col("roc_auc")).alias("d"))
    return (drop.groupBy("feature").agg(F.round(F.avg("d"), 6).alias("roc_auc_drop_mean"),
                                        F.round(F.stddev_pop("d"), 6).alias("roc_auc_drop_std"))
            .orderBy(F.col("roc_auc_drop_mean").desc(), "feature").limit(k))


# ---------------------------------------------------------------------------
# Bundle (A9)
# ---------------------------------------------------------------------------

def save_bundle(spark: SparkSession, fm: FittedModel, path: str, manifest: Mapping) -> None:
    """One pipeline directory (preparation included) and the manifest as a one-row JSON document."""
    fm.model.write().overwrite().save(f"{path}/pipeline")
    doc = {"spec": fm.spec.__dict__, "numeric": fm.numeric, "categorical": fm.categorical, "manifest": dict(manifest)}
    spark.createDataFrame([(json.dumps(doc, default=str),)], "doc string").coalesce(1) \
        .write.mode("overwrite").text(f"{path}/manifest")


def load_bundle(spark: SparkSession, path: str) -> tuple[FittedModel, dict]:
    doc = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    return FittedModel(ModelSpec(**doc["spec"]), PipelineModel.load(f"{path}/pipeline"), doc["numeric"], doc["categorical"]), doc["manifest"]
