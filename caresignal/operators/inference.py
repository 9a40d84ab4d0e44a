"""Guarded batch inference and request routing.

Requests are rows of a table: `request_id`, `research_acknowledged`, `payload`
(map<string,string>), `task`, `unit`. Every check is a column expression over the
map, so a table of any size is validated in one narrow pass."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col_of, is_number, numeric_coerce, threshold_flag
from ..functions.constants import (
    ACK_FIELD,
    DIMENSIONS,
    GLOBAL_DRIVER_FIELDS,
    HOSPITAL_TASK,
    NUMERIC_FIELDS,
    REQUIRED_RESEARCH_FIELDS,
    RESEARCH_THRESHOLD,
    SANDBOX_MODEL_ID,
    SANDBOX_UNIT_ALIAS,
)

MAX_BROADCAST_REGISTRY_ROWS = 10_000


def _empty(v: Column) -> Column:
    return v.isNull() | (v == "")


def _py_list(arr: Column) -> Column:
    """['a', 'b'] text of a string array, as the service reports field lists."""
    inner = F.array_join(arr, "', '")
    return F.when(F.size(arr) > 0, F.concat(F.lit("['"), inner, F.lit("']"))).otherwise(F.lit("[]"))


def validate_requests(req: DataFrame, expected: Sequence[str], numeric: Sequence[str] = NUMERIC_FIELDS,
                      required: Sequence[str] = REQUIRED_RESEARCH_FIELDS, payload: str = "payload",
                      ack: str = ACK_FIELD) -> DataFrame:
    """Adds `status` (valid/invalid) and `error`, checked in the service's order:
    acknowledgement (column or payload field), unknown fields, missing required fields, non-numeric values."""
    pl = col_of(payload)
    acked = F.coalesce(col_of(ack), F.lit(False)) | F.coalesce(F.lower(pl[ACK_FIELD]) == "true", F.lit(False))
    # every check is a plain (code-generated) expression over the fixed field lists
    exp_arr = F.array(*[F.lit(c) for c in (*expected, ACK_FIELD)])
    unknown = F.sort_array(F.array_except(F.map_keys(pl), exp_arr))
    missing_txt = F.concat_ws(", ", *[F.when(_empty(pl[c]), F.lit(f"'{c}'")) for c in required])
    num_in_order = [c for c in expected if c in set(numeric)]
    first_bad = F.coalesce(*[F.when(~_empty(pl[c]) & ~is_number(pl[c]), F.lit(c))
                             for c in num_in_order], F.lit(None).cast("string"))
    # the three checks are separate columns first: smaller generated methods stay
    # JIT-compiled, and each check is evaluated once per row
    x = req.withColumns({"_unknown": unknown, "_missing": missing_txt, "_bad": first_bad})
    u, m, b = F.col("_unknown"), F.col("_missing"), F.col("_bad")
    err = (F.when(~acked, F.lit("Research-only acknowledgement is required."))
           .when(F.size(u) > 0, F.concat(F.lit("Unknown fields: "), _py_list(u)))
           .when(m != "", F.concat(F.lit("Missing required research fields: ["), m, F.lit("]")))
           .when(b.isNotNull(), F.concat(F.lit("Field "), b, F.lit(" must be numeric."))))
    # validity as a plain boolean, so a filter on `status` needs no error text
    ok = acked & (F.size(u) == 0) & (m == "") & b.isNull()
    return (x.withColumn("error", err)
            .withColumn("status", F.when(ok, F.lit("valid")).otherwise(F.lit("invalid")))
            .drop("_unknown", "_missing", "_bad"))


def normalize_requests(req: DataFrame, feature_types: dict[str, str], payload: str = "payload",
                       keep: Sequence[str] = ("request_id",)) -> DataFrame:
    """Payload map -> typed feature row in manifest order; absent or empty -> NULL."""
    pl = col_of(payload)
    cols = []
    for f, t in feature_types.items():
        raw = F.element_at(pl, f)
        v = F.when(_empty(raw), F.lit(None).cast("string")).otherwise(raw)
        cols.append((numeric_coerce(v) if t == "numeric" else v).alias(f))
    return req.select(*[col_of(k) for k in keep], *cols)


def entered_drivers(req: DataFrame, fields: Sequence[str] = GLOBAL_DRIVER_FIELDS,
                    payload: str = "payload") -> DataFrame:
    """Adds `entered_global_driver_fields`: (feature, value) for present driver fields."""
    pl = col_of(payload)
    item = lambda f: F.struct(F.lit(f).alias("feature"), pl[f].alias("value"))
    present = F.array(*[F.when(~_empty(pl[f]), item(f)) for f in fields])
    # drop the NULL slots without a per-row lambda (features are distinct, so no
    # element is lost to the set semantics of array_except)
    arr = F.array_except(present, F.array(F.lit(None).cast("struct<feature:string,value:string>")))
    return req.withColumn("entered_global_driver_fields", arr)


def response_rows(scored: DataFrame, model_id: str, clinical_status: str,
                  threshold: float = RESEARCH_THRESHOLD, prob: str = "p") -> DataFrame:
    """Scored valid requests -> response rows."""
    return scored.select(
        "*",
        F.lit(model_id).alias("model_id"),
        F.round(col_of(prob), 4).alias("research_probability"),
        F.lit(float(threshold)).alias("research_threshold"),
        threshold_flag(prob, threshold).alias("threshold_signal"),
        F.lit(clinical_status).alias("clinical_status"),
        F.lit(False).alias("public_patient_probability_allowed"),
        F.lit("Research estimate only. The threshold signal is for technical demonstration and must not be "
              "used for diagnosis, treatment, discharge, or autonomous clinical decisions.").alias("interpretation"))


# ---------------------------------------------------------------------------
# Routing
# ---------------------------------------------------------------------------

def registry_routes(registry: DataFrame) -> DataFrame:
    """(task, match_unit) -> first registry model that serves it. A model matches
    its own unit of analysis; the sandbox model also answers the sandbox alias."""
    own = registry.select("task", F.col("unit_of_analysis").alias("match_unit"), "position", "id",
                          "patient_probability_allowed", "status")
    alias = (registry.where(F.col("id") == SANDBOX_MODEL_ID)
             .select("task", F.lit(SANDBOX_UNIT_ALIAS).alias("match_unit"), "position", "id",
                     "patient_probability_allowed", "status"))
    both = own.unionByName(alias)
    first = both.groupBy("task", "match_unit").agg(F.min_by(F.struct("id", "patient_probability_allowed", "status"),
                                                            F.col("position")).alias("m"))
    return first.select("task", "match_unit", "m.*")


def route_requests(req: DataFrame, registry: DataFrame | None, task: str = "task", unit: str = "unit") -> DataFrame:
    """Adds `route_status` and `model_id`; requests are never shuffled: the route
    table is broadcast when its size is within the checked bound."""
    if registry is None:
        return req.withColumn("model_id", F.lit(None).cast("string")) \
                  .withColumn("route_status", F.lit("REGISTRY UNAVAILABLE"))
    routes = registry_routes(registry).select(
        F.col("task").alias("_r_task"), F.col("match_unit").alias("_r_unit"), F.col("id").alias("_r_id"),
        F.col("patient_probability_allowed").alias("_r_allowed"))
    n = routes.count()  # the size check behind the broadcast
    r = F.broadcast(routes) if n <= MAX_BROADCAST_REGISTRY_ROWS else routes
    j = req.join(r, (col_of(task) == F.col("_r_task")) & (col_of(unit) == F.col("_r_unit")), "left")
    status = (F.when(F.col("_r_id").isNull(), F.lit("NO VALID ROUTE"))
              .when(col_of(task) == HOSPITAL_TASK, F.lit("ANALYTICS READY"))
              .when(F.col("_r_allowed") == F.lit(True), F.lit("PROBABILITY ENABLED"))
              .otherwise(F.lit("OUTPUT LOCKED")))
    return j.select(*[col_of(c) for c in req.columns], F.col("_r_id").alias("model_id"),
                    status.alias("route_status"))


# ---------------------------------------------------------------------------
# Code tables
# ---------------------------------------------------------------------------

def dimension_counts(df: DataFrame, columns: Sequence[str], suffix: str = "_label") -> DataFrame:
    """(dimension, code, label, encounters) of decoded columns, one pass for all of them."""
    cells = F.explode(F.array(*[F.struct(
        F.lit(c).alias("dimension"), col_of(c).cast("string").alias("code"), col_of(f"{c}{suffix}").alias("label")) for c in columns]))
    return df.select(cells.alias("_c")).select("_c.*").groupBy("dimension", "code", "label").agg(F.count(F.lit(1)).alias("encounters"))


def decode_dims(df: DataFrame, dims=DIMENSIONS, suffix: str = "_label") -> DataFrame:
    """Adds a clinical label column for every coded column present (literal map
    lookup: the code tables are fixed and tiny)."""
    out = df
    for c, pairs in dims:
        if c not in df.columns:
            continue
        m = F.create_map(*[x for code, label in pairs for x in (F.lit(code), F.lit(label))])
        out = out.withColumn(f"{c}{suffix}", m[col_of(c).cast("string")])
    return out
