"""Structured Streaming form of guarded inference: request files arriving in a
folder are routed, validated, scored and written out, micro-batch by
micro-batch. This replaces the per-request HTTP service with a table job that
scales with the request volume; progress lives in the checkpoint folder, so a
restarted query resumes where it stopped."""
from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators import inference
from ..operators.models import FittedModel

REQUEST_SCHEMA = T.StructType([
    T.StructField("request_id", T.LongType()),
    T.StructField("research_acknowledged", T.BooleanType()),
    T.StructField("payload", T.MapType(T.StringType(), T.StringType())),
    T.StructField("task", T.StringType()),
    T.StructField("unit", T.StringType()),
])

RESPONSE_COLUMNS = ("request_id", "route_status", "status", "error", "model_id", "research_probability",
                    "research_threshold", "threshold_signal", "clinical_status", "entered_global_driver_fields", "interpretation")


def respond(requests: DataFrame, fm: FittedModel, manifest: Mapping, registry: DataFrame | None) -> DataFrame:
    """Batch or streaming requests -> one response row each (valid and invalid).

    One pass: the payload of an invalid request is blanked before it is typed, so the
    model never sees it, and its response columns are NULL. The routing table is static
    and broadcast, so no stateful operator is needed."""
    routed = inference.route_requests(requests, registry).withColumnRenamed("model_id", "route_model_id")
    expected = list(manifest["input_features"])
    ok = F.col("status") == "valid"
    v = inference.validate_requests(routed, expected).withColumn("payload", F.when(ok, F.col("payload")))
    rows = inference.normalize_requests(inference.entered_drivers(v), {c: manifest["feature_types"][c] for c in expected},
                                        keep=("request_id", "route_status", "status", "error", "entered_global_driver_fields"))
    scored = inference.response_rows(fm.score(rows), manifest["model_id"], manifest["clinical_status"])
    return scored.select(*RESPONSE_COLUMNS[:4], *[F.when(ok, F.col(c)).alias(c) for c in RESPONSE_COLUMNS[4:]])


def start_request_stream(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_dir: str,
                         fm: FittedModel, manifest: Mapping, registry: DataFrame | None,
                         available_now: bool = False, max_files_per_trigger: int = 100) -> StreamingQuery:
    """Start the scoring stream: parquet request files -> parquet responses."""
    stream = (spark.readStream.schema(REQUEST_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger)
              .parquet(source_dir))
    out = respond(stream, fm, manifest, registry)
    w = (out.writeStream.format("parquet").option("path", sink_dir)
         .option("checkpointLocation", checkpoint_dir).outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
