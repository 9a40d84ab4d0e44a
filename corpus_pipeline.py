"""Corpus pipeline: five stages over `documents`, each written as Parquet and read again.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of `documents`. Rejected documents go in the first two stages, line dedup
edits texts (n_chars follows the text) and drops documents of which it leaves no word,
near-dedup keeps the smallest doc_id of each group and one of equal rows, and the last
stage returns one row per packed piece. Documents that had no text before line dedup stay
there (quality rules reject them). Rows of one doc_id that differ are documents of their own.
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caresignal.llm import crf_quality, host_rules, hyperminhash, packing, window_dedup
from caresignal.llm.common import drop_repeated_rows, table
from caresignal.session import delete_path, scratch_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return host_rules.keep_documents(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return crf_quality.keep_documents(docs, crf_quality.train(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = window_dedup.remove_repeats(docs, counts=("__lines", "__removed"))
    size = F.when(F.col("__removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    emptied = (F.col("__removed") > 0) & (F.btrim("text", F.lit(host_rules.SPACE_CHARS)) == "")
    return out.filter(~F.coalesce(emptied, F.lit(False))).withColumn("n_chars", size).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_repeated_rows(hyperminhash.keep_one_per_group(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_rules", quality_rules), ("quality_classifier", quality_classifier), ("line_dedup", line_dedup),
          ("near_dedup", near_dedup), ("packing", pack)]

#: A trained classifier and a tokenizer have no SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each one's result is a table in the shared checkpoint folder, deleted once the next one is
    written. The last table is deleted when the process ends."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch_dir(spark, f"corpus-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete_path(spark, before)
        before = path
    return docs
