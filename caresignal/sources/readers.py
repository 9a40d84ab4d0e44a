"""Readers: hospital CSV (A1, A2), encounter CSV (A3, A4), JSON config.

CSV files are read with an all-string schema (no inference pass over the data);
typing happens in one projection afterwards so suppressed text is never lost."""
from __future__ import annotations

import re
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.constants import HRRP_COLUMNS, ID_COLUMNS, NUMERIC_FIELDS, TARGET_COLUMN
from ..operators.prepare import kpi_slice, prepare_encounters, prepare_hospital


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the Hadoop file system of the path (works for
    cluster file systems, not only local disks)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p))


def resolve_input(spark: SparkSession, candidates: Sequence[str]) -> str:
    """First existing candidate path, else FileNotFoundError (A2)."""
    for c in candidates:
        if path_exists(spark, c):
            return c
    raise FileNotFoundError(f"input not found; tried: {list(candidates)}")


def _header(spark: SparkSession, path: str | Sequence[str]) -> list[str]:
    # reading the header only: the schema of a one-line sample, no data pass
    return spark.read.option("header", True).option("inferSchema", False).option("escape", '"').csv(path).columns


#: Stands for a quoted run while lines are judged; a file that holds it itself is read whole.
_RUN = "\u0001"


def files_by_lines(spark: SparkSession, path: str | Sequence[str]) -> tuple[list[str], list[str]]:
    """Files whose lines are all whole rows, and files that may hold a line feed inside a cell.

    A file is proven plain if each of its lines is by itself a row of whole cells: cut out quoted runs, and no
    quote may be left and no run may touch anything but a comma, another run (a doubled quote) or the line's
    end. Then every line starts and ends outside quotes. The pass reads lines, in splits, and groups by file."""
    paths = [path] if isinstance(path, str) else list(path)
    rest = F.regexp_replace("value", '"[^"]*"', _RUN)
    opened = F.contains("value", F.lit(_RUN)) | F.contains(rest, F.lit('"')) | rest.rlike(f"[^,{_RUN}]{_RUN}|{_RUN}[^,{_RUN}]")
    by = (spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), opened.alias("opened"))
          .groupBy("file").agg(F.bool_or("opened").alias("opened")))
    files = by.orderBy("file").collect()  # a name a file, as Spark's own listing holds
    return [r["file"] for r in files if not r["opened"]], [r["file"] for r in files if r["opened"]]


def _as_path(file: str) -> str:
    """A file address of `_metadata` as a reader's path: decoded, and its glob characters escaped."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", unquote(file))


def read_text_csv(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str] | None = None,
                  multi_line: bool | None = None) -> DataFrame:
    """CSV as text columns. Quotes are doubled inside quoted cells.

    By default a pass over the lines finds the files whose cells may hold line feeds: only those are read whole, one
    task a file, and all others in splits. `multi_line` True reads every file whole, False none; neither takes the pass.
    Every file's header must name the columns in order, and a row with another number of cells stops the
    job (`columnPruning` off: the check needs whole rows)."""
    cols = list(columns) if columns else _header(spark, path)
    schema = T.StructType([T.StructField(c, T.StringType(), True) for c in cols])

    def read(files: str | Sequence[str], whole: bool) -> DataFrame:
        # nullValue is a token nobody writes: the missing-value tokens are applied later
        return (spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("enforceSchema", False)
                .option("escape", '"').option("multiLine", whole).option("columnPruning", False)
                .option("nullValue", "\u0000").option("emptyValue", "").csv(files))
    if multi_line is not None:
        return read(path, multi_line)
    plain, opened = files_by_lines(spark, path)
    if not plain or not opened:
        return read(path, bool(opened))
    return read([_as_path(f) for f in plain], False).unionAll(read([_as_path(f) for f in opened], True))


def hrrp_scan(spark: SparkSession, path: str | Sequence[str], states: Sequence[str] | None = None,
              conditions: Sequence[str] | None = None, facilities: Sequence[str] | None = None,
              fmt: str = "csv", multi_line: bool | None = None) -> DataFrame:
    """Hospital-condition file -> typed table (see `prepare_hospital`). Slicers
    are applied on the stored text columns before typing, so with Parquet they
    are pushed into the scan. `multi_line` as in `read_text_csv`."""
    if fmt == "csv":
        cols = _header(spark, path)
        raw = read_text_csv(spark, path, cols, multi_line)
    else:
        raw = spark.read.format(fmt).load(path)
        cols = raw.columns
    missing = [c for c in HRRP_COLUMNS if c not in cols]
    if missing:
        raise ValueError(f"hospital file lacks columns: {missing}")
    return prepare_hospital(kpi_slice(raw, states, conditions, facilities))


def encounter_scan(spark: SparkSession, path: str | Sequence[str],
                   numeric: Sequence[str] = NUMERIC_FIELDS, multi_line: bool | None = None) -> DataFrame:
    """Encounter CSV -> table with encounter null tokens, numeric features as
    double, ids as bigint. The target and patient columns must exist (A4). `multi_line`
    as in `read_text_csv`."""
    cols = _header(spark, path)
    if TARGET_COLUMN not in cols or "patient_nbr" not in cols:
        raise ValueError(f"encounter file lacks {TARGET_COLUMN} or patient_nbr")
    df = prepare_encounters(read_text_csv(spark, path, cols, multi_line), numeric=numeric)
    return df.select([F.trim(F.col(c)).try_cast("bigint").alias(c) if c in ID_COLUMNS else F.col(f"`{c}`")
                      for c in df.columns])


REGISTRY_SCHEMA = T.StructType([
    T.StructField("schema_version", T.StringType()),
    T.StructField("routing_policy", T.StringType()),
    T.StructField("models", T.ArrayType(T.StructType([
        T.StructField("id", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("task", T.StringType()),
        T.StructField("data_source", T.StringType()),
        T.StructField("unit_of_analysis", T.StringType()),
        T.StructField("patient_probability_allowed", T.BooleanType()),
        T.StructField("unlock_rule", T.StringType()),
    ]))),
])


def registry_scan(spark: SparkSession, path: str) -> DataFrame:
    """Model registry document -> one row per model with its position."""
    doc = spark.read.schema(REGISTRY_SCHEMA).option("multiLine", True).json(path)
    return doc.select(F.posexplode("models").alias("position", "m")).select("position", "m.*")
