"""Adapters that derive the operator input tables from the driver's parquet tables.

No original hospital or encounter file ships with the project, so the inputs are
derived from the TPC-H-like tables with fixed rules (see FIXTURES.md). Every rule
is a plain DataFrame plan: scans prune to the needed columns, aggregation is
partial before each shuffle, and only provably tiny tables are broadcast.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import measure_code


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ----------------------------------------------------------------------------
# Hospital-condition records (raw text, as a CSV read with all-string schema)
# ----------------------------------------------------------------------------

def _returned(li_flag, li_supp, li_line):
    return (li_flag == "R") | ((li_flag == "A") & (li_supp % 4 == 0) & (li_line <= 4))


def hospital_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(supplier, measure index m) -> n rows, r 'readmissions', plus measure totals."""
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_linenumber", "l_returnflag")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    # Pre-aggregate lineitem to (supplier, part) before the join: a hot part or
    # supplier collapses to one row per pair ahead of the shuffle.
    pre = (li.where(F.col("l_suppkey").isNotNull()).groupBy("l_suppkey", "l_partkey")
           .agg(F.count(F.lit(1)).alias("n"),
                F.count_if(_returned(F.col("l_returnflag"), F.col("l_suppkey"), F.col("l_linenumber"))).alias("r")))
    m = F.col("p_size") % 6
    grp = (pre.join(part, pre.l_partkey == part.p_partkey)
           .groupBy(F.col("l_suppkey"), m.alias("m"))
           .agg(F.sum("n").alias("n"), F.sum("r").alias("r")))
    # six measure indexes at most: the totals table is bounded by construction
    totals = grp.groupBy("m").agg(F.sum("n").alias("mn"), F.sum("r").alias("mr"))
    return grp.join(F.broadcast(totals), "m")


def hospital_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = hospital_counts(spark, sf_dir)
    sup = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    nat = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    j = (g.join(sup, g.l_suppkey == sup.s_suppkey)
         .join(nat, F.col("s_nationkey") == F.col("n_nationkey")))
    sk, m, n, r, mn, mr = (F.col(c) for c in ("l_suppkey", "m", "n", "r", "mn", "mr"))
    # every tenth hospital reports four conditions only
    supp = ((sk * 7 + m * 11) % 23 < 6) | ((sk % 10 == 9) & (m >= 4))
    too_few = (sk * 13 + m * 5) % 17 < 4
    null_s = F.lit(None).cast("string")
    err = F.expr("(r * mn * 10000) div (n * mr)") / F.lit(10000.0)
    start = F.date_add(F.lit("2021-07-01").cast("date"), m.cast("int"))
    end = F.date_sub(F.lit("2024-06-30").cast("date"), m.cast("int"))
    # a few records are delivered twice
    copies = F.when((sk % 25 == 3) & (m == 2), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    # three states hold nine tenths of the hospitals, so that the volume rule for states is met
    state = (F.when(sk % 10 < 3, F.lit("CA")).when(sk % 10 < 6, F.lit("TX")).when(sk % 10 < 9, F.lit("NY"))
             .otherwise(F.col("n_name")))
    return j.withColumn("copy", F.explode(copies)).select(
        F.col("s_name").alias("Facility Name"),
        F.col("s_suppkey").cast("string").alias("Facility ID"),
        state.alias("State"),
        measure_code(m).alias("Measure Name"),
        F.when(supp, null_s).otherwise(n.cast("string")).alias("Number of Discharges"),
        F.when(supp, F.lit("5")).when(too_few, F.lit("1")).otherwise(null_s).alias("Footnote"),
        F.when(supp, null_s).otherwise(err.cast("string")).alias("Excess Readmission Ratio"),
        F.when(supp, null_s).otherwise((F.lit(100.0) * r / n).cast("string")).alias("Predicted Readmission Rate"),
        F.when(supp, null_s).otherwise((F.lit(100.0) * mr / mn).cast("string")).alias("Expected Readmission Rate"),
        F.when(supp, F.lit("N/A")).when(too_few, F.lit("Too Few to Report"))
         .otherwise(r.cast("string")).alias("Number of Readmissions"),
        F.date_format(start, "MM/dd/yyyy").alias("Start Date"),
        F.date_format(end, "MM/dd/yyyy").alias("End Date"),
    )


HOSPITAL_FIXTURE_SQL = """
hrrp_li AS (
  SELECT l.l_suppkey AS sk, p.p_size % 6 AS m, count(*) AS n,
         count(*) FILTER (WHERE l.l_returnflag = 'R'
             OR (l.l_returnflag = 'A' AND l.l_suppkey % 4 = 0 AND l.l_linenumber <= 4)) AS r
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
  GROUP BY 1, 2),
hrrp_mt AS (SELECT m, sum(n) AS mn, sum(r) AS mr FROM hrrp_li GROUP BY m),
hrrp_base AS (
  SELECT g.*, t.mn, t.mr, s.s_name, n.n_name,
         (g.sk * 7 + g.m * 11) % 23 < 6 OR (g.sk % 10 = 9 AND g.m >= 4) AS supp,
         (g.sk * 13 + g.m * 5) % 17 < 4 AS too_few
  FROM hrrp_li g JOIN hrrp_mt t USING (m)
  JOIN supplier s ON s.s_suppkey = g.sk
  JOIN nation n ON s.s_nationkey = n.n_nationkey),
hrrp AS (
  SELECT
    CAST(sk AS VARCHAR) AS facility_id,
    s_name AS facility_name,
    CASE WHEN sk % 10 < 3 THEN 'CA' WHEN sk % 10 < 6 THEN 'TX' WHEN sk % 10 < 9 THEN 'NY' ELSE n_name END AS state,
    CASE m WHEN 0 THEN 'READM-30-AMI-HRRP' WHEN 1 THEN 'READM-30-HF-HRRP'
           WHEN 2 THEN 'READM-30-COPD-HRRP' WHEN 3 THEN 'READM-30-PN-HRRP'
           WHEN 4 THEN 'READM-30-CABG-HRRP' WHEN 5 THEN 'READM-30-HIP-KNEE-HRRP' END AS measure_name,
    CASE m WHEN 0 THEN 'Acute Myocardial Infarction (AMI)' WHEN 1 THEN 'Heart Failure (HF)'
           WHEN 2 THEN 'COPD' WHEN 3 THEN 'Pneumonia'
           WHEN 4 THEN 'CABG' WHEN 5 THEN 'Hip/Knee Replacement' END AS condition,
    CASE WHEN supp THEN NULL ELSE CAST(n AS DOUBLE) END AS discharges,
    CASE WHEN supp THEN NULL WHEN too_few THEN 'Too Few to Report' ELSE CAST(r AS VARCHAR) END AS readmissions_raw,
    CASE WHEN supp OR too_few THEN NULL ELSE CAST(r AS DOUBLE) END AS readmissions,
    CASE WHEN supp THEN NULL ELSE ((r * mn * 10000) // (n * mr)) / 10000.0::DOUBLE END AS err,
    CASE WHEN supp THEN NULL ELSE 100.0::DOUBLE * r / n END AS predicted,
    CASE WHEN supp THEN NULL ELSE 100.0::DOUBLE * mr / mn END AS expected,
    CASE WHEN supp THEN '5' WHEN too_few THEN '1' ELSE NULL END AS footnote,
    CAST(DATE '2021-07-01' + CAST(m AS INTEGER) AS DATE) AS start_date,
    CAST(DATE '2024-06-30' - CAST(m AS INTEGER) AS DATE) AS end_date
  FROM hrrp_base, (VALUES (0), (1)) copies(copy) WHERE copy = 0 OR (sk % 25 = 3 AND m = 2))
"""


# ----------------------------------------------------------------------------
# Patient encounters
# ----------------------------------------------------------------------------

def encounters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One encounter per order; prior use from the customer's orders in the
    previous 365 days; label from the customer's next order."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    lines = li.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("l_quantity").alias("qty"),
        F.min("l_partkey").alias("min_part"), F.max("l_partkey").alias("max_part"))

    day = F.datediff(F.to_date("o_orderdate"), F.lit("1970-01-01").cast("date"))
    o = orders.withColumn("day", day)
    # Collapse to (customer, day) first: a customer with a huge share of all orders
    # still has at most one row per calendar day, so the per-customer window below
    # is bounded by the calendar, not by the data volume.
    per_day = o.groupBy("o_custkey", "day").agg(
        F.count(F.lit(1)).alias("cnt"),
        F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("cnt_urgent"),
        F.count_if(F.col("o_orderpriority") == "5-LOW").alias("cnt_low"),
        F.max("o_orderkey").alias("last_key"))
    w = Window.partitionBy("o_custkey").orderBy("day")
    hist = w.rangeBetween(-365, -1)
    per_day = per_day.select(
        "o_custkey", "day", "last_key",
        F.coalesce(F.sum("cnt").over(hist), F.lit(0)).alias("number_inpatient"),
        F.coalesce(F.sum("cnt_urgent").over(hist), F.lit(0)).alias("number_emergency"),
        F.coalesce(F.sum("cnt_low").over(hist), F.lit(0)).alias("number_outpatient"),
        F.lead("day").over(w).alias("next_day"))

    e = (o.join(per_day, ["o_custkey", "day"])
         .join(lines, o.o_orderkey == lines.l_orderkey, "left")
         .join(cust, F.col("o_custkey") == F.col("c_custkey")))
    k, ck = F.col("o_orderkey"), F.col("c_custkey")
    readm = (F.when(k < F.col("last_key"), F.lit("<30"))
             .when(F.col("next_day").isNull(), F.lit("NO"))
             .when(F.col("next_day") < F.col("day") + 30, F.lit("<30"))
             .otherwise(F.lit(">30")))
    no_lines = F.col("n_lines").isNull()
    a = (ck % 10) * 10
    part_1, part_2 = F.col("min_part") % 20, F.col("max_part") % 12
    return e.select(
        k.alias("encounter_id"),
        F.col("o_custkey").alias("patient_nbr"),
        readm.alias("readmitted"),
        F.concat(F.lit("["), a.cast("string"), F.lit("-"), (a + 10).cast("string"), F.lit(")")).alias("age"),
        F.when(ck % 97 == 0, F.lit("Unknown/Invalid"))
         .when(ck % 2 == 0, F.lit("Female")).otherwise(F.lit("Male")).alias("gender"),
        F.substring("o_orderpriority", 1, 1).cast("bigint").alias("admission_type_id"),
        (F.lit(1) + k % 7).cast("bigint").alias("discharge_disposition_id"),
        F.col("c_nationkey").cast("bigint").alias("admission_source_id"),
        (F.lit(1) + k % 14).cast("bigint").alias("time_in_hospital"),
        F.when(k % 5 == 0, F.lit("?")).when(k % 97 == 1, F.concat(F.lit("RARE-"), (k % 37).cast("string")))
         .otherwise(F.col("c_mktsegment")).alias("medical_specialty"),
        F.when(k % 11 != 0, F.coalesce(F.col("qty"), F.lit(0.0)).cast("bigint")).alias("num_lab_procedures"),
        F.coalesce(F.col("n_lines"), F.lit(0)).cast("bigint").alias("num_procedures"),
        (F.coalesce(F.col("n_lines"), F.lit(0)) * 3).cast("bigint").alias("num_medications"),
        F.col("number_outpatient").cast("bigint").alias("number_outpatient"),
        F.col("number_emergency").cast("bigint").alias("number_emergency"),
        F.col("number_inpatient").cast("bigint").alias("number_inpatient"),
        F.when(part_1 == 0, F.lit("428")).when(part_1 == 1, F.lit("250.4")).when(part_1 == 2, F.lit("401"))
         .otherwise(part_1.cast("string")).alias("diag_1"),
        F.when(no_lines | (F.col("max_part") % 9 == 0), F.lit("?"))
         .when(part_2 == 1, F.lit("414")).when(part_2 == 2, F.lit("486"))
         .otherwise(part_2.cast("string")).alias("diag_2"),
        F.when(no_lines | (F.col("min_part") % 6 == 0), F.lit("?"))
         .otherwise((F.col("min_part") % 15).cast("string")).alias("diag_3"),
        (F.lit(1) + k % 9).cast("bigint").alias("number_diagnoses"),
        F.when(k % 40 == 0, F.lit("[50-75)")).otherwise(F.lit("?")).alias("weight"),
    )


ENCOUNTER_FIXTURE_SQL = """
enc_lines AS (
  SELECT l_orderkey, count(*) AS n_lines, sum(l_quantity) AS qty,
         min(l_partkey) AS min_part, max(l_partkey) AS max_part
  FROM lineitem GROUP BY l_orderkey),
enc_o AS (
  SELECT o.*, CAST(CAST(o.o_orderdate AS DATE) - DATE '1970-01-01' AS BIGINT) AS day FROM orders o),
enc_w AS (
  SELECT o.*,
    lead(day) OVER (PARTITION BY o_custkey ORDER BY day, o_orderkey) AS next_day,
    count(*) OVER (PARTITION BY o_custkey ORDER BY day RANGE BETWEEN 365 PRECEDING AND 1 PRECEDING) AS n_in,
    count(*) FILTER (WHERE o_orderpriority = '1-URGENT') OVER (PARTITION BY o_custkey ORDER BY day
        RANGE BETWEEN 365 PRECEDING AND 1 PRECEDING) AS n_em,
    count(*) FILTER (WHERE o_orderpriority = '5-LOW') OVER (PARTITION BY o_custkey ORDER BY day
        RANGE BETWEEN 365 PRECEDING AND 1 PRECEDING) AS n_out
  FROM enc_o o),
enc AS (
  SELECT
    w.o_orderkey AS encounter_id,
    w.o_custkey AS patient_nbr,
    CASE WHEN w.next_day IS NULL THEN 'NO' WHEN w.next_day < w.day + 30 THEN '<30' ELSE '>30' END AS readmitted,
    '[' || CAST((c.c_custkey % 10) * 10 AS VARCHAR) || '-' || CAST((c.c_custkey % 10) * 10 + 10 AS VARCHAR) || ')' AS age,
    CASE WHEN c.c_custkey % 97 = 0 THEN NULL WHEN c.c_custkey % 2 = 0 THEN 'Female' ELSE 'Male' END AS gender,
    CAST(substr(w.o_orderpriority, 1, 1) AS BIGINT) AS admission_type_id,
    CAST(1 + w.o_orderkey % 7 AS BIGINT) AS discharge_disposition_id,
    CAST(c.c_nationkey AS BIGINT) AS admission_source_id,
    CAST(1 + w.o_orderkey % 14 AS BIGINT) AS time_in_hospital,
    CASE WHEN w.o_orderkey % 5 = 0 THEN NULL WHEN w.o_orderkey % 97 = 1 THEN 'RARE-' || CAST(w.o_orderkey % 37 AS VARCHAR)
         ELSE c.c_mktsegment END AS medical_specialty,
    CASE WHEN w.o_orderkey % 11 <> 0 THEN CAST(coalesce(l.qty, 0) AS BIGINT) END AS num_lab_procedures,
    CAST(coalesce(l.n_lines, 0) AS BIGINT) AS num_procedures,
    CAST(coalesce(l.n_lines, 0) * 3 AS BIGINT) AS num_medications,
    CAST(coalesce(w.n_out, 0) AS BIGINT) AS number_outpatient,
    CAST(coalesce(w.n_em, 0) AS BIGINT) AS number_emergency,
    CAST(coalesce(w.n_in, 0) AS BIGINT) AS number_inpatient,
    CASE l.min_part % 20 WHEN 0 THEN '428' WHEN 1 THEN '250.4' WHEN 2 THEN '401' ELSE CAST(l.min_part % 20 AS VARCHAR) END AS diag_1,
    CASE WHEN l.n_lines IS NULL OR l.max_part % 9 = 0 THEN NULL WHEN l.max_part % 12 = 1 THEN '414' WHEN l.max_part % 12 = 2 THEN '486'
         ELSE CAST(l.max_part % 12 AS VARCHAR) END AS diag_2,
    CASE WHEN l.n_lines IS NULL OR l.min_part % 6 = 0 THEN NULL ELSE CAST(l.min_part % 15 AS VARCHAR) END AS diag_3,
    CAST(1 + w.o_orderkey % 9 AS BIGINT) AS number_diagnoses,
    CASE WHEN w.o_orderkey % 40 = 0 THEN '[50-75)' ELSE NULL END AS weight
  FROM enc_w w
  LEFT JOIN enc_lines l ON l.l_orderkey = w.o_orderkey
  JOIN customer c ON c.c_custkey = w.o_custkey)
"""
