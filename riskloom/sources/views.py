"""Findings and advisories as views over the event and order tables, so that both engines see many rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    sev = F.when(F.col("value") >= 200, "CRITICAL").when(F.col("value") >= 100, "HIGH").when(F.col("value") >= 50, "MEDIUM").when(F.col("value") >= 10, "LOW").otherwise("INFO")
    kind = F.col("event_type")
    cls = F.when(kind == "error", "CODE_EXECUTION").when(kind == "purchase", "INJECTION").when(kind == "click", "XSS").when(kind == "signup", "AUTHENTICATION_BYPASS").otherwise("INFORMATION_DISCLOSURE")
    return e.select(
        F.col("event_id").alias("id"), "ts", sev.alias("severity"), cls.alias("vuln_class"),
        ((F.col("event_id") % 101) / F.lit(100.0)).alias("confidence"),
        ((F.col("event_id") % 10) / F.lit(20.0)).alias("fp"),
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("file_path"),
        (F.col("event_id") % 97).cast("int").alias("line_start"),
        kind.alias("tag"), kind.alias("title"),
    )


FINDINGS_SQL = """
    SELECT event_id AS id, ts,
           CASE WHEN value >= 200 THEN 'CRITICAL' WHEN value >= 100 THEN 'HIGH' WHEN value >= 50 THEN 'MEDIUM' WHEN value >= 10 THEN 'LOW' ELSE 'INFO' END AS severity,
           CASE event_type WHEN 'error' THEN 'CODE_EXECUTION' WHEN 'purchase' THEN 'INJECTION' WHEN 'click' THEN 'XSS' WHEN 'signup' THEN 'AUTHENTICATION_BYPASS' ELSE 'INFORMATION_DISCLOSURE' END AS vuln_class,
           (event_id % 101) / 100e0 AS confidence, (event_id % 10) / 20e0 AS fp,
           'user_' || user_id AS file_path, CAST(event_id % 97 AS INTEGER) AS line_start, event_type AS tag, event_type AS title
    FROM events
"""


def advisories(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    p = F.col("o_orderpriority")
    cwe = F.when(p == "1-URGENT", "CWE-94").when(p == "2-HIGH", "CWE-89").when(p == "3-MEDIUM", "CWE-79").when(p == "4-NOT SPECIFIED", "CWE-287").otherwise("CWE-200")
    return o.select(
        F.concat(F.lit("CVE-"), F.year("o_orderdate").cast("string"), F.lit("-"), F.lpad(F.col("o_orderkey").cast("string"), 7, "0")).alias("cve_id"),
        ((F.col("o_orderkey") % 101) / F.lit(10.0)).alias("cvss"),
        cwe.alias("cwe_id"), F.col("o_orderdate").alias("published"),
    )


ADVISORIES_SQL = """
    SELECT 'CVE-' || year(o_orderdate) || '-' || lpad(CAST(o_orderkey AS VARCHAR), 7, '0') AS cve_id, (o_orderkey % 101) / 10e0 AS cvss,
           CASE o_orderpriority WHEN '1-URGENT' THEN 'CWE-94' WHEN '2-HIGH' THEN 'CWE-89' WHEN '3-MEDIUM' THEN 'CWE-79' WHEN '4-NOT SPECIFIED' THEN 'CWE-287' ELSE 'CWE-200' END AS cwe_id,
           o_orderdate AS published
    FROM orders
"""
