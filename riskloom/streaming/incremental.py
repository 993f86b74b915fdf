"""Incremental operators on streams; the checkpoint stands for the time of the last look."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators import matching, risk
from riskloom.sources.code import lines


def new_advisories(stream: DataFrame, watched: list[str], late: str = "30 days") -> DataFrame:
    """Advisories of watched CWEs, each once, as they come; state goes after ``late``."""
    return stream.where(F.col("cwe_id").isin(watched)).withWatermark("published", late).dropDuplicatesWithinWatermark(["cve_id"])


def match_files(stream: DataFrame) -> DataFrame:
    """Rule matches of (path, language, content) files as they come; needs no state."""
    return matching.match(lines(stream)).select("path", "line_no", "pattern", "matched", "confidence", "fp_reason", "score")


def risk_history(findings: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Greatest and mean risk of findings by time window (findings have ts, severity, vuln_class, confidence, fp)."""
    r = risk.risk(F.col("severity"), F.col("vuln_class"), F.col("confidence"), F.col("fp"))
    d = findings.withColumn("risk", r).withWatermark("ts", late).groupBy(F.window("ts", width))
    return d.agg(F.max("risk").alias("top"), F.avg("risk").alias("mean"), F.count("*").alias("n"))
