"""From sources to findings and reports: folders, files, pieces of code."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom import model, rules
from riskloom.functions.files import exists
from riskloom.operators import report, scan, trees
from riskloom.sources import code

#: folders that hold no code of a project's own
SKIPPED = [".git", "node_modules", "vendor", "__pycache__"]


def scan_folder(spark: SparkSession, folder: str, exclude: list[str] = SKIPPED, detector: trees.Forest | None = None) -> DataFrame:
    """Findings of all files of known extensions below a folder, with what a report needs; see ``findings_of``."""
    skipped = [f"*/{x}/*" for x in exclude]
    files = code.read_folder(spark, folder, include=[f"*{e}" for e in rules.EXTENSIONS], exclude=skipped)
    return findings_of(files, detector)


def analyze(spark: SparkSession, source: str, language: str | None = None, detector: trees.Forest | None = None) -> DataFrame:
    """Findings of a folder, a file, or, where nothing is at such a path, of a piece of code, whose language is guessed if it isn't named."""
    if source.strip() and "\n" not in source and _is_path(spark, source):
        return scan_folder(spark, source, detector=detector)
    d = spark.createDataFrame([("code", source)], "path string, content string")
    named = F.lit(language) if language else code.guessed_language(F.col("content"))
    return findings_of(d.select("path", named.alias("language"), "content"), detector)


def _is_path(spark: SparkSession, source: str) -> bool:
    try:
        return exists(source, spark)
    except Py4JJavaError:  # no path at all
        return False


def scan_code(spark: SparkSession, text: str, language: str, name: str = "code") -> DataFrame:
    return findings_of(spark.createDataFrame([(name, language, text)], "path string, language string, content string"))


def findings_of(files: DataFrame, detector: trees.Forest | None = None) -> DataFrame:
    """id, severity, vuln_class, confidence, file_path, line_start, title, pass, cwe_id, code_snippet of a scan.

    ``detector`` is a trained one of unusual files (``scan.train_detector``, ``trees.load``); without it there is no anomaly pass.
    """
    found = scan.scan(files, detector)
    d = found.join(files.select(F.col("path").alias("file_path"), "content"), "file_path")
    title = F.when(F.col("pass") == "anomaly", "Anomalous code pattern detected").otherwise(F.initcap(F.replace(F.col("vuln_class"), F.lit("_"), F.lit(" "))))
    name = F.concat_ws(":", "file_path", F.col("line_start").cast("string"), "vuln_class")
    return d.select(scan.uuid5(name).alias("id"), "severity", "vuln_class", "confidence", "file_path", "line_start", title.alias("title"), "pass", model.of_class(F.col("vuln_class"), 6, "CWE-20").alias("cwe_id"), scan.snippet(F.col("content"), F.col("line_start")).alias("code_snippet"))


def report_folder(spark: SparkSession, folder: str, format: str, path: str, when: str) -> None:
    """Scan a folder and write its report."""
    report.write_report(scan_folder(spark, folder), format, folder, when, path)
