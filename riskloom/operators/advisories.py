"""Advisories: parsing, search, statistics, trends, correlation with findings, enrichment, impact, monitoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom import model


def parse_ids(df: DataFrame, text: str) -> DataFrame:
    """One row for each CVE number in a text: cve_id, year, number."""
    ids = F.explode(F.regexp_extract_all(text, F.lit(r"CVE-(\d{4})-(\d+)"), F.lit(0)))
    d = df.select("*", ids.alias("cve_id"))
    return d.withColumn("year", F.split("cve_id", "-")[1].cast("int")).withColumn("number", F.split("cve_id", "-")[2].cast("long"))


def is_valid(col: Column) -> Column:
    return col.rlike(r"^CVE-\d{4}-\d{4,}$")


def search(cves: DataFrame, cwe: str | None = None, least: float = 0.0) -> DataFrame:
    d = cves.where(F.col("cvss") >= least)
    return d.where(F.col("cwe_id") == cwe) if cwe else d


def by_cwe(cves: DataFrame) -> DataFrame:
    return cves.groupBy("cwe_id").agg(F.count("*").alias("n"), F.avg("cvss").alias("avg_cvss"), F.max("cvss").alias("max_cvss"))


def yearly(cves: DataFrame, last_year: int, years: int = 5) -> DataFrame:
    """Years without advisories have a row of zeros."""
    all_years = cves.sparkSession.range(last_year - years + 1, last_year + 1).select(F.col("id").cast("int").alias("year"))
    g = cves.groupBy(F.year("published").alias("year")).agg(F.count("*").alias("n"), F.avg("cvss").alias("avg_cvss"), F.sum((F.col("cvss") >= 9).cast("int")).alias("n_critical"))
    return all_years.join(g, "year", "left").select("year", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("avg_cvss", F.lit(0.0)).alias("avg_cvss"), F.coalesce("n_critical", F.lit(0)).alias("n_critical"))


def top_of_cwe(cves: DataFrame, k: int = 5) -> DataFrame:
    """The k gravest of each CWE; a top-k that is bounded before it is joined."""
    w = Window.partitionBy("cwe_id").orderBy(F.desc("cvss"), "cve_id")
    return cves.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def correlate(findings: DataFrame, cves: DataFrame, k: int = 5) -> DataFrame:
    """Findings with the k gravest advisories of their CWE: (id, cve_id, cvss, place).

    As the k best depend on the CWE alone, they are taken before the join, so that no finding meets all advisories.
    """
    cwe = model.of_class(F.col("vuln_class"), 6, "CWE-20")
    return findings.select("id", cwe.alias("cwe_id")).join(top_of_cwe(cves, k), "cwe_id").select("id", "cve_id", "cvss", "place")


def real_world_risk(confidence: Column, avg_cvss: Column, exploit: Column) -> Column:
    r = F.when(avg_cvss.isNotNull(), F.lit(0.5) * confidence + F.lit(0.5) * avg_cvss / F.lit(10.0)).otherwise(confidence)
    r = F.when(exploit, F.least(r * F.lit(1.3), F.lit(1.0))).otherwise(r)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), r))


def enrich(findings: DataFrame, cves: DataFrame, least: float = 5.0, k: int = 5, exploited: DataFrame | None = None) -> DataFrame:
    """Adds the number and mean score of the k gravest advisories of at least ``least``, whether one of them is exploited, and the real-world risk.

    ``exploited`` has the cve_id of each advisory with a known exploit; without it none has.
    """
    best = top_of_cwe(cves.where(F.col("cvss") >= least), k)
    known = exploited.select("cve_id", F.lit(True).alias("known")).distinct() if exploited is not None else None
    best = best.join(known, "cve_id", "left") if known is not None else best.withColumn("known", F.lit(False))
    best = best.groupBy("cwe_id").agg(F.count("*").alias("n_cves"), F.sum("cvss").alias("s"), F.max(F.coalesce("known", F.lit(False))).alias("known"))
    d = findings.withColumn("cwe_id", model.of_class(F.col("vuln_class"), 6, "CWE-20")).join(best, "cwe_id", "left")
    avg, exploit = F.col("s") / F.col("n_cves"), F.coalesce("known", F.lit(False))
    return d.select("id", "cwe_id", F.coalesce("n_cves", F.lit(0)).alias("n_cves"), exploit.alias("exploit"), real_world_risk(F.col("confidence"), avg, exploit).alias("risk"))


def impact(findings: DataFrame, cves: DataFrame, k: int = 5) -> DataFrame:
    """One row: findings, different advisories among their best, greatest and mean score, level."""
    used = findings.select(model.of_class(F.col("vuln_class"), 6, "CWE-20").alias("cwe_id")).distinct()
    c = top_of_cwe(cves, k).join(used, "cwe_id").dropDuplicates(["cve_id"]).agg(F.count("*").alias("n_cves"), F.max("cvss").alias("max_cvss"), F.avg("cvss").alias("avg_cvss"))
    n = findings.agg(F.count("*").alias("n_findings"))
    top = F.col("max_cvss")
    level = F.when(top >= 9, "CRITICAL").when(top >= 7, "HIGH").when(top >= 4, "MEDIUM").otherwise("LOW")
    return n.crossJoin(c).select("n_findings", "n_cves", "max_cvss", "avg_cvss", level.alias("level"))  # one row each


def new_since(cves: DataFrame, watched: list[str], since: str) -> DataFrame:
    """Advisories of watched CWEs that were published after a time, each once."""
    return cves.where(F.col("cwe_id").isin(watched) & (F.col("published") > F.lit(since).cast("timestamp_ntz"))).dropDuplicates(["cve_id"])


def notable(cwe: Column) -> Column:
    """The notable advisories of a CWE; none for others."""
    return model.choose(cwe, model.NOTABLE, F.array().cast("array<string>"))


def keywords(cls: Column) -> Column:
    """The words by which advisories name a class; its own name where there are none."""
    return F.coalesce(model.choose(cls, model.KEYWORDS, None), F.array(cls))


def display(cve_id: Column, score: Column, severity: Column) -> Column:
    mark = model.choose(severity, {"CRITICAL": "🔴", "HIGH": "🟠", "MEDIUM": "🟡"}, "🟢")
    return F.concat(mark, F.lit(" "), cve_id, F.lit(" (CVSS: "), score.cast("string"), F.lit(")"))


def section_rows(cves: DataFrame) -> DataFrame:
    """Adds row, a line of a Markdown table; descriptions end after 50 characters."""
    short = F.when(F.char_length("description") > 50, F.concat(F.substring("description", 1, 50), F.lit("..."))).otherwise(F.col("description"))
    return cves.withColumn("row", F.concat(F.lit("| "), "cve_id", F.lit(" | "), F.col("cvss").cast("string"), F.lit(" | "), "severity", F.lit(" | "), short, F.lit(" |")))


def section(rows: list[str]) -> str:
    """A Markdown section of such rows."""
    return "\n".join(["| CVE ID | CVSS | Severity | Description |", "|--------|------|----------|-------------|", *rows]) if rows else "No related CVEs found."
