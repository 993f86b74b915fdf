"""Report rows and documents: SARIF, JSON, Markdown, HTML."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import model


def escape_html(col: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        col = F.replace(col, F.lit(a), F.lit(b))
    return col


def sarif(findings: DataFrame) -> DataFrame:
    """The flat fields of SARIF results."""
    level = F.when(F.col("severity").isin("CRITICAL", "HIGH"), "error").when(F.col("severity") == "MEDIUM", "warning").otherwise("note")
    return findings.withColumns({"rule_id": F.col("vuln_class"), "level": level, "uri": F.col("file_path"), "line_hash": F.sha2(F.concat("file_path", F.col("line_start").cast("string")), 256)})


def rules(findings: DataFrame) -> DataFrame:
    """(vuln_class, level, cwe_id): a rule for each class that findings have."""
    c = F.col("vuln_class")
    level = F.when(c.isin(model.SARIF_ERROR), "error").when(c.isin(model.SARIF_WARNING), "warning").otherwise("note")
    return findings.where(c.isNotNull()).select("vuln_class").distinct().select("vuln_class", level.alias("level"), model.of_class(c, 6, "CWE-20").alias("cwe_id"))


def markdown_counts(findings: DataFrame) -> DataFrame:
    g = findings.groupBy("severity", "vuln_class").agg(F.count("*").alias("n"))
    return g.withColumn("row", F.concat(F.lit("| "), "severity", F.lit(" | "), "vuln_class", F.lit(" | "), F.col("n").cast("string"), F.lit(" |")))


def write_json_lines(findings: DataFrame, path: str) -> None:
    """Findings as JSON objects with a nested location; written by the executors, however many."""
    loc = F.struct(F.col("file_path").alias("file"), F.col("line_start").alias("line"))
    findings.select("id", "severity", "vuln_class", "confidence", loc.alias("location")).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_sarif_results(findings: DataFrame, path: str) -> None:
    """SARIF result objects, one for each line."""
    s = sarif(findings)
    place = F.array(F.struct(F.struct(F.struct(F.col("uri").alias("uri")).alias("artifactLocation"), F.struct(F.col("line_start").alias("startLine")).alias("region")).alias("physicalLocation")))
    s.select(F.col("rule_id").alias("ruleId"), "level", F.struct(F.col("title").alias("text")).alias("message"), place.alias("locations"), F.struct(F.col("line_hash").alias("primaryLocationLineHash")).alias("partialFingerprints")).write.mode("overwrite").json(path)


# --- whole reports ---------------------------------------------------------------------------------------------------

MARKS = {"CRITICAL": "🔴", "HIGH": "🟠", "MEDIUM": "🟡", "LOW": "🟢", "INFO": "🔵"}
FORMATS = ("html", "json", "sarif", "markdown", "md")


def described(findings: DataFrame) -> DataFrame:
    """Adds cwe_id and remediation by class, and percent, the confidence as a whole number."""
    c = F.col("vuln_class")
    return findings.withColumns({"cwe_id": model.of_class(c, 6, "CWE-20"), "remediation": F.array_join(model.choose(c, {k: v for k, v in model.REMEDIATION.items() if k != "*"}, model.REMEDIATION["*"]), "; "), "percent": F.round(F.col("confidence") * 100).cast("int").cast("string")})


def _text(*parts) -> Column:
    """Parts put together; a null is nothing."""
    return F.concat(*[F.coalesce(p, F.lit("")) if isinstance(p, Column) else F.lit(p) for p in parts])


def _json(*fields: Column) -> Column:
    """A JSON object of the fields, nulls as null."""
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def rendered(findings: DataFrame) -> DataFrame:
    """Described findings with json, markdown and html, a finding's part of each report."""
    c = F.col
    at = _text(c("file_path"), ":", c("line_start").cast("string"))
    mark = model.choose(c("severity"), MARKS, "🔵")
    place = F.struct(c("file_path").alias("file"), "line_start").alias("location")
    json_ = _json(c("id").cast("string").alias("id"), c("vuln_class"), c("severity"), c("confidence"), c("title"), place, c("cwe_id"), c("remediation"))
    markdown = _text("### ", mark, " ", c("title"), "\n\n**Severity:** ", c("severity"), "  \n**Vulnerability Type:** ", c("vuln_class"), "  \n**Location:** `", at, "`  \n**Confidence:** ", c("percent"), "%  \n**CWE:** ", c("cwe_id"), "\n\n", c("remediation"), "\n")
    html = _text('<article class="', F.lower("severity"), '"><h3>', escape_html(c("title")), "</h3><p>", c("severity"), " | ", escape_html(at), " | ", c("vuln_class"), " | ", c("cwe_id"), " | ", c("percent"), "%</p><p>", escape_html(c("remediation")), "</p></article>")
    return findings.withColumns({"json": json_, "markdown": markdown, "html": html})


def _ordered(findings: DataFrame) -> DataFrame:
    """Gravest and surest first."""
    return findings.withColumn("rank", F.struct((-model.severity_rank(F.col("severity"))).alias("s"), (-F.col("confidence")).alias("c"), F.col("id").alias("i")))


def report(findings: DataFrame, format: str, target: str, when: str) -> DataFrame:
    """(place, rank, value): the lines of a report in order, for ``write_report`` or a reader of one's own.

    Findings have id, severity, vuln_class, confidence, file_path, line_start and title. Only counts by severity and class come to the driver.
    """
    if format not in FORMATS:
        raise ValueError(f"unsupported format: {format}")
    n = {s[0]: 0 for s in model.SEVERITIES} | {r.severity: r.n for r in findings.groupBy("severity").agg(F.count("*").alias("n")).collect()}
    files = findings.select(F.count_distinct("file_path").alias("n")).first().n
    d = _ordered(rendered(described(findings)))
    total = sum(n.values())
    listed = False
    if format == "json":
        head = json.dumps({"target": target, "timestamp": when, "statistics": {"files": files, "total_findings": total, "findings_by_severity": {str(k): v for k, v in n.items()}}}, ensure_ascii=False)
        head, body, tail, listed = head[:-1] + ', "findings":[', F.col("json"), "]}", True
    elif format == "sarif":
        d = sarif(d)
        place = F.array(F.struct(F.struct(F.struct(F.col("uri").alias("uri")).alias("artifactLocation"), F.struct(F.col("line_start").alias("startLine")).alias("region")).alias("physicalLocation")))
        body = _json(F.col("rule_id").alias("ruleId"), F.col("level"), F.struct(F.col("title").alias("text")).alias("message"), place.alias("locations"), F.struct(F.col("line_hash").alias("primaryLocationLineHash")).alias("partialFingerprints"))
        named = [{"id": c[0]} for c in model.CLASSES]
        head, tail, listed = json.dumps({"version": "2.1.0", "runs": [{"tool": {"driver": {"name": "riskloom", "rules": named}}}]})[:-3] + ', "results":[', "]}]}", True
    elif format == "html":
        cells = "".join(f"<li>{k}: {v}</li>" for k, v in n.items())
        safe = target.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
        head, body, tail = f"<!DOCTYPE html><html><head><meta charset=\"utf-8\"><title>Scan of {safe}</title></head><body><h1>Scan of {safe}</h1><p>{when}, {files} files</p><ul>{cells}</ul><h2>Findings ({total})</h2>", F.col("html"), "</body></html>"
    else:
        rows = "\n".join(f"| {MARKS.get(k, '')} {k} | {v} |" for k, v in n.items())
        head, body, tail = f"# Scan of `{target}`\n\n{when}, {files} files, {total} findings\n\n| Severity | Count |\n|----------|-------|\n{rows}\n\n## Findings\n", F.col("markdown"), "Findings should be reviewed; some may be false."
    ends = findings.sparkSession.createDataFrame([(0, head), (3, tail)], "place int, value string")
    mine = d.select(F.lit(1).alias("place"), "rank", body.alias("value"))
    if listed:
        # equal lines are counted and told apart again, so that exactly one line, the first, has no comma
        mine = mine.groupBy("place", "rank", "value").agg(F.count("*").alias("n"))
        first = mine.agg(F.min(F.struct("rank", "value")).alias("first"))  # one row
        mine = mine.crossJoin(F.broadcast(first)).select("place", "rank", "value", F.struct("rank", "value").eqNullSafe(F.col("first")).alias("leads"), F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("i"))
        order = F.when(F.col("leads") & (F.col("i") == 1), 0).otherwise(1)
        mine = mine.select((F.lit(1) + order).alias("place"), "rank", F.concat(F.when(order == 0, "").otherwise(","), "value").alias("value"))
    return mine.unionByName(ends.withColumn("rank", F.lit(None).cast(mine.schema["rank"].dataType)))


def write_report(findings: DataFrame, format: str, target: str, when: str, path: str) -> None:
    """Write a report as text parts that, in order of their names, are one document; executors write them."""
    report(findings, format, target, when).orderBy("place", "rank").select("value").write.mode("overwrite").text(path)
