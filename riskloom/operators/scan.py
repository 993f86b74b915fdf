"""The scan: all passes over files as one table of findings; null dereferences, evidence, snippets, ids, advisory JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import model, rules
from riskloom.functions.lineage import cut
from riskloom.functions.text import by_language, java
from riskloom.operators import features, flow, matching, risk, trees, vectors
from riskloom.operators.ml import rounded
from riskloom.sources import code


def null_derefs(files: DataFrame) -> DataFrame:
    """(path, assign_line, line_no, var): a line that takes a member of a variable set to null before, or on it, unguarded.

    A guard is a test against null on the line or the three before. Each assignment counts.
    """
    d = files.where(F.col("language").isin(list(rules.NULLS))).select("path", "language", F.split("content", "\n", -1).alias("ls"))
    before = lambda i: F.array_join(F.slice("ls", F.greatest(i - 2, F.lit(1)), F.least(i + 1, F.lit(4))), "\n")
    d = d.select("path", "language", F.explode(F.transform("ls", lambda x, i: F.struct((i + 1).alias("line_no"), x.alias("text"), before(i).alias("before")))).alias("l")).select("path", "language", "l.*")
    names = by_language("language", rules.NULLS, lambda r: F.regexp_extract_all("text", F.lit(java(r)), F.lit(1)), None)
    nulls = d.select("path", F.col("line_no").alias("assign_line"), F.explode(names).alias("var"))
    uses = d.where(F.contains("text", F.lit(".")) | F.contains("text", F.lit("->"))).join(nulls, "path").where("line_no >= assign_line")
    uses = uses.where(F.contains("text", F.concat("var", F.lit("."))) | F.contains("text", F.concat("var", F.lit("->"))))
    guard = F.concat(F.lit(r"if\s*\(?\s*"), "var", F.lit(r"\s*(?:!=|!==)\s*(?:NULL|nullptr|null|None)"))
    return uses.where(~F.regexp_like("before", guard)).select("path", "assign_line", "line_no", "var")


def evidence(files: DataFrame) -> DataFrame:
    """(path, name, line_no): the first line that names each dangerous function of a file."""
    ls = F.split("content", "\n", -1)
    d = files.select("path", ls.alias("ls"), F.explode(features.dangerous("content", "language")).alias("name"))
    return d.select("path", "name", F.array_position(F.transform("ls", lambda x: F.contains(x, F.col("name"))), F.lit(True)).cast("int").alias("line_no"))


def uuid5(name: Column) -> Column:
    """The version 5 id of a text in the DNS namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit("6ba7b8109dad11d180b400c04fd430c8")), F.encode(name, "UTF-8")))
    variant = F.substr(F.lit("89ab"), F.conv(F.substr(h, F.lit(17), F.lit(1)), 16, 10).cast("int") % 4 + 1, F.lit(1))
    part = lambda a, n: F.substr(h, F.lit(a), F.lit(n))
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def snippet(content: Column, line: Column, around: int = 3) -> Column:
    """The lines around one, numbered, with an arrow at it."""
    ls = F.split(content, "\n", -1)
    first = F.greatest(line - around, F.lit(1))
    part = F.slice(ls, first, F.least(line + around, F.size(ls)) - first + 1)
    return F.array_join(F.transform(part, lambda x, i: F.format_string("%s%4d │ %s", F.when(first + i == line, "→ ").otherwise("  "), first + i, x)), "\n")


def _severity(score: Column) -> Column:
    return F.when(score >= 0.9, "CRITICAL").when(score >= 0.7, "HIGH").when(score >= 0.5, "MEDIUM").otherwise("LOW")


def file_vectors(files: DataFrame) -> DataFrame:
    """(vec_id, embedding): the path and the 160 features of each file, by millionths, as detectors read them."""
    return vectors.feature_vectors(files).select(F.col("path").alias("vec_id"), F.transform("x", rounded).alias("embedding"))


def train_detector(files: DataFrame, contamination: float = 0.1) -> trees.Forest:
    """A detector of unusual files, learned from files that count as usual but for the share ``contamination``."""
    return trees.fit_detector(cut(file_vectors(files)), contamination)


def scan(files: DataFrame, detector: trees.Forest | None = None, least: float = 0.3, most: int = 50) -> DataFrame:
    """Findings of all passes: file_path, line_start, vuln_class, severity, confidence (by millionths), pass.

    Passes in this order: dangerous functions and complexity, semantics, data flow, taint, rules, scoring model, and the
    anomaly pass if there is a trained detector. Then at least ``least`` confident ones, the ``most`` gravest of a file, and
    of those the first of each line and class.
    """
    lines = code.texts(files)
    feats = cut(features.features(files))

    def rows(d, name, line, cls, severity, confidence):
        lit = lambda x: x if isinstance(x, Column) else F.lit(x)
        return d.select(F.col("path").alias("file_path"), lit(line).cast("int").alias("line_start"), lit(cls).alias("vuln_class"), lit(severity).alias("severity"), rounded(lit(confidence).cast("double")).alias("confidence"), F.lit(name).alias("pass"))

    dangerous = files.select("path", F.explode(features.dangerous("content", "language")).alias("name"))
    out = rows(dangerous, "static", 1, "INJECTION", "HIGH", 0.7)
    out = out.union(rows(feats.where("complexity > 20"), "static", 1, "INFORMATION_DISCLOSURE", "LOW", 0.5))
    out = out.union(rows(flow.unsafe_casts(lines), "semantic", F.col("line_no"), "TYPE_CONFUSION", "MEDIUM", 0.5))
    out = out.union(rows(flow.resource_leaks(files), "semantic", 1, "DENIAL_OF_SERVICE", "MEDIUM", 0.6))
    out = out.union(rows(null_derefs(files), "semantic", F.col("line_no"), "DENIAL_OF_SERVICE", "HIGH", 0.7))
    out = out.union(rows(flow.privilege_lines(lines), "semantic", F.col("line_no"), "PRIVILEGE_ESCALATION", "MEDIUM", 0.6))
    out = out.union(rows(flow.tainted_paths(lines), "dataflow", 1, "INJECTION", "HIGH", 0.8))
    tainted = flow.propagate(lines)
    paths = flow.exploitable(flow.taint_sinks(lines, tainted), tainted)
    grave = F.when(F.col("confidence") >= 0.8, "CRITICAL").when(F.col("confidence") >= 0.6, "HIGH").when(F.col("confidence") >= 0.4, "MEDIUM").otherwise("LOW")
    out = out.union(rows(paths, "taint", F.col("line_no"), F.col("vuln_class"), grave, F.col("confidence")))
    severity = model.choose(F.col("pattern"), {p.name: p.severity for p in rules.PATTERNS}, 0.5)
    out = out.union(rows(matching.match(code.lines(files)).where("fp_reason IS NULL"), "rules", F.col("line_no"), F.col("vuln_class"), _severity(severity), F.col("confidence")))
    scored = features.predict(feats, 0.6)
    out = out.union(rows(scored, "model", 1, F.col("vuln_class"), F.when(F.col("prob") >= 0.9, "CRITICAL").when(F.col("prob") >= 0.8, "HIGH").when(F.col("prob") >= 0.7, "MEDIUM").otherwise("LOW"), F.col("prob")))
    if detector is not None and detector.dim:
        odd = trees.detect(file_vectors(files), detector).where("is_anomaly").withColumnRenamed("vec_id", "path")
        out = out.union(rows(odd, "anomaly", 1, "CODE_EXECUTION", F.when(F.col("score") >= 0.8, "HIGH").otherwise("MEDIUM"), F.col("score")))
    out = out.withColumn("id", F.concat_ws(":", "pass", "vuln_class", F.col("line_start").cast("string")))
    return risk.capped(out, most, least).select("file_path", "line_start", "vuln_class", "severity", "confidence", "pass")


ADVISORY_JSON = "struct<vulnerabilities:array<struct<cve:struct<id:string,descriptions:array<struct<lang:string,value:string>>,metrics:struct<cvssMetricV31:array<struct<cvssData:struct<baseScore:double,vectorString:string,baseSeverity:string>>>,cvssMetricV30:array<struct<cvssData:struct<baseScore:double,vectorString:string,baseSeverity:string>>>>,weaknesses:array<struct<description:array<struct<value:string>>>>,references:array<struct<url:string>>,configurations:array<struct<nodes:array<struct<cpeMatch:array<struct<criteria:string>>>>>>,published:string,lastModified:string>>>>"


def parse_advisories(df: DataFrame, col: str) -> DataFrame:
    """cve_id, description (the first English one), score, vector and severity (of version 3.1, else 3.0), cwes, urls, products, published, modified of JSON answers."""
    d = df.select(F.explode(F.from_json(F.col(col), ADVISORY_JSON)["vulnerabilities"]).alias("v")).select("v.cve.*")
    english = F.get(F.filter("descriptions", lambda x: x["lang"] == "en"), F.lit(0))["value"]
    metric = F.coalesce(F.get(F.col("metrics.cvssMetricV31"), F.lit(0))["cvssData"], F.get(F.col("metrics.cvssMetricV30"), F.lit(0))["cvssData"])
    cwes = F.filter(F.flatten(F.transform("weaknesses", lambda w: F.transform(w["description"], lambda x: x["value"]))), lambda c: F.startswith(c, F.lit("CWE-")))
    none = F.array().cast("array<string>")
    nodes = F.flatten(F.transform("configurations", lambda c: F.coalesce(F.flatten(F.transform(c["nodes"], lambda n: F.transform(n["cpeMatch"], lambda m: m["criteria"]))), none)))
    second = lambda c: F.substr(c, F.lit(1), F.lit(19))
    return d.select(
        F.col("id").alias("cve_id"), F.coalesce(english, F.lit("")).alias("description"), F.coalesce(metric["baseScore"], F.lit(0.0)).alias("score"), metric["vectorString"].alias("vector"), metric["baseSeverity"].alias("severity"),
        F.array_join(cwes, ",").alias("cwes"), F.array_join(F.transform("references", lambda r: r["url"]), ",").alias("urls"), F.coalesce(nodes, none).alias("products"), second("published").alias("published"), second("lastModified").alias("modified"),
    )
